"""Gray PNG files as labels, in numpy: small files come by the hundred thousand, and an image library's set-up outweighs them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_START = b"\x89PNG\r\n\x1a\n"
#: First column and row, and their steps, of the passes of an interlaced picture.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bytes (height, width, bytes of a pixel) behind filtered ones; kinds: the filter of each row."""
    if not kinds.any():
        return rows
    h, w, n = rows.shape
    if kinds.max() <= 2:
        out = rows.copy()
        for y in np.flatnonzero(kinds):
            if kinds[y] == 1:
                out[y] = np.cumsum(rows[y], axis=0, dtype=np.uint8)
            elif y:
                out[y] += out[y - 1]
        return out
    framed = np.zeros((h + 1, w + 1, n), np.int16)  # a pixel needs those left of it and above: all of one diagonal are done at once
    framed[1:, 1:] = rows
    flat, kind = framed.reshape(-1, n), kinds[:, None]
    for t in range(h + w - 1):
        top, end = max(0, t - w + 1), min(h - 1, t)
        at = (top + 1) * (w + 1) + t - top + 1
        take = lambda back: flat[at - back : at - back + (end - top) * w + 1 : w]  # noqa: B023, E731
        a, b, c, k = take(1), take(w + 1), take(w + 2), kind[top : end + 1]
        to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        paeth = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        here = take(0)
        here[:] = (here + np.where(k == 4, paeth, np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))) & 255
    return framed[1:, 1:].astype(np.uint8)


def gray(data: bytes) -> tuple[int, int, bytes] | None:
    """(height, width, labels, a byte for each pixel in row order) of a gray PNG of 8 bits, or of the lower 8 of 16, its alpha left out;
    null for any other file."""
    if data[:8] != _START or data[12:16] != b"IHDR" or len(data) < 33:
        return None
    width, height, depth, kind, _, _, laced = struct.unpack_from(">IIBBBBB", data, 16)
    if not width or not height or depth not in (8, 16) or kind not in (0, 4):
        return None
    packed, at = [], 33
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    n = depth // 8 * (1 if kind == 0 else 2)
    passes = [(x, y, dx, dy, -(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in (_PASSES if laced else ((0, 0, 1, 1),)) if y < height and x < width]
    need = sum(h * (1 + w * n) for *_, h, w in passes)
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), need), np.uint8)
    except zlib.error:
        return None
    if raw.size < need:
        return None
    out, at = np.empty((height, width), np.uint8), 0
    for x, y, dx, dy, h, w in passes:
        part = raw[at : at + h * (1 + w * n)].reshape(h, 1 + w * n)
        at += part.size
        if part[:, 0].max() > 4:
            return None
        out[y::dy, x::dx] = unfiltered(part[:, 0], part[:, 1:].reshape(h, w, n))[:, :, depth // 8 - 1]
    return height, width, out.tobytes()
