"""Vector codes of a byte for each part, their codebooks fitted by Lloyd's rounds with Elkan's bounds.

The state of a round is a table: for each part of a vector its entry, an upper bound of the distance to it and a lower bound of the
distance to every entry of the codebook. Between rounds, bounds move by as much as the entries did. An entry is passed over only
if a bound puts it strictly farther than the assigned one; what is left is compared in integers, so ties are exact.
Codebooks are a bounded table (entries x components); the sums that move them are grouped aggregates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, dealt_join, materialise

SCALE = 256
#: Integers beyond this are held at it: squared distances of some hundred components then fit a long.
LIMIT = 1 << 27
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
_SLICE = 2048
_STATE = "vec_id long, label string, no_label boolean, ints binary, entry binary, upper binary, lower binary"


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def assign(x: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
    """The nearest entry of book (k, w) to each row of x (n, w), ties to the lower index. entry, upper (n) and lower (n, k) hold
    bounds of true distances, and are made tighter in place; upper must bound the distance to entry."""
    half = np.sqrt(_squares(book[:, None], book[None])) * (_DOWN / 2)
    np.fill_diagonal(half, np.inf)
    near = (lower <= upper[:, None]) & (half[entry] <= upper[:, None])
    near[np.arange(len(x)), entry] = False
    rows = np.flatnonzero(near.any(axis=1))  # the others' entries are strictly nearest
    if not len(rows):
        return
    x, e, low = x[rows], entry[rows], lower[rows]
    exact = _squares(x, book[e])
    up = np.sqrt(exact) * _UP
    low[np.arange(len(rows)), e] = np.sqrt(exact) * _DOWN
    for j in range(len(book)):
        at = np.flatnonzero((e != j) & (low[:, j] <= up) & (half[e, j] <= up))
        if not len(at):
            continue
        d = _squares(x[at], book[j])
        low[at, j] = np.sqrt(d) * _DOWN
        closer = (d < exact[at]) | ((d == exact[at]) & (j < e[at]))
        at, d = at[closer], d[closer]
        e[at], exact[at], up[at] = j, d, np.sqrt(d) * _UP
    entry[rows], upper[rows], lower[rows] = e, up, low


def _packed(entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> list[pa.Array]:
    """Bounds as bytes, rounded outward: upper to 32 bits, lower to 16."""
    top = (upper * (1 + 1e-6)).astype("<f4")
    low = np.clip(lower * (1 - 1e-3) - 1e-4, 0, 60_000).astype("<f2")
    return [pa.array([r.tobytes() for r in a], pa.binary()) for a in (entry.astype("u1"), top, low)]


def _unpacked(part: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(part.num_rows, -1)


def _first_round(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, no_label, vec) -> the first state: nothing is known, so lower bounds are zero."""
    parts, k, width = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            some = batch.slice(at, _SLICE)
            x = integers(some.column(3).flatten().to_numpy(zero_copy_only=False)).reshape(-1, parts, width)
            entry, lower = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts, k))
            upper = np.sqrt(_squares(x, books[None, :, 0])) * _UP
            for p in range(parts):
                assign(x[:, p], books[p], entry[:, p], upper[:, p], lower[:, p])
            ints = pa.array([r.tobytes() for r in x.reshape(len(x), -1).astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[:3], ints, *_packed(entry, upper, lower.reshape(len(x), -1))], _STATE.replace(",", "").split()[::2])


def _moved(part: pa.RecordBatch, before: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers and entries of a state before the codebooks moved, with what is nearest now, and bounds of it."""
    parts, k, width = books.shape
    x = _unpacked(part, "ints", "<i4").astype(np.int64).reshape(-1, parts, width)
    entry = _unpacked(part, "entry", "u1").astype(np.int64)
    step = np.sqrt(_squares(before, books)) * _UP
    upper = (_unpacked(part, "upper", "<f4").astype(np.float64) + step[np.arange(parts), entry]) * _UP
    lower = _unpacked(part, "lower", "<f2").astype(np.float64).reshape(-1, parts, k)
    lower = np.maximum(0, (lower - step) - 1e-9 * lower)
    for p in range(parts):
        assign(x[:, p], books[p], entry[:, p], upper[:, p], lower[:, p])
    return x, entry, upper, lower


def _next_round(batches: Iterator[pa.RecordBatch], before: np.ndarray, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            some = batch.slice(at, _SLICE)
            _, entry, upper, lower = _moved(some, before, books)
            yield pa.RecordBatch.from_arrays([*some.columns[:4], *_packed(entry, upper, lower.reshape(len(entry), -1))], some.schema.names)


def _codes(batches: Iterator[pa.RecordBatch], before: np.ndarray, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The last assignment, as (vec_id, label, no_label, code, error)."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            some = batch.slice(at, _SLICE)
            x, entry, _, _ = _moved(some, before, books)
            error = _squares(x, books[np.arange(len(books)), entry]).sum(axis=1)
            codes = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(codes), pa.array(error)], ["vec_id", "label", "no_label", "code", "error"])


def _sums(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """(ints, entry) -> (slot, total, n) of the task: the sum of each component of each entry, and the parts assigned to it."""
    parts, k, width = shape
    totals, n = np.zeros((width, parts * k), np.int64), np.zeros(parts * k, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):  # so few that sums of doubles are exact
            some = batch.slice(at, _SLICE)
            x = _unpacked(some, "ints", "<i4").reshape(-1, width)
            slot = (_unpacked(some, "entry", "u1").astype(np.int64) + np.arange(parts) * k).ravel()
            n += np.bincount(slot, minlength=parts * k)
            for w in range(width):
                totals[w] += np.bincount(slot, x[:, w], parts * k).astype(np.int64)
    used = np.flatnonzero(n)
    slots = (used[:, None] * width + np.arange(width)).ravel()
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(totals.T[used].ravel()), pa.array(np.repeat(n[used], width))], ["slot", "total", "n"])


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry the componentwise floor of the mean of its parts; unused entries stay."""
    shape = books.shape
    sums = state.select("ints", "entry").mapInArrow(lambda it: _sums(it, shape), "slot long, total long, n long").groupBy("slot").agg(F.sum("total"), F.sum("n"))
    moved = books.copy().ravel()
    for slot, total, n in sums.collect():  # at most entries x components rows
        moved[slot] = total // n
    return moved.reshape(shape)


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept row of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped. A component x becomes floor(256 x), held within
    2^27 either way. A vector is cut into `parts` equal parts; each part position has a codebook, which begins with that part of
    the vectors of the `entries` least ids (null ids last, repeated ids by their vectors; fewer rows, fewer entries; at most 256). Each round assigns
    every part to the nearest entry, ties to the lower index, and moves each entry to the componentwise floor of the mean of
    its parts; entries without a part stay. After `rounds` of these parts are assigned once more. error sums the squared distances,
    label_error the errors of all rows of an equal label (nulls are one label), code spells the entries in hex.

    The length that counts is that of the least id's vector whose length is a positive multiple of `parts`; rows of another length
    have a null code and error and no part in anything. Repeated rows count as often as they stand; long vectors are whole; an empty
    table gives no rows; other columns are not read, whatever they are called."""
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("entries must be 1 to 256, rounds at least 1")
    mark = column(label).cast("string")
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), F.coalesce(mark, F.lit("")).alias("label"), mark.isNull().alias("no_label"), column(vector).cast("array<double>").alias("vec"))
    rows = rows.where(usable(F.col("vec")))
    order = [F.asc_nulls_last("vec_id"), F.asc("vec")]
    first = rows.where((F.size("vec") > 0) & (F.size("vec") % parts == 0)).orderBy(*order).select("vec").head(1)
    if not first:
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    length = len(first[0]["vec"])
    fits = F.size("vec") == length
    least = rows.where(fits).orderBy(*order).select("vec").limit(entries).collect()
    books = integers(np.array([r["vec"] for r in least])).reshape(len(least), parts, -1).transpose(1, 0, 2).copy()
    state = materialise(rows.where(fits).mapInArrow(lambda it, books=books: _first_round(it, books), _STATE))
    before, books = books, _updated(state, books)
    for _ in range(rounds - 1):
        state = materialise(state.mapInArrow(lambda it, before=before, books=books: _next_round(it, before, books), _STATE))
        before, books = books, _updated(state, books)
    coded = materialise(state.mapInArrow(lambda it: _codes(it, before, books), "vec_id long, label string, no_label boolean, code string, error long"))
    other = rows.where(~fits).select("vec_id", "label", "no_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = coded.union(other)
    key = ["label", "no_label"]
    totals = materialise(coded.groupBy(*key).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return dealt_join(coded, totals, key, "n", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
