"""Benchmark decontamination by spaced seeds.

Fixed masks keep some word positions of a window and ignore the others; the hash of the kept words is a seed. Seeds of the
benchmark meet those of the documents, and each place where one agrees is verified along its diagonal, substitutions allowed.

The seeds meet in one of two ways, which give the same rows. An index of the benchmark whose size, by a bound that is checked first,
fits INDEX_BYTES goes to all tasks. A larger benchmark is joined: its seeds, dealt over SALTS, against those seeds
of the documents that a bitmap of fixed size lets through."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, materialise, pack, utf8
from scene_qa.llm.words import LETTERS, mixed, word_hashes

#: Fixed masks over word positions: 1 is hashed, 0 may differ.
MASKS = ("11111111", "110110101011", "1101100110111", "11101001101011", "11011011", "1101000111")
#: A passage counts if this many of its words match in one stretch; an item of up to SHORT words, if MIN_SHARE of its words do.
MIN_WORDS, MIN_SHARE, SHORT = 13, 0.8, 16
#: An index up to this size is broadcast.
INDEX_BYTES = 128 << 20
#: Parts of each seed of a joined benchmark, so that a seed which many documents hold is met in as many tasks.
SALTS = 8
#: Bits of a mask's bitmap in an index, and of the bitmap before a join.
_BITS, _JOIN_BITS = 22, 26
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64)]


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, punctuation left out."""
    return word_hashes(text, LETTERS)


def needed(n: int) -> int:
    """Matches that an item of n words asks for."""
    return MIN_WORDS if n > SHORT else max(1, -(-round(MIN_SHARE * 100) * n // 100))


def masks_of(n: int) -> list[str]:
    """The masks of an item of n words. A short item has runs of words so short that, whichever of its words may
    differ do, one run is whole; so no short passage is missed."""
    if n > SHORT:
        return [m for m in MASKS if len(m) <= n]
    spare = n - needed(n)
    return ["1" * (-(-(n - spare) // (spare + 1)))] if n else []


def seeds(words: np.ndarray, mask: str, made: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A hash of the positions that the mask keeps, and of the mask, at each place where all of it fits. made: products that the
    masks of one text share."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    made = {} if made is None else made
    out = np.full(n, hash_of_mask(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            p = made.get(j)
            if p is None:
                p = words * _ODD[j]
                if n < 1 << 17:  # a very long text's are not kept
                    made[j] = p
            out += p[j : j + n]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x9E3779B97F4A7C15)


@cache
def hash_of_mask(mask: str) -> int:
    return int(mixed(np.array([int("1" + mask, 2)], np.uint64))[0])


def overlap(item: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Where item[k] lies on words[k + shift]: matches of the best stretch, its first and its end position in words. The best
    stretch has most matches less twice its substitutions, then most matches; of a short item it is all from the first
    match to the last."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    if high <= low:
        return 0, 0, 0
    same = item[low:high] == words[low + shift : high + shift]
    if len(item) <= SHORT:
        hits = np.flatnonzero(same)
        return (len(hits), int(hits[0]) + low + shift, int(hits[-1]) + 1 + low + shift) if len(hits) else (0, 0, 0)
    total = np.cumsum(np.where(same, 1, -2))
    floor = np.minimum.accumulate(np.r_[0, total[:-1]])
    gain = total - floor
    matches = np.r_[0, np.cumsum(same)]
    best = (0, 0, 0)
    for end in np.flatnonzero(gain == gain.max()).tolist():
        start = int(np.flatnonzero(np.r_[0, total[:end]] == floor[end])[0])
        n = int(matches[end + 1] - matches[start])
        if n > best[0]:
            best = n, start + low + shift, end + 1 + low + shift
    return best


def best_of(item: np.ndarray, words: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """The best passage of an item over these diagonals: most matches, then the earliest; None if none counts."""
    found = [o for s in shifts if (o := overlap(item, words, s))[0] >= needed(len(item))]
    return max(found, key=lambda o: (o[0], -o[1], -o[2]), default=None)


class Index:
    """The seeds of a benchmark, sorted, behind bitmaps of fixed size."""

    def __init__(self, items: list[tuple[object, bytes]]) -> None:
        self.items = [(key, w) for key, text in items if len(w := tokens(text))]
        of: dict[str, list[tuple[int, np.ndarray]]] = {}
        for k, (_, w) in enumerate(self.items):
            for mask in masks_of(len(w)):
                of.setdefault(mask, []).append((k, w))
        self.tables = {}
        for mask, held in sorted(of.items()):
            h = np.concatenate([seeds(w, mask) for _, w in held])
            sizes = [len(w) - len(mask) + 1 for _, w in held]
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[h >> np.uint64(64 - _BITS)] = True
            self.tables[mask] = h[order], np.repeat([k for k, _ in held], sizes)[order], np.concatenate([np.arange(n) for n in sizes])[order], bitmap

    def find(self, words: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        """(item, matched words, words of the item, start, end) of each item found in a text: its best passage."""
        tried: dict[int, set[int]] = {}
        made: dict[int, np.ndarray] = {}
        for mask, (h, item, at, bitmap) in self.tables.items():
            mine = seeds(words, mask, made)
            where = np.flatnonzero(bitmap[mine >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(h, mine[where], "left"), np.searchsorted(h, mine[where], "right")
            for w, a, b in zip(where[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                for k, j in zip(item[a:b].tolist(), at[a:b].tolist(), strict=True):
                    tried.setdefault(k, set()).add(w - j)
        found = ((k, best_of(self.items[k][1], words, list(shifts))) for k, shifts in sorted(tried.items()))
        return [(self.items[k][0], o[0], len(self.items[k][1]), o[1], o[2]) for k, o in found if o]


def index_bound(items: DataFrame) -> int:
    """Bytes that an index of items(data) takes at most: a word for every two bytes, an entry of 24 bytes for each mask and word,
    a bitmap for each of at most len(MASKS) + SHORT masks."""
    size, n = items.agg(F.sum(F.octet_length("data")), F.count("*")).first()
    return int((size or 0) / 2 * (8 + 24 * len(MASKS)) + n * 200 + (len(MASKS) + SHORT) * (1 << _BITS))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, data) -> (seed, k, at, mask)."""
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = tokens(data.as_py())
            for mask in masks_of(len(words)):
                h = seeds(words, mask).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), k)), pa.array(np.arange(len(h), dtype=np.int64)), pa.array([mask] * len(h))], ["seed", "k", "at", "mask"])


def _candidates(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows(r, data), items(k, data), both materialised -> (r, k, shifts): the diagonals on which a seed of an item lies."""
    sc = rows.sparkSession.sparkContext
    of = materialise(items.select("k", "data").mapInArrow(_item_seeds, "seed long, k long, at long, mask string"))
    masks = [r.mask for r in of.select("mask").distinct().orderBy("mask").collect()]  # at most len(MASKS) + SHORT
    word = F.shiftrightunsigned("seed", 64 - _JOIN_BITS + 6).cast("int")
    bits = of.select(word.alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(seed, {64 - _JOIN_BITS}) & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2^20 rows at most
    bitmap = np.zeros(1 << (_JOIN_BITS - 6), np.int64)
    bitmap[bits["w"]] = bits["b"]
    shared = sc.broadcast((masks, bitmap.view(np.uint64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, bitmap = shared.value
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, made = tokens(data.as_py()), {}
                for mask in masks:
                    h = seeds(words, mask, made)
                    top = h >> np.uint64(64 - _JOIN_BITS)
                    at = np.flatnonzero((bitmap[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), r)), pa.array(at)], ["seed", "r", "pos"])

    mine = rows.select("r", "data").mapInArrow(search, "seed long, r long, pos long").withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int"))
    theirs = of.select("seed", "k", "at", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    met = mine.join(theirs, ["seed", "salt"]).select("r", "k", (F.col("pos") - F.col("at")).alias("shift"))
    return met.groupBy("r", "k").agg(F.collect_set("shift").alias("shifts"))  # diagonals of one document


_FOUND = ["matched_words", "item_words", "start_word", "end_word"]


def _verified(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows(r, data), items(k, data), both materialised -> (r, k, matched_words, item_words, start_word, end_word)."""
    tried = materialise(_candidates(rows, items))
    asked = tried.join(items.select("k", F.col("data").alias("item")), "k")
    texts = rows.join(tried.select("r").distinct(), "r", "left_semi").select("r", "data")

    def verify(asked: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        words, out = tokens(bytes(texts["data"].iloc[0])), []
        for r, k, shifts, item in zip(asked["r"], asked["k"], asked["shifts"], asked["item"], strict=True):
            w = tokens(bytes(item))
            if o := best_of(w, words, [int(s) for s in shifts]):
                out.append((r, k, o[0], len(w), o[1], o[2]))
        return pd.DataFrame(out, columns=["r", "k", *_FOUND])

    pairs = asked.select("r", "k", "shifts", "item").groupBy("r").cogroup(texts.groupBy("r"))
    return pairs.applyInPandas(verify, "r long, k long, " + ", ".join(f"{c} long" for c in _FOUND))


def _numbered(items: DataFrame, item_id: str, text: str) -> DataFrame:
    return items.select(column(item_id).alias("item_id"), utf8(column(text)).alias("data")).withColumn("k", F.monotonically_increasing_id())


def _index(items: DataFrame) -> Index:
    """Of all items; their number and size are bounded by index_bound."""
    return Index([(r.k, bytes(r.data)) for r in items.select("k", "data").orderBy("k").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, start_word, end_word): one row for each row of docs and
    benchmark item of which it holds a passage, with the best passage of the pair; of equally good ones the first.

    A passage is a stretch of words in place, substitutions allowed at twice the price of a match, with 13 matches; of an item of
    up to 16 words, 0.8 of them in place. Only diagonals on which a seed agrees are verified: short items miss
    nothing, of longer ones a passage that no mask fits is not seen (README has the shares).
    Null, empty and wordless texts and items match nothing; a very long text is read whole; equal items and repeated
    rows each give their own rows; ids may be null; only the named columns are read; an empty table on either side gives no rows."""
    items = materialise(_numbered(benchmark, item_id, item_text))
    narrow = docs.select(column(doc_id).alias("doc_id"), utf8(column(text)).alias("data"))
    if index_bound(items) > index_bytes:
        rows = materialise(narrow.withColumn("r", F.monotonically_increasing_id()))
        found = _verified(rows, items).join(rows.select("r", "doc_id"), "r")
    else:
        index = docs.sparkSession.sparkContext.broadcast(_index(items))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(i, *hit) for i, data in enumerate(batch.column(1)) for hit in index.value.find(tokens(data.as_py()))]
                cols = list(zip(*hits, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "k", *_FOUND])

        found = narrow.mapInArrow(search, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, k long, " + ", ".join(f"{c} long" for c in _FOUND))
    return found.join(items.select("k", "item_id"), "k").select("doc_id", "item_id", *_FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark (see contaminated)."""
    items = materialise(_numbered(benchmark, item_id, item_text))
    rows = pack(docs)
    if index_bound(items) > index_bytes:
        rows = materialise(rows.withColumn("_r", F.monotonically_increasing_id()))
        narrow = materialise(rows.select(F.col("_r").alias("r"), utf8(column("_row", text)).alias("data")))
        return rows.join(_verified(narrow, items).select(F.col("r").alias("_r")).distinct(), "_r", "left_anti").select("_row.*")
    index = docs.sparkSession.sparkContext.broadcast(_index(items))

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: bool(index.value.find(tokens(bytes(x)))))

    return rows.where(~hit(utf8(column("_row", text)))).select("_row.*")
