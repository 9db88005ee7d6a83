"""Ranked lexical search of items over documents by sort-based accumulation.

Each document is cut into terms once. In a block of documents the arrays of (item, document, impact) of all matched terms are
concatenated, radix sorted by keys that pack item and document, and summed with reduceat; each item's best are held in a
heap. All that belongs to a document is summed in its task, so no postings are shuffled: only the heaps are, dealt by ranges
of item and part."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.llm.common import column, materialise, utf8

#: Bytes of item texts that one search holds; more items are searched block by block, each over all documents.
BLOCK_BYTES = 16 << 20
#: (item, document, impact) entries sorted at once, but for the last document's.
HELD = 1 << 20
#: Parts in which the heaps of an item are merged before they meet.
PARTS = 32
_TERM, _GAP, _CHUNK = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]"), 1 << 20
_LAST = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter[bytes]:
    """Terms of a whole text in UTF-8: runs of ASCII letters and digits and of all that isn't ASCII; A-Z lower-cased."""
    text, start, found = text.lower(), 0, Counter()
    while start < len(text):
        gap = _GAP.search(text, start + _CHUNK) if len(text) - start > _CHUNK else None
        stop = gap.start() if gap else len(text)
        found.update(_TERM.findall(text, start, stop))
        start = stop
    return found


class ItemIndex:
    """The items of a block by term: those of term t are items[starts[t] : starts[t + 1]], times holds their repeats."""

    def __init__(self, texts: list[bytes]):
        self.numbers: dict[bytes, int] = {}
        rows = [(self.numbers.setdefault(term, len(self.numbers)), item, n) for item, text in enumerate(texts) for term, n in term_counts(text).items()]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.items, self.times, self.n_items = table[:, 1], table[:, 2], len(texts)
        self.starts = np.searchsorted(table[:, 0], np.arange(len(self.numbers) + 1))


def _matches(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n, terms, tfs): all terms of a document counted, those of the items named."""
    for batch in batches:
        n, terms, tfs = [], [], []
        for text in batch.column(1):
            counts = term_counts(text.as_py())
            met = sorted((numbers[t], counts[t]) for t in counts.keys() & numbers.keys())
            n.append(counts.total())
            terms.append(np.array([t for t, _ in met], "<i4").tobytes())
            tfs.append(np.array([c for _, c in met], "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])


def _frequencies(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """(terms) -> (term, df) of the task."""
    seen = np.zeros(n_terms, np.int64)
    for batch in batches:
        for terms in batch.column(0):
            seen[np.frombuffer(terms.as_buffer(), "<i4")] += 1  # a document names a term once
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "df"])


def radix_order(keys: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of keys under bound: one radix pass for each 16 bits, lowest first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(1, bound - 1).bit_length(), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Best:
    """The k best of each item so far: scores from the highest, then ids from the least, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.score, self.id = np.zeros(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).min)  # what an entry must beat: of score 0 none is wanted

    def add(self, items: np.ndarray, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores > self.score[items]) | ((scores == self.score[items]) & (ids < self.id[items]))
        for item, one, gone, score in zip(items[keep].tolist(), ids[keep].tolist(), missing[keep].tolist(), scores[keep].tolist(), strict=True):
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -one, gone))
            else:
                heapq.heappushpop(heap, (score, -one, gone))
            if len(heap) == self.k:
                self.score[item], self.id[item] = heap[0][0], -heap[0][1]


def _accumulate(docs: list[tuple], index: ItemIndex, weights: np.ndarray, n_docs: int, n_terms: int, best: Best) -> None:
    """Adds the scores of docs, (doc_id, n, terms, tfs), to best."""
    sizes = np.array([len(d[2]) for d in docs])
    terms, tf = np.concatenate([d[2] for d in docs]).astype(np.int64), np.concatenate([d[3] for d in docs])
    m = np.array([100 - 25 + 25 * d[1] * n_docs // n_terms for d in docs], np.int64)  # Python's integers do not overflow
    doc = np.repeat(np.arange(len(docs)), sizes)
    impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    many = index.starts[terms + 1] - index.starts[terms]
    at = np.repeat(index.starts[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    key = index.items[at] * len(docs) + np.repeat(doc, many)  # item and document in one integer
    order = radix_order(key, index.n_items * len(docs))
    key, impact = key[order], (np.repeat(impact, many) * index.times[at])[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    items, doc = np.divmod(key[first], len(docs))
    ids = np.array([_LAST if d[0] is None else d[0] for d in docs], np.int64)
    missing = np.array([d[0] is None for d in docs])
    best.add(items, ids[doc], missing[doc], np.add.reduceat(impact, first))


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex, weights: np.ndarray, n_docs: int, n_terms: int, k: int, held: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, tfs) -> (item, doc_id, score), the k best of the task for each item."""
    best, docs, work = Best(index.n_items, k), [], 0
    per_term = np.diff(index.starts)
    for batch in batches:
        for doc_id, n, terms, tfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = np.frombuffer(terms, "<i4")
            if not len(terms):
                continue
            docs.append((doc_id, n, terms, np.frombuffer(tfs, "<i8")))
            work += int(per_term[terms].sum())
            if work >= held:
                _accumulate(docs, index, weights, n_docs, n_terms, best)
                docs, work = [], 0
    if docs:
        _accumulate(docs, index, weights, n_docs, n_terms, best)
    rows = [(item, None if gone else -one, score) for item, heap in enumerate(best.heaps) for score, one, gone in heap]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, held: int = HELD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of items with a score above 0, fewer if there are fewer;
    equal scores by ascending doc_id, null ids last.

    N counts the documents with a term, L all their terms, n those of one document, df the documents that hold a term, tf its
    occurrences in one. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and adds, for each time the item holds it,
    w * ((10^9 tf) div (1000 tf + 12 m)) with m = 100 - 25 + (25 n N) div L. Statistics are those of all documents.

    Null and empty texts have no terms: such a document is nowhere found and such an item finds nothing. Texts are read whole,
    in pieces of about a mebibyte. Repeated rows are documents, or items, of their own. Empty tables give no rows. Only the named columns are
    read, whatever others are called. The index of the items is held in memory, in blocks of block_bytes of their texts;
    any blocks give the same rows."""
    spark = docs.sparkSession
    read = docs.select(column(doc_id).cast("long").alias("doc_id"), utf8(column(text)).alias("text"))
    wanted = items.select(column(item_id).alias("item_id"), utf8(column(item_text)).alias("text"))
    blocks = -(-(wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    out = spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = wanted.where(F.col("block") == block).select("item_id", "text").collect()  # about block_bytes
        index = ItemIndex([bytes(r["text"]) for r in rows])
        numbers = index.numbers
        matched = materialise(read.mapInArrow(lambda it, numbers=numbers: _matches(it, numbers), "doc_id long, n long, terms binary, tfs binary"))
        n_docs, n_terms = matched.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not numbers:
            continue
        df = matched.select("terms").mapInArrow(lambda it, many=len(numbers): _frequencies(it, many), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        seen = dict(df.collect())  # a row for each term of the block
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen.get(t, 0) + 1))) for t in range(len(numbers))], np.int64)
        found = matched.mapInArrow(lambda it, index=index, weights=weights, n=n_docs, m=n_terms: _search(it, index, weights, n, m, k, held), "item long, doc_id long, score long")
        found = materialise(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))))
        found = _ranked(_ranked(found.repartitionByRange("item", "part"), ["item", "part"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {items.schema[item_id].dataType.simpleString()}")
        out = out.union(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
