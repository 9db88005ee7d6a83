"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are cut into blocks, more than the radius; two of them within the radius agree on all blocks but at most
radius, so the value of the blocks that agree is the shared masked pattern at the top of the index and the key that
spreads the work. Below it the
fingerprints stand in Gray rank, in nodes of FANOUT that hold the bits their members share; a child keeps only
the bits its parent does not yet fix, so a search adds up differences on the way down and drops a node, with
all that stands below it, as soon as the sum passes the radius. Links found join classes at once, and a node
that lies wholly in the query's class is dropped too: a dense cluster costs near-linear time and gives a
spanning forest, not all its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, dealt_join, materialise, small_join, utf8
from scene_qa.llm.components import connected_components

FANOUT = 8
#: Rows held at once by a search, unless one bucket has more (at most HOT_ROWS by construction).
BLOCK_ROWS = 100_000
HOT_ROWS = 200_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, A-Z lower-cased, repeats included; fewer words are one shingle."""
    tokens = text.lower().split()  # of bytes: only A-Z change, only \x20 and \x09-\x0d part words
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), len(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    m = max(1, n - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], 42) for s, e in zip(starts[:m].tolist(), ends[n - m :].tolist(), strict=True)], np.uint64, m)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none: 0."""
    m = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprint(text: bytes, words: int) -> int:
    """Majority of the XXH64 bits of the word shingles of a text."""
    return majority(shingle_hashes(text, words))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(df: DataFrame, text: str, words: int, name: str = "_fp") -> DataFrame:
    """df and a long column of fingerprints."""

    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(lambda x: _signed(fingerprint(bytes(x), words)))

    return df.withColumn(name, fp(utf8(F.col(text))))  # text: a column's name or the path of a field


def _levels(bucket: np.ndarray, fp: np.ndarray) -> tuple[list[dict], np.ndarray]:
    """Nodes bottom up: level 0 is the rows. Each level: first row, end row, first and last child, pattern, OR and
    AND of its rows. Also the lowest level at which each row's bucket is one node."""
    rows = np.arange(len(fp))
    first_of_bucket = np.r_[True, bucket[1:] != bucket[:-1]]
    of = np.cumsum(first_of_bucket) - 1
    levels = [{"row": rows, "end": rows + 1, "of": of, "pattern": fp, "or": fp, "and": fp}]
    root = np.full(of[-1] + 1, -1)
    while True:
        below = levels[-1]
        starts = np.r_[True, below["of"][1:] != below["of"][:-1]]
        at = np.flatnonzero(starts)
        counts = np.diff(np.r_[at, len(starts)])
        fresh = below["of"][at[counts == 1]]
        root[fresh[root[fresh] < 0]] = len(levels) - 1
        if (counts == 1).all():
            break
        nth = np.arange(len(starts)) - np.repeat(at, counts)
        cut = np.flatnonzero(nth % FANOUT == 0)
        levels.append({"row": below["row"][cut], "end": below["end"][np.r_[cut[1:], len(starts)] - 1], "of": below["of"][cut], "child": cut, "child_end": np.r_[cut[1:], len(starts)], "pattern": below["pattern"][cut], "or": np.bitwise_or.reduceat(below["or"], cut), "and": np.bitwise_and.reduceat(below["and"], cut)})
    for level in levels:
        level["mask"] = ~(level["or"] ^ level["and"])
    return levels, root[of]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        if not apart.any():
            return labels
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def near_classes(bucket: np.ndarray, fp: np.ndarray, radius: int, labels: np.ndarray | None = None, same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, work_held: int = 2_000_000, loose: np.ndarray | None = None) -> np.ndarray:
    """For rows in order of (bucket, Gray rank): the least row of the class that each row is linked to by steps
    of at most radius differing bits inside its bucket.

    labels: the same for classes known before. same(a, b): which of the pairs of rows a link within the radius
    really joins; asked only of rows of different classes, for about work_held pairs at a time at most. loose: rows
    for which no difference is too large."""
    n = len(fp)
    loose = np.zeros(n, bool) if loose is None else loose
    labels = np.arange(n) if labels is None else labels.copy()
    if n < 2:
        return labels
    levels, root = _levels(bucket, fp)
    sizes = np.bincount(levels[0]["of"])[levels[0]["of"]]
    work = np.cumsum(sizes * (sizes > 1))
    queries = np.flatnonzero(sizes > 1)
    at = 0
    while at < len(queries):
        stop = max(at + 1, int(np.searchsorted(work[queries], work[queries[at]] + work_held)))
        now, at = queries[at:stop], stop
        q = node = acc = np.empty(0, np.int64)
        fixed = np.empty(0, np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            fresh = now[root[now] == depth] if depth else now[:0]
            if len(fresh):
                q, node, acc = np.r_[q, fresh], np.r_[node, np.searchsorted(level["of"], levels[0]["of"][fresh])], np.r_[acc, np.zeros(len(fresh), np.int64)]
                fixed = np.r_[fixed, np.zeros(len(fresh), np.uint64)]
            if not len(q):
                continue
            acc = acc + np.bitwise_count((fp[q] ^ level["pattern"][node]) & level["mask"][node] & ~fixed)
            keep = ((acc <= radius) | loose[q]) & (level["end"][node] > q + 1)
            if depth:
                low, high = np.minimum.reduceat(labels, level["row"])[node], np.maximum.reduceat(labels, level["row"])[node]
                keep &= ~((low == high) & (low == labels[q]))
            q, node, acc = q[keep], node[keep], acc[keep]
            if depth:
                fixed = level["mask"][node]
                first, width = level["child"][node], (level["child_end"] - level["child"])[node]
                q, acc, fixed = np.repeat(q, width), np.repeat(acc, width), np.repeat(fixed, width)
                node = np.repeat(first - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        apart = labels[q] != labels[node]
        q, node = q[apart], node[apart]
        if same is not None and len(q):
            joined = same(q, node)
            q, node = q[joined], node[joined]
        labels = _join(labels, q, node)
    return labels


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    def found(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        labels = near_classes(bucket, fp.view(np.uint64), radius)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        # a copy: Arrow's buffers end with the batch
        held.append((batch.column(0).to_numpy(zero_copy_only=False).copy(), batch.column(1).to_numpy(zero_copy_only=False).copy()))
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(bucket == bucket[-1], True))  # the last bucket may go on
            if cut:
                yield found(bucket[:cut], fp[:cut])
                held, rows = [(bucket[cut:], fp[cut:])], len(fp) - cut
            else:
                held = [(bucket, fp)]
    if rows:
        yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))


def with_cells(keyed: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """keyed and a column cell. A key of hot(key, k), materialised, has its rows dealt into k parts by the column `by`, and
    a cell for each pair of parts, so that every pair of its rows meets in a cell; another key is one cell."""
    zero = F.lit(0).cast("long")
    if not hot.head(1):
        return keyed.withColumn("cell", zero)
    dealt = small_join(keyed, hot, ["key"]).withColumn("part", F.pmod(F.xxhash64(by), F.col("k")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("k").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("k") - 1))))
    cell = F.when(F.col("k").isNull(), zero).otherwise(F.least("part", "other") * F.col("k") + F.greatest("part", "other"))
    return dealt.withColumn("cell", cell).drop("k", "part", "other")


def in_gray_order(keyed: DataFrame) -> DataFrame:
    """Rows of one key and cell in one task, in order of the Gray rank of fp."""
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        keyed = keyed.withColumn("gray", gray)
        gray = F.col("gray").bitwiseXOR(F.shiftrightunsigned("gray", shift))
    return keyed.withColumn("gray", gray).repartition("key", "cell").sortWithinPartitions("key", "cell", F.shiftrightunsigned("gray", 32), F.col("gray").bitwiseAND(F.lit(0xFFFFFFFF)))


def block_keys(radius: int, blocks: int) -> Column:
    """An array of keys of fp: the bits are cut into `blocks` blocks, and each choice of blocks - radius of them is a key. Two
    fingerprints within the radius differ in at most that many blocks, so they share a key."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    keys = []
    for k, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in kept)
        bits = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.struct(F.xxhash64(F.lit(k), bits).alias("key")))
    return F.array(*keys)


def blocks_for(n: int, radius: int, rows: int = 2000) -> int:
    """The fewest blocks that leave about `rows` of n evenly spread fingerprints to a key: more fingerprints, longer keys."""
    blocks = radius + 1
    while blocks < 2 * radius and n / 2.0 ** (64 * (blocks - radius) / blocks) > rows:
        blocks += 1
    return blocks


def fingerprint_links(fps: DataFrame, radius: int = 3, hot_rows: int = HOT_ROWS, blocks: int | None = None) -> DataFrame:
    """fps(fp long, distinct, materialised) -> (a, b): a spanning forest of the links at radius or fewer differing bits, found
    bucket by bucket. A bucket over hot_rows rows is cut into k parts and searched as the k (k + 1) / 2 pairs
    of parts, so no task holds more than two parts and no link is lost. blocks: see block_keys; any number over the radius
    gives the same classes, and by default it grows with the input so that buckets don't."""
    blocks = blocks_for(fps.count(), radius) if blocks is None else blocks
    keyed = fps.select("fp", F.inline(block_keys(radius, blocks)))
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_rows).select("key", F.ceil(F.col("count") / hot_rows).cast("long").alias("k"))
    keyed = in_gray_order(with_cells(keyed, materialise(hot), "fp"))
    return keyed.select(F.xxhash64("key", "cell").alias("bucket"), "fp").mapInArrow(lambda it: _links(it, radius), "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts have fingerprint zero and link like any other; a text of fewer words than a shingle is
    one shingle. Rows of one fingerprint are one node of the link graph, so copies, repeated rows and null ids
    cost nothing; component_id is the least id that is not null in the component, null if there is none.
    An empty table gives no rows; other columns are not read."""
    narrow = materialise(with_fingerprint(docs.select(column(doc_id).alias("doc_id"), column(text).alias("_text")), "_text", words).select("doc_id", F.col("_fp").alias("fp")))
    nodes = narrow.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = materialise(connected_components(fingerprint_links(materialise(narrow.select("fp").distinct()), radius)))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lowest = placed.where(F.col("least").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(placed.join(lowest, "root", "left").select("fp", "component_id", "n"))
    return dealt_join(narrow, named, ["fp"], "n", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
