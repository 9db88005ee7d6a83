"""Near copies of whole texts: five-word shingles that agree to 0.8, over the SimHash index.

At that similarity 64-bit fingerprints differ in up to 18 bits, where blocks of a fingerprint no longer bring two
texts together at any size of input. So the upper masks of the index are replaced by bands of least hashes of the
shingles: two texts at 0.8 share one of BANDS bands of ROWS but for three in a million. Below a band stands the Gray-order
tree of the fingerprints, which drops groups that differ in more than RADIUS bits, and each pair that is left and not yet of
one class is verified on its whole sets of shingles. Bands are searched in rounds: a bucket whose texts are of one class
by then is not searched again, so a large group of near copies costs about one round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.hashing import row_hash
from scene_qa.llm.common import column, materialise, pack, small_join, utf8
from scene_qa.llm.components import connected_components
from scene_qa.llm.simhash import _signed, in_gray_order, majority, near_classes, with_cells
from scene_qa.llm.words import NOT_SPACE, shingles, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Bands of each round.
ROUNDS = (range(0, 4), range(4, BANDS))
#: Fingerprints of the sets of two texts at SIMILARITY differ in 64 x 0.15 bits on average; by the binomial tail, in over RADIUS
#: with about one in 10^10. Sets under LOOSE shingles are too small for that: none of their pairs is dropped.
RADIUS, LOOSE = 32, 40
#: Bytes of shingle sets that a search holds, unless one cell has more (at most twice HOT_BYTES).
BLOCK_BYTES = 32 << 20
HOT_BYTES = 32 << 20
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: bytes, words: int) -> tuple[bytes, int, list[int], bytes]:
    """Digest of 128 bits of the set of shingles, fingerprint of the set, bands, and the set as sorted 32-bit hashes. Repeats don't weigh:
    they'd part fingerprints of texts whose sets agree."""
    distinct = np.unique(shingles(word_hashes(text, NOT_SPACE), words))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), 1024):
        h = distinct[at : at + 1024, None]
        np.minimum(least, ((h ^ (h >> np.uint64(32))) * _FACTORS).min(axis=0), out=least)
    bands = [_signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, ROWS))] if len(distinct) else []
    return xxhash.xxh3_128_digest(distinct.tobytes(), 42), _signed(majority(distinct)), bands, np.unique((distinct >> np.uint64(32)).astype("<u4")).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            digest, fp, bands, shingles = zip(*[sketch(x.as_py(), words) for x in part.column(1)], strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(shingles, pa.binary())], ["first", "digest", "fp", "bands", "shingles"])


def agree(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of the sets a[i] and b[i], of 32-bit hashes, is at least `similarity`, for all i."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    todo = np.flatnonzero(out)
    todo = todo[np.argsort(a[todo], kind="stable")]
    at = 0
    while at < len(todo):
        one = a[todo[at]]
        stop, held = at, 0
        while stop < len(todo) and a[todo[stop]] == one and held < 1 << 20:
            held += sizes[b[todo[stop]]]
            stop += 1
        mine, theirs = sets[one], [sets[j] for j in b[todo[at:stop]].tolist()]
        values = np.concatenate(theirs)
        met = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
        n = np.fromiter(map(len, theirs), np.int64, len(theirs))
        common = np.add.reduceat(met.astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
        out[todo[at:stop]] = common >= similarity * (len(mine) + n - common) - 1e-9
        at = stop
    return out


def _joined(batches: Iterator[pa.RecordBatch], similarity: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp, digest, root, shingles) in order of bucket and Gray rank -> links (a, b) of digests."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        bucket, fp, digest, root = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        order = np.lexsort((root, bucket))  # stable: the least row of a class comes first
        fresh = np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (root[order][1:] != root[order][:-1])]
        known = np.empty(len(rows), np.int64)
        known[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        sets = [np.frombuffer(r[4], "<u4") for r in rows]
        loose = np.fromiter(map(len, sets), np.int64, len(sets)) < LOOSE
        labels = near_classes(bucket, fp.view(np.uint64), radius, known, lambda a, b: agree(sets, a, b, similarity), 2000, loose)
        new = np.flatnonzero(labels != known)
        return pa.RecordBatch.from_arrays([pa.array(digest[new]), pa.array(digest[labels[new]])], ["a", "b"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield found(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 200
    if held:
        yield found(held)


def near_copy_links(nodes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """nodes(digest, fp, bands, shingles), materialised, digests distinct -> (node, root): the texts with a near copy, and
    the least digest of their class. A bucket of more than hot_bytes of sets is searched as pairs of its parts, so no
    task holds more than two parts and no link is lost."""
    spark = nodes.sparkSession
    roots = spark.createDataFrame([], "node long, root long")
    bare = nodes.select("digest", "fp", "bands", (F.octet_length("shingles") + 200).alias("size"))
    for bands in ROUNDS:
        now = bare.join(roots, bare["digest"] == roots["node"], "left").withColumn("root", F.coalesce("root", "digest"))
        keyed = now.select("digest", "fp", "root", "size", F.explode(F.slice("bands", bands.start + 1, len(bands))).alias("key"))
        mixed = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("bytes")).where("low <> high")
        mixed = materialise(mixed.select("key", F.ceil(F.col("bytes") / hot_bytes).cast("long").alias("k")))
        keyed = materialise(keyed.join(mixed.select("key"), "key").drop("size"))
        wanted = materialise(keyed.select("digest").distinct())
        sets = small_join(nodes.select("digest", "shingles"), wanted, ["digest"], "inner")
        dealt = with_cells(keyed, mixed.where("k > 1"), "digest").join(sets, "digest")
        ordered = in_gray_order(dealt).select(F.xxhash64("key", "cell").alias("bucket"), "fp", "digest", "root", "shingles")
        links = ordered.mapInArrow(lambda it: _joined(it, similarity, radius), "a long, b long")
        links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = materialise(connected_components(links))
    return roots


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, of each class of near copies: the row with the least doc_id that is not
    null, then the least hash of its id and text, then of the whole row, in which nulls count.

    Classes are those of the links between whole texts whose sets of `words`-word shingles, A-Z lower-cased, have a Jaccard
    similarity of `similarity` or more, taken on 32-bit hashes of the shingles; equal sets always link (they have one digest of 128 bits;
    sets of one digest that differ raise an error), others by the bands but for 3 in a million at 0.8, fewer above. A text of fewer words is
    one shingle; null and blank texts are one class. Repeated rows are one row. An empty table gives no rows."""
    # two hashes name a row of docs without its text
    names = lambda key, data: (F.xxhash64(key.isNull(), key, data).alias("_a"), F.xxhash64(data, F.lit(7), key).alias("_b"))
    key, data = column(doc_id), column(text)
    first = F.struct(key.isNull().alias("none"), key.alias("key"), *names(key, data)).alias("first")
    rows = docs.select(first, utf8(data).alias("data"))
    schema = f"first {rows.schema['first'].dataType.simpleString()}, digest binary, fp long, bands array<long>, shingles binary"
    rows = materialise(rows.mapInArrow(lambda it: _sketches(it, words), schema))
    same = F.struct("fp", F.octet_length("shingles"), F.xxhash64("shingles"))
    nodes = rows.groupBy("digest").agg(F.min("first").alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles"), (F.min(same) == F.max(same)).alias("one"))
    sound = F.when(F.col("one"), F.col("fp")).otherwise(F.raise_error(F.lit("two sets of shingles have one digest")).cast("long"))
    # numbered once, when written: the number stands for the digest
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("digest"), "first", sound.alias("fp"), "bands", "shingles"))
    roots = near_copy_links(nodes, similarity)
    placed = nodes.select("digest", "first").join(roots, nodes["digest"] == roots["node"], "left")
    winners = placed.groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("first").alias("first")).select("first._a", "first._b")
    packed = pack(docs)
    key, data = column("_row", doc_id), column("_row", text)
    whole = F.struct(*[row_hash(*[column("_row", c) for c in docs.columns], types=[t for _, t in docs.dtypes], seed=k) for k in (0, 1)])
    each = packed.select("_row", *names(key, data), whole.alias("_whole")).groupBy("_a", "_b").agg(F.min_by("_row", "_whole").alias("_row"))
    return each.join(materialise(winners), ["_a", "_b"], "left_semi").select("_row.*")
