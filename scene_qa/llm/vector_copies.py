"""Near copies among vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

The signs of a vector's products with random hyperplanes are cut into a key for each table; only vectors that share a key
meet. A pair is verified, and counted, in the first table whose key it shares, so that links can be counted for each
vector without writing pairs, and each bucket writes only a spanning forest of its new links.

A large group of near copies would meet in every table, each with each. So vectors of a hot bucket of the first table that lie within half
the linking angle of its centre are a ball: any two of them link, by the triangle inequality, and are counted by one sum. They
are compared with what is outside of their ball only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, dealt_join, materialise, small_join
from scene_qa.llm.components import connected_components
from scene_qa.llm.simhash import _join

#: Chance that a pair at the stated cosine shares no key; at higher cosines it is far less.
MISSED = 1e-5
#: Vectors that share a key, if they were spread evenly: keys get longer as vectors get more.
BUCKET = 256
#: Vectors of a bucket that meet in one task; a larger bucket is searched as pairs of its parts.
HOT_ROWS = 4096
#: Rows of products computed at once, and pairs compared at once.
_ROWS, _PAIRS = 512, 1 << 17


def plan(n: int, cosine: float, missed: float = MISSED, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a key for n vectors, and the tables that leave a pair at `cosine` without a shared key with chance `missed`."""
    bits = min(40, max(4, math.ceil(math.log2(max(1, n / bucket)))))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(missed) / math.log1p(-(agree**bits)))


def hyperplanes(length: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, length)).standard_normal((length, bits * tables))


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has a direction: all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square leaves the doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _keys(signs: np.ndarray, bits: int) -> np.ndarray:
    """(rows, tables * bits) of booleans -> (rows, tables) of keys."""
    return (signs.reshape(len(signs), -1, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)


def _signed_rows(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, weight, vec) -> (node, weight, vec as bytes, all signs as bytes, a key for each table)."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            vectors = [np.asarray(v, np.float64) for v in part.column(2).to_pylist()]
            signs = [b""] * len(vectors)
            keys = np.zeros((len(vectors), tables), np.int64)
            for length in {len(v) for v in vectors}:
                mine = [i for i, v in enumerate(vectors) if len(v) == length]
                if length not in planes:
                    planes = {length: hyperplanes(length, bits, tables, seed)}  # of one length at a time
                side = units(np.array([vectors[i] for i in mine])) @ planes[length] > 0
                keys[mine] = _keys(side, bits)
                for i, row in zip(mine, np.packbits(side, axis=1), strict=True):
                    signs[i] = row.tobytes()
            keys |= np.arange(tables) << 42
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(signs, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "weight", "vec", "signs", "keys"])


def _links(rows: dict[str, np.ndarray], table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors of one length in one cell: how many vectors each is newly linked to, and the least row of its new class."""
    x, codes, part, weight, ball = units(rows["vec"]), rows["codes"][:, : table + 1], rows["part"], rows["weight"], rows["ball"]
    counts, labels = np.zeros(len(x), np.int64), np.arange(len(x))
    across = rows["across"][0]  # a cell of two parts: pairs inside a part meet in its own cell
    for at in range(0, len(x), _ROWS):
        a, b = np.nonzero(np.triu(x[at : at + _ROWS] @ x[at:].T >= cosine, 1))
        for cut in range(0, len(a), _PAIRS):
            i, j = a[cut : cut + _PAIRS] + at, b[cut : cut + _PAIRS] + at
            same = codes[i] == codes[j]
            new = same[:, -1] & ~same[:, :-1].any(axis=1)
            new &= ((ball[i] != ball[j]) | (ball[i] < 0)) & ((part[i] != part[j]) | (not across))
            i, j = i[new], j[new]
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            labels = _join(labels, i, j)
    return counts, labels


def _search(batches: Iterator[pa.RecordBatch], bits: int, tables: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """(key, cell, part, across, ball, node, weight, vec, signs) in order of key and cell -> (node, links, root): rows with new links."""

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(held).combine_chunks()
        table = cell["key"][0].as_py() >> 42
        sizes = np.array([len(v) for v in cell["vec"].to_pylist()])
        for size in np.unique(sizes).tolist():
            some = cell.filter(pa.array(sizes == size))
            signs = np.frombuffer(b"".join(some["signs"].to_pylist()), np.uint8).reshape(len(some), -1)
            rows = {k: some[k].to_numpy() for k in ("part", "node", "weight", "across", "ball")} | {"vec": np.frombuffer(b"".join(some["vec"].to_pylist()), "<f8").reshape(len(some), -1), "codes": _keys(np.unpackbits(signs, axis=1, count=bits * tables)[:, : bits * (table + 1)], bits)}
            counts, labels = _links(rows, table, cosine)
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rows["node"][at]), pa.array(counts[at]), pa.array(rows["node"][labels[at]])], ["node", "links", "root"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key, cell = (batch.column(k).to_numpy() for k in (0, 1))
        edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1, batch.num_rows]
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if stop == start:
                continue
            if held and (key[start], cell[start]) != last:
                yield from found(held)
                held = []
            last = (key[start], cell[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield from found(held)


def _centre_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ball, vec) -> (ball, at, total): the task's sums of each component of the vectors' directions."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        balls, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for ball in np.unique(balls).tolist():
            mine = [np.frombuffer(vectors[i], "<f8") for i in np.flatnonzero(balls == ball)]
            sums[ball] = sums.get(ball, 0) + units(np.array(mine)).sum(axis=0)
    for ball, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([ball] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array(total)], ["ball", "at", "total"])


def _inside(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(node, weight, ball, vec, centre) -> (node, weight, ball) of the vectors within half the angle of their centre."""
    least = math.cos(math.acos(cosine) / 2) + 1e-9  # what rounding may move
    for batch in batches:
        keep = []
        for vec, centre in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            size = float(np.linalg.norm(centre))
            keep.append(size > 0 and float(units(np.frombuffer(vec, "<f8")[None])[0] @ np.asarray(centre)) >= least * size)
        yield pa.RecordBatch.from_arrays(batch.columns[:3], ["node", "weight", "ball"]).filter(pa.array(keep, pa.bool_()))


def _balls(signed: DataFrame, cosine: float, hot_rows: int) -> DataFrame | None:
    """(node, ball, links, root), materialised: the vectors of balls, the weight of the others of their ball and its least node; None
    if no bucket of the first table is hot."""
    first = signed.select("node", "weight", "vec", F.get("keys", F.lit(0)).alias("key"), F.octet_length("vec").alias("length"))
    hot = first.groupBy("key", "length").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = materialise(hot.withColumn("ball", F.monotonically_increasing_id()))
    if not hot.head(1):
        return None
    held = materialise(dealt_join(first, hot, ["key", "length"], "n", "node"))
    sums = held.select("ball", "vec").mapInArrow(_centre_sums, "ball long, at int, total double").groupBy("ball", "at").agg(F.sum("total").alias("total"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda c: c["total"])  # of one vector's length
    centres = materialise(sums.groupBy("ball").agg(centre.alias("centre")).join(hot.select("ball", "n"), "ball"))
    near = dealt_join(held, centres, ["ball"], "n", "node").select("node", "weight", "ball", "vec", "centre")
    inside = materialise(near.mapInArrow(lambda it: _inside(it, cosine), "node long, weight long, ball long"))
    sizes = materialise(inside.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("node").alias("root"), F.count("*").alias("n")).where("n > 1"))
    return materialise(dealt_join(inside, sizes, ["ball"], "n", "node").select("node", "ball", (F.col("all") - F.col("weight")).alias("links"), "root"))


def _in_cells(keyed: DataFrame, hot_rows: int) -> DataFrame:
    """keyed and columns part, cell and across, whether the cell is one of two parts. The rows of a key that has over hot_rows are
    dealt into parts, each of one ball or of what is in none; every pair of parts has a cell but those of one ball, and a part in
    no ball has one with itself. Another key is one cell."""
    zero = F.lit(0).cast("long")
    counts = keyed.groupBy("key", "ball").agg(F.count("*").alias("n"))
    hot = counts.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("ball", F.ceil(F.col("n") / hot_rows).alias("k"))).alias("groups")).where(F.col("n") > hot_rows)
    parts = F.flatten(F.transform("groups", lambda g: F.transform(F.sequence(F.lit(0).cast("long"), g["k"] - 1), lambda i: F.struct(g["ball"].alias("ball"), i.alias("i"), g["k"].alias("k")))))
    hot = materialise(hot.select("key", parts.alias("parts")))
    if not hot.head(1):
        return keyed.withColumn("part", zero).withColumn("cell", zero).withColumn("across", F.lit(False))
    dealt = small_join(keyed, hot, ["key"])
    k = F.get(F.filter("parts", lambda p: p["ball"] == F.col("ball")), F.lit(0))["k"]
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node"), k))
    place = F.array_position(F.transform("parts", lambda p: (p["ball"] == F.col("ball")) & (p["i"] == F.col("i"))), F.lit(True)) - 1
    dealt = dealt.withColumn("part", F.coalesce(place, zero))
    others = F.filter(F.transform("parts", lambda p, j: F.when((p["ball"] != F.col("ball")) | (p["ball"] < 0), j.cast("long"))), lambda j: j.isNotNull())
    dealt = dealt.withColumn("other", F.explode(F.coalesce(others, F.array(zero))))
    cell = F.least("part", "other") * F.coalesce(F.size("parts"), F.lit(1)) + F.greatest("part", "other")
    return dealt.withColumn("cell", cell).withColumn("across", F.col("part") != F.col("other")).drop("parts", "i", "other")


def vector_links(nodes: DataFrame, cosine: float = 0.95, seed: int = 12, hot_rows: int = HOT_ROWS, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """nodes(node long, weight long, vec array), materialised, usable and distinct -> (node, links, root), materialised: in one or
    more rows the weight of the nodes that a node links to, and a forest of the links."""
    many = plan(nodes.count(), cosine)
    bits, tables = bits or many[0], tables or many[1]
    signed = materialise(nodes.select("node", "weight", "vec").mapInArrow(lambda it: _signed_rows(it, bits, tables, seed), "node long, weight long, vec binary, signs binary, keys array<long>"))
    balls = _balls(signed, cosine, hot_rows)
    outside = F.lit(-1).cast("long")
    signed = signed.withColumn("ball", outside) if balls is None else signed.join(balls.select("node", "ball"), "node", "left").withColumn("ball", F.coalesce("ball", outside))
    keyed = signed.withColumn("key", F.explode("keys")).drop("keys")
    dealt = _in_cells(keyed, hot_rows).select("key", "cell", "part", "across", "ball", "node", "weight", "vec", "signs")
    placed = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = placed.mapInArrow(lambda it: _search(it, bits, tables, cosine), "node long, links long, root long")
    return materialise(found if balls is None else found.union(balls.select("node", "links", "root")))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 12, hot_rows: int = HOT_ROWS, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Two vectors of one length link if their cosine, in double precision, is at least `cosine` and they share the key of a
    table; by the plan of tables a pair at that very cosine shares none with chance MISSED, a closer pair more rarely. None
    below it link. n_links counts the other rows linked directly; component_id is the least id that is not null and reachable by links,
    its own included (null if there is none); kept says whether it is the row's own.

    Rows whose vector is null, empty or zero, or holds a null or non-finite component, link with nothing. Rows of equal vectors
    are one node of that weight, so copies cost nothing and link with each other; repeated rows likewise, and all rows of
    a kept id are kept. An empty table gives no rows; other columns are not read, whatever they are called. Long vectors are
    whole. No pairs are written: each bucket writes counts and a forest, a large bucket is searched as pairs of its parts, and a
    dense group in it, as a ball, is not compared with itself."""
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), column(vector).cast("array<double>").alias("vec"))
    good = usable(F.col("vec"))
    nodes = rows.where(good).groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbered once, when written
    links = vector_links(nodes, cosine, seed, hot_rows, bits, tables)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = materialise(connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    placed = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("vec", "weight", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = dealt_join(rows.where(good), materialise(named), ["vec"], "weight", "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
