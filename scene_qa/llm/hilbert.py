"""Sharding along a Hilbert curve over metadata, for pruning of files by several columns at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.functions.hashing import row_hash
from scene_qa.llm.common import column, materialise, pack, small_join, utf8

BITS = 5
#: Bits of a cell up to which the table of cells, a row of 32 bytes for each, is broadcast: at most 4 MiB.
FEW_CELLS = 17
#: Sub-buckets of a cell of the curve, so that a hot cell is ranked in as many tasks.
SALT_BITS = 10


#: Characters of a string that make a cut point: it needn't be a value.
PREFIX = 4096
#: Rows of one text beyond which they are dealt over sub-buckets of their own, of about so many rows; more if over HOT_PART texts
#: could have as many.
HOT_ROWS, HOT_PART = 1000, 100_000


def ordered(name: str, kind: str) -> Column:
    """What a dimension is ordered by: a string as it is, in order of its bytes; anything else as a number."""
    if kind == "string":
        return column(name)
    return F.unix_micros(column(name).cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else column(name).cast("double")


def cut_points(docs: DataFrame, dims: list[str], bits: int = BITS) -> list[list]:
    """At most 2^bits - 1 cut points for each dimension, a bounded result that all rows decide: of numbers approximate quantiles
    in one pass, of strings exact quantiles of their first PREFIX characters."""
    kinds, many = dict(docs.dtypes), 1 << bits
    shares = F.array(*[F.lit(k / many) for k in range(1, many)])
    out: list[list] = [[] for _ in dims]
    numbers = [i for i, d in enumerate(dims) if kinds[d] != "string"]
    if numbers:
        row = docs.agg(*[F.percentile_approx(ordered(dims[i], kinds[dims[i]]), shares, 10_000).alias(f"d{i}") for i in numbers]).first()
        for i in numbers:
            out[i] = sorted(set(row[f"d{i}"] or []))
    strings = [i for i in range(len(dims)) if i not in numbers]
    if strings:
        for r in string_quantiles(docs.select(F.inline(F.array(*[F.struct(F.lit(i).alias("dim"), F.substring(column(dims[i]), 1, PREFIX).alias("value")) for i in strings]))), many).collect():
            out[r["dim"]].append(r["value"])
    return [sorted(cuts) for cuts in out]  # Python's order of strings is that of their UTF-8 bytes


def string_quantiles(values: DataFrame, many: int) -> DataFrame:
    """values(dim, value) -> the distinct (dim, value) at places k * n div many, for k from 1, in the order of a dim's n values
    without nulls. Equal values are counted first; their counts are added up in stretches of the order, and those by stretch."""
    tally = values.where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tally = materialise(tally.repartitionByRange(parts, "dim", "value").withColumn("stretch", F.spark_partition_id()))
    before = lambda order, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = tally.groupBy("dim", "stretch").agg(F.sum("n").alias("n"))  # at most a row for each partition and dim
    stretches = stretches.select("dim", "stretch", before("stretch", "dim").alias("_to"), F.sum("n").over(Window.partitionBy("dim")).alias("total"))
    placed = tally.withColumn("_in", before("value", "dim", "stretch")).join(F.broadcast(stretches), ["dim", "stretch"]).withColumn("low", F.col("_to") + F.col("_in"))
    places = F.transform(F.sequence(F.lit(1), F.lit(many - 1)), lambda k: F.expr("total").cast("long") * k)
    here = F.exists(places, lambda at: (F.floor(at / many) >= F.col("low")) & (F.floor(at / many) < F.col("low") + F.col("n"))) if many > 1 else F.lit(False)
    return placed.where(here).select("dim", "value")


def quantised(value: Column, cuts: list, bits: int = BITS) -> Column:
    """How many cut points lie at or below the value, spread over all coordinates of so many bits, so that a dimension of few
    steps reaches the curve's upper bits as well; null is 0."""
    if not cuts:
        return F.lit(0)
    below = reduce(lambda a, b: a + b, [F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts])
    return F.coalesce(F.floor(below * ((1 << bits) - 1) / F.lit(len(cuts))).cast("int"), F.lit(0))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The position on the Hilbert curve of a point with these coordinates of `bits` bits, by Skilling's
    transform: undo the excess work from the highest bit down, Gray encode, interleave."""
    n = len(axes)
    point = F.array(*[a.cast("int") for a in axes])
    flip = lambda p, by: F.transform(p, lambda v, j: F.when(j == 0, v.bitwiseXOR(by)).otherwise(v))

    def undo(p, step):
        low, i = step["low"], step["i"]
        both = F.get(p, F.lit(0)).bitwiseXOR(F.get(p, i)).bitwiseAND(low)
        swapped = F.transform(p, lambda v, j: F.when((j == 0) != (j == i), v.bitwiseXOR(both)).otherwise(v))
        return F.when(F.get(p, i).bitwiseAND(low + 1) != 0, flip(p, low)).otherwise(swapped)

    steps = F.array(*[F.struct(F.lit((1 << b) - 1).alias("low"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    point = F.aggregate(steps, point, undo) if bits > 1 else point
    gray = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.slice(point, F.lit(1), i + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    lows = F.array(*[F.lit((1 << b) - 1) for b in range(1, bits)]) if bits > 1 else F.array(F.lit(0))

    def finish(g):
        t = F.aggregate(lows, F.lit(0), lambda a, low: a.bitwiseXOR(F.when(F.element_at(g, -1).bitwiseAND(low + 1) != 0, low).otherwise(0)))
        g = F.transform(g, lambda v: v.bitwiseXOR(t))
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, at: a * 2 + F.call_function("shiftright", F.get(g, at["i"]), at["b"]).bitwiseAND(F.lit(1)))

    return F.element_at(F.transform(F.array(gray), finish), 1)


def _ranked(docs: DataFrame, dims: list[str], doc_id: str, text: str, bits: int, cuts: list[list], hot_rows: int) -> DataFrame:
    """Distinct (doc_id, size, text_crc32, text_hash) of docs with n, its rows, curve, from, the rank of the first of them, and
    total, the number of all rows."""
    kinds = dict(docs.dtypes)
    axes = [quantised(ordered(d, kinds[d]), c, bits) for d, c in zip(dims, cuts, strict=True)]
    data = utf8(column(text))
    same = ["size", "text_crc32", "text_hash"]
    base = docs.select(*_identity(doc_id, data), *[a.alias(f"x{i}") for i, a in enumerate(axes)])
    packed = reduce(lambda a, b: a * (1 << bits) + b, [F.col(f"x{i}") for i in range(len(axes))])
    base = base.groupBy("doc_id", *same).agg(F.min(packed.cast("long")).alias("cell"), F.count("*").alias("n"))
    # rows of one text share the least of their cells; a text that is hot is numbered in many tasks
    texts = materialise(base.groupBy(*same).agg(F.min("cell").alias("_cell"), F.sum("n").alias("_n"), F.count("*").alias("_ids")).where("_ids > 1").drop("_ids"))
    base = small_join(base, texts, same).withColumn("cell", F.coalesce("_cell", "cell"))
    most = max(hot_rows, (texts.agg(F.sum("_n")).first()[0] or 0) // HOT_PART)
    hot = F.coalesce(F.col("_n") > most, F.lit(False))
    base = base.withColumn("sub", F.shiftrightunsigned("text_hash", 64 - SALT_BITS)).withColumn("apart", F.when(hot, F.col("text_hash")).otherwise(0)).withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / most).cast("long"))).otherwise(-1)).drop("_cell", "_n")

    part = ["cell", "sub", "apart", "salt"]
    tally = base.groupBy(*part).agg(F.sum("n").alias("n"))
    coordinates = [F.shiftrightunsigned("cell", bits * (len(axes) - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(len(axes))]
    cells = tally.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("curve", hilbert_index(coordinates, bits))
    wide = max(0, bits * len(axes) - 7)
    cells = cells.withColumn("stretch", F.shiftrightunsigned("curve", wide))  # at most 128 stretches of the curve
    before = lambda order, *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = cells.groupBy("stretch").agg(F.sum("n").alias("n"))
    stretches = stretches.select("stretch", F.coalesce(F.sum("n").over(before(["stretch"])), F.lit(0)).alias("to_stretch"), F.sum("n").over(Window.partitionBy()).alias("total"))
    cells = cells.withColumn("to_cell", F.coalesce(F.sum("n").over(before(["curve"], "stretch")), F.lit(0)))
    cells = cells.join(F.broadcast(stretches), "stretch").select("cell", "curve", "total", (F.col("to_stretch") + F.col("to_cell")).alias("to_cell"))
    tally = tally.withColumn("to_sub", F.coalesce(F.sum("n").over(before(["sub", "apart", "salt"], "cell")), F.lit(0)))
    few = F.broadcast if bits * len(axes) <= FEW_CELLS else lambda side: side.hint("merge")
    tally = tally.join(few(cells), "cell").select(*part, "curve", "total", (F.col("to_cell") + F.col("to_sub")).alias("to_sub"))

    within = Window.partitionBy(*part).orderBy("text_hash", "size", "text_crc32", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = base.withColumn("_to", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return numbered.join(tally, part).select("doc_id", *same, "n", "curve", "total", (F.col("to_sub") + F.col("_to")).alias("from"))


def _identity(doc_id: str, data: Column) -> list[Column]:
    return [column(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("text_hash")]


def _placed(shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank among total rows: runs of the order whose lengths differ by at most one."""
    shard = F.expr(f"(rank * {shards}L) div total")
    return shard.cast("int"), (F.col("rank") - F.expr(f"(((rank * {shards}L) div total) * total + {shards - 1}L) div {shards}L")).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("source", "lang", "n_chars"), doc_id: str = "doc_id", text: str = "text", bits: int = BITS, cuts: list[list] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    The dimensions are quantised at approximate quantiles, rows stand in order of the Hilbert index of their cell
    (in a cell by text and id) and the order is cut into `shards` runs, so a shard covers few values of each
    dimension and files of it prune on all of them. The law is `rows`: counts of shards differ by at most one.
    grown_shard is null under this law. Rows of equal texts stand together, in the first of their cells, so a group of them lies
    in one shard unless a cut falls inside it: at most shards - 1 groups are cut, as a hot one must be.

    The rank is never taken in one task: rows are counted by cell and sub-bucket, the counts are added up in three
    bounded steps, and only rows of a sub-bucket are numbered together; a text of over hot_rows rows has sub-buckets of its
    own. Rows of one id and text are one row with a count till the end, so repeated rows stay spread as well; ties have nothing
    left to tell them apart. Nulls: a null dimension is the first step of it; a null text has size 1 and CRC 0. A very
    long text is only hashed. Other columns are not read, whatever they are called. An empty table gives no rows."""
    dims_ = list(dims)
    cuts = cut_points(docs, dims_, bits) if cuts is None else cuts
    ranked = _ranked(docs, dims_, doc_id, text, bits, cuts, hot_rows)
    each = ranked.select("doc_id", "size", "text_crc32", "curve", "total", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("rank"))
    shard, slot = _placed(shards)
    return each.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_rows(docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("source", "lang", "n_chars"), doc_id: str = "doc_id", text: str = "text", bits: int = BITS, cuts: list[list] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Whole rows of docs, all columns, with shard and slot (see hilbert_shards); columns of docs of these names are replaced.

    Rows of one id and text are told apart by all their columns, in whose hash nulls count, and take the slots of that id and text
    in order of it. Rows that agree in all columns are one row with a count till the end. Whole rows are shuffled once, combined before;
    all that is numbered is numbered over hashes, in 64 parts of each id and text."""
    dims_ = list(dims)
    cuts = cut_points(docs, dims_, bits) if cuts is None else cuts
    name, key = ["doc_id", "size", "text_crc32", "text_hash"], ["_a", "_b"]
    two = lambda *cols: [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]
    ranked = _ranked(docs, dims_, doc_id, text, bits, cuts, hot_rows).select(*[c.alias(k) for c, k in zip(two(*name), key, strict=True)], "from", "total")
    data = utf8(column("_row", text))
    same = two(column("_row", doc_id), (F.octet_length(data) + 1).cast("long"), F.crc32(data), F.xxhash64(data))
    whole = [row_hash(*[column("_row", c) for c in docs.columns], types=[t for _, t in docs.dtypes], seed=k) for k in (0, 1)]
    rows = pack(docs).select("_row", *[c.alias(k) for c, k in zip([*same, *whole], [*key, "_w", "_x"], strict=True)])
    counts = rows.groupBy(*key, "_w", "_x").agg(F.count("*").alias("_n")).withColumn("_sub", F.shiftrightunsigned("_w", 58))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    to = lambda keys, order: F.coalesce(F.sum("_n").over(before(keys, order)), F.lit(0))
    parts = counts.groupBy(*key, "_sub").agg(F.sum("_n").alias("_n")).withColumn("_to", to(key, ["_sub"])).join(ranked, key)
    counts = counts.withColumn("_in", to([*key, "_sub"], ["_w", "_x"])).join(parts.drop("_n"), [*key, "_sub"])
    counts = counts.select(*key, "_w", "_x", "_n", "total", (F.col("from") + F.col("_to") + F.col("_in")).alias("from"))
    met = rows.groupBy(*key, "_w", "_x").agg(F.first("_row").alias("_row")).join(counts, [*key, "_w", "_x"])
    met = met.select("_row", "total", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("_n") - 1)).alias("rank"))
    shard, slot = _placed(shards)
    return met.select(*[column("_row", c).alias(c) for c in docs.columns if c not in ("shard", "slot")], shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """shard_rows(docs) as a Parquet table of a file for each shard, in order of shard and slot: a filter on the dimensions skips the
    files, and in them the row groups, whose least and greatest values lie outside of it. An empty table has no rows and one file."""
    rows = shard_rows(docs, shards, **options)
    rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").write.parquet(path)
