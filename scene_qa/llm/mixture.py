"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.llm.common import column, materialise, pack, small_join

#: Exponent on a source's share of the bytes when no weights are given: below 1 it lifts small sources.
ALPHA = 0.7


def repetition_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(source, rate): how often a document of a source should appear on average, so that sources' bytes come to
    the target weights and the total to `epochs` times the input's. weights(source, weight) need not sum to 1; a source
    that it lacks has weight 0, one that it names more than once the sum of its weights; null and negative weights are 0.
    Without it, the weight is the share of the bytes to the power alpha.

    The size of a row is its bytes plus 1, so empty texts count. Null is a source of its own."""
    sizes = docs.select(column(source).alias("source"), (F.octet_length(F.coalesce(column(text), F.lit(""))) + 1).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        positive = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum(positive).alias("_w"))
        weighed = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "size", F.coalesce("_w", F.lit(0.0)).alias("weight"))
    weighed = materialise(weighed)
    total = weighed.agg(F.sum("size").alias("sizes"), F.sum("weight").alias("weights")).first()
    if not total["weights"]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    per_weight = epochs * float(total["sizes"]) / float(total["weights"])
    return weighed.select("source", (F.col("weight") * F.lit(per_weight) / F.col("size")).alias("rate"))


def poisson_cdf(rate) -> "F.Column":
    """P(X <= k) for k = 0 .. rate + 12 sqrt(rate) + 30, past which less than a 2^-53rd is left.

    Right to 2 in 10^11 at a rate of 2,000, 3 in 10^9 at 20,000. A source's table is built in the square of its length: 4 seconds at
    20,000."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + F.exp(log_p)).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(1).cast("long"), last), start, step, lambda acc: acc["cdf"])
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0)))


def uniform(seed: int, *columns) -> "F.Column":
    """A number in [0, 1) that the seed and the columns decide: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _in_order(rows: DataFrame, key: Column) -> DataFrame:
    """rows in the global order of their hash _at, ties by key. A hash is spread evenly, so its range is cut into equal parts, one for
    each shuffle partition: no sample of the rows is needed to find the cuts, and they are made once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(parts - 1), F.floor((F.col("_at").cast("double") / float(1 << 64) + 0.5) * parts)).cast("int")  # rises with _at
    return rows.repartitionById(parts, part).sortWithinPartitions("_at", key)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = 17, counts: bool = False) -> DataFrame:
    """Each row of docs as often as a Poisson number with its source's rate says, all in a global random order.

    The number inverts the distribution at a hash of seed and doc_id: the same for any layout and any retry. A null id
    is hashed as such, repeated ids share their number, and the order is by a hash of seed, id and copy, ties by id. All
    columns stay, whatever they are called; with counts there are only doc_id, source, rate, copies and copy. A source of weight 0
    goes; very long texts are counted whole; an empty table gives no rows."""
    rates = materialise(repetition_rates(docs, source, text, weights, alpha, epochs).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), poisson_cdf(F.col("rate")).alias("_cdf")))
    packed = docs.select(column(doc_id).alias("doc_id"), column(source).alias("source")) if counts else docs
    doc_id, source = ("doc_id", "source") if counts else (doc_id, source)
    rows = pack(packed)
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), column("_row", source).cast("string")), F.lit("-")))
    rates = rates.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("-"))).drop("_source")
    rows = small_join(rows, rates, ["_key"], "inner", 20_000)
    key = column("_row", doc_id)
    u = uniform(seed, key)
    rows = rows.withColumn("_copies", F.size(F.filter("_cdf", lambda c: c <= u)).cast("long")).drop("_cdf", "_key")
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))))
    rows = _in_order(rows.withColumn("_at", F.xxhash64(F.lit(seed), key, F.col("_copy"))), key)
    if counts:
        return rows.select("_row.*", F.round("_rate", 6).alias("rate"), F.col("_copies").alias("copies"), F.col("_copy").alias("copy"))
    return rows.select("_row.*")
