"""Export records, balanced samples, training cells and step schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.functions.hashing import sha
from scene_qa.functions.joins import shuffled
from scene_qa.functions.ordering import hash_rank, permuted_heads
from scene_qa.operators.traces import soft_answer
from scene_qa.schemas import CELLS, FAMILIES


def verified_traces(questions: DataFrame, traces: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, trace_answer, trace_support, trace_steps, mask_evidence): the soft answer over all variants, the direct
    program's steps without its answer, the areas and the radius. The traces are read once, the evidence of an image is
    met once."""
    direct = F.max(F.when(F.col("program_variant") == "direct", F.struct(F.lit(1).alias("one"), F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))).alias("steps"))))["steps"]
    each = traces.groupBy("question_id").agg(F.collect_list("answer_distribution").alias("d"), direct.alias("trace_steps"))
    support, top = soft_answer(F.col("d"))
    shown = evidence.select("image_id", F.struct("area_pixels", "adjacency_radius").alias("mask_evidence"))
    return questions.select("question_id", "image_id").join(shuffled(each), "question_id").join(shuffled(shown), "image_id").select("question_id", top.alias("trace_answer"), support.alias("trace_support"), "trace_steps", "mask_evidence")


def assemble(questions: DataFrame, images: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Export records, and the violations (check, key): images listed twice or missing, files without a path or hash, splits that differ, answers outside
    the space, trace answers that are not the gold answer. images: image_id, image_path, mask_sha256, group_id, split."""
    twice = images.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated image").alias("check"), F.col("image_id").cast("string").alias("key"))
    once = images.withColumnRenamed("split", "image_split").dropDuplicates(["image_id"])
    rows = questions.withColumnRenamed("answer", "gold_answer").join(shuffled(once), "image_id", "left").join(shuffled(resolved), "question_id", "left")
    lost = F.col("image_path").isNull() | F.col("mask_sha256").isNull()
    problem = F.when(F.col("image_split").isNull(), "missing image").when(lost, "missing file").when(F.col("image_split") != F.col("split"), "split differs").when(~F.array_contains("answer_space", F.col("gold_answer")), "answer not in space").when(~F.col("trace_answer").eqNullSafe(F.col("gold_answer")), "trace is not gold")
    rows = rows.withColumn("_p", problem)
    return rows.where("_p is null").drop("_p", "image_split"), twice.union(rows.where("_p is not null").select(F.col("_p").alias("check"), F.col("question_id").alias("key")))


def family_gaps(questions: DataFrame, splits: tuple[str, ...] = ("train", "test"), families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(split, question_type, problem): families that a split lacks or has too many of."""
    every = questions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split")).select("split", F.explode(F.array(*map(F.lit, families))).alias("question_type"))
    have = questions.where(F.col("split").isin(*splits)).select("split", "question_type").distinct()
    return every.exceptAll(have).withColumn("problem", F.lit("missing")).union(have.join(every, ["split", "question_type"], "left_anti").withColumn("problem", F.lit("unknown")))


def balanced_sample(rows: DataFrame, k: int, seed: int, exact: bool = False) -> DataFrame:
    """k rows of each family, whatever the input's order; too few raise an error. By a seeded hash; with exact, by a seeded
    shuffle of the ids' ranks, for parity: the draws are made one after the other (see permuted_heads), and k ranks for each
    family are broadcast. Hash order is the form for tables of any size."""
    if exact:
        sizes = {r["question_type"]: r["n"] for r in rows.groupBy("question_type").agg(F.count("*").alias("n")).collect()}
        picks = permuted_heads(sizes, k, seed)
        chosen = F.inline(F.array(*[F.struct(F.lit(f).alias("question_type"), F.lit(r).cast("long").alias("_rank"), F.lit(i).cast("long").alias("position")) for f, ranks in picks.items() for i, r in enumerate(ranks)]))
        ranked = family_rank(rows, sizes)
        return ranked.join(F.broadcast(rows.sparkSession.range(1).select(chosen)), ["question_type", "_rank"]).drop("_rank")
    order = Window.partitionBy("question_type").orderBy(sha(str(seed), F.col("question_id")), "question_id")
    few = F.collect_set(F.when(F.col("n") < k, F.concat_ws("=", "question_type", F.col("n").cast("string"))))
    short = rows.groupBy("question_type").agg(F.count("*").alias("n")).agg(few.alias("few")).first()["few"]
    if short:
        raise ValueError(f"too few rows: {short}")
    # the bare rank, so that each task keeps k rows of a family before the shuffle
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).withColumn("position", (F.col("_nth") - 1).cast("long")).drop("_nth")


def family_rank(rows: DataFrame, sizes: dict[str, int], bucket_rows: int = 200_000) -> DataFrame:
    """rows with the rank of question_id inside its family. A family is cut into stretches of ids of about bucket_rows rows, by
    edges from a sample of about 100,000 ids chosen by a hash, which are ranked apart; the stretches' counts are added
    up. Any edges give the same ranks."""
    edges: dict[str, list[str]] = {}
    if max(sizes.values(), default=0) > bucket_rows:
        share = min(1.0, 100_000 / sum(sizes.values()))
        found: dict[str, list[str]] = {}
        for r in rows.where(F.pmod(F.xxhash64("question_id"), F.lit(1 << 30)) < share * (1 << 30)).select("question_type", "question_id").collect():
            found.setdefault(r.question_type, []).append(r.question_id)
        for family, ids in found.items():
            ids.sort()
            cuts = min(1024, -(-sizes[family] // bucket_rows))
            edges[family] = sorted({ids[k * len(ids) // cuts] for k in range(1, cuts)})
    if any(edges.values()):
        table = F.create_map(*[x for f, e in edges.items() if e for x in (F.lit(f), F.array(*map(F.lit, e)))])
        bucket = F.coalesce(F.size(F.filter(F.try_element_at(table, F.col("question_type")), lambda e: e <= F.col("question_id"))), F.lit(0))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("_b", F.greatest(bucket, F.lit(0)))
    counts = rows.groupBy("question_type", "_b").agg(F.count("*").alias("_n"))
    to = F.coalesce(F.sum("_n").over(Window.partitionBy("question_type").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("question_type", "_b").orderBy("question_id")) - 1
    return rows.withColumn("_i", inside).join(counts.withColumn("_to", to).drop("_n"), ["question_type", "_b"]).withColumn("_rank", (F.col("_i") + F.col("_to")).cast("long")).drop("_b", "_i", "_to")


def make_cells(rows: DataFrame, seed: int) -> DataFrame:
    """Four training rows for each record, in one seeded order that the cells share: position, cell, loss_support (PC: the
    whole sequence, AA: the answer), target_source, target_answer. A trace that is not gold, a gold answer outside the
    space, and an id that repeats raise an error."""
    sound = F.when((F.col("trace_answer") == F.col("gold_answer")) & F.array_contains("answer_space", F.col("gold_answer")), F.col("gold_answer")).otherwise(F.raise_error(F.concat(F.lit("unsound record "), F.col("question_id"))))
    twice = F.count("*").over(Window.partitionBy("question_id")) > 1
    once = F.when(twice, F.raise_error(F.concat(F.lit("repeated question "), F.col("question_id")))).otherwise(F.col("question_id"))
    rows = rows.withColumn("question_id", once)
    ordered = hash_rank(rows.withColumn("gold_answer", sound), sha(str(seed), F.col("question_id")), "question_id")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(c[:2]).alias("loss_support"), F.lit(c[3:]).alias("target_source")) for c in CELLS])).alias("_c")
    return ordered.select("*", cells).select(*[c for c in ordered.columns], "_c.*").withColumn("target_answer", F.when(F.col("target_source") == "Trace", F.col("trace_answer")).otherwise(F.col("gold_answer")))


def micro_steps(ordered: DataFrame, updates: int, accumulation: int) -> DataFrame:
    """ordered(position, ...) cycled for updates x accumulation steps: (step, update, position, ...). The update is the number
    of optimizer steps done once this one is."""
    n = ordered.count()
    steps = ordered.sparkSession.range(updates * accumulation if n else 0).select(F.col("id").alias("step"), F.expr(f"(id + 1) div {int(accumulation)}").alias("update"), (F.col("id") % max(1, n)).alias("position"))
    return steps.join(ordered, "position")
