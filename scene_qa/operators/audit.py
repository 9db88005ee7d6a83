"""Audit of question tables: balance, templates, drift, review samples. Checks return violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scene_qa.functions.binding import let
from scene_qa.functions.hashing import row_hash, sha
from scene_qa.operators.questions import decoded, difficulty, recompute_answer
from scene_qa.schemas import FAMILIES, SPLITS

#: The fields of a question that are compared.
FIELDS = ("image_id", "split", "question_type", "template_id", "question", "answer", "answer_space", "evidence")
#: Rows of a task that groups by id, about.
ID_ROWS = 250_000
SETS = {"total": [], "split": ["split"], "type": ["question_type"], "answer": ["answer"], "split_type": ["split", "question_type"], "split_type_answer": ["split", "question_type", "answer"], "split_type_template": ["split", "question_type", "template_id"]}


def distribution(questions: DataFrame) -> DataFrame:
    """Counts over seven grouping sets in one pass: (level, split, question_type, answer, template_id, n)."""
    dims = ["split", "question_type", "answer", "template_id"]
    grouped = questions.groupingSets([[F.col(c) for c in s] for s in SETS.values()], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    ids = {name: sum((c not in s) << (len(dims) - 1 - i) for i, c in enumerate(dims)) for name, s in SETS.items()}
    level = F.element_at(F.create_map(*[F.lit(x) for name, g in ids.items() for x in (g, name)]), F.col("_g").cast("int"))
    return grouped.select(level.alias("level"), *dims, "n")


def grid(questions: DataFrame, splits: tuple[str, ...] = SPLITS, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Counts by split and family, zero where there are none."""
    every = questions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split")).select("split", F.explode(F.array(*map(F.lit, families))).alias("question_type"))
    return every.join(questions.groupBy("split", "question_type").agg(F.count("*").alias("n")), ["split", "question_type"], "left").fillna(0, ["n"])


def report(questions: DataFrame, splits: tuple[str, ...] = SPLITS, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """distribution() of the known splits, with rows of zero for each split, and each split and family, that has no question;
    difficulty is that of the family. The total, and the levels without a split, count all rows."""
    found = distribution(questions).where(F.col("split").isNull() | F.col("split").isin(*splits))
    every = grid(questions, splits, families).where("n = 0")
    lacking = every.select(F.lit("split_type").alias("level"), "split", "question_type", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("template_id"), "n")
    bare = questions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split")).join(questions.select("split").distinct(), "split", "left_anti")
    bare = bare.select(F.lit("split").alias("level"), "split", *[F.lit(None).cast("string").alias(c) for c in ("question_type", "answer", "template_id")], F.lit(0).cast("long").alias("n"))
    return found.unionByName(lacking).unionByName(bare).withColumn("difficulty", difficulty(F.col("question_type")))


def input_violations(rows: DataFrame, required: tuple[str, ...], splits: tuple[str, ...] = SPLITS, collection: str | None = None) -> DataFrame:
    """(problem, split, n): unknown splits, and with `collection` (a column that says which split's table a row came from) rows
    whose own split is another. A missing column raises an error at once."""
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    other = F.lit(False) if collection is None else ~F.col("split").eqNullSafe(F.col(collection))
    problem = F.when(F.col("split").isNull() | ~F.col("split").isin(*splits), "unknown split").when(other, "split differs from its collection")
    return rows.select(problem.alias("problem"), "split").where("problem is not null").groupBy("problem", "split").agg(F.count("*").alias("n"))


def minimum_examples(questions: DataFrame, least: int, splits: tuple[str, ...] = ("val", "test"), families: tuple[str, ...] = FAMILIES) -> DataFrame:
    return grid(questions, splits, families).where(F.col("n") < least)


def majority_share(questions: DataFrame, most: float = 1.0) -> DataFrame:
    """Of each split and family: rows, the commonest answer's share, and whether it is strictly above `most`."""
    if not 0 <= most <= 1:
        raise ValueError("most must lie in 0..1")
    each = questions.groupBy("split", "question_type", "answer").agg(F.count("*").alias("n")).groupBy("split", "question_type").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    return each.select("split", "question_type", "n", (F.col("m") / F.col("n")).alias("share"), (F.col("m") / F.col("n") > most).alias("above"))


def degenerate_templates(questions: DataFrame) -> DataFrame:
    """Templates with two rows or more, over all splits, and one answer."""
    return questions.groupBy("template_id").agg(F.count("*").alias("n"), F.countDistinct("answer").alias("answers")).where("n >= 2 and answers = 1")


def ids_across_splits(questions: DataFrame, first: int | None = None, task_rows: int = ID_ROWS) -> DataFrame:
    """(question_id, splits) of ids that stand in more than one split. Rows are dealt by id over as many tasks as leave task_rows to
    each, and grouped there: what a task holds of them does not grow with the table."""
    rows = questions.select("question_id", "split")
    found = rows.repartition(max(1, -(-rows.count() // task_rows)), "question_id").distinct().groupBy("question_id").agg(F.count("*").alias("splits")).where("splits > 1")
    return found.orderBy("question_id").limit(first) if first else found


def evidence_violations(questions: DataFrame) -> DataFrame:
    """(question_id, problem): evidence that is empty, no JSON object, or leads to another answer."""
    questions, e = let(questions.select("question_id", "question_type", "answer", "evidence"), _e=decoded(F.col("evidence"))), F.col("_e")
    bare = F.trim(F.coalesce("evidence", F.lit("")))
    problem = F.when(bare.isin("", "{}"), "empty").when(~bare.startswith("{") | F.get_json_object("evidence", "$").isNull(), "not an object").when(~recompute_answer(F.col("question_type"), e).eqNullSafe(F.col("answer")), "answer differs")
    return questions.select("question_id", problem.alias("problem")).where("problem is not null")


def differences(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(question_id, field, old, new) wherever a stored table and a regenerated one differ. A row's fields are compared by
    one hash first, in which nulls count, and told apart only where that differs; evidence is compared decoded, so JSON spacing and key order do not
    count. A missing or extra id is field `question_id`; an id that is blank or repeated on either side is field `id`."""
    value = lambda f: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json("evidence", "map<string,string>"))))) if f == "evidence" else F.to_json(F.array(F.col(f))) if f == "answer_space" else F.col(f).cast("string")
    side = lambda df, name: df.select("question_id", F.struct(*[value(f).alias(f) for f in fields]).alias(name), row_hash(*[value(f) for f in fields]).alias(f"_{name}"))
    both = side(old, "old").join(side(new, "new"), "question_id", "full")
    one = both.where("old is null or new is null").select("question_id", F.lit("question_id").alias("field"), F.when(F.col("old").isNotNull(), F.col("question_id")).alias("old"), F.when(F.col("new").isNotNull(), F.col("question_id")).alias("new"))
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("old"), F.col(f"new.{f}").alias("new")) for f in fields]), lambda s: ~s["old"].eqNullSafe(s["new"]))).alias("d")
    changed = both.where("old is not null and new is not null and _old <> _new").select("question_id", each).select("question_id", "d.*")
    bad = old.select("question_id", F.lit("old").alias("side")).union(new.select("question_id", F.lit("new").alias("side"))).groupBy("question_id", "side").agg(F.count("*").alias("n")).where("n > 1 or question_id is null or trim(question_id) = ''")
    ids = bad.select("question_id", F.lit("id").alias("field"), F.when(F.col("side") == "old", F.col("n").cast("string")).alias("old"), F.when(F.col("side") == "new", F.col("n").cast("string")).alias("new"))
    return one.union(changed).union(ids)


def review_sample(questions: DataFrame, per_split: int = 100, seed: int = 20260615, most: int = 100) -> DataFrame:
    """The first min(per_split, most) questions of each split by a seeded hash; splits in order train, val, test."""
    if per_split < 0:
        raise ValueError("per_split must not be negative")
    order = Window.partitionBy("split").orderBy(sha(str(seed), F.col("split"), F.col("question_id")), "question_id")
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    return questions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(per_split, most)).orderBy(place, "rank")
