"""The registered queries of the library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.binding import let
from scene_qa.functions.hashing import sha
from scene_qa.functions.joins import shuffled
from scene_qa.functions.ordering import hash_rank
from scene_qa.functions.tables import materialise, scratch_path
from scene_qa.jobs import inputs
from scene_qa.operators import audit, dataset, diagnostics, masks, metrics, predictions, prepare, questions, reports, sequences, splits, tiles, traces, training_rows
from scene_qa.schemas import CLASSES, EVENTS, FAMILIES, PAIRS, SPLITS
from scene_qa.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _r(*names: str, digits: int = 8) -> list:
    return [F.round(n, digits).alias(n) for n in names]


_SPLIT = "CASE WHEN {0} % 5 < 3 THEN 'train' WHEN {0} % 5 = 3 THEN 'val' ELSE 'test' END"
_PRED = """p AS (SELECT doc_id::VARCHAR AS question_id, 'img-' || doc_id AS image_id, lang AS question_type, quality::VARCHAR AS answer, run, seed, doc_id * 37 % 101 / 100.0::DOUBLE AS confidence,
    (CASE run WHEN 'Zero-shot' THEN k % 2 WHEN 'PC-Ans' THEN (k // 100) % 2 WHEN 'PC-Trace' THEN (toxic + (k % 5 = 0)::INT) % 2 WHEN 'AA-Ans' THEN CASE WHEN k % 10 = 0 THEN 1 - quality ELSE quality END ELSE CASE WHEN k % 7 = 0 THEN 1 - quality ELSE quality END END)::INT::VARCHAR AS prediction
    FROM (SELECT d.*, quality, toxic, run, seed, n_chars + seed AS k FROM documents d JOIN labels USING (doc_id), (SELECT 'Zero-shot' AS run, 1 AS seed UNION ALL SELECT run, seed FROM (VALUES ('PC-Ans'), ('PC-Trace'), ('AA-Ans'), ('AA-Trace')) a(run), (VALUES (1), (2), (3)) b(seed)) r))"""
_METRICS = f"""WITH {_PRED}, f AS (SELECT *, unnest(['overall', question_type]) AS family FROM p),
    a AS (SELECT run, seed, family, count(*) AS count, avg((answer = prediction)::INT) AS accuracy FROM f GROUP BY ALL),
    l AS (SELECT run, seed, family, answer AS label, count(*) AS gold, 0 AS said, count(*) FILTER (answer = prediction) AS tp FROM f GROUP BY ALL UNION ALL SELECT run, seed, family, prediction, 0, count(*), 0 FROM f GROUP BY ALL),
    s AS (SELECT run, seed, family, label, sum(gold) AS gold, sum(said) AS said, sum(tp) AS tp FROM l GROUP BY ALL),
    m AS (SELECT run, seed, family, avg(2 * tp / (gold + said)) AS macro_f1, max(said) / sum(said) AS top_share, CASE WHEN count(*) > 1 THEN -sum(CASE WHEN said > 0 THEN q * ln(q) ELSE 0 END) / ln(count(*)) ELSE 0 END AS entropy FROM (SELECT *, said / sum(said) OVER (PARTITION BY run, seed, family) AS q FROM s) GROUP BY ALL),
    b AS (SELECT run, seed, family, least(9, floor(confidence * 10)) AS bin, abs(sum(confidence) - sum((answer = prediction)::INT)) AS gap, count(*) AS n FROM f GROUP BY ALL),
    e AS (SELECT run, seed, family, sum(gap) / sum(n) AS ece FROM b GROUP BY ALL),
    metrics AS (SELECT * FROM a JOIN m USING (run, seed, family) JOIN e USING (run, seed, family))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_metrics(inputs.predictions(spark, sf_dir), ["run", "seed"])


@query(_METRICS + " SELECT run, seed, family, count, round(accuracy, 8) AS accuracy, round(macro_f1, 8) AS macro_f1, round(ece, 8) AS ece, round(top_share, 8) AS top_share, round(entropy, 8) + 0.0 AS entropy FROM metrics")
def run_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("run", "seed", "family", "count", *_r(*metrics.METRICS))


@query(_METRICS + ", u AS (UNPIVOT (SELECT run, seed, family, accuracy, macro_f1, ece, top_share, entropy FROM metrics) ON accuracy, macro_f1, ece, top_share, entropy INTO NAME metric VALUE value) SELECT run AS cell, family, metric, count(value) AS seeds, round(avg(value), 8) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END, 8) AS std FROM u GROUP BY ALL")
def seed_summary(spark, sf_dir):
    return metrics.over_seeds(_metrics(spark, sf_dir).withColumnRenamed("run", "cell"), ["cell"]).select("cell", "family", "metric", "seeds", *_r("mean", "std"))


@query(_METRICS + ", g AS (SELECT seed, sum(CASE WHEN run LIKE 'AA%' THEN accuracy ELSE -accuracy END) / 2 AS gap FROM metrics WHERE family = 'overall' AND run <> 'Zero-shot' GROUP BY seed HAVING count(*) = 4) SELECT 'rules' AS backbone, count(*) AS seeds, round(avg(gap), 8) AS mean, round(stddev_samp(gap), 8) AS std FROM g")
def alignment_gap(spark, sf_dir):
    cells = _metrics(spark, sf_dir).withColumnRenamed("run", "cell").withColumn("backbone", F.lit("rules"))
    return metrics.alignment_gap(cells, ["backbone"]).select("backbone", "seeds", *_r("mean", "std"))


@query(f"WITH {_PRED} SELECT run, seed, question_type, answer, prediction, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrices(spark, sf_dir):
    return metrics.confusion(inputs.predictions(spark, sf_dir), ["run", "seed"])


@query(_METRICS + " SELECT run, seed, round(min(top_share) FILTER (family <> 'overall'), 8) AS least_share, round(max(top_share) FILTER (family <> 'overall'), 8) AS greatest_share, round(max(entropy) FILTER (family = 'overall'), 8) AS entropy FROM metrics GROUP BY ALL")
def prediction_behavior(spark, sf_dir):
    return reports.prediction_behavior(_metrics(spark, sf_dir), ["run", "seed"]).select("run", "seed", *_r("least_share", "greatest_share", "entropy"))


@query(_METRICS + " SELECT run, round(accuracy * 100, 2) AS accuracy, round(macro_f1 * 100, 2) AS macro_f1, round(ece * 100, 2) AS ece FROM metrics WHERE family = 'overall' AND seed = 1")
def method_by_metric(spark, sf_dir):
    return reports.method_by_metric(_metrics(spark, sf_dir).where("seed = 1"))


@query(_METRICS + " SELECT run, " + ", ".join(f"round(max(accuracy) FILTER (family = '{x}') * 100, 2) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM metrics WHERE seed = 1 GROUP BY run")
def method_by_family(spark, sf_dir):
    return reports.method_by_family(_metrics(spark, sf_dir).where("seed = 1"), ["de", "en", "es", "fr"])


_CASES = f"""WITH {_PRED}, w AS (SELECT question_id, question_type, answer, max(prediction) FILTER (run = 'Zero-shot') AS z, max(prediction) FILTER (run = 'AA-Ans' AND seed = 1) AS a, max(prediction) FILTER (run = 'AA-Trace' AND seed = 1) AS t, max(prediction) FILTER (run = 'AA-Ans' AND seed = 2) AS s FROM p GROUP BY ALL),
    c AS (SELECT *, z <> answer AND a = answer AS fixes_zero_shot, a <> answer AND t = answer AS trace_helps, a = answer AND t <> answer AS trace_hurts, a <> answer AND t <> answer AS remaining_hard, a <> s AS seed_disagreements FROM w)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = inputs.predictions(spark, sf_dir).where("seed = 1 or (seed = 2 and run = 'AA-Ans')").withColumn("run", F.when(F.col("seed") == 2, "AA-Ans-second-seed").otherwise(F.col("run")))
    return diagnostics.case_events(predictions.paired(runs, ("Zero-shot", "AA-Ans", "AA-Trace", "AA-Ans-second-seed")), "AA-Ans-second-seed")


@query(_CASES + " SELECT question_id, question_type, answer, " + ", ".join(EVENTS) + " FROM c")
def case_events(spark, sf_dir):
    return _cases(spark, sf_dir).select("question_id", "question_type", "answer", *EVENTS)


@query(_CASES + ", f AS (SELECT unnest(['overall', question_type]) AS family, * FROM c) SELECT family, " + ", ".join(f"sum({e}::INT) AS {e}" for e in EVENTS) + " FROM f GROUP BY family")
def event_totals(spark, sf_dir):
    return diagnostics.event_totals(_cases(spark, sf_dir))


@query(_CASES + ", u AS (UNPIVOT c ON " + ", ".join(EVENTS) + " INTO NAME category VALUE hit) SELECT category, question_type, question_id, row_number() OVER (PARTITION BY category, question_type ORDER BY question_id) AS rank FROM u WHERE hit QUALIFY rank <= 2")
def representative_cases(spark, sf_dir):
    return diagnostics.representative_cases(_cases(spark, sf_dir))


@query(f"WITH {_PRED}, x AS (SELECT * REPLACE (CASE WHEN run = 'AA-Trace' AND question_id::INT % 11 = 0 THEN '?' ELSE question_type END AS question_type) FROM p WHERE seed = 1 AND NOT (run = 'PC-Ans' AND question_id::INT % 13 = 0)), g AS (SELECT question_id, count(*) AS n, count(DISTINCT run) AS r, count(DISTINCT (image_id, answer, question_type)) AS k FROM x GROUP BY 1) SELECT question_id, CASE WHEN n > r THEN 'repeated' WHEN r < 5 THEN 'missing in a run' ELSE 'differs between runs' END AS problem FROM g WHERE n > r OR r < 5 OR k > 1")
def membership_violations(spark, sf_dir):
    """Runs with planted faults: families changed in one run, rows missing in another."""
    rows = inputs.predictions(spark, sf_dir).where("seed = 1 and not (run = 'PC-Ans' and cast(question_id as int) % 13 = 0)")
    rows = rows.withColumn("question_type", F.expr("if(run = 'AA-Trace' and cast(question_id as int) % 11 = 0, '?', question_type)"))
    return predictions.membership_violations(rows)


_RECORDS = _CASES + """, d AS (SELECT doc_id::VARCHAR AS question_id, doc_id AS i, n_chars % 7 AS tree, n_chars % 5 AS water FROM documents),
    j AS (SELECT c.*, i, tree, water FROM c JOIN d USING (question_id))"""


def _with_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases and records of the same documents; every 17th has no record, every 19th one of another image."""
    cases = _cases(spark, sf_dir)
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question_id"), "doc_id", "n_chars")
    gold = F.col("answer")
    other = F.when(gold == "0", "1").otherwise("0")
    areas = F.create_map(F.lit("tree"), F.col("n_chars") % 7, F.lit("water"), F.col("n_chars") % 5).cast("map<string,bigint>")
    image = F.when(F.col("doc_id") % 19 == 0, "else").otherwise(F.col("image_id"))
    records = cases.join(docs, "question_id").where("doc_id % 17 <> 0").select("question_id", image.alias("image_id"), "question_type", gold.alias("gold_answer"), gold.alias("trace_answer"), F.create_map(gold, F.lit(0.75), other, F.lit(0.25)).alias("trace_support"), F.struct(areas.alias("area_pixels")).alias("mask_evidence"))
    return diagnostics.with_records(cases, records)


@query(_RECORDS + " SELECT question_id, answer AS trace_answer, trace_hurts, CASE WHEN tree + water > 0 THEN round(abs(tree - water) / (tree + water)::DOUBLE, 8) END AS area_margin, 0.75::DOUBLE AS gold_support, 0.5::DOUBLE AS support_margin FROM j WHERE i % 17 <> 0 AND i % 19 <> 0")
def case_records(spark, sf_dir):
    return _with_records(spark, sf_dir)[0].select("question_id", "trace_answer", "trace_hurts", *_r("area_margin", "gold_support", "support_margin"))


@query(_RECORDS + " SELECT question_id, CASE WHEN i % 17 = 0 THEN 'no record' ELSE 'identity differs' END AS problem FROM j WHERE i % 17 = 0 OR i % 19 = 0")
def case_record_violations(spark, sf_dir):
    return _with_records(spark, sf_dir)[1]


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark)
    tables.write_jsonl(inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"), path)
    return tables.read_jsonl(spark, path, "doc_id long, lang string, source string, n_chars long, text string")


@query("SELECT conv_id, turn, role, text FROM conversations")
def csv_round_trip(spark, sf_dir):
    path, rows = scratch_path(spark), inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


def _run_tree(spark: SparkSession, rows: DataFrame) -> str:
    """Predictions as a run tree: a folder for each of the thirteen runs. The hash of a run's test set is that of the sum of its
    questions' hashes."""
    root, rows = scratch_path(spark), materialise(rows)
    number = F.conv(F.substring(sha(F.col("question_id"), F.col("answer")), 1, 12), 16, 10).cast("decimal(20,0)")
    sets = rows.groupBy("run", "seed").agg(F.sha2(F.sum(number).cast("string").cast("binary"), 256).alias("test"), F.count("*").alias("n"))
    stated = {(r.run, r.seed): r for r in sets.collect()}  # a row for each run
    for cell, seed in inputs.RUN_SEEDS:
        folder = f"{root}/rules/seed{seed}/{cell}/eval_candidate"
        tables.write_jsonl(rows.where((F.col("run") == cell) & (F.col("seed") == seed)).drop("run", "seed"), f"{folder}/predictions.jsonl")
        tables.write_manifest(spark, {"protocol": "v1", "test_sha256": stated[cell, seed].test, "count": stated[cell, seed].n}, f"{folder}/meta.json")
    return root


@query(f"WITH {_PRED} SELECT question_id, image_id, question_type, answer, prediction, confidence, 'rules' AS backbone, run AS cell, seed, 'candidate' AS mode FROM p")
def run_tree_round_trip(spark, sf_dir):
    return tables.read_runs(spark, _run_tree(spark, inputs.predictions(spark, sf_dir))).drop("candidate_scores", "generated_text")


@query(f"""WITH {_PRED}, h AS (SELECT run, seed, count(*) AS n, sha256(sum(('0x' || substr(sha256(question_id || chr(0) || answer), 1, 12))::UBIGINT::HUGEINT)::VARCHAR) AS test
    FROM p WHERE run <> 'AA-Trace' OR seed <> 3 OR question_id::BIGINT % 11 <> 0 GROUP BY ALL) SELECT 'rules' AS backbone, 'candidate' AS mode, count(DISTINCT test) AS hashes, min(test) AS test_sha256, count(*) AS runs, sum(n)::BIGINT AS stated FROM h""")
def run_metadata(spark, sf_dir):
    """Metadata of the run tree, in which one run was scored on another test set."""
    other = (F.col("run") == "AA-Trace") & (F.col("seed") == 3) & (F.col("question_id").cast("long") % 11 == 0)
    meta = tables.read_run_meta(spark, _run_tree(spark, inputs.predictions(spark, sf_dir).where(~other)))
    return predictions.run_hashes(meta).crossJoin(meta.agg(F.count("*").alias("runs"), F.sum("count").alias("stated")))  # one row


_MASK = f"m AS (SELECT vec_id AS image_id, p, {list(inputs.CLASS_OF_TENTH)}[1 + least(9, greatest(0, floor((x::DOUBLE + 0.5) * 10)))::INT] AS c FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS p FROM embeddings))"
_NAMES = f"names AS (SELECT unnest({list(CLASSES)}) AS name, unnest(range(0, 10)) AS c)"
_AREAS = f"{_MASK}, {_NAMES}, v AS (SELECT vec_id AS image_id, name, names.c, count(m.p) AS area FROM embeddings CROSS JOIN names LEFT JOIN m ON m.image_id = vec_id AND m.c = names.c GROUP BY ALL)"


@query(f"WITH {_AREAS} SELECT image_id, c AS class_id, area FROM v WHERE area > 0")
def mask_histogram(spark, sf_dir):
    return masks.histogram_relational(inputs.mask_table(spark, sf_dir))


@query(f"WITH {_AREAS} SELECT image_id, name AS class_name, area > 0 AS present, area AS area_pixels, area / 64.0::DOUBLE AS area_ratio, CASE WHEN area = 0 THEN 'none' WHEN area / 64.0::DOUBLE <= 0.05 THEN 'low' WHEN area / 64.0::DOUBLE <= 0.2 THEN 'medium' ELSE 'high' END AS ratio_category FROM v")
def mask_evidence(spark, sf_dir):
    e = inputs.evidence(spark, sf_dir)
    return e.select("image_id", F.explode("area_pixels").alias("class_name", "area_pixels"), "presence", "area_ratio", "ratio_categories").select("image_id", "class_name", F.col("presence")[F.col("class_name")].alias("present"), "area_pixels", F.col("area_ratio")[F.col("class_name")].alias("area_ratio"), F.col("ratio_categories")[F.col("class_name")].alias("ratio_category"))


@query(f"WITH {_AREAS} SELECT image_id, arg_max(name, (area, -c)) AS dominant_class FROM v GROUP BY image_id")
def dominant_class(spark, sf_dir):
    return inputs.evidence(spark, sf_dir).select("image_id", "dominant_class")


def _touch(radius: int) -> str:
    return f"SELECT DISTINCT x.image_id, x.c AS a, y.c AS b FROM m x JOIN m y ON x.image_id = y.image_id AND x.c < y.c AND abs(x.p // 8 - y.p // 8) <= {radius} AND abs(x.p % 8 - y.p % 8) <= {radius}"


def _adjacent(spark: SparkSession, sf_dir: str, radius: int) -> DataFrame:
    return _pairs_of(masks.measure(inputs.mask_table(spark, sf_dir), radius))


def _pairs_of(measured: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS])
    return measured.select("image_id", F.inline(F.arrays_zip("adjacent", pairs.alias("pair")))).where("adjacent").select("image_id", "pair.a", "pair.b")


def _tiled(spark: SparkSession, sf_dir: str, height: int, width: int, radius: int) -> DataFrame:
    """Evidence of the masks from a table of their tiles."""
    cut = materialise(tiles.tile_masks(inputs.mask_table(spark, sf_dir), height, width))
    return tiles.measure_tiles(cut, height, width, radius)


@query(f"WITH {_MASK} {_touch(1)}")
def mask_adjacency(spark, sf_dir):
    return _adjacent(spark, sf_dir, 1)


@query(f"WITH {_MASK} {_touch(2)}")
def mask_adjacency_radius_2(spark, sf_dir):
    return _adjacent(spark, sf_dir, 2)


@query(f"WITH {_MASK} {_touch(1)}")
def mask_adjacency_join(spark, sf_dir):
    return masks.adjacency_relational(inputs.mask_table(spark, sf_dir), 1)


@query(f"WITH {_MASK} {_touch(1)}")
def tile_adjacency(spark, sf_dir):
    return _pairs_of(_tiled(spark, sf_dir, 3, 3, 1))


@query(f"WITH {_MASK} {_touch(2)}")
def tile_adjacency_radius_2(spark, sf_dir):
    return _pairs_of(_tiled(spark, sf_dir, 1, 5, 2))


@query(f"WITH {_AREAS} SELECT image_id, 8 AS height, 8 AS width, c AS class_id, area, 0 AS bad_labels FROM v")
def tile_histogram(spark, sf_dir):
    found = _tiled(spark, sf_dir, 5, 2, 0)
    return found.select("image_id", "height", "width", F.posexplode("counts").alias("class_id", "area"), "bad_labels")


def _pick(purpose: str, family: str, n: int) -> str:
    return f"(('0x' || substr(sha256('20260615' || chr(0) || image_id || chr(0) || {family} || chr(0) || '{purpose}'), 1, 16))::UBIGINT % {n})::INT"


_QUESTIONS = f"""WITH {_AREAS}, touch AS (SELECT DISTINCT image_id FROM ({_touch(1)}) WHERE a = 3 AND b = 5),
    e AS (SELECT v.image_id, map_from_entries(list((name, area))) AS area, arg_max(name, (area, -c)) AS dominant, bool_or(t.image_id IS NOT NULL) AS touch FROM v LEFT JOIN touch t ON t.image_id = v.image_id GROUP BY ALL),
    f AS (SELECT *, {_SPLIT.format('image_id')} AS split, unnest({list(FAMILIES)}) AS question_type FROM e),
    n AS (SELECT *, {_pick('template', 'question_type', 3)} + 1 AS t, {list(CLASSES[1:])}[1 + {_pick('class', "'presence'", 9)}] AS cls FROM f),
    q AS (SELECT *, question_type || '-' || t AS template_id, CASE question_type WHEN 'presence' THEN CASE WHEN area[cls] > 0 THEN 'yes' ELSE 'no' END WHEN 'damage_state' THEN CASE WHEN area['building_flooded'] > 0 OR area['road_flooded'] > 0 THEN 'damage_present' ELSE 'no_damage' END
        WHEN 'area_comparison' THEN CASE WHEN area['road_flooded'] > area['road_non_flooded'] THEN 'road_flooded' WHEN area['road_flooded'] < area['road_non_flooded'] THEN 'road_non_flooded' ELSE 'equal' END
        WHEN 'spatial_adjacency' THEN CASE WHEN touch THEN 'yes' ELSE 'no' END WHEN 'dominant_class' THEN dominant ELSE CASE WHEN touch AND area['road_flooded'] > 0 THEN 'yes' ELSE 'no' END END AS answer FROM n),
    questions AS (SELECT *, question_type || '-' || substr(sha256(image_id || chr(0) || split || chr(0) || question_type || chr(0) || template_id), 1, 20) AS question_id FROM q)"""


@query(_QUESTIONS + " SELECT question_id, image_id, split, question_type, template_id, answer FROM questions")
def generated_questions(spark, sf_dir):
    return inputs.question_table(spark, sf_dir).select("question_id", "image_id", "split", "question_type", "template_id", "answer")


@query(_QUESTIONS + " SELECT question_id, CASE WHEN image_id % 7 = 1 THEN 'empty' ELSE 'answer differs' END AS problem FROM questions WHERE image_id % 7 <= 1")
def evidence_violations(spark, sf_dir):
    """Questions with planted faults: wrong answers, and evidence that is gone."""
    rows = inputs.question_table(spark, sf_dir).withColumn("answer", F.when(F.col("image_id") % 7 == 0, "wrong").otherwise(F.col("answer"))).withColumn("evidence", F.when(F.col("image_id") % 7 == 1, "{}").otherwise(F.col("evidence")))
    return audit.evidence_violations(rows)


@query(_QUESTIONS + """ SELECT question_id, 'answer' AS field, answer AS old, 'wrong' AS new FROM questions WHERE image_id % 7 = 0 UNION ALL SELECT question_id, 'question_id', question_id, NULL FROM questions WHERE image_id % 7 = 1
    UNION ALL SELECT question_id, 'template_id', template_id, NULL FROM questions WHERE image_id % 7 = 2 UNION ALL SELECT question_id, 'question', NULL, template_id FROM questions WHERE image_id % 7 = 2""")
def regenerated_differences(spark, sf_dir):
    """Wrong answers, questions that are gone, and a value that stands in the field beside its own, whose is null."""
    moved = lambda held, here: F.when(F.col("image_id") % 7 == 2, F.col("template_id") if here else F.lit(None).cast("string")).otherwise(F.col(held))
    rows = inputs.question_table(spark, sf_dir)
    rows, changed = rows.withColumn("question", moved("question", False)), rows.withColumn("question", moved("question", True)).withColumn("template_id", moved("template_id", False))
    changed = changed.where("image_id % 7 <> 1").withColumn("answer", F.when(F.col("image_id") % 7 == 0, "wrong").otherwise(F.col("answer")))
    return audit.differences(rows, changed)


_KEYS = {f: ",".join(sorted([*questions.field_names(f), "expected_answer"])) for f in FAMILIES}


def _of(families: str, value: str) -> str:
    return "CASE WHEN question_type IN (" + ", ".join(f"'{f}'" for f in families.split()) + f") THEN {value} END"


@query(_QUESTIONS + " SELECT question_id, CASE question_type " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in _KEYS.items()) + " END AS keys, answer AS expected_answer, " + ", ".join(f"{_of(f, v)} AS {n}" for n, f, v in (
    ("class_name", "presence", "cls"), ("present", "presence", "area[cls] > 0"), ("area_ratio", "presence", "area[cls] / 64.0::DOUBLE"),
    ("building_flooded_present", "damage_state", "area['building_flooded'] > 0"), ("road_flooded_present", "damage_state logical_conjunction", "area['road_flooded'] > 0"),
    ("first_class", "area_comparison spatial_adjacency", "'road_flooded'"), ("second_area_pixels", "area_comparison", "area['road_non_flooded']"),
    ("adjacent", "spatial_adjacency", "touch"), ("adjacency_radius", "spatial_adjacency logical_conjunction", "1"), ("dominant_area_pixels", "dominant_class", "area[dominant]"), ("road_flooded_water_adjacent", "logical_conjunction", "touch"))) + " FROM questions")
def evidence_json(spark, sf_dir):
    """The evidence of each question, decoded, and the keys that its JSON holds, in their order."""
    e = questions.decoded(F.col("evidence"))
    names = ("expected_answer", "class_name", "present", "area_ratio", "building_flooded_present", "road_flooded_present", "first_class", "second_area_pixels", "adjacent", "adjacency_radius", "dominant_area_pixels", "road_flooded_water_adjacent")
    return inputs.question_table(spark, sf_dir).select("question_id", F.array_join(F.json_object_keys("evidence"), ",").alias("keys"), e.alias("e")).select("question_id", "keys", *[F.col(f"e.{n}") for n in names])


@query(_QUESTIONS + " SELECT question_id, CASE WHEN question_type IN ('area_comparison', 'logical_conjunction') THEN 'compositional' WHEN question_type = 'dominant_class' THEN 'multiclass' ELSE 'binary' END AS difficulty FROM questions")
def question_difficulty(spark, sf_dir):
    return inputs.question_table(spark, sf_dir).select("question_id", questions.difficulty(F.col("question_type")).alias("difficulty"))


_ROWS = "a AS (SELECT l_orderkey || '-' || l_suppkey AS question_id, CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'val' ELSE 'test' END AS split, CASE l_linestatus WHEN 'O' THEN 'presence' ELSE 'damage_state' END AS question_type, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS answer, l_linestatus || '-' || l_linenumber AS template_id FROM lineitem)"


@query(f"WITH {_ROWS} SELECT CASE grouping(split, question_type, answer, template_id) WHEN 15 THEN 'total' WHEN 7 THEN 'split' WHEN 11 THEN 'type' WHEN 13 THEN 'answer' WHEN 3 THEN 'split_type' WHEN 1 THEN 'split_type_answer' ELSE 'split_type_template' END AS level, split, question_type, answer, template_id, count(*) AS n FROM a GROUP BY GROUPING SETS ((), (split), (question_type), (answer), (split, question_type), (split, question_type, answer), (split, question_type, template_id))")
def question_distribution(spark, sf_dir):
    return audit.distribution(inputs.audit_rows(spark, sf_dir))


@query(f"WITH {_ROWS}, s AS (SELECT * FROM (SELECT unnest(['train', 'val', 'test']) AS split), (SELECT unnest({list(FAMILIES)}) AS question_type)) SELECT s.split, s.question_type, count(a.answer) AS n, CASE WHEN s.question_type IN ('area_comparison', 'logical_conjunction') THEN 'compositional' WHEN s.question_type = 'dominant_class' THEN 'multiclass' ELSE 'binary' END AS difficulty FROM s LEFT JOIN a USING (split, question_type) GROUP BY ALL")
def question_grid(spark, sf_dir):
    """The split and family level of the audit report, with its zeros."""
    return audit.report(inputs.audit_rows(spark, sf_dir)).where("level = 'split_type'").select("split", "question_type", "n", "difficulty")


@query(f"WITH {_ROWS} SELECT 'unknown split' AS problem, 'x' AS split, count(*) AS n FROM a WHERE template_id LIKE '%-3' UNION ALL SELECT 'split differs from its collection', split, count(*) FROM a WHERE template_id NOT LIKE '%-3' AND split <> 'train' GROUP BY split")
def input_violations(spark, sf_dir):
    """All rows offered as the train collection, those of every template 3 with a split that is none."""
    rows = inputs.audit_rows(spark, sf_dir).withColumn("split", F.when(F.col("template_id").endswith("-3"), "x").otherwise(F.col("split"))).withColumn("collection", F.lit("train"))
    return audit.input_violations(rows, ("question_id", "split"), collection="collection")


@query(f"WITH {_ROWS} SELECT question_id, count(DISTINCT split) AS splits FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1 ORDER BY question_id LIMIT 5")
def first_ids_across_splits(spark, sf_dir):
    return audit.ids_across_splits(inputs.audit_rows(spark, sf_dir), first=5)


@query(f"WITH {_ROWS}, g AS (SELECT split, question_type, answer, count(*) AS c FROM a GROUP BY ALL) SELECT split, question_type, sum(c) AS n, round(max(c) / sum(c), 8) AS share, max(c) / sum(c) > 0.4 AS above FROM g GROUP BY ALL")
def majority_share(spark, sf_dir):
    return audit.majority_share(inputs.audit_rows(spark, sf_dir), 0.4).select("split", "question_type", "n", *_r("share"), "above")


@query(f"WITH {_ROWS}, s AS (SELECT * FROM (SELECT unnest(['val', 'test']) AS split), (SELECT unnest({list(FAMILIES)}) AS question_type)), g AS (SELECT s.split, s.question_type, count(a.answer) AS n FROM s LEFT JOIN a USING (split, question_type) GROUP BY ALL) SELECT * FROM g WHERE n < 5000")
def minimum_examples(spark, sf_dir):
    return audit.minimum_examples(inputs.audit_rows(spark, sf_dir), 5000)


@query("SELECT o_orderkey::VARCHAR AS template_id, count(*) AS n, count(DISTINCT l_linestatus) AS answers FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_linestatus) = 1")
def degenerate_templates(spark, sf_dir):
    """Orders as templates, line status as the answer."""
    rows = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("template_id"), F.col("l_linestatus").alias("answer"))
    return audit.degenerate_templates(rows)


@query(f"WITH {_ROWS} SELECT question_id, count(DISTINCT split) AS splits FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1")
def ids_across_splits(spark, sf_dir):
    return audit.ids_across_splits(inputs.audit_rows(spark, sf_dir))


@query(f"WITH d AS (SELECT doc_id::VARCHAR AS question_id, {_SPLIT.format('doc_id')} AS split FROM documents) SELECT question_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('7' || chr(0) || split || chr(0) || question_id)) AS rank FROM d QUALIFY rank <= 50")
def review_sample(spark, sf_dir):
    return audit.review_sample(inputs.export_rows(spark, sf_dir), 50, 7).select("question_id", "split", "rank")


_SEQ = "r AS (SELECT event_id AS image_id, ts, CASE event_type WHEN 'purchase' THEN 'cam-b' ELSE 'cam-a' END AS cam FROM events), g AS (SELECT *, sum(CASE WHEN lag IS NULL THEN 0 WHEN epoch_us(ts) - epoch_us(lag) > {0} * 1000000 OR cam <> was THEN 1 ELSE 0 END) OVER (ORDER BY ts, image_id) AS group_no FROM (SELECT *, lag(ts) OVER o AS lag, lag(cam) OVER o AS was FROM r WINDOW o AS (ORDER BY ts, image_id)))"


@query(f"WITH {_SEQ.format(300)} SELECT image_id, group_no, 'seq-' || lpad(group_no::VARCHAR, greatest(5, length(group_no::VARCHAR))::INT, '0') AS group_id FROM g")
def capture_sequences(spark, sf_dir):
    return sequences.group_sequences(inputs.image_records(spark, sf_dir), 300).select("image_id", "group_no", "group_id")


@query(f"WITH {_SEQ.format(300)} SELECT 'seq-' || lpad(group_no::VARCHAR, greatest(5, length(group_no::VARCHAR))::INT, '0') AS group_id, min(cam) AS camera_model, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS image_count, string_agg(image_id::VARCHAR, ',' ORDER BY ts, image_id) AS members FROM g GROUP BY group_no")
def sequence_table(spark, sf_dir):
    t = sequences.sequence_table(sequences.group_sequences(inputs.image_records(spark, sf_dir), 300))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.select("group_id", "camera_model", us("start_time").alias("start_us"), us("end_time").alias("end_us"), "image_count", F.array_join(F.transform("image_ids", lambda x: x.cast("string")), ",").alias("members"))


@query(f"WITH {_SEQ.format(900)}, n AS (SELECT *, (row_number() OVER (PARTITION BY group_no ORDER BY ts, image_id) - 1) // 7 AS page FROM g) SELECT 'seq-' || lpad(group_no::VARCHAR, greatest(5, length(group_no::VARCHAR))::INT, '0') AS group_id, page, string_agg(image_id::VARCHAR, ',' ORDER BY ts, image_id) AS members FROM n GROUP BY group_no, page")
def sequence_pages(spark, sf_dir):
    pages = sequences.sequence_pages(sequences.group_sequences(inputs.image_records(spark, sf_dir), 900), 7)
    return pages.select("group_id", "page", F.array_join(F.transform("image_ids", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"(WITH {_SEQ.format(g)}, s AS (SELECT group_no, count(*) AS n FROM g GROUP BY 1) SELECT {g}.0::DOUBLE AS gap_seconds, count(*) AS groups, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round(avg(n), 8) AS mean_size FROM s)" for g in (60, 300, 900)) + ")")
def gap_sensitivity(spark, sf_dir):
    return sequences.gap_summary(inputs.image_records(spark, sf_dir), [60, 300, 900]).select("gap_seconds", "groups", "singletons", "largest", *_r("mean_size"))


_GROUP = "'seq-' || lpad(group_no::VARCHAR, greatest(5, length(group_no::VARCHAR))::INT, '0')"
_FIFTH = "CASE WHEN group_no % 5 < 3 THEN 'train' WHEN group_no % 5 = 3 THEN 'val' ELSE 'test' END"


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Capture sequences, and a split for each by its number."""
    records = inputs.image_records(spark, sf_dir).withColumns({"original_split": F.lit("train"), "image_path": F.concat(F.lit("img/"), F.col("image_id").cast("string")), "mask_path": F.concat(F.lit("mask/"), F.col("image_id").cast("string"))})
    grouped = sequences.group_sequences(records, 900)
    return grouped, grouped.select("group_id", inputs.split_of(F.col("group_no")).alias("split")).distinct()


@query(f"WITH {_SEQ.format(900)}, {_AREAS}, w AS (SELECT image_id, " + ", ".join(f"max(area) FILTER (c = {k}) AS class_{k}_pixels" for k in range(10)) + f" FROM v GROUP BY image_id) SELECT g.image_id, {_GROUP} AS group_id, {_FIFTH} AS split, 'train' AS original_split, 'img/' || g.image_id AS image_path, 'mask/' || g.image_id AS mask_path, cam AS camera_model, " + ", ".join(f"class_{k}_pixels" for k in range(10)) + " FROM g LEFT JOIN w ON w.image_id = g.image_id")
def images_table(spark, sf_dir):
    grouped, assigned = _grouped(spark, sf_dir)
    return dataset.images_table(grouped, assigned, masks.measure(inputs.mask_table(spark, sf_dir))).drop("timestamp")


@query(f"WITH {_SEQ.format(900)} SELECT {_GROUP} AS group_id, {_FIFTH} AS split, min(cam) AS camera_model, epoch_us(min(ts)) AS start_us, count(*) AS image_count, string_agg(image_id::VARCHAR, ',' ORDER BY ts, image_id) AS members FROM g GROUP BY group_no")
def sequences_table(spark, sf_dir):
    grouped, assigned = _grouped(spark, sf_dir)
    t = dataset.sequences_table(sequences.sequence_table(grouped), assigned)
    return t.select("group_id", "split", "camera_model", F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"), "image_count", F.array_join(F.transform("image_ids", lambda x: x.cast("string")), ",").alias("members"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = sequences.group_sequences(inputs.image_records(spark, sf_dir), 900)
    counts = masks.measure(inputs.mask_table(spark, sf_dir)).select("image_id", "counts")
    images = materialise(grouped.join(shuffled(counts), "image_id", "left"))  # grouped and measured once
    return images.join(splits.assign_groups(images, counts="counts"), "group_id")


@query()
def split_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("image_id", "group_id", "split")


@query()
def split_counts(spark, sf_dir):
    return splits.split_counts(_assigned(spark, sf_dir))


@query(f"WITH d AS (SELECT source, {_SPLIT.format('doc_id')} AS split, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, sum(n) AS s, sum(n * n) AS q FROM d GROUP BY 1) SELECT sum((s * s - q) // 2) AS pairs FROM s")
def cross_split_pairs(spark, sf_dir):
    return splits.cross_split_pairs(inputs.export_rows(spark, sf_dir))


@query(f"WITH d AS (SELECT doc_id::VARCHAR AS id, source, sha256(text) AS h, {_SPLIT.format('doc_id')} AS split FROM documents), k AS (SELECT split, unnest(['question_id', 'image_id', 'mask_sha256', 'group_id']) AS key, unnest([id, id, h, source]) AS value FROM d) SELECT 'shared' AS \"check\", key, value FROM k WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL HAVING count(DISTINCT split) > 1")
def leak_audit(spark, sf_dir):
    return splits.leaks(inputs.export_rows(spark, sf_dir))


@query(f"WITH d AS (SELECT doc_id::VARCHAR AS id, source, sha256(text) AS h, {_SPLIT.format('doc_id')} AS split FROM documents), k AS (SELECT split, unnest(['question_id', 'image_id', 'mask_sha256', 'group_id']) AS key, unnest([id, id, h, source]) AS value FROM d) SELECT 'shared' AS \"check\", key, value FROM k WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL HAVING count(DISTINCT split) > 1")
def leak_audit_filtered(spark, sf_dir):
    return splits.leaks(inputs.export_rows(spark, sf_dir), filtered=True)


@query(f"SELECT {_SPLIT.format('doc_id')} AS split, count(*) AS questions, count(DISTINCT doc_id) AS images, count(DISTINCT sha256(text)) AS masks FROM documents GROUP BY 1")
def audit_counts(spark, sf_dir):
    return splits.audit_counts(inputs.export_rows(spark, sf_dir))


def _traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, their traces and the evidence, of which one pass over the masks is made."""
    e = materialise(inputs.evidence(spark, sf_dir))
    q = inputs.asked(e)
    return q, traces.run_programs(q, traces.mask_tools(e)), e


_VARIANTS = ", ".join(f"('{f}', '{v}', {sum(10 if c.endswith('*') else 1 for c in calls)})" for f, vs in traces.PROGRAMS.items() for v, calls in vs.items())
_TRACES = _QUESTIONS + f", variants(question_type, program_variant, calls) AS (VALUES {_VARIANTS}), t AS (SELECT question_id, question_type, program_variant, answer, 'trace-' || substr(sha256(question_id || program_variant), 1, 20) AS trace_id, CASE WHEN question_type = 'damage_state' AND program_variant = 'direct' AND area['building_flooded'] > 0 THEN 1 ELSE calls END AS k FROM questions JOIN variants USING (question_type))"


@query(_TRACES + " SELECT trace_id, question_id, program_variant, answer AS final_answer, k + 1 AS n_steps, round(1 / (1 + 0.05::DOUBLE * (k - 1)), 8) AS generator_score FROM t")
def evidence_programs(spark, sf_dir):
    _, t, _ = _traces(spark, sf_dir)
    return t.select("trace_id", "question_id", "program_variant", "final_answer", F.size("steps").alias("n_steps"), *_r("generator_score"))


@query(_TRACES + " SELECT trace_id, 'latency does not add up' AS rule FROM t WHERE program_variant = 'direct'")
def trace_violations(spark, sf_dir):
    """Traces with a planted fault: the direct ones state another latency."""
    _, t, _ = _traces(spark, sf_dir)
    return traces.violations(t.withColumn("total_latency_ms", F.when(F.col("program_variant") == "direct", 5.0).otherwise(F.col("total_latency_ms"))))


@query(_TRACES + " SELECT question_id, arg_max(trace_id, (1 / (1 + 0.05::DOUBLE * (k - 1)), trace_id)) AS trace_id, answer AS final_answer FROM t GROUP BY question_id, answer")
def best_traces(spark, sf_dir):
    return traces.best_trace(_traces(spark, sf_dir)[1]).select("question_id", "trace_id", "final_answer")


@query(_TRACES + " SELECT DISTINCT question_id, answer AS trace_answer, 1.0::DOUBLE AS support FROM t")
def soft_answers(spark, sf_dir):
    t = traces.soft_answers(_traces(spark, sf_dir)[1])
    return t.select("question_id", "trace_answer", F.round(F.element_at("soft_answer", F.col("trace_answer")), 8).alias("support"))


@query(_QUESTIONS + " SELECT question_id, 'multi_trace_soft_answer' AS variant, answer FROM questions")
def training_targets(spark, sf_dir):
    q, t, _ = _traces(spark, sf_dir)
    return traces.targets(q, t, "multi_trace_soft_answer").select("question_id", "variant", "answer")


def _exported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, t, e = _traces(spark, sf_dir)
    q = materialise(q)
    images = e.select("image_id", F.concat(F.lit("img/"), F.col("image_id").cast("string")).alias("image_path"), F.sha2(F.to_json("area_pixels"), 256).alias("mask_sha256"), F.concat(F.lit("seq-"), (F.col("image_id") % 5).cast("string")).alias("group_id"), inputs.split_of(F.col("image_id")).alias("split"))
    return prepare.assemble(q, images, prepare.verified_traces(q, t, e))


@query(_QUESTIONS + " SELECT question_id, image_id, split, answer AS gold_answer, answer AS trace_answer, 'img/' || image_id AS image_path FROM questions")
def export_records(spark, sf_dir):
    return _exported(spark, sf_dir)[0].select("question_id", "image_id", "split", "gold_answer", "trace_answer", "image_path")


_SHA_ODD = "right(sha256(question_id || program_variant || 'failure'), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')"


def _faulty(spark: SparkSession, sf_dir: str, family: str, results) -> DataFrame:
    """Traces of one family's questions by tools whose results were changed: results(map, image_id) -> map."""
    e = materialise(inputs.evidence(spark, sf_dir))
    tools = traces.mask_tools(e).withColumn("results", results(F.col("results"), F.col("image_id")))
    return traces.run_programs(inputs.asked(e).where(F.col("question_type") == family), tools)


def _shown(t: DataFrame) -> DataFrame:
    last = F.element_at("steps", -1)
    return t.select("question_id", "program_variant", "final_answer", F.size("steps").alias("n_steps"), last["failure"].alias("failure"), F.element_at("answer_distribution", F.col("final_answer")).alias("p"), *_r("generator_score"), "total_latency_ms")


#: Presence questions; tools that fail on every fourth image, are unsure on the next, and count no pixels on the next.
_PRESENCE = _QUESTIONS + """, x AS (SELECT question_id, image_id % 4 AS f, area[cls] > 0 AS p, v.program_variant, v.pres, v.pixels FROM questions, (VALUES ('direct', true, false), ('area_check', false, true), ('verified', true, true)) v(program_variant, pres, pixels) WHERE question_type = 'presence'),
    y AS (SELECT *, CASE WHEN pres AND f = 0 THEN 'presence unavailable' WHEN pres AND pixels AND f = 2 AND p THEN 'presence/area contradiction' END AS failure, pres::INT + pixels::INT AS n, (CASE WHEN pres THEN CASE f WHEN 0 THEN 0 WHEN 1 THEN 0.2 ELSE 1 END ELSE 0 END + pixels::INT)::DOUBLE / (pres::INT + pixels::INT) AS mean FROM x),
    z AS (SELECT *, CASE WHEN failure IS NOT NULL THEN CASE WHEN """ + _SHA_ODD + """ THEN 'no' ELSE 'yes' END WHEN pres THEN CASE WHEN p THEN 'yes' ELSE 'no' END WHEN p AND f <> 2 THEN 'yes' ELSE 'no' END AS final_answer FROM y)
    SELECT question_id, program_variant, final_answer, n + 1 AS n_steps, failure, (CASE WHEN failure IS NOT NULL OR mean <= 0.5 THEN 0.5 ELSE mean END)::DOUBLE AS p, round((n - (failure IS NOT NULL)::INT) / n::DOUBLE * mean / (1 + 0.05::DOUBLE * (n - 1)), 8) AS generator_score, (CASE WHEN pres AND f = 0 THEN 1 ELSE 0 END)::DOUBLE AS total_latency_ms FROM z"""


@query(_PRESENCE)
def trace_faults_presence(spark, sf_dir):
    """Failures, low confidence and contradictions of the presence programs."""

    def results(m, image):
        def change(k, r):
            broken = F.struct(F.lit(None).cast("string").alias("output"), F.lit(0.0).alias("confidence"), r["evidence_ids"].alias("evidence_ids"), F.lit(1.0).alias("latency_ms"), F.lit("presence unavailable").alias("failure"))
            seen = k.startswith("presence:")
            return F.when(seen & (image % 4 == 0), broken).when(seen & (image % 4 == 1), r.withField("confidence", F.lit(0.2))).when(k.startswith("area_pixels:") & (image % 4 == 2), r.withField("output", F.lit("0"))).otherwise(r)

        return F.transform_values(m, change)

    return _shown(_faulty(spark, sf_dir, "presence", results))


#: Adjacency questions; water is reported absent on every other image, and every third image's adjacency result is missing.
_ADJACENT = _QUESTIONS + """, x AS (SELECT question_id, image_id, touch, area['road_flooded'] > 0 AS road, area['water'] > 0 AND image_id % 2 = 1 AS water, v.* FROM questions, (VALUES ('direct', 1), ('presence_then_relation', 3), ('relation_then_presence', 3)) v(program_variant, n) WHERE question_type = 'spatial_adjacency'),
    y AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN 'no result for adjacency:road_flooded__water' WHEN n = 3 AND touch AND NOT (road AND water) THEN 'adjacency/presence contradiction' END AS failure, CASE WHEN image_id % 3 = 0 THEN (n - 1) / n::DOUBLE ELSE 1 END AS mean FROM x)
    SELECT question_id, program_variant, CASE WHEN failure IS NOT NULL THEN CASE WHEN """ + _SHA_ODD + """ THEN 'no' ELSE 'yes' END WHEN touch THEN 'yes' ELSE 'no' END AS final_answer, n + 1 AS n_steps, failure, (CASE WHEN failure IS NOT NULL THEN 0.5 ELSE 1 END)::DOUBLE AS p, round((n - (failure IS NOT NULL)::INT) / n::DOUBLE * mean / (1 + 0.05::DOUBLE * (n - 1)), 8) AS generator_score, 0.0::DOUBLE AS total_latency_ms FROM y"""


@query(_ADJACENT)
def trace_faults_adjacency(spark, sf_dir):
    """Contradictions and missing results of the adjacency programs."""
    absent = lambda m, image: F.transform_values(m, lambda k, r: F.when((k == "presence:water") & (image % 2 == 0), r.withField("output", F.lit("false"))).otherwise(r))
    return _shown(_faulty(spark, sf_dir, "spatial_adjacency", lambda m, image: F.map_filter(absent(m, image), lambda k, r: ~((k == "adjacency:road_flooded__water") & (image % 3 == 0)))))


@query(_TRACES + """, d AS (SELECT trace_id, image_id % 13 AS k FROM t JOIN (SELECT question_id, image_id FROM questions) USING (question_id) WHERE question_type = 'presence' AND program_variant = 'direct'),
    r(k, rule) AS (VALUES (1, 'no steps'), (2, 'last step is no answer'), (3, 'last output is not the final answer'), (4, 'empty distribution'), (4, 'distribution does not sum to 1'), (4, 'final answer not in distribution'), (5, 'probability out of range'), (5, 'last confidence differs'), (6, 'distribution does not sum to 1'), (7, 'final answer not in distribution'), (8, 'last confidence differs'), (9, 'failure is lost'), (10, 'final answer is no maximum'), (11, 'latency does not add up'), (12, 'field out of range'))
    SELECT trace_id, rule FROM d JOIN r USING (k)""")
def trace_rules(spark, sf_dir):
    """Each rule of trace validation, broken by the traces of a thirteenth of the images."""
    q, t, _ = _traces(spark, sf_dir)
    t = t.where("question_type = 'presence' and program_variant = 'direct'").join(shuffled(q.select("question_id", (F.col("image_id") % 13).alias("k"))), "question_id")
    k, final, steps = F.col("k"), F.col("final_answer"), F.col("steps")
    other = F.when(final == "yes", "no").otherwise("yes")
    two = lambda a, b: F.create_map(final, F.lit(a), other, F.lit(b))
    last = lambda name, value: F.transform(steps, lambda s, i: F.when(i == F.size(steps) - 1, s.withField(name, value)).otherwise(s))
    broken = F.when(k == 1, F.slice(steps, 1, 0)).when(k == 2, last("tool", F.lit("x"))).when(k == 3, last("output", F.lit("else"))).when(k == 8, last("confidence", F.lit(0.4))).when(k == 9, F.transform(steps, lambda s, i: F.when(i == 0, s.withField("failure", F.lit("x"))).otherwise(s))).when(k == 10, last("confidence", F.lit(0.3))).otherwise(steps)
    spread = F.when(k == 4, F.map_filter("answer_distribution", lambda a, p: F.lit(False))).when(k == 5, two(1.5, -0.5)).when(k == 6, two(1.0, 0.5)).when(k == 7, F.create_map(F.lit("zzz"), F.lit(1.0))).when(k == 10, two(0.3, 0.7)).otherwise(F.col("answer_distribution"))
    t = t.select("trace_id", "final_answer", broken.alias("steps"), spread.alias("answer_distribution"), F.when(k == 12, -1.0).otherwise(F.col("generator_score")).alias("generator_score"), F.when(k == 11, 5.0).otherwise(F.col("total_latency_ms")).alias("total_latency_ms"))
    return traces.violations(t)


@query("SELECT question_id, answer, round(p / 2.5, 8)::DOUBLE AS support, CASE WHEN first(answer) OVER w = 'a' THEN 'a' ELSE first(answer) OVER w END AS trace_answer FROM (SELECT doc_id::VARCHAR AS question_id, unnest(['a', 'b', 'c']) AS answer, unnest([0.5 + (doc_id % 3) * 0.25, 0.5 + (doc_id % 2) * 0.5, 1.5 - (doc_id % 3) * 0.25 - (doc_id % 2) * 0.5]) AS p FROM documents) WINDOW w AS (PARTITION BY question_id ORDER BY p DESC, answer ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def soft_answer_sums(spark, sf_dir):
    """Two distributions of each document that add up to shares which differ, tie, and lack an answer on one side."""
    d = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question_id"), ((F.col("doc_id") % 3) * 0.25).cast("double").alias("x"), ((F.col("doc_id") % 2) * 0.5).cast("double").alias("y"))
    half = F.lit(0.5)
    one, two = F.create_map(F.lit("a"), half + F.col("x"), F.lit("c"), 1.5 - F.col("x") - F.col("y")), F.create_map(F.lit("b"), half + F.col("y"))
    soft = traces.soft_answers(d.select("question_id", F.explode(F.array(one, two)).alias("answer_distribution")))
    return soft.select("question_id", "trace_answer", F.explode("soft_answer").alias("answer", "support")).withColumn("support", F.round("support", 8))


@query(_QUESTIONS + " SELECT question_id, 'task_only' AS variant, answer FROM questions")
def task_only_targets(spark, sf_dir):
    q, t, _ = _traces(spark, sf_dir)
    return traces.targets(q, t, "task_only").select("question_id", "variant", "answer")


@query(f"WITH {_ROWS} SELECT s.split, f.question_type, 'missing' AS problem FROM (SELECT unnest(['train', 'test']) AS split) s, (SELECT unnest({list(FAMILIES)}) AS question_type) f WHERE NOT EXISTS (FROM a WHERE a.split = s.split AND a.question_type = f.question_type)")
def family_gaps(spark, sf_dir):
    return prepare.family_gaps(inputs.audit_rows(spark, sf_dir))


@query("WITH d AS (SELECT doc_id::VARCHAR AS question_id, lang AS question_type FROM documents) SELECT question_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY sha256('11' || chr(0) || question_id)) - 1 AS position FROM d QUALIFY position < 20")
def balanced_sample(spark, sf_dir):
    return prepare.balanced_sample(inputs.export_rows(spark, sf_dir), 20, 11).select("question_id", "question_type", "position")


@query()
def balanced_sample_exact(spark, sf_dir):
    return prepare.balanced_sample(inputs.export_rows(spark, sf_dir), 20, 11, exact=True).select("question_id", "question_type", "position")


_CELLS = _QUESTIONS + ", o AS (SELECT question_id, answer, row_number() OVER (ORDER BY sha256('5' || chr(0) || question_id)) - 1 AS position FROM questions)"


@query(_CELLS + " SELECT question_id, position, cell, cell[1:2] AS loss_support, cell[4:] AS target_source, answer AS target_answer FROM o, (SELECT unnest(['PC-Ans', 'PC-Trace', 'AA-Ans', 'AA-Trace']) AS cell)")
def training_cells(spark, sf_dir):
    return prepare.make_cells(_exported(spark, sf_dir)[0], 5).select("question_id", "position", "cell", "loss_support", "target_source", "target_answer")


@query("WITH o AS (SELECT doc_id::VARCHAR AS question_id, row_number() OVER (ORDER BY sha256('5' || chr(0) || doc_id)) - 1 AS position FROM documents), s AS (SELECT unnest(range(0, 3 * (SELECT count(*) FROM documents))) AS step) SELECT step, (step + 1) // 4 AS update, question_id FROM s JOIN o ON o.position = step % (SELECT count(*) FROM documents)")
def micro_steps(spark, sf_dir):
    """Three passes over the documents in a seeded order, four steps to an update."""
    rows = inputs.export_rows(spark, sf_dir)
    ordered = hash_rank(rows, sha("5", F.col("question_id")), "question_id")
    n = rows.count()
    steps = prepare.micro_steps(ordered, 3 * n // 4 + 1, 4).where(F.col("step") < 3 * n)
    return steps.select("step", "update", "question_id")


@query("SELECT conv_id, turn, text || chr(10) || 'Choose one answer: yes, no' AS prompt, role AS answer FROM conversations")
def chat_messages(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations").withColumn("m", training_rows.messages(F.col("text"), F.array(F.lit("yes"), F.lit("no")), F.col("role")))
    return rows.select("conv_id", "turn", F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["content"].alias("answer"))


@query("SELECT p_partkey AS image_id, CASE WHEN w * h > 4096 THEN greatest(1, floor(w * sqrt(4096.0::DOUBLE / (w * h)))::INT) ELSE w END AS width, CASE WHEN w * h > 4096 THEN greatest(1, floor(h * sqrt(4096.0::DOUBLE / (w * h)))::INT) ELSE h END AS height FROM (SELECT p_partkey, (1 + p_partkey % 1000)::INT AS w, (1 + p_partkey % 37)::INT AS h FROM part)")
def bounded_sizes(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (1 + F.col("p_partkey") % 1000).cast("int").alias("w"), (1 + F.col("p_partkey") % 37).cast("int").alias("h"))
    return rows.select("image_id", training_rows.bounded_size(F.col("w"), F.col("h"), 4096).alias("s")).select("image_id", "s.*")


@query("WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM documents), l AS (SELECT doc_id, len(ids) AS n, ids[1:3] AS p, ids FROM t) SELECT doc_id, CASE WHEN n <= 3 THEN 'answer span' WHEN len(list_filter(ids[4:], lambda x: x <> 0)) = 0 THEN 'nothing to learn' END AS error, len(list_filter(ids[4:], lambda x: x <> 0)) AS learned FROM l")
def loss_masks(spark, sf_dir):
    """Word lengths as tokens, the first three as the prompt, 0 as padding, answer-only support."""
    rows = inputs.table(spark, sf_dir, "documents").withColumn("ids", F.transform(F.split("text", " "), lambda w: F.length(w)))
    labels, error = training_rows.loss_labels(F.col("ids"), F.slice("ids", 1, 3), 0, F.lit("AA"), F.lit(None).cast("int"))
    return rows.select("doc_id", error.alias("error"), F.size(F.filter(labels, lambda x: x != training_rows.IGNORED)).alias("learned"))


@query("WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM documents), l AS (SELECT doc_id, len(ids) AS n, ids, doc_id % 4 AS k FROM t) SELECT doc_id, CASE WHEN k = 0 OR n < 2 THEN 'prompt is no prefix' WHEN k = 1 THEN 'support' WHEN k = 2 THEN 'attention length' WHEN n <= 3 THEN 'answer span' END AS error, CASE WHEN k = 3 THEN len(list_filter(ids[2:], lambda x, i: i % 2 = 1)) END AS learned FROM l")
def loss_masks_whole(spark, sf_dir):
    """Whole-sequence support without padding, every second place shown, the answer up to one before the end; of each four
    documents one has an empty prompt, one an unknown support and one a short attention mask."""
    k = F.col("doc_id") % 4
    rows = let(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), ids=F.transform(F.split("text", " "), lambda w: F.length(w)))
    n = F.size("ids")
    shown = F.transform("ids", lambda x, i: F.when(i % 2 == 1, 1).otherwise(0))
    rows = let(rows, prompt=F.slice("ids", 1, F.when((k == 0) | (n < 2), 0).otherwise(2)), shown=F.when(k == 2, F.slice(shown, 1, n - 1)).otherwise(shown))
    labels, error = training_rows.loss_labels(F.col("ids"), F.col("prompt"), None, F.when(k == 1, "XX").otherwise("PC"), n - 1, F.col("shown"))
    learned = F.size(F.filter(labels, lambda x: x != training_rows.IGNORED))
    return rows.select("doc_id", error.alias("error"), F.when(k == 3, learned).alias("learned"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Evidence: {' || chr(34) || 'turn' || chr(34) || ':' || turn || '}' || chr(10) || 'Answer: ' || role ELSE role END AS answer FROM conversations")
def chat_trace_messages(spark, sf_dir):
    """Messages whose even turns state their evidence before the answer."""
    shown = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("turn")))
    rows = inputs.table(spark, sf_dir, "conversations").withColumn("m", training_rows.messages(F.col("text"), F.array(F.lit("yes"), F.lit("no")), F.col("role"), shown))
    return rows.select("conv_id", "turn", F.col("m")[1]["content"].alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type ELSE '__unmatched__' END AS prediction FROM events")
def normalized_predictions(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    space = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "logout", "login", "scroll", "error", "add_to_cart", "search")])
    types = F.array_union(space, F.array("event_type"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Some thought.\nAnswer: "), F.upper("event_type"), F.lit("."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("It must be ("), F.col("event_type"), F.lit("), I think"))).otherwise("none of these fits")
    return events.select("event_id", predictions.normalize_prediction(text, types).alias("prediction"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber::VARCHAR AS k, max(l_quantity) AS v FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(v) AS top FROM s GROUP BY 1) SELECT l_orderkey, min(k) FILTER (v = top) AS prediction, round(1 / sum(exp(v - top)), 8) AS confidence FROM s JOIN m USING (l_orderkey) GROUP BY 1")
def candidate_scores(spark, sf_dir):
    """Line numbers of an order as candidates, quantities as their scores."""
    rows = inputs.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("k")).agg(F.max("l_quantity").alias("v"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", F.col("v").cast("double").alias("v")))).alias("e"))
    s = predictions.from_scores(F.map_from_entries("e"), F.transform("e", lambda x: x["k"]))
    return rows.select("l_orderkey", s.alias("s")).select("l_orderkey", "s.prediction", F.round("s.confidence", 8).alias("confidence"))


_STATS = f"WITH {_AREAS}, d AS (SELECT image_id, sum(area) AS total, list_sort(list(area), 'DESC') AS a, -sum(CASE WHEN area > 0 THEN area / 64.0::DOUBLE * ln(area / 64.0::DOUBLE) ELSE 0 END) / ln(10) AS entropy, CASE WHEN image_id % 3 = 0 THEN 'no' ELSE 'yes' END AS said, image_id % 4 AS h FROM v GROUP BY image_id), s AS (SELECT *, (a[1] - a[2]) / total AS margin, CASE WHEN h = 0 THEN 0.6 ELSE 0.9 END AS top FROM d)"


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as records of family dominant_class, with a support that image numbers decide."""
    top = F.when(F.col("image_id") % 4 == 0, 0.6).otherwise(0.9)
    rows = inputs.evidence(spark, sf_dir).select("image_id", F.lit("dominant_class").alias("question_type"), F.col("area_pixels").alias("areas"), F.create_map(F.lit("yes"), top, F.lit("no"), F.lit(1.0) - top).alias("support"), F.lit("yes").alias("answer"), F.when(F.col("image_id") % 3 == 0, "no").otherwise("yes").alias("AA-Ans"))
    rows = rows.withColumns(diagnostics.evidence_statistics(F.col("question_type"), F.col("areas"), F.col("support"), F.col("answer")))
    return rows.withColumn("trace_hurts", F.col("image_id") % 5 == 0).withColumn("trace_answer", F.lit("yes"))


@query(_STATS + " SELECT image_id, round(margin, 8) AS area_margin, round(entropy, 8) AS area_entropy, round(top, 8)::DOUBLE AS gold_support, round(2 * top - 1, 8)::DOUBLE AS support_margin FROM s")
def evidence_statistics(spark, sf_dir):
    return _statistics(spark, sf_dir).select("image_id", *_r("area_margin", "area_entropy", "gold_support", "support_margin"))


@query("WITH d AS (SELECT doc_id, n_chars % 7 AS a, n_chars % 5 AS b, doc_id % 5 AS k FROM documents) SELECT doc_id, CASE WHEN k = 1 THEN 'negative area' WHEN k = 2 THEN 'support' END AS error, CASE WHEN k NOT IN (1, 2) AND a + b > 0 THEN round(abs(a - b) / (a + b + 9)::DOUBLE, 8) WHEN k NOT IN (1, 2) THEN 0 END AS area_margin FROM d")
def area_comparison_statistics(spark, sf_dir):
    """The area_comparison margin is of the two roads, whatever else covers the image; bad areas and supports are named."""
    k = F.col("doc_id") % 5
    rows = inputs.table(spark, sf_dir, "documents").withColumn("areas", F.create_map(F.lit("road_flooded"), F.col("n_chars") % 7, F.lit("road_non_flooded"), F.col("n_chars") % 5, F.lit("grass"), F.when(k == 1, -1).otherwise(9)).cast("map<string,bigint>"))
    support = F.create_map(F.lit("yes"), F.when(k == 2, 0.7).otherwise(0.6), F.lit("no"), F.lit(0.4))
    found = diagnostics.evidence_statistics(F.lit("area_comparison"), F.col("areas"), support, F.lit("yes"))
    return rows.select("doc_id", found["error"].alias("error"), F.when(found["error"].isNull(), F.round(found["area_margin"], 8)).alias("area_margin"))


@query(_STATS + " SELECT said = 'yes' AS correct, count(*) AS cases, round(median(margin), 8) AS median_margin, round(avg(entropy), 8) AS mean_entropy, count(*) FILTER (margin < 0.1) AS narrow FROM s GROUP BY 1")
def dominant_analysis(spark, sf_dir):
    return diagnostics.dominant_analysis(_statistics(spark, sf_dir)).select("correct", "cases", *_r("median_margin", "mean_entropy"), "narrow")


@query(_STATS + " SELECT count(*) AS regressions, count(*) AS area_related, count(*) FILTER (margin < 0.1) AS narrow_area, count(*) FILTER (h = 0) AS narrow_support, 0 AS mismatches FROM s WHERE image_id % 5 = 0")
def regression_analysis(spark, sf_dir):
    return diagnostics.regression_analysis(_statistics(spark, sf_dir))


@query(_STATS + " SELECT count(*) AS examples, count(*) AS top1_is_gold, round(median(top), 8)::DOUBLE AS median_gold_support, count(*) FILTER (h = 0) AS narrow, 0 AS mismatches FROM s")
def trace_support(spark, sf_dir):
    return reports.trace_support(_statistics(spark, sf_dir)).select("examples", "top1_is_gold", *_r("median_gold_support"), "narrow", "mismatches")


@query(f"WITH d AS (SELECT doc_id::VARCHAR AS id, lang, sha256(text) AS h, {_SPLIT.format('doc_id')} AS split FROM documents), t AS (FROM d WHERE split = 'test') SELECT unnest(['images', 'test_questions', 'test_families', 'least_per_family', 'shared_images', 'shared_masks']) AS metric, unnest([(SELECT count(*) FROM d), (SELECT count(*) FROM t), (SELECT count(DISTINCT lang) FROM t), (SELECT min(n) FROM (SELECT count(*) AS n FROM t GROUP BY lang)), 0, (SELECT count(DISTINCT h) FROM t WHERE h IN (SELECT h FROM d WHERE split = 'train'))]) AS value")
def dataset_statistics(spark, sf_dir):
    rows = inputs.export_rows(spark, sf_dir)
    return reports.dataset_statistics(rows, rows)
