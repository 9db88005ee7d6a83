"""Evidence programs as tables: every question's variants, their steps, answers and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.binding import let
from scene_qa.functions.hashing import full_modulo, trace_id
from scene_qa.functions.joins import shuffled
from scene_qa.schemas import CLASSES

#: The tools each variant calls, in order. $c is the class the question asks for, * every class in order.
PROGRAMS = {
    "presence": {"direct": ["presence $c"], "area_check": ["area_pixels $c"], "verified": ["presence $c", "area_pixels $c"]},
    "damage_state": {"direct": ["presence building_flooded", "presence road_flooded"], "roads_first": ["presence road_flooded", "presence building_flooded"], "buildings_first": ["presence building_flooded", "presence road_flooded"]},
    "area_comparison": {"direct": ["area_pixels road_flooded", "area_pixels road_non_flooded"], "reverse_order": ["area_pixels road_non_flooded", "area_pixels road_flooded"], "ratio_route": ["presence road_flooded", "presence road_non_flooded", "area_pixels road_flooded", "area_pixels road_non_flooded"]},
    "spatial_adjacency": {"direct": ["adjacency road_flooded water"], "presence_then_relation": ["presence road_flooded", "presence water", "adjacency road_flooded water"], "relation_then_presence": ["adjacency road_flooded water", "presence road_flooded", "presence water"]},
    "dominant_class": {"direct": ["dominant_class"], "area_scan": ["area_pixels *"], "presence_area_scan": ["presence *", "area_pixels *"]},
    "logical_conjunction": {"direct": ["area_pixels road_flooded", "adjacency road_flooded water"], "presence_first": ["presence road_flooded", "adjacency road_flooded water"], "relation_first": ["adjacency road_flooded water", "presence road_flooded"]},
}
STEP = "struct<tool:string,arg1:string,arg2:string,output_type:string,output:string,confidence:double,evidence_ids:array<string>,latency_ms:double,failure:string>"


RESULT = "struct<output:string,confidence:double,evidence_ids:array<string>,latency_ms:double,failure:string>"


def program_table() -> Column:
    """family -> array of (variant, calls: array of (tool, arg1, arg2)): a fixed map; arg1 `$c` stands for the question's class."""
    out = []
    for family, variants in PROGRAMS.items():
        each = []
        for variant, calls in variants.items():
            flat = [(c.split(), k) for c in calls for k in (CLASSES if c.endswith("*") else [None])]
            steps = []
            for parts, cls in flat:
                args = [cls if p == "*" else p for p in parts[1:]] + [None, None]
                steps.append(F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip((parts[0], args[0], args[1]), ("tool", "arg1", "arg2"), strict=True)]))
            each.append(F.struct(F.lit(variant).alias("variant"), F.array(*steps).alias("calls")))
        out += [F.lit(family), F.array(*each)]
    return F.create_map(*out)


def _key(tool: Column, arg1: Column, arg2: Column) -> Column:
    return F.concat_ws(":", tool, F.concat_ws("__", arg1, arg2))


def mask_tools(evidence: DataFrame) -> DataFrame:
    """What the tools answer from mask evidence: (image_id, results), a map from `tool:arg1__arg2` to the result. No
    row leaves its place: the maps of an image's evidence become one map."""
    none = F.lit(None).cast("string")
    result = lambda key, output: F.struct(key.alias("key"), F.struct(output.cast("string").alias("output"), F.lit(1.0).alias("confidence"), F.array(key).alias("evidence_ids"), F.lit(0.0).alias("latency_ms"), none.alias("failure")).alias("value"))
    of = lambda column, tool: F.transform(F.map_entries(column), lambda e: result(F.concat(F.lit(tool + ":"), e["key"]), e["value"]))
    one = F.array(result(F.lit("dominant_class"), F.col("dominant_class")))
    entries = F.concat(of("presence", "presence"), of("area_pixels", "area_pixels"), of("adjacency", "adjacency"), one)
    return evidence.select("image_id", F.map_from_entries(entries).cast(f"map<string,{RESULT}>").alias("results"))


def tool_map(tool_results: DataFrame) -> DataFrame:
    """tool_results(image_id, tool, arg1, arg2, output, confidence, evidence_ids, latency_ms, failure), of any tool set ->
    (image_id, results) as mask_tools gives it. An image has a few dozen results; one that repeats raises an error."""
    key = F.when(F.col("arg1").isNull(), F.col("tool")).otherwise(_key(F.col("tool"), F.col("arg1"), F.col("arg2")))
    entry = F.struct(key.alias("key"), F.struct("output", "confidence", "evidence_ids", "latency_ms", "failure").alias("value"))
    return tool_results.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).cast(f"map<string,{RESULT}>").alias("results"))


def _seen(steps: Column) -> Column:
    """For each class, in order: what its last presence and area steps say (false and 0 after a failure), and whether they
    are there and sound."""
    def last(tool: str, k: Column) -> Column:
        return F.try_element_at(F.filter(steps, lambda s: (s["tool"] == tool) & s["arg1"].eqNullSafe(k)), F.lit(-1))

    met = F.transform(F.array(*map(F.lit, CLASSES)), lambda k: F.struct(k.alias("k"), last("presence", k).alias("p"), last("area_pixels", k).alias("a")))
    sound = lambda s: s.isNotNull() & s["failure"].isNull()
    return F.transform(met, lambda x: F.struct(x["k"].alias("k"), sound(x["p"]).alias("has_p"), sound(x["a"]).alias("has_a"), F.coalesce(sound(x["p"]) & (x["p"]["output"] == "true"), F.lit(False)).alias("present"), F.coalesce(F.when(sound(x["a"]), x["a"]["output"].cast("long")), F.lit(0).cast("long")).alias("area")))


def _last(steps: Column, tool: str, arg: Column | None) -> Column:
    """The place of the last step of a tool (and class)."""
    fits = lambda s: (s["tool"] == tool) & (F.lit(True) if arg is None else s["arg1"].eqNullSafe(arg))
    return F.array_max(F.transform(steps, lambda s, i: F.when(fits(s), i)))


def run_programs(questions: DataFrame, tools: DataFrame) -> DataFrame:
    """questions(question_id, image_id, question_type, answer_space, class_name) x their variants -> traces: trace_id,
    question_id, question_type, source_family, program_variant, steps, final_answer, answer_distribution, generator_score,
    total_latency_ms. tools: (image_id, results), or the rows that tool_map takes.

    An image's results meet its questions as one map, in one shuffle join, before these become variants; steps are looked up
    in it, so nothing is regrouped. A result that is missing is a failed step of confidence 0. An unknown family raises an error."""
    tools = tools if "results" in tools.columns else tool_map(tools)
    family = F.col("question_type")
    programs = F.coalesce(F.element_at(program_table(), family), F.raise_error(F.concat(F.lit("unknown family "), family)))
    held = questions.select("question_id", "image_id", "question_type", "answer_space", F.col("class_name").alias("c")).join(shuffled(tools.select("image_id", "results")), "image_id", "left")
    rows = held.select("*", F.inline(programs))
    asked = F.transform("calls", lambda k: F.struct(k["tool"].alias("tool"), F.when(k["arg1"] == "$c", F.col("c")).otherwise(k["arg1"]).alias("arg1"), k["arg2"].alias("arg2")))
    looked = F.transform(asked, lambda k: F.struct(k.alias("k"), F.when(k["arg1"].isNull(), k["tool"]).otherwise(_key(k["tool"], k["arg1"], k["arg2"])).alias("key")))
    met = F.transform(looked, lambda x: F.struct(x["k"].alias("k"), x["key"].alias("key"), F.try_element_at("results", x["key"]).alias("r")))

    def step(x: Column) -> Column:
        tool, r, none = x["k"]["tool"], x["r"], F.lit(None).cast("string")
        kind = F.when(tool.isin("presence", "adjacency"), "bool").when(tool == "area_pixels", "int").otherwise("class_name")
        lost = F.when(r.isNull(), F.concat(F.lit("no result for "), x["key"])).otherwise(r["failure"])
        return F.struct(tool.alias("tool"), x["k"]["arg1"].alias("arg1"), x["k"]["arg2"].alias("arg2"), kind.alias("output_type"), F.when(lost.isNull(), r["output"]).otherwise(none).alias("output"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(r["evidence_ids"], F.array().cast("array<string>")).alias("evidence_ids"), F.coalesce(r["latency_ms"], F.lit(0.0)).alias("latency_ms"), lost.alias("failure"))

    runs = let(rows, steps=F.transform(met, step).cast(f"array<{STEP}>")).select("question_id", "question_type", "answer_space", "c", "variant", "steps")
    family, variant, c = F.col("question_type"), F.col("variant"), F.col("c")
    # the direct damage program stops once it has seen a flooded building
    first = F.get("steps", F.lit(0))
    stop = (family == "damage_state") & (variant == "direct") & first["failure"].isNull() & (first["output"] == "true")
    runs = let(runs, raw=F.when(stop, F.slice("steps", 1, 1)).otherwise(F.col("steps"))).drop("steps")
    relation = F.try_element_at(F.filter("raw", lambda s: s["tool"] == "adjacency"), F.lit(-1))
    runs = let(runs, look=_seen(F.col("raw")), relation=relation, first_output=F.get("raw", F.lit(0))["output"])
    at = lambda k: F.get("look", F.lit(CLASSES.index(k)))
    clash = lambda x: x["has_p"] & x["has_a"] & (x["present"] != (x["area"] > 0))
    runs = let(runs, rf=at("road_flooded"), rn=at("road_non_flooded"), bf=at("building_flooded"), water=at("water"), mine=F.get(F.filter("look", lambda x: x["k"] == c), F.lit(0)), clashing=F.get(F.filter("look", clash), F.lit(0))["k"], related=F.col("relation").isNotNull() & F.col("relation.failure").isNull(), touch=F.coalesce(F.col("relation.failure").isNull() & (F.col("relation.output") == "true"), F.lit(False)))
    yes = lambda x: F.when(x, "yes").otherwise("no")
    areas = F.transform("look", lambda x: x["area"])
    scanned = F.get("look", (F.array_position(areas, F.array_max(areas)) - 1).cast("int"))["k"]
    rf, rn, touch = F.col("rf"), F.col("rn"), F.col("touch")
    sound = rf["has_a"] & rn["has_a"]
    answer = (
        F.when(family == "presence", F.when(variant == "area_check", yes(F.col("mine.area") > 0)).otherwise(yes(F.col("mine.present"))))
        .when(family == "damage_state", F.when(F.col("bf.present") | rf["present"], "damage_present").otherwise("no_damage"))
        .when(family == "area_comparison", F.when(sound & (rf["area"] > rn["area"]), "road_flooded").when(sound & (rn["area"] > rf["area"]), "road_non_flooded").otherwise("equal"))
        .when(family == "spatial_adjacency", yes(touch))
        .when(family == "dominant_class", F.when(variant == "direct", F.col("first_output")).otherwise(scanned))
        .otherwise(F.when(variant == "direct", yes((rf["area"] > 0) & touch)).otherwise(yes(rf["present"] & touch)))
    )
    last = lambda tool, arg: _last(F.col("raw"), tool, arg)
    apart = rf["has_p"] & F.col("water.has_p") & F.col("related") & touch & ~(rf["present"] & F.col("water.present"))
    # fixed values: the texts of the marks
    marks = F.array(
        F.struct(F.when((family == "presence") & (variant == "verified") & clash(F.col("mine")), last("area_pixels", c)).alias("at"), F.lit("presence/area contradiction").alias("text")),
        *[F.struct(F.when((family == "area_comparison") & (variant == "ratio_route") & clash(x), last("area_pixels", x["k"])).alias("at"), F.lit("inconsistent evidence").alias("text")) for x in (rf, rn)],
        F.struct(F.when((family == "spatial_adjacency") & (variant != "direct") & apart, last("adjacency", None)).alias("at"), F.lit("adjacency/presence contradiction").alias("text")),
        # only the first class that contradicts itself
        F.struct(F.when((family == "dominant_class") & (variant == "presence_area_scan"), last("area_pixels", F.col("clashing"))).alias("at"), F.lit("presence/area contradiction").alias("text")),
    )
    runs = let(runs, answer0=answer, marks=F.filter(marks, lambda m: m["at"].isNotNull()))
    runs = runs.drop("look", "relation", "first_output", "rf", "rn", "bf", "water", "mine", "clashing", "related", "touch")

    def marked(s: Column, i: Column) -> Column:
        text = F.get(F.filter("marks", lambda m: m["at"] == i), F.lit(0))["text"]
        return s.withField("failure", F.coalesce(text, s["failure"]))

    runs = let(runs, steps=F.transform("raw", marked)).drop("raw", "marks")
    return finish(runs)


def answer_distribution(space: Column, answer: Column, confidence: Column, failed: Column) -> Column:
    n = F.size(space)
    even, top = F.lit(1.0) / n, F.least(F.lit(1.0), confidence)
    share = lambda a: F.when((n == 1) & ~failed, 1.0).when(failed | (confidence <= even), even).when(a == answer, top).otherwise((1.0 - top) / F.greatest(n - 1, F.lit(1)))
    return F.map_from_arrays(space, F.transform(space, share))


def finish(runs: DataFrame) -> DataFrame:
    """runs(question_id, question_type, variant, answer_space, steps, answer0) -> traces with the answer step."""
    n = F.size("steps")
    failure = F.element_at(F.concat(F.transform(F.filter("steps", lambda s: s["failure"].isNotNull()), lambda s: s["failure"]), F.array(F.lit(None).cast("string"))), 1)
    mean = F.when(n > 0, F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["confidence"]) / n).otherwise(1.0)
    hashed = F.sha2(F.concat("question_id", "variant", F.lit("failure")).cast("binary"), 256)
    runs = let(runs, failure=failure, mean=mean)
    runs = let(runs, final_answer=F.when(F.col("failure").isNull(), F.col("answer0")).otherwise(F.element_at("answer_space", full_modulo(hashed, F.size("answer_space")) + 1)))
    runs = let(runs, answer_distribution=answer_distribution(F.col("answer_space"), F.col("final_answer"), F.col("mean"), F.col("failure").isNotNull()))
    good = F.size(F.filter("steps", lambda s: s["failure"].isNull()))
    score = F.when(n > 0, good / n * F.col("mean") * (1.0 / (1.0 + 0.05 * (n - 1)))).otherwise(0.0)
    last = F.struct(F.lit("answer").alias("tool"), F.lit(None).cast("string").alias("arg1"), F.lit(None).cast("string").alias("arg2"), F.lit("answer").alias("output_type"), F.col("final_answer").alias("output"), F.element_at("answer_distribution", F.col("final_answer")).alias("confidence"), F.array_distinct(F.flatten(F.transform("steps", lambda s: s["evidence_ids"]))).alias("evidence_ids"), F.lit(0.0).alias("latency_ms"), F.col("failure"))
    latency = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["latency_ms"])
    return runs.select(trace_id(F.col("question_id"), F.col("variant")).alias("trace_id"), "question_id", "question_type", F.lit("evidence_rules").alias("source_family"), F.col("variant").alias("program_variant"), F.array_append("steps", last).alias("steps"), "final_answer", "answer_distribution", score.alias("generator_score"), latency.alias("total_latency_ms"))


def violations(traces: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(trace_id, rule) for each rule that a trace breaks."""
    last = F.try_element_at("steps", F.lit(-1))
    d = F.col("answer_distribution")
    p = F.map_values(d)
    before = F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0)))
    upstream = F.exists(before, lambda s: s["failure"].isNotNull())
    rules = {
        "no steps": F.size("steps") < 1,
        "last step is no answer": (last["tool"] != "answer") | (last["output_type"] != "answer"),
        "last output is not the final answer": (F.size("steps") > 0) & ~last["output"].eqNullSafe(F.col("final_answer")),
        "empty distribution": F.size(d) < 1,
        "probability out of range": F.exists(p, lambda x: (x < 0) | (x > 1)),
        "distribution does not sum to 1": F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > eps,
        "final answer not in distribution": ~F.map_contains_key(d, F.col("final_answer")),
        "last confidence differs": F.abs(last["confidence"] - F.element_at(d, F.col("final_answer"))) > eps,
        "failure is lost": upstream & last["failure"].isNull(),
        "final answer is no maximum": last["failure"].isNull() & (F.element_at(d, F.col("final_answer")) < F.array_max(p) - 1e-12),
        "latency does not add up": F.abs(F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["latency_ms"]) - F.col("total_latency_ms")) > eps,
        "field out of range": F.exists("steps", lambda s: (s["confidence"] < 0) | (s["confidence"] > 1) | (s["latency_ms"] < 0)) | (F.col("generator_score") < 0) | (F.col("total_latency_ms") < 0),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return traces.select("trace_id", F.explode(found).alias("rule"))


def best_trace(traces: DataFrame) -> DataFrame:
    """Of each question the trace with the greatest (score, probability of its answer, id)."""
    order = F.struct("generator_score", F.element_at("answer_distribution", F.col("final_answer")).alias("p"), "trace_id")
    return traces.groupBy("question_id").agg(F.max_by(F.struct("trace_id", "final_answer", "generator_score"), order).alias("b")).select("question_id", "b.*")


def soft_answer(distributions: Column) -> tuple[Column, Column]:
    """(soft answer, trace answer) of an array of distributions: their summed shares by answer, in order of answer, and the
    greatest, alphabetical among equals."""
    entries = F.flatten(F.transform(distributions, lambda d: F.map_entries(d)))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    total = lambda es: F.aggregate(es, F.lit(0.0), lambda a, e: a + e["value"])
    shares = F.transform(names, lambda k: F.struct(k.alias("answer"), (total(F.filter(entries, lambda e: e["key"] == k)) / total(entries)).alias("p")))
    top = F.get(F.array_sort(F.transform(shares, lambda x: F.struct((-x["p"]).alias("p"), x["answer"].alias("answer")))), F.lit(0))["answer"]
    return F.map_from_entries(shares), top


def soft_answers(traces: DataFrame) -> DataFrame:
    """(question_id, soft_answer map sorted by answer, trace_answer): the mean distribution of a question's traces, and its
    greatest answer, alphabetical among equals. A question has a few traces, which meet in one grouping."""
    each = traces.groupBy("question_id").agg(F.collect_list("answer_distribution").alias("d"))
    soft, top = soft_answer(F.col("d"))
    return each.select("question_id", soft.alias("soft_answer"), top.alias("trace_answer"))


def targets(questions: DataFrame, traces: DataFrame, variant: str) -> DataFrame:
    """Training targets: task_only (gold answer) or multi_trace_soft_answer (best trace's answer and the soft answer)."""
    if variant == "task_only":
        return questions.select("question_id", F.lit(variant).alias("variant"), "answer", "answer_space", F.lit(None).cast("map<string,double>").alias("soft_answer"))
    if variant != "multi_trace_soft_answer":
        raise ValueError(f"unknown variant {variant}")
    found = best_trace(traces).select("question_id", F.col("final_answer").alias("answer")).join(shuffled(soft_answers(traces)), "question_id")
    return questions.drop("answer").join(shuffled(found), "question_id").select("question_id", F.lit(variant).alias("variant"), "answer", "answer_space", "soft_answer")
