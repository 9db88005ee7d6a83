"""One question for each family and image, with its answer and the evidence for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scene_qa.functions.binding import let
from scene_qa.functions.hashing import question_id, stable_pick
from scene_qa.schemas import CLASSES, FAMILIES, SPACES, SPLITS, TEMPLATES_PER_FAMILY, WORDING

EVIDENCE = "class_name string, present boolean, area_ratio double, ratio_category string, building_flooded_present boolean, road_flooded_present boolean, first_class string, first_area_pixels long, first_ratio_category string, second_class string, second_area_pixels long, second_ratio_category string, adjacent boolean, adjacency_radius int, dominant_class string, dominant_area_pixels long, road_flooded_water_adjacent boolean, expected_answer string"


def _by_family(family: Column, values: dict[str, Column]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(family == name, value) if out is None else out.when(family == name, value)
    return out


def recompute_answer(family: Column, e: Column) -> Column:
    """The answer that an evidence struct leads to; null for an unknown family or where a field it needs is null."""
    yes = lambda c: F.when(c, "yes").when(~c, "no")
    built, road = e["building_flooded_present"], e["road_flooded_present"]
    damage = F.when(built.isNotNull() & road.isNotNull(), F.when(built | road, "damage_present").otherwise("no_damage"))
    first, second = e["first_area_pixels"], e["second_area_pixels"]
    area = F.when(first > second, e["first_class"]).when(second > first, e["second_class"]).when(first == second, "equal")
    touch = e["road_flooded_water_adjacent"]
    both = F.when(road.isNotNull() & touch.isNotNull(), yes(road & touch))
    return _by_family(family, {"presence": yes(e["present"]), "damage_state": damage, "area_comparison": area, "spatial_adjacency": yes(e["adjacent"]), "dominant_class": e["dominant_class"], "logical_conjunction": both})


def generate(evidence: DataFrame, seed: int = 20260615, split: str = "split") -> DataFrame:
    """evidence with a split column -> question_id, image_id, split, question_type, template_id, question, answer,
    answer_space, evidence (JSON with sorted keys). Other splits than train, val and test raise an error."""
    image = F.col("image_id").cast("string")
    known = F.when(F.col(split).isin(*SPLITS), F.col(split)).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(F.col(split), F.lit("null")))))
    rows = evidence.withColumn("_split", known).withColumn("question_type", F.explode(F.array(*map(F.lit, FAMILIES))))
    family = F.col("question_type")
    picked = F.element_at(F.array(*map(F.lit, CLASSES[1:])), stable_pick(seed, image, "presence", "class", len(CLASSES) - 1) + 1)
    rows = let(rows, _class=F.when(family == "presence", picked), _n=stable_pick(seed, image, family, "template", TEMPLATES_PER_FAMILY) + 1)
    at = lambda m, key: F.element_at(F.col(m), key)
    road, dry, touch = F.lit("road_flooded"), F.lit("road_non_flooded"), at("adjacency", F.lit("road_flooded__water"))
    fields = {
        "presence": [F.col("_class").alias("class_name"), at("presence", F.col("_class")).alias("present"), at("area_ratio", F.col("_class")).alias("area_ratio"), at("ratio_categories", F.col("_class")).alias("ratio_category")],
        "damage_state": [at("presence", F.lit("building_flooded")).alias("building_flooded_present"), at("presence", road).alias("road_flooded_present")],
        "area_comparison": [road.alias("first_class"), at("area_pixels", road).alias("first_area_pixels"), at("ratio_categories", road).alias("first_ratio_category"), dry.alias("second_class"), at("area_pixels", dry).alias("second_area_pixels"), at("ratio_categories", dry).alias("second_ratio_category")],
        "spatial_adjacency": [road.alias("first_class"), F.lit("water").alias("second_class"), touch.alias("adjacent"), F.col("adjacency_radius")],
        "dominant_class": [F.col("dominant_class"), at("area_pixels", F.col("dominant_class")).alias("dominant_area_pixels")],
        "logical_conjunction": [at("presence", road).alias("road_flooded_present"), touch.alias("road_flooded_water_adjacent"), F.col("adjacency_radius")],
    }
    plain = {k: F.from_json(F.to_json(F.struct(*v)), EVIDENCE) for k, v in fields.items()}
    rows = let(rows, _e=_by_family(family, plain))
    rows = let(rows, answer=recompute_answer(family, F.col("_e")))
    keys = {k: sorted([*field_names(k), "expected_answer"]) for k in fields}
    as_json = {k: F.to_json(F.struct(*[F.col("answer").alias("expected_answer") if n == "expected_answer" else F.col("_e")[n].alias(n) for n in names])) for k, names in keys.items()}
    wording = {k: F.element_at(F.array(*map(F.lit, WORDING[k])), F.col("_n")) for k in FAMILIES}
    template = F.concat(family, F.lit("-"), F.col("_n").cast("string"))
    return rows.select(
        question_id(image, F.col("_split"), family, template).alias("question_id"), F.col("image_id"), F.col("_split").alias("split"), "question_type", template.alias("template_id"),
        F.replace(_by_family(family, wording), F.lit("{}"), F.coalesce(F.replace(F.col("_class"), F.lit("_"), F.lit(" ")), F.lit(""))).alias("question"), "answer",
        _by_family(family, {k: F.array(*map(F.lit, v)) for k, v in SPACES.items()}).alias("answer_space"), _by_family(family, as_json).alias("evidence"),
    )


def field_names(family: str) -> list[str]:
    return {
        "presence": ["class_name", "present", "area_ratio", "ratio_category"],
        "damage_state": ["building_flooded_present", "road_flooded_present"],
        "area_comparison": ["first_class", "first_area_pixels", "first_ratio_category", "second_class", "second_area_pixels", "second_ratio_category"],
        "spatial_adjacency": ["first_class", "second_class", "adjacent", "adjacency_radius"],
        "dominant_class": ["dominant_class", "dominant_area_pixels"],
        "logical_conjunction": ["road_flooded_present", "road_flooded_water_adjacent", "adjacency_radius"],
    }[family]


def decoded(evidence: Column) -> Column:
    return F.from_json(evidence, EVIDENCE)


def difficulty(family: Column) -> Column:
    return F.when(family.isin("presence", "damage_state", "spatial_adjacency"), "binary").when(family.isin("area_comparison", "logical_conjunction"), "compositional").when(family == "dominant_class", "multiclass")
