"""Fixed values of the scene data model."""

#: Semantic classes, a class's id is its place.
CLASSES = ("background", "building_flooded", "building_non_flooded", "road_flooded", "road_non_flooded", "water", "tree", "vehicle", "pool", "grass")
#: Splits, question families.
SPLITS = ("train", "val", "test")
FAMILIES = ("presence", "damage_state", "area_comparison", "spatial_adjacency", "dominant_class", "logical_conjunction")
#: Ordered class pairs, the lower id first.
PAIRS = tuple((a, b) for a in range(len(CLASSES)) for b in range(a + 1, len(CLASSES)))
#: Answer spaces of the families.
YES_NO = ("yes", "no")
SPACES = {"presence": YES_NO, "damage_state": ("damage_present", "no_damage"), "area_comparison": ("road_flooded", "road_non_flooded", "equal"), "spatial_adjacency": YES_NO, "dominant_class": CLASSES, "logical_conjunction": YES_NO}
TEMPLATES_PER_FAMILY = 3
#: Our wording; ids depend on a template's number only.
WORDING = {
    "presence": ("Can you see any {} here?", "Is there some {} in this picture?", "Does any part of the image show {}?"),
    "damage_state": ("Has flooding reached a building or a road?", "Do buildings or roads show flooding?", "Is anything built under water?"),
    "area_comparison": ("Are more of the road pixels flooded or dry?", "Which road state takes up more pixels?", "Flooded or dry: which part of the roads is larger?"),
    "spatial_adjacency": ("Does flooded road touch water?", "Is water next to a flooded road?", "Do flooded road and water meet?"),
    "dominant_class": ("What covers most of the picture?", "Which class has the most pixels?", "What is the largest class here?"),
    "logical_conjunction": ("Is there flooded road that touches water?", "Does the image show flooded road, and water beside it?", "Are flooded road and water both there and touching?"),
}
#: Prediction runs, training cells, case events.
RUNS = ("Zero-shot", "PC-Ans", "PC-Trace", "AA-Ans", "AA-Trace")
CELLS = ("PC-Ans", "PC-Trace", "AA-Ans", "AA-Trace")
EVENTS = ("fixes_zero_shot", "trace_helps", "trace_hurts", "remaining_hard", "seed_disagreements")
