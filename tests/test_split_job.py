"""The job build_split does no work that its results don't ask for, and gives the same splits as the plain rule."""

import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from scene_qa.jobs import datasets
from scene_qa.operators import masks, splits
from scene_qa.schemas import SPLITS
from scene_qa.sources import listing


def groups_of(rng, n, cameras, classes, most):
    found = sorted(((rng.choice(cameras), rng.randint(1, 9)) for _ in range(n)), key=lambda g: -g[1])
    return [(c, size, {k: rng.randrange(most) * rng.randint(0, 1) for k in range(classes) if k != 3 or rng.random() < 0.5}) for c, size in found]


def totals_of(groups, classes):
    return splits.Totals(len(groups), sum(g[1] for g in groups), {c: sum(g[1] for g in groups if g[0] == c) for c in {g[0] for g in groups}}, {k: sum(g[2].get(k, 0) for g in groups) for k in range(classes)})


def plain(groups, totals, ratios, seed):
    """The rule from all counts anew for each group."""
    share, generator, out = [r / sum(ratios) for r in ratios], random.Random(seed), []
    cameras = sorted(totals.cameras, key=lambda c: (c is not None, c))

    def deviation(counts, of):
        return sum(abs(counts[s] - of * share[s]) for s in range(3)) / of if of else 0.0

    for i in range(len(groups)):
        active = [s for s in range(3) if share[s] > 0]
        lacking = lambda s: {a for a in active if a != s and a not in out}  # noqa: B023, E731
        scores = {}
        for s in active:
            if len(groups) >= len(active) and len(groups) - i - 1 < len(lacking(s)):
                continue
            put = list(zip(groups[: i + 1], [*out, s], strict=True))
            here = lambda of: [sum(of(g) for g, t in put if t == u) for u in range(3)]  # noqa: B023, E731
            value = deviation(here(lambda g: g[1]), totals.images)
            value += 0.25 * sum(deviation(here(lambda g: g[1] * (g[0] == c)), totals.cameras[c]) for c in cameras) / max(1, len(cameras))  # noqa: B023
            if totals.classes:
                value += 0.25 * sum(deviation(here(lambda g: g[2].get(k, 0)), n) for k, n in totals.classes.items()) / len(totals.classes)  # noqa: B023
            scores[s] = value
        best = min(scores.values())
        out.append(generator.choice([s for s, v in scores.items() if abs(v - best) <= max(1e-12 * max(abs(v), abs(best)), 1e-12)]))
    return [SPLITS[s] for s in out]


@pytest.mark.parametrize("ratios", [(0.6, 0.2, 0.2), (1, 1, 1), (0.5, 0.5, 0)])
def test_splits_are_those_of_the_plain_rule(ratios):
    for seed in range(25):
        rng = random.Random(seed)
        classes = rng.choice([0, 1, 10])
        groups = groups_of(rng, rng.choice([0, 1, 2, 3, 40]), rng.sample([None, "a", "b", "c"], rng.randint(1, 4)), classes, rng.choice([2, 10, 10**6]))
        totals = totals_of(groups, classes)
        assert list(splits.greedy(groups, totals, ratios, seed)) == plain(groups, totals, ratios, seed)


def test_the_ordered_pass_weighs_each_count_once():
    """It is one task: of a group, one call for its images, its camera and each class, in each of three splits, and a few more."""
    groups, calls = groups_of(random.Random(1), 200, ["a", "b"], 10, 50), []
    totals = totals_of(groups, 10)
    sys.setprofile(lambda frame, event, _: calls.append(1) if event == "call" and frame.f_code.co_filename == splits.__file__ else None)
    try:
        list(splits.greedy(groups, totals, (0.6, 0.2, 0.2), 5))
    finally:
        sys.setprofile(None)
    assert len(calls) <= 200 * (3 * 12 + 2) + 50


def test_maps_as_dicts():
    rows = [[(1, 2), (3, 4)], None, [], [(5, None)], [(0, 9)]]
    maps = pa.array(rows, pa.map_(pa.int32(), pa.int64()))
    for start in range(6):
        for n in range(6 - start):
            assert splits._dicts(maps.slice(start, n)) == [dict(r or []) for r in rows[start : start + n]]


def test_areas_alone_are_measured(spark, tree, tmp_path, monkeypatch):
    real, asked = masks.measure, []
    monkeypatch.setattr(masks, "measure", lambda rows, radius=1: asked.append(radius) or real(rows, radius))
    datasets.build_split(spark, str(tree[0]), str(tmp_path))
    assert asked == [0]
    found = {r.image_id: [r[f"class_{k}_pixels"] for k in range(10)] for r in spark.read.parquet(f"{tmp_path}/splits/images.parquet").collect()}
    assert found == {i: [int((a == k).sum()) for k in range(10)] for i, a in tree[1].items()}


def test_folders_are_listed_once(spark, tree, tmp_path, monkeypatch):
    real, asked = listing._rows, []
    monkeypatch.setattr(listing, "_rows", lambda session, folders: asked.extend(folders) or real(session, folders))
    for name in ("a/b/c/1.x", "a/b/2.x", "3.x", "a/.hidden/4.x", "e/f/"):
        path = tmp_path / name
        (path if name.endswith("/") else path.parent).mkdir(parents=True, exist_ok=True)
        if not name.endswith("/"):
            path.write_text(name)
    got = [(r.path, r.length) for r in listing.below(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"file:{tmp_path}/{n}", len(n)) for n in ("a/b/c/1.x", "a/b/2.x", "3.x"))
    assert sorted(asked) == sorted(f"file:{p}" for p in (tmp_path, *(tmp_path / n for n in ("a", "a/b", "a/b/c", "e", "e/f"))))
    root = Path(tree[0])
    assert {r.path for r in listing.below(spark, str(root)).collect()} == {f"file:{p}" for p in root.rglob("*") if p.is_file()}
