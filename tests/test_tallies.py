"""Summaries from stored tallies: equal to a full recomputation, and old runs are not opened again."""

import shutil
from pathlib import Path

import pytest

from scene_qa.jobs import runs
from scene_qa.schemas import CELLS
from scene_qa.sources import tables


def test_updates_equal_the_full_summary(spark, run_tree, tmp_path, monkeypatch):
    root, _ = run_tree
    store, opened, read = str(tmp_path / "store"), [], tables.read_runs

    def watched(*args, **named):
        opened.append(named["runs"])
        return read(*args, **named)

    monkeypatch.setattr(tables, "read_runs", watched)
    one = runs.update_summary(spark, root, store, str(tmp_path / "a"), "model", [1], "candidate")
    assert opened == [[("model", 1, c, "candidate") for c in CELLS]] and one["alignment_gap"]["std"] == 0.0
    away = tmp_path / "away"
    shutil.copytree(root, away)
    shutil.rmtree(away / "model/seed1")  # what is stored is not looked at
    both = runs.update_summary(spark, str(away), store, str(tmp_path / "b"), "model", [1, 2], "candidate")
    assert opened[1:] == [[("model", 2, c, "candidate") for c in CELLS]]
    runs.update_summary(spark, str(away), store, str(tmp_path / "c"), "model", [2], "candidate")
    assert len(opened) == 2
    monkeypatch.undo()
    full = runs.summarize_runs(spark, root, str(tmp_path / "full"), "model", [1, 2], "candidate")

    def rounded(x):
        return {k: rounded(v) for k, v in x.items()} if isinstance(x, dict) else [rounded(v) for v in x] if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x

    assert rounded(both) == rounded(full) and [g["seed"] for g in full["alignment_gap"]["per_seed"]] == [1, 2]
    assert rounded(tables.read_manifest(spark, f"{tmp_path}/b/summary.json")) == rounded(full)


@pytest.mark.parametrize("fault", ["another question", "repeated", "empty", "hash"])
def test_faulty_runs_are_not_stored(spark, run_tree, tmp_path, fault):
    root, store = tmp_path / "runs", str(tmp_path / "store")
    shutil.copytree(run_tree[0], root)
    folder = root / "model/seed2/AA-Ans/eval_candidate"
    lines = [x for x in (folder / "predictions.jsonl").read_text().split("\n") if x]
    changed = {"another question": lines[1:], "repeated": [*lines, lines[0]], "empty": [], "hash": lines}[fault]
    (folder / "predictions.jsonl").write_text("\n".join(changed))
    if fault == "hash":
        meta = (folder / "meta.json").read_text()
        (folder / "meta.json").write_text(meta.replace('"test_sha256": "', '"test_sha256": "x'))
    first = runs.update_summary(spark, str(root), store, str(tmp_path / "out"), "model", [1], "candidate")
    match = {"another question": "different questions", "repeated": "repeat a question", "empty": "without metadata", "hash": "different test sets"}[fault]
    with pytest.raises(ValueError, match=match):
        runs.update_summary(spark, str(root), store, str(tmp_path / "out"), "model", [1, 2], "candidate")
    assert tables.read_manifest(spark, f"{tmp_path}/out/summary.json") == first
    assert len(list(Path(store, "updates").iterdir())) == (2 if fault in ("another question", "hash") else 1)
