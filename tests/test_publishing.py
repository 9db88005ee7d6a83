"""A job that fails leaves the old dataset; one that is lost after its decision is carried out by the next."""

from pathlib import Path

import pytest

from scene_qa.jobs import datasets, publishing
from scene_qa.sources import tables


def files_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(Path(root).rglob("*")) if p.is_file()}


def test_a_job_that_fails_between_files_changes_nothing(spark, dataset, tmp_path, monkeypatch):
    out, _ = dataset
    before = files_of(out)

    def fails(*_):
        raise OSError("the disk is full")

    monkeypatch.setattr(tables, "write_manifest", fails)  # questions are written by then
    with pytest.raises(OSError, match="full"):
        datasets.build_questions(spark, out, seed=1)
    monkeypatch.setattr(tables, "write_csv", fails)
    with pytest.raises(OSError, match="full"):
        datasets.audit_questions(spark, out, least=0)
    assert files_of(out) == before
    monkeypatch.undo()
    monkeypatch.setattr(datasets, "FAMILIES", datasets.FAMILIES[:5])  # a check that doesn't hold
    with pytest.raises(ValueError, match="lacks a question"):
        datasets.build_questions(spark, out, seed=1)
    assert files_of(out) == before
    monkeypatch.undo()
    assert datasets.audit_questions(spark, out, least=0)["total_questions"] == 900


def test_a_failed_export_leaves_the_old_one(spark, dataset, tmp_path, monkeypatch):
    out, folder = dataset[0], str(tmp_path / "export")
    first = datasets.prepare_export(spark, f"{out}/manifest.json", folder, 2, 2)
    before, write, calls = files_of(folder), tables.write_jsonl, []

    def second_fails(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("the disk is full")
        write(*args)

    monkeypatch.setattr(tables, "write_jsonl", second_fails)
    with pytest.raises(OSError, match="full"):
        datasets.prepare_export(spark, f"{out}/manifest.json", folder, 3, 3)
    assert files_of(folder) == before and datasets.audit_export(spark, folder) == first["split_audit"]


def test_a_publication_once_decided_is_carried_out(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")

    def publish(value):
        with publishing.Staged(spark, root) as out:
            spark.range(value).write.parquet(out.path("a/rows.parquet"))
            tables.write_manifest(spark, {"value": value}, out.path("manifest.json"))

    publish(3)
    move, moves = publishing.Folder.move, []

    def lost(self, old, new):
        moves.append(new)
        if new == "manifest.json":
            raise SystemExit("the driver is lost")
        move(self, old, new)

    monkeypatch.setattr(publishing.Folder, "move", lost)
    with pytest.raises(SystemExit):
        publish(5)
    assert [m for m in moves if not m.startswith("_")] == ["a/rows.parquet", "manifest.json"]
    monkeypatch.undo()
    publishing.settle(spark, root)
    publishing.settle(spark, root)
    assert tables.read_manifest(spark, f"{root}/manifest.json") == {"value": 5} and spark.read.parquet(f"{root}/a/rows.parquet").count() == 5
    assert sorted(p.name for p in Path(root).iterdir()) == ["a", "manifest.json"]


def test_an_error_before_the_decision_deletes_what_was_staged(spark, tmp_path):
    with pytest.raises(RuntimeError), publishing.Staged(spark, str(tmp_path / "x")) as out:
        spark.range(2).write.json(out.path("rows.json"))
        raise RuntimeError("checked and found wrong")
    assert not [p for p in (tmp_path / "x").rglob("*") if p.is_file()]
    publishing.settle(spark, str(tmp_path / "nothing here"))
