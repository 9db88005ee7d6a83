"""A small image tree, written byte by byte, and what the jobs make of it: made once for all tests, which leave it as it is."""

import json
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from scene_qa.jobs import datasets
from scene_qa.schemas import RUNS, SPLITS


def png(path: Path, labels: np.ndarray, kind: int = 0) -> None:
    """An 8-bit gray PNG, or with kind 3 one with a palette."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + bytes(r) for r in labels.astype(np.uint8))
    palette = chunk(b"PLTE", bytes(range(30))) if kind == 3 else b""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", labels.shape[1], labels.shape[0], 8, kind, 0, 0, 0)) + palette + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def jpeg(path: Path, taken: str | None, changed: str | None, camera: str | None, order: str = "<", before: int = 0) -> None:
    """A JPEG header with an Exif block, behind `before` other segments of 64 KiB."""
    body, entries, extra = b"", [], []
    for tag, text in ((272, camera), (306, changed)):
        if text is not None:
            entries.append((tag, text.encode() + b"\0"))
    n = len(entries) + (taken is not None)
    at = 8 + 2 + 12 * n + 4
    rows = b""
    for tag, data in entries:
        if len(data) <= 4:
            rows += struct.pack(order + "HHI", tag, 2, len(data)) + data.ljust(4, b"\0")
        else:
            rows += struct.pack(order + "HHII", tag, 2, len(data), at)
            extra.append(data)
            at += len(data)
    if taken is not None:
        rows += struct.pack(order + "HHII", 34665, 4, 1, at)
        data = taken.encode() + b"\0"
        extra.append(struct.pack(order + "H", 1) + struct.pack(order + "HHII", 36867, 2, len(data), at + 18) + struct.pack(order + "I", 0) + data)
    body = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", n) + rows + struct.pack(order + "I", 0) + b"".join(extra)
    exif = b"Exif\0\0" + body
    path.parent.mkdir(parents=True, exist_ok=True)
    other = (b"\xff\xe2" + struct.pack(">H", 65535) + b"\x07" * 65533) * before
    path.write_bytes(b"\xff\xd8" + other + b"\xff" + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\0\x02" + b"pixels Exif\0\0")


def scene(rng: random.Random) -> np.ndarray:
    """Blocks of a few classes, so that every family has different answers."""
    a = np.full((8, 8), rng.choice([0, 5, 6, 9, 3]))
    for _ in range(rng.randrange(7)):
        y, x = rng.randrange(7), rng.randrange(7)
        a[y : y + rng.randint(1, 4), x : x + rng.randint(1, 4)] = rng.choice([1, 2, 3, 3, 4, 4, 5, 5, 7, 8])
    return a


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tree"), random.Random(8)
    found = {}
    for i in range(150):
        split = SPLITS[i % 3]
        a = scene(rng)
        while any((a == b).all() for b in found.values()):
            a = scene(rng)
        seconds = 20 * (i // 2) + 60 * (i // 10)
        time = f"2021:03:04 {10 + seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
        jpeg(root / split / f"{split}-org-img" / f"{i}.jpg", time if i % 4 else None, time if i % 4 == 0 else "2001:01:01 00:00:00", None if i % 50 == 7 else f"Cam-{i // 40}", "<>"[i % 2], before=3 * (i == 5))
        png(root / split / f"{split}-label-img" / f"{i}_lab.png", a)
        found[str(i)] = a
    return root, found


@pytest.fixture(scope="session")
def dataset(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    audit = datasets.build_split(spark, str(tree[0]), out, gap_seconds=30.0, gaps=(10.0, 30.0))
    datasets.build_questions(spark, out)
    return out, audit


@pytest.fixture(scope="session")
def export(spark, dataset, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("export"))
    return folder, datasets.prepare_export(spark, f"{dataset[0]}/manifest.json", folder, train_per_family=4, test_per_family=3)


@pytest.fixture(scope="session")
def run_tree(spark, export, tmp_path_factory):
    """Runs over the exported test questions: plain files, with blank lines."""
    root = tmp_path_factory.mktemp("runs")
    records = sorted(datasets.read_export(spark, export[0], export[1]).where("split = 'test'").collect(), key=lambda r: r.question_id)
    for seed in (1, 2):
        for n, cell in enumerate(RUNS):
            folder = root / "model" / f"seed{seed}" / cell / "eval_candidate"
            folder.mkdir(parents=True)
            lines = []
            for i, r in enumerate(records):
                said = r.gold_answer if (i + n + seed) % (n + 2) else r.answer_space[(list(r.answer_space).index(r.gold_answer) + 1) % len(r.answer_space)]
                lines.append(json.dumps({"question_id": r.question_id, "image_id": r.image_id, "question_type": r.question_type, "answer": r.gold_answer, "prediction": said, "confidence": (i % 10) / 10, "candidate_scores": None, "generated_text": None}))
            (folder / "predictions.jsonl").write_text("\n\n".join(lines) + "\n")
            (folder / "meta.json").write_text(json.dumps({"protocol": "v1", "test_sha256": export[1]["files"]["test"]["sha256"], "count": len(lines)}, indent=1))
    return str(root), records
