"""Hashes of files, of their blocks' trees and of folders, against plain ones."""

import hashlib

import pytest

from scene_qa.sources import hashes, listing


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).digest()


def plain_root(data, block, fanout):
    level = [sha(b"\0", data[k : k + block]) for k in range(0, max(1, len(data)), block)]
    level = [sha(b"\1", *level[k : k + fanout]) for k in range(0, len(level), fanout)]
    while len(level) > 1:
        level = [x[0] if len(x) == 1 else sha(b"\1", *x) for x in (level[k : k + fanout] for k in range(0, len(level), fanout))]
    return level[0].hex()


FILES = {"a.bin": b"", "b c.bin": b"x", "d/e.bin": bytes(range(256)) * 40, "d/f.bin": bytes(range(256)) * 4, "d/g.bin": b"y" * 1024}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return root


@pytest.mark.parametrize("ranged", [True, False])
@pytest.mark.parametrize("block, fanout", [(1024, 1024), (100, 3), (1 << 20, 2)])
def test_trees_of_blocks(spark, folder, monkeypatch, ranged, block, fanout):
    if not ranged:  # a store that only Spark's readers open
        for module in (hashes, listing):
            monkeypatch.setattr(module, "ranged", lambda _: False)
    paths = [str(folder), f"{folder}/d"]
    found = {r.path.removeprefix(f"file:{folder}/"): r.root for r in hashes.tree_hashes(spark, paths, block, fanout).collect()}
    wanted = {n: d for n, d in FILES.items() if ranged or d}  # Spark lists no empty files
    assert found == {n: plain_root(d, block, fanout) for n, d in wanted.items()}
    plain = {r.path.removeprefix(f"file:{folder}/"): r.sha256 for r in hashes.file_hashes(spark, paths).collect()}
    assert plain == {n: hashlib.sha256(d).hexdigest() for n, d in wanted.items()}


def test_a_folder_changes_with_any_name_or_byte(spark, folder, tmp_path):
    def root(files, base):
        return tuple(hashes.folder_hash(spark.createDataFrame(files, "path string, root string"), base).first())

    rows = [(f"file:/x/{k}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(200)]
    first = root(rows, "file:/x")
    moved = [(p.replace("file:/x", "s3:/bucket/y"), h) for p, h in reversed(rows)]
    assert first[0] == 200 and root(moved, "s3:/bucket/y") == first
    assert root([("file:/x/other", rows[0][1]), *rows[1:]], "file:/x") != first and root([(rows[0][0], rows[1][1]), *rows[1:]], "file:/x") != first


def test_a_file_beyond_two_gibibytes(spark, tmp_path):
    """A sparse file: Spark's own reader refuses it, blocks don't care."""
    path = tmp_path / "large.bin"
    with path.open("wb") as f:
        f.truncate((2 << 30) + 5)
        f.seek(2 << 30)
        f.write(b"end")
    block = sha(b"\0", bytes(64 << 20))
    want = sha(b"\1", *[block] * 32, sha(b"\0", b"end\0\0")).hex()
    assert [r.root for r in hashes.tree_hashes(spark, str(path)).collect()] == [want]
