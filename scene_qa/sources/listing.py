"""Files by name: listed by Spark, opened by Arrow where it knows the store."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.functions.tables import materialise

#: Files of a task, about; bytes of what a task has read of them before it hands them on.
FILES, HELD = 2000, 16 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def uri(path: Column) -> Column:
    """A path with one slash after its scheme: Spark's readers differ in that."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


@lru_cache
def _store(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or glob, the path in it, and what its files' names begin with as Spark writes them, one slash
    after the scheme. A store that can't be opened here raises pa.ArrowInvalid or OSError."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/+", path)
    if scheme is None or scheme[1] == "file":
        return pafs.LocalFileSystem(), "/" + path[scheme.end() :] if scheme else path, "file:/"
    store, _, rest = path[scheme.end() :].partition("/")
    system, base = _store(f"{scheme[1]}://{store}/")
    return system, f"{base.rstrip('/')}/{rest}" if base.strip("/") else rest, f"{scheme[1]}:/" + (f"{store}/" if not base.strip("/") else "")


def ranged(paths: str | list[str]) -> bool:
    """Whether Arrow opens the stores of these paths, so that tasks can read ranges of their files."""
    try:
        for path in [paths] if isinstance(paths, str) else paths:
            opened(path)
    except (pa.ArrowInvalid, OSError, ImportError):
        return False
    return True


def _matching(system: pafs.FileSystem, pattern: str) -> list[pafs.FileInfo]:
    fixed = re.match(r"(?:[^/*?\[]*/)*", pattern)[0].rstrip("/") or "/"
    names = [n for n in pattern[len(fixed) :].split("/") if n]
    here = system.get_file_info([fixed])
    for name in names:
        inside = [x for d in here if d.type == pafs.FileType.Directory for x in system.get_file_info(pafs.FileSelector(d.path))]
        here = [x for x in inside if fnmatchcase(x.base_name, name)]
    return here


def directories(system: pafs.FileSystem, pattern: str) -> list[str]:
    """Folders that match a glob."""
    return sorted(x.path for x in _matching(system, pattern) if x.type == pafs.FileType.Directory)


def matched(system: pafs.FileSystem, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files that match a glob (* ? [ ] inside a name), folder by folder; a folder stands for the files in it."""
    here = _matching(system, pattern)
    folders = [x for x in here if x.type == pafs.FileType.Directory]
    inside = [x for d in folders for x in system.get_file_info(pafs.FileSelector(d.path))]
    return sorted((x.path, x.size) for x in [*here, *inside] if x.is_file)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of files; nothing is read. Where Arrow opens the store it lists them, hidden files (._) left out as by
    Spark; else Spark does, which leaves out empty files."""
    if not ranged(paths):
        return spark.read.format("binaryFile").load(paths).select(uri(F.col("path")).alias("path"), "length")
    found = set()
    for glob in [paths] if isinstance(paths, str) else paths:
        system, pattern, prefix = opened(glob)
        found |= {(prefix + path.lstrip("/"), size) for path, size in matched(system, pattern) if path.rsplit("/", 1)[-1][0] not in "._"}
    return spark.createDataFrame(sorted(found), "path string, length long")


def dealt(rows: DataFrame, n: int = 0) -> DataFrame:
    """rows over four tasks for each core, or with n, their number, over tasks of FILES if those are more."""
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism * 4, -(-n // FILES)))


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _inside(rows: DataFrame, name: str | None = None) -> DataFrame:
    """(path, length, folder) of what lies in the folders of rows(path), each listed by the task that has it: files, and folders if
    no name is given, a pattern of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, base, prefix = opened(folder)
                infos = [x for x in system.get_file_info(pafs.FileSelector(base)) if not _hidden(x.base_name) and (name is None or fnmatchcase(x.base_name, name))]
                if name is not None:  # a folder stands for the files in it
                    infos += [y for x in infos if x.type == pafs.FileType.Directory for y in system.get_file_info(pafs.FileSelector(x.path)) if not _hidden(y.base_name)]
                kept = [x for x in infos if (x.is_file and x.size) or (name is None and x.type == pafs.FileType.Directory)]
                for k in range(0, len(kept), 10_000):
                    some = kept[k : k + 10_000]
                    columns = [pa.array([prefix + x.path.lstrip("/") for x in some], pa.string()), pa.array([x.size or 0 for x in some], pa.int64()), pa.array([not x.is_file for x in some], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "length", "folder"])

    return rows.mapInArrow(run, "path string, length long, folder boolean")


def _rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in folders], "path string").repartition(max(1, min(len(folders), spark.sparkContext.defaultParallelism * 4)))


def below(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files in root and in all folders below it, as Spark's readers list them: no hidden and no empty ones.
    Tasks list each folder once, level by level; only the folders' names come to the driver."""
    if not ranged(root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(uri(F.col("path")).alias("path"), "length")
    system, base, prefix = opened(root)
    if system.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")
    level, out = [prefix + base.strip("/")], None
    while level:
        found = materialise(_inside(_rows(spark, level)))
        files = found.where(~F.col("folder")).select("path", "length")
        out = files if out is None else out.union(files)
        level = [r.path for r in found.where("folder").select("path").collect()]
    return out


def globbed(spark: SparkSession, globs: list[str]) -> DataFrame:
    """(path, length) of the files that match globs whose last part names files, each once; hidden and empty ones are left out. The
    driver finds their folders, tasks list those."""
    out = None
    for glob in globs:
        folder, name = glob.rsplit("/", 1)
        system, pattern, prefix = opened(folder)
        found = [prefix + x.lstrip("/") for x in directories(system, pattern)]
        if not found:
            raise FileNotFoundError(f"no folder {folder}")
        rows = _inside(_rows(spark, found), name).select("path", "length")
        out = rows if out is None else out.union(rows)
    return materialise(out.distinct() if len(globs) > 1 else out)


def with_contents(files: DataFrame, path: str, read: Callable[[str, pa.NativeFile], tuple], schema: str, n: int = 0) -> DataFrame:
    """files with what read(path, file) gives for the file that column `path` names, as columns of schema. Their number n deals them; a
    task opens its files one after the other and holds HELD bytes of results, and a file's, at most."""
    names = [c.split(" ") for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(batch: pa.RecordBatch, start: int, found: list[tuple]) -> pa.RecordBatch:
            columns = [*batch.slice(start, len(found)).columns, *[pa.array([r[k] for r in found], _ARROW[t]) for k, (_, t) in enumerate(names)]]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[c for c, _ in names]])

        for batch in batches:
            start, held, found = 0, 0, []
            for named in batch.column(path).to_pylist():
                system, inside, _ = opened(named or "")
                try:
                    file = system.open_input_file(inside)
                except FileNotFoundError:
                    raise FileNotFoundError(f"no file at {named}") from None
                with file:
                    found.append(read(named, file))
                held += sum(len(v) for v in found[-1] if isinstance(v, bytes))
                if held >= HELD:
                    yield part(batch, start, found)
                    start, held, found = start + len(found), 0, []
            yield part(batch, start, found)

    return dealt(files, n).mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in files.dtypes], schema]))
