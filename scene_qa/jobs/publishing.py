"""The outputs of a job, published together: a failed run leaves the old ones as they are."""

from __future__ import annotations

import json
import uuid
from types import TracebackType

from pyspark.sql import SparkSession

_STAGED, _DECIDED = "_staged-", "_publish-"


class Folder:
    """A folder of any store that Spark writes to, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        """Names in the folder itself, oldest first."""
        if not self.fs.exists(self.path("")):
            return []
        return [s.getPath().getName() for s in sorted(self.fs.listStatus(self.path("")), key=lambda s: s.getModificationTime())]

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(self.fs.open(self.path(name)), "UTF-8"))
        try:
            return stream.readLine()
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """Puts old in the place of new, if old is there; done again, it changes nothing."""
        if not self.fs.exists(self.path(old)):
            return
        self.fs.delete(self.path(new), True)
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{self.root}: {old} can't be moved to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def settle(spark: SparkSession, root: str) -> None:
    """Carries out what was decided and not finished: every job calls it on a folder before it reads it."""
    folder = Folder(spark, root)
    for name in folder.names():
        if name.startswith(_DECIDED):
            key = name.removeprefix(_DECIDED)
            for output in json.loads(folder.read(name)):
                folder.move(f"{_STAGED}{key}/{output}", output)
            folder.delete(f"{_STAGED}{key}")
            folder.delete(name)


class Staged:
    """`with Staged(spark, root) as out`: outputs are written to out.path(name), and checked there. Leaving the block publishes them:
    one file, renamed into root, names them all and so decides; then each moves to root/name. An error before that deletes what was
    staged; a driver lost after it leaves the moves to the next settle()."""

    def __init__(self, spark: SparkSession, root: str):
        settle(spark, root)
        self.spark, self.key, self.outputs = spark, uuid.uuid4().hex, []
        self.target = Folder(spark, root)
        self.folder = f"{self.target.root}/{_STAGED}{self.key}"

    def path(self, name: str) -> str:
        self.outputs.append(name)
        return f"{self.folder}/{name}"

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind is not None:
            self.target.delete(_STAGED + self.key)
            return
        self.target.write(f"{_STAGED}{self.key}/outputs", json.dumps(self.outputs))
        self.target.move(f"{_STAGED}{self.key}/outputs", _DECIDED + self.key)
        settle(self.spark, self.target.root)
