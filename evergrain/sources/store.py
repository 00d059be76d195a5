"""Versioned tables in a folder that driver and executors share: data is written beside what is read, and one rename shows it.

A version is a manifest, a small JSON file that names the data folders it is made of. Readers take the newest manifest, writers
stage folders and publish the next one; a rename that finds its number taken fails, so of two writers one has to start again.
What no manifest names is left over from runs that did not end, and sweep() deletes it.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published this version."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local master without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evergrain-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Store:
    """Folders of data below root/data and manifests below root/versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stage(self, df: DataFrame, name: str, by: str | list[str] | None = None, dealt: bool = False) -> str:
        """Writes df to a folder of its own, of which no manifest knows yet. by: columns whose values become folders, few files each.

        dealt: rows lie in few large partitions, and each writes its own files.
        """
        path, by = f"data/{name}-{uuid.uuid4().hex}", [by] if isinstance(by, str) else by
        writer = (df.hint("rebalance", *map(F.col, by)) if by and not dealt else df).write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{path}")
        return path

    def folder(self, path: str) -> str:
        """A folder of staged data, which is made if no row has come there."""
        self._fs().mkdirs(self._path(path))
        return path

    def read(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path("versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> dict | None:
        """The newest manifest, with its number under `version`; None before the first."""
        numbers = self.versions()
        if not numbers:
            return None
        stream = self._fs().open(self._path("versions", f"{numbers[-1]:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": numbers[-1]}

    def publish(self, manifest: dict, after: dict | None) -> dict:
        """Shows a manifest as the version after the one given."""
        number = 1 if after is None else after["version"] + 1
        manifest = {k: v for k, v in manifest.items() if k != "version"}
        fs, draft, final = self._fs(), self._path("versions", f".draft-{uuid.uuid4().hex}"), self._path("versions", f"{number:012d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:
            none = self._hadoop.Options.Rename.NONE
            gate = self.spark.sparkContext._gateway
            options = gate.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {number} exists") from e
            raise
        return manifest | {"version": number}

    def sweep(self, keep: int = 2) -> int:
        """Deletes manifests but the newest `keep`, and data folders that none of those names; the number of folders deleted.

        For times when no writer is at work: a folder staged but not published yet looks like one left over.
        """
        fs, numbers = self._fs(), self.versions()
        for n in numbers[:-keep]:
            fs.delete(self._path("versions", f"{n:012d}.json"), False)
        named = ""
        for n in numbers[-keep:]:
            stream = fs.open(self._path("versions", f"{n:012d}.json"))
            named += self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        if not fs.exists(self._path("data")):
            return 0
        left = [s.getPath() for s in fs.listStatus(self._path("data")) if f"data/{s.getPath().getName()}" not in named]
        for path in left:
            fs.delete(path, True)
        return len(left)
