"""Batches that go on where they stopped: a manifest lists the finished steps, each committed after its output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from .layers import delete, finished

MANIFEST = "key string, name string, path string, parameters string"


@dataclass(frozen=True)
class Step:
    """A finished step: its output and the key that its name, parameters and inputs make."""

    df: DataFrame
    key: str


class Batch:
    """Steps of a job in one folder.

    A step is found again by its key; so another parameter, or an input that is not the same, makes it run. Its output goes
    to a path of its own, and only then a row to the manifest: what a broken run left half written is in no row, and is
    never read. ``prune`` deletes it.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.started: list[str] = []
        self.used: set[str] = set()
        rows = spark.read.schema(MANIFEST).parquet(self._manifest).collect() if finished(spark, self._manifest) else []
        self.done = {r.key: r.path for r in rows}

    @property
    def _manifest(self) -> str:
        return f"{self.folder}/manifest"

    def source(self, path: str) -> str:
        """Key of a source's present state: names, sizes and times of its files."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        store, files = p.getFileSystem(conf), []
        each = store.listFiles(p, True)
        while each.hasNext():
            f = each.next()
            files.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
        return sha256(json.dumps(sorted(files)).encode()).hexdigest()

    def step(self, name: str, make: Callable[[], DataFrame], inputs: list[Step | str] | None = None, **parameters: object) -> Step:
        """The step's output: read if it is finished, else made, written and committed."""
        told = json.dumps(parameters, sort_keys=True)
        key = sha256(json.dumps([name, told, [i.key if isinstance(i, Step) else i for i in inputs or []]]).encode()).hexdigest()
        path = self.done.get(key)
        if path is None or not finished(self.spark, path):
            self.started.append(name)
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            make().write.parquet(path)
            self.spark.createDataFrame([(key, name, path, told)], MANIFEST).coalesce(1).write.mode("append").parquet(self._manifest)
            self.done[key] = path
        self.used.add(path)
        return Step(self.spark.read.parquet(path), key)

    def prune(self) -> list[str]:
        """Delete the folders of steps that this run neither made nor read, and return their paths."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        names = {p.rsplit("/", 1)[1] for p in self.used} | {"manifest"}
        gone = [str(f.getPath()) for f in root.getFileSystem(conf).listStatus(root) if f.getPath().getName() not in names]
        delete(self.spark, *gone)
        return gone
