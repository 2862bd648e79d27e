"""Partial aggregates of micro-batches, folded as they come.

Each micro-batch writes its partial sums to a folder of its own. As soon as
FOLD neighbouring folders cover equally many micro-batches they are folded
into one, so that a stream of n micro-batches keeps at most FOLD - 1 folders
of each size, FOLD * log(n) in all, and rewrites a row log(n) times.

A folder counts once its _SUCCESS file is there and no complete folder covers
a wider range: what a job that was stopped leaves behind, between the writing
of a folded folder and the deletion of its parts or within a writing, changes
nothing, and a replayed micro-batch overwrites its own folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOLD = 8


class Partials:
    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fold: int = FOLD):
        self.spark, self.path, self.merge, self.fold = spark, path.rstrip("/"), merge, fold
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, first: int, last: int) -> str:
        return f"{self.path}/batches-{first}-{last}"

    def ranges(self) -> list[tuple[int, int]]:
        """The complete folders that count, in order."""
        if not self._fs.exists(self._path(self.path)):
            return []
        found = [re.fullmatch(r"batches-(\d+)-(\d+)", s.getPath().getName()) for s in self._fs.listStatus(self._path(self.path))]
        wide = sorted(((int(m[1]), int(m[2])) for m in found if m), key=lambda r: (r[0], -r[1]))
        out: list[tuple[int, int]] = []
        for r in wide:
            if (not out or r[0] > out[-1][1]) and self._fs.exists(self._path(f"{self._name(*r)}/_SUCCESS")):
                out.append(r)
        return out

    def read(self) -> DataFrame | None:
        """The merged partials of all micro-batches; None before the first."""
        paths = [self._name(*r) for r in self.ranges()]
        return self.merge(self.spark.read.parquet(*paths)) if paths else None

    def add(self, df: DataFrame, batch: int) -> None:
        """The partials of one micro-batch."""
        self.merge(df).write.mode("overwrite").parquet(self._name(batch, batch))
        while self._fold_once():
            pass

    def _fold_once(self) -> bool:
        ranges = self.ranges()
        for at in range(len(ranges) - self.fold + 1):
            part = ranges[at:at + self.fold]
            if len({b - a for a, b in part}) == 1:
                whole = (part[0][0], part[-1][1])
                rows = self.merge(self.spark.read.parquet(*[self._name(*r) for r in part]))
                rows.write.mode("overwrite").parquet(self._name(*whole))
                for r in part:
                    self._fs.delete(self._path(self._name(*r)), True)
                return True
        return False
