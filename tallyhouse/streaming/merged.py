"""Sums that streams add to, kept as batch folders that are merged into generations.

``batches/batch_id=N`` holds what micro-batch N adds; a repeated batch overwrites its folder.
Every so many batches all folders so far are summed into ``merged/generation=G``, and a row in ``manifest``
says which batches that generation holds. Readers take the last row of the manifest, its
generation, and the batches after it, so they open a bounded number of folders. A generation counts from
the moment its row is there: the row is one file that appears by one rename, and a merge that dies before leaves
a folder that the next merge overwrites. Folders go one generation late, so that a reader
that has just taken the row before still finds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import known_table

MERGE_EVERY = 16
_MANIFEST = "upto bigint, generation bigint"


def _files(spark: SparkSession, path: str):
    """(file system, path) of a place that every task sees, through Hadoop's file system API."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@dataclass(frozen=True)
class MergedSums:
    """A table of sums by key; ``every`` is the number of batches between merges."""

    spark: SparkSession
    path: str
    keys: list[str]
    sums: list[str]
    every: int = MERGE_EVERY

    def _exists(self, name: str) -> bool:
        files, place = _files(self.spark, f"{self.path}/{name}")
        return files.exists(place)

    def _remove(self, name: str, least: int) -> None:
        """Numbered folders up to ``least``."""
        if self._exists(name):
            files, place = _files(self.spark, f"{self.path}/{name}")
            for found in files.listStatus(place):
                _, _, number = found.getPath().getName().partition("=")
                if number.isdigit() and int(number) <= least:
                    files.delete(found.getPath(), True)

    def _state(self) -> tuple[int, int]:
        """Last generation (0: none) and the last batch it holds."""
        if not self._exists("manifest"):
            return 0, -1
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        last = rows.agg(F.max_by(F.struct("generation", "upto"), "generation")).first()[0]
        return (last["generation"], last["upto"]) if last else (0, -1)

    def _parts(self, before: int | None) -> DataFrame | None:
        generation, upto = self._state()
        parts = []
        if generation:
            parts.append(self.spark.read.parquet(f"{self.path}/merged/generation={generation}").select(*self.keys, *self.sums))
        if self._exists("batches"):
            batches = self.spark.read.option("basePath", f"{self.path}/batches").parquet(f"{self.path}/batches/batch_id=*")
            late = batches.filter(F.col("batch_id") > upto)
            late = late if before is None else late.filter(F.col("batch_id") < before)
            parts.append(late.select(*self.keys, *self.sums))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, before: int | None = None) -> DataFrame | None:
        """The sums, of batches before one if it is given; None while there is no batch at all."""
        parts = self._parts(before)
        return None if parts is None else parts.groupBy(*self.keys).agg(*[F.sum(s).alias(s) for s in self.sums])

    def add(self, sums: DataFrame, batch_id: int) -> None:
        """Store what a batch adds; before every time that so many have come, merge those before it."""
        if batch_id and batch_id % self.every == 0:
            self.merge(batch_id - 1)
        sums.select(*self.keys, *self.sums).write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def merge(self, upto: int) -> None:
        """Sum the batches up to one into a new generation; batches that a later one repeats must come after it."""
        generation, done = self._state()
        if upto <= done or not self._exists("batches"):
            return
        self.read(upto + 1).write.mode("overwrite").parquet(f"{self.path}/merged/generation={generation + 1}")
        self._publish(generation + 1, upto)
        self._remove("merged", generation - 1)
        self._remove("batches", done)

    def _publish(self, generation: int, upto: int) -> None:
        row = known_table(self.spark, [(upto,)], "upto bigint").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/manifest/generation={generation}")
