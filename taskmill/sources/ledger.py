"""A ledger of answered records: which keys have a result, and which batch wrote it.

The ledger is a bucketed parquet table below the results. It is read by its key column alone and joined
without moving, however much has been answered. A batch is entered after its results lie in their
folder; until then it counts as not done, and its folder is written again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.scale import partitions, remove
from taskmill.schema import RECORD_KEY

FOLDER = "_ledger"
DONE = "_done"


def record_key(columns: Sequence[str], key: Sequence[str] = tuple(RECORD_KEY)) -> Column:
    """One text that tells records apart: the key columns, null apart from empty.

    A record without the last of them, its id, is told apart by all of its ``columns``.
    """
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string") for c in columns])), 256)
    content = F.when(F.col(key[-1]).isNull(), whole).alias("content")
    return F.to_json(F.struct(*[F.col(k).cast("string") for k in key], content))


class Ledger:
    """The ledger of one results folder; a new one has as many buckets as the session's shuffles have partitions."""

    def __init__(self, spark: SparkSession, results: str, buckets: int | None = None) -> None:
        self.spark, self.results = spark, results.rstrip("/")
        found = [re.fullmatch(r"gen-(\d+)-(\d+)", n) for n in self._names(f"{self.results}/{FOLDER}")]
        found = sorted((int(m[1]), int(m[2])) for m in found if m)
        # A generation is valid once the one before is gone, or if it is the only one.
        self.generation, self.buckets = found[0] if found else (0, buckets or partitions(spark))
        self._register()

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(folder)

    def _files(self, folder: str):
        return self._path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files = self._files(folder)
        if not files.exists(self._path(folder)):
            return []
        return [s.getPath().getName() for s in files.listStatus(self._path(folder))]

    def _place(self, generation: int) -> str:
        return f"{self.results}/{FOLDER}/gen-{generation}-{self.buckets}"

    def _register(self) -> None:
        """Make the files known as a bucketed table of this session; the files are what counts."""
        place = self._place(self.generation)
        self.table = "ledger_" + hashlib.md5(place.encode()).hexdigest()
        files = self._files(place)
        files.mkdirs(self._path(place))
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"create table if not exists {self.table} (record string, batch string) using parquet "
            f"clustered by (record) sorted by (record) into {self.buckets} buckets location '{quoted}'"
        )
        self.spark.catalog.refreshTable(self.table)

    def done(self) -> set[str]:
        """The batches that are finished: one small marker each."""
        return set(self._names(f"{self.results}/{DONE}"))

    def answered(self, apart_from: str | None = None) -> DataFrame:
        """The keys with a result, as ``record``; those of one batch may be left out, if it is to be done again."""
        rows = self.spark.table(self.table)
        if apart_from is not None:
            rows = rows.where(F.col("batch") != apart_from)
        return rows.select("record")

    def enter(self, keys: DataFrame, batch: str) -> None:
        """Enter the keys (``record``) of a batch and mark it as done.

        If this is cut short and done again, keys may be there twice, which the joins do not mind.
        """
        rows = keys.select("record", F.lit(batch).alias("batch")).repartition(self.buckets, "record")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "record").sortBy("record").option(
            "path", self._place(self.generation)
        ).saveAsTable(self.table)
        self._files(self.results).create(self._path(f"{self.results}/{DONE}/{batch}"), True).close()

    def compact(self) -> None:
        """Write each bucket anew as one file, without keys that were entered twice.

        The new generation is complete before the old one goes; while both are there the old one counts.
        """
        old, self.generation = self.generation, self.generation + 1
        rows = self.spark.table(self.table).groupBy("record").agg(F.max("batch").alias("batch"))
        new = self._place(self.generation)
        remove(self.spark, new)
        table = self.table
        rows.repartition(self.buckets, "record").write.format("parquet").bucketBy(self.buckets, "record").sortBy(
            "record"
        ).option("path", new).mode("overwrite").saveAsTable("ledger_" + hashlib.md5(new.encode()).hexdigest())
        self.spark.sql(f"drop table {table}")
        remove(self.spark, self._place(old))
        self._register()
