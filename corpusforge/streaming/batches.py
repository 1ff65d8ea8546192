"""A table of keyed rows that grows by numbered batches: the newest batch's row of a key counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class BatchTable:
    """Batches in a folder that driver and executors share. A batch written again under its number takes the place of itself."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]

    def _names(self, folder: str) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def batches(self) -> list[str]:
        """The folders that count: the last merge, and the whole batches after it."""
        marks = [(int(x.split("=")[1]), x) for x in self._names("commits") if x.startswith(("batch=", "merged="))]
        merged = max((n for n, x in marks if x.startswith("merged=")), default=-1)
        return [x for n, x in sorted(marks) if n > merged or x == f"merged={merged}"]

    def write(self, rows: DataFrame, number: int) -> None:
        """Of several rows of a key in one batch one stays, the greatest by its other columns."""
        self._put(rows.withColumn("_at", F.lit(number).cast("bigint")), f"batch={number}")

    def _put(self, rows: DataFrame, name: str) -> None:
        self._newest(rows.select(*self._columns(), "_at")).write.mode("overwrite").parquet(f"{self.path}/rows/{name}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self._columns() if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("_at", *rest)).alias("_row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"_row.`{c}`").alias(c) for c in self._columns()], "_row._at")

    def _all(self) -> DataFrame:
        kind, names = self.schema + ", _at bigint", self.batches()
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/rows/{x}" for x in names]) if names else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        return self._newest(self._all()).drop("_at")

    def merge(self) -> None:
        """The batches up to the last as one folder beside them; they go when it has its mark, so a merge may end half-way."""
        names = self.batches()
        if len(names) < 2:
            return
        self._put(self._all(), f"merged={names[-1].split('=')[1]}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            for folder in ("commits", "rows"):
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{name}")
                at.getFileSystem(conf).delete(at, True)
