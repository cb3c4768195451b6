"""A keyed table on plain Parquet that batches of updates merge into.

Rows are dealt to buckets by a hash of their keys.  A batch rewrites the buckets that it touches and no others: it
reads their present versions, keeps the row with the highest order of each key and writes new versions beside the old.  It
counts from the moment its manifest, one small file, is in place.  A batch that ran before is skipped, and one that
was cut off writes its folder again, so a retry changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """path: the table's folder; keys and order as in upsert(); buckets: fixed for the table's life, so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.schema = schema if not isinstance(schema, str) else spark.createDataFrame([], schema).schema

    def versions(self) -> dict[int, int]:
        """The batch that wrote each bucket last; a row a bucket."""
        try:
            log = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        return {r["bucket"]: r["version"] for r in log.filter("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("version")).collect()}

    def committed(self, batch: int) -> bool:
        try:
            return bool(self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifest").filter(F.col("batch") == batch).take(1))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The present rows, of all buckets or of some."""
        found = [f"{self.path}/data/batch={v}/bucket={b}" for b, v in sorted(self.versions().items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, updates: DataFrame, batch: int) -> list[int]:
        """The buckets rewritten; batches must be numbered upwards.  Equal orders of a key keep the row of the later batch."""
        if self.committed(batch):
            return []
        updates = updates.select(*self.schema.fieldNames()).withColumn("bucket", self.bucket())
        touched = {r[0] for r in updates.select("bucket").distinct().collect()}
        if touched:
            present = self.read(touched).withColumn("bucket", self.bucket()).withColumn("_late", F.lit(0))
            rows = present.unionByName(updates.withColumn("_late", F.lit(1))).repartition(min(len(touched), self.buckets), "bucket")
            first = Window.partitionBy("bucket", *self.keys).orderBy(F.desc(self.order), F.desc("_late"))
            merged = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_late")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        marks = [(b, batch) for b in sorted(touched)] or [(-1, batch)]  # a batch without rows is marked too
        self.spark.createDataFrame(marks, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/of={batch}")
        return sorted(touched)
