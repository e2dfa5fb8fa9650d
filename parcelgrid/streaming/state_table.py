"""Keyed state of a stream as a table whose buckets are rewritten by batch.

A micro-batch reads the newest version of the buckets that its keys fall into and writes new versions of those, so its
cost grows with the buckets it meets and not with the batches before it.  Versions lie in ``batch=<n>/bucket=<b>``; the
index of a batch, at most ``buckets`` rows, names the version of each bucket and is written last, so a batch that is
repeated after a failure starts from the same state and replaces what it wrote.  Older versions may be deleted once
no query needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SEED = -1


class StateTable:
    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 256):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema = T.StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions(self, before: int) -> dict[int, int]:
        """Bucket -> batch of its newest version, at most ``buckets`` entries."""
        if before - 1 < SEED:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/index/batch={before - 1}")
        return {r.bucket: r.version for r in rows.collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of ``rows``."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows as of the batch before ``before``, of all buckets or of those given."""
        newest = self._versions(before)
        wanted = newest if buckets is None else [b for b in buckets if b in newest]
        paths = [f"{self.folder}/rows/batch={newest[b]}/bucket={b}" for b in wanted]
        if not paths:
            return self.empty()
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, batch: int, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """``rows`` as the whole content of ``buckets`` (all buckets if None) from this batch on."""
        path = f"{self.folder}/rows/batch={batch}"
        names = self.schema.fieldNames()
        # files of a bucket by parts of its rows, so that a hot key is written by several tasks
        spread = F.pmod(F.xxhash64(*names), F.lit(8))
        placed = rows.select(*names).withColumn("bucket", self.bucket()).repartition(F.col("bucket"), spread)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        full = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
        written = {r[0] for r in full.select("bucket").distinct().collect()}
        replaced = set(range(self.buckets)) if buckets is None else set(buckets)
        versions = {b: v for b, v in self._versions(batch).items() if b not in replaced} | {b: batch for b in written}
        index = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version long")
        index.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/index/batch={batch}")

    def last_batch(self) -> int | None:
        """Newest batch with a written index; None for a table that was never written."""
        from py4j.protocol import Py4JJavaError

        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/index")
        try:
            found = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        except Py4JJavaError:
            return None
        done = [int(s.getPath().getName().split("=")[1]) for s in found]
        return max(done, default=None)
