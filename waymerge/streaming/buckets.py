"""Bounded state of a stream in files: per bucket one snapshot and the changes since."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVERY = 8  # batches between snapshots


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the job's own through Spark's file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class BucketTable:
    """Rows of batches below ``folder``, dealt to buckets by a hash of ``keys``.

    Batch n writes its rows to ``changes/epoch=n``; every ``every`` batches all rows are reduced to a new snapshot. A batch reads one
    snapshot and at most ``every`` sets of changes, of the buckets it names. What a repeated batch needs stays; older files go.
    All writes replace what an earlier try of the same batch left.
    """

    def __init__(self, folder: str, schema: str, keys: Sequence[str], reduce: Callable[[DataFrame], DataFrame], buckets: int = 64, every: int = EVERY) -> None:
        self.folder, self.schema, self.keys, self.reduce, self.buckets, self.every = folder, schema, list(keys), reduce, buckets, every

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows, ``buckets`` numbers at most."""
        return sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def last_snapshot(self, epoch: int) -> int:
        """The snapshot that batch ``epoch`` starts from: one before it, so it can be repeated; -1 before the first."""
        return (epoch - 1) // self.every * self.every if epoch > self.every else -1

    def put(self, rows: DataFrame, epoch: int) -> None:
        rows.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/changes/epoch={epoch}")

    def read(self, spark: SparkSession, epoch: int, buckets: Sequence[int] | None = None, own: bool = True) -> DataFrame:
        """All rows up to batch ``epoch`` (``own``: with that batch's), or those of some buckets."""
        start = self.last_snapshot(epoch)
        paths = [f"{self.folder}/snapshots/epoch={start}"] if start >= 0 else []
        paths += [f"{self.folder}/changes/epoch={e}" for e in range(start + 1, epoch + own)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        parts = [spark.read.schema(f"{self.schema}, bucket int").parquet(p) for p in paths]
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(*buckets)) for p in parts]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        return rows.drop("bucket")

    def end(self, spark: SparkSession, epoch: int) -> None:
        """Close a batch: a snapshot if one is due, after which what no batch can ask for any more goes."""
        if epoch == 0 or epoch % self.every:
            return
        start = self.last_snapshot(epoch)
        self.reduce(self.read(spark, epoch)).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/snapshots/epoch={epoch}")
        for e in range(max(0, start - self.every + 1), start + 1):
            remove(spark, f"{self.folder}/changes/epoch={e}")
        if start >= self.every:
            remove(spark, f"{self.folder}/snapshots/epoch={start - self.every}")
