"""A keyed table that micro-batches change: a base in hash buckets, and deltas beside it.

A micro-batch writes its own newest rows and nothing else, so written bytes follow the batch.
Readers merge base and deltas: of all rows of a key the one with the largest order counts, and
of equal orders the largest values. That merge gives the same whichever rows it sees twice, so
a batch that is replayed overwrites its own delta, and compaction needs no transaction: it
writes the touched buckets anew and only then removes what they replace. Buckets that no delta
names are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgate.session import make_folder, remove_folder, subfolders


class MergeTable:
    """Newest row per `key` by `order` in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str,
                 key: str = "name", order: str = "ts", buckets: int = 64, every: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        self.key, self.order, self.buckets, self.every = key, order, buckets, every
        self.values = [c for c in self.schema.names if c not in (key, order)]
        for part in ("base", "delta"):
            make_folder(spark, f"{self.path}/{part}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(self.key).agg(
            F.max(F.struct(self.order, *self.values)).alias("v"))
        return newest.select(self.key, "v.*").select(*self.schema.names)

    def _part(self, part: str, version: str) -> DataFrame:
        """Rows of the base or the deltas, with their bucket and version."""
        schema = StructType(list(self.schema.fields)).add(version, "long").add("bucket", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.path}/{folder}")

    def read(self) -> DataFrame:
        base = self._part("base", "upto").select(*self.schema.names)
        return self._newest(base.unionByName(self._part("delta", "epoch").select(*self.schema.names)))

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """A foreachBatch function."""
        self._write(self._newest(batch.select(*self.schema.names)), f"delta/epoch={epoch}")
        if (epoch + 1) % self.every == 0:
            self.compact(epoch)

    def _names(self, folder: str, name: str) -> list[int]:
        found = subfolders(self.spark, f"{self.path}/{folder}")
        return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))

    def compact(self, upto: int) -> None:
        """Put the deltas up to an epoch into the base; only buckets they touch are rewritten."""
        epochs = [e for e in self._names("delta", "epoch") if e <= upto]
        touched = sorted({b for e in epochs for b in self._names(f"delta/epoch={e}", "bucket")})
        if not touched:
            return
        old = self._part("base", "upto").where(F.col("bucket").isin(touched))
        new = self._part("delta", "epoch").where(F.col("epoch") <= upto)
        rows = old.select(*self.schema.names).unionByName(new.select(*self.schema.names))
        earlier = [v for v in self._names("base", "upto") if v != upto]
        self._write(self._newest(rows), f"base/upto={upto}")
        for v in earlier:
            for b in set(self._names(f"base/upto={v}", "bucket")) & set(touched):
                remove_folder(self.spark, f"{self.path}/base/upto={v}/bucket={b}")
        for e in epochs:
            remove_folder(self.spark, f"{self.path}/delta/epoch={e}")
