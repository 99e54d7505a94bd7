"""Tables dealt to shards by ranges of a hash of their key.

A shard holds an equal range of the 32-bit FNV-1a hashes of the key as text. A
query for one key reads the shard that owns it; any other reads all of them, and
the result is what the shards give, one after another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.compat import fnv1a32

SPAN = 1 << 32


@dataclass(frozen=True)
class Shards:
    key: str
    count: int

    def route(self) -> Column:
        """Shard of a row, 0 to count - 1; rows without a key go to the first."""
        return F.coalesce(F.floor(fnv1a32(F.col(self.key).cast("string")) * F.lit(self.count) / F.lit(SPAN)), F.lit(0)).cast("int")

    def owner(self, value) -> int:
        """Shard of one key."""
        h = 2166136261
        for b in str(value).encode():
            h = (h ^ b) * 16777619 & SPAN - 1
        return h * self.count // SPAN

    def write(self, df: DataFrame, path: str) -> None:
        df.withColumn("_shard", self.route()).write.partitionBy("_shard").parquet(path)

    def read(self, spark: SparkSession, path: str, value=None) -> DataFrame:
        """All rows, or those of one key from the shard that owns it."""
        df = spark.read.parquet(path)
        if value is not None:
            df = df.where((F.col("_shard") == self.owner(value)) & (F.col(self.key) == value))
        return df.drop("_shard")
