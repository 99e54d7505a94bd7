"""Range, list and hash partitioning: routing, pruning and checks of a declaration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.compat import fnv1a32

MAXVALUE = None


@dataclass
class Partitioning:
    """kind: range (names with upper bounds, MAXVALUE last), list (names with values) or hash (buckets)."""

    kind: str
    column: str
    bounds: list[tuple[str, object]] = field(default_factory=list)
    lists: list[tuple[str, list]] = field(default_factory=list)
    buckets: int = 0

    def validate(self) -> None:
        if self.kind == "range":
            values = [v for _, v in self.bounds]
            if not values:
                raise ValueError("no partitions")
            if MAXVALUE in values[:-1]:
                raise ValueError("MAXVALUE must come last")
            known = [v for v in values if v is not MAXVALUE]
            if any(a >= b for a, b in zip(known, known[1:], strict=False)):
                raise ValueError("bounds must ascend")
        elif self.kind == "list":
            flat = [v for _, vs in self.lists for v in vs]
            if not flat or len(flat) != len(set(flat)):
                raise ValueError("list values must be given, once each")
        elif self.kind == "hash":
            if self.buckets < 1:
                raise ValueError("buckets must be positive")
        else:
            raise ValueError(f"unknown kind of partitioning: {self.kind}")

    def route(self) -> Column:
        """Name of the partition of a row; NULL where none takes it."""
        c = F.col(self.column)
        if self.kind == "hash":
            return F.concat(F.lit("p"), F.pmod(fnv1a32(c.cast("string")), F.lit(self.buckets)).cast("string"))
        out = F.lit(None).cast("string")
        if self.kind == "range":
            for name, bound in reversed(self.bounds):
                out = F.when(F.lit(True) if bound is MAXVALUE else c < bound, F.lit(name)).otherwise(out)
            return F.when(c.isNotNull(), out)
        for name, values in reversed(self.lists):
            out = F.when(c.isin(values), F.lit(name)).otherwise(out)
        return out

    def prune(self, op: str, value) -> list[str]:
        """Partitions that rows with ``column op value`` may lie in. ``in`` takes a list."""
        if op == "in":
            return [n for n in self.names() if any(n in self.prune("=", v) for v in value)]
        if self.kind == "range":
            out, low = [], None
            for name, high in self.bounds:
                inside = {
                    "=": (low is None or value >= low) and (high is MAXVALUE or value < high),
                    "<": low is None or low < value,
                    "<=": low is None or low <= value,
                    ">": high is MAXVALUE or high > value,
                    ">=": high is MAXVALUE or high > value,
                }[op]
                if inside:
                    out.append(name)
                low = high
            return out
        if self.kind == "list" and op == "=":
            return [n for n, vs in self.lists if value in vs]
        if self.kind == "hash" and op == "=":
            h = 2166136261
            for b in str(value).encode():
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            return [f"p{h % self.buckets}"]
        return self.names()

    def names(self) -> list[str]:
        if self.kind == "hash":
            return [f"p{i}" for i in range(self.buckets)]
        return [n for n, _ in (self.bounds if self.kind == "range" else self.lists)]


def write(df: DataFrame, how: Partitioning, path: str) -> None:
    """Write by partition, so that filters on ``_part`` read only the partitions named."""
    how.validate()
    df.withColumn("_part", how.route()).write.partitionBy("_part").mode("append").parquet(path)


def read(spark, path: str, how: Partitioning, op: str | None = None, value=None) -> DataFrame:
    df = spark.read.parquet(path)
    if op is not None:
        df = df.where(F.col("_part").isin(how.prune(op, value)))
        c = F.col(how.column)
        df = df.where({"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op] if op != "in" else c.isin(value))
    return df.drop("_part")
