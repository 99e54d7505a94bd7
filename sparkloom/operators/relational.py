"""Relational operators as DataFrame builders where Spark's own method says too little."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.dialect import global_places


def null_last(c: str, desc: bool = False) -> Column:
    """NULL is greater than everything."""
    return F.col(c).desc_nulls_first() if desc else F.col(c).asc_nulls_last()


def _directed(c: Column, desc: bool, first: bool) -> Column:
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else c.asc_nulls_first() if first else c.asc_nulls_last()


def place(df: DataFrame, name: str, keys: list[tuple[str, bool, bool]], rank: bool = False) -> DataFrame:
    """``name`` becomes row_number(), or rank(), OVER (ORDER BY keys) of all rows; keys are (column, descending, NULLs first).

    A window without partitions is one task. Here rows are dealt by ranges of the keys and sorted, each task numbers
    its own, and what stands before a task is added. Hashes of whole rows part equal keys, so no key is one task's.
    """
    from sparkloom.store.files import materialize

    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    by = [*(_directed(F.col(c), desc, first) for c, desc, first in keys), F.col("_tie")]
    done = df.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    done = materialize(done.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    parts = done.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = done.join(F.broadcast(parts), "_part").withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int"))
    if rank:
        out = out.withColumn("_key", F.struct(*(k[0] for k in keys)))
        firsts = out.groupBy("_key").agg(F.min(name).alias("_first"))
        out = out.join(firsts, "_key").withColumn(name, F.col("_first"))
    return out.select(df.columns)


def query(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """A query in Spark's dialect; row_number() and rank() over all rows among its columns are not one task's.

    Those of subqueries, and of a SELECT with DISTINCT, LIMIT or set operations, are left to Spark.
    """
    found = global_places(text)
    if not found:
        return spark.sql(text, args=args)
    inner, places, order = found
    try:
        df = spark.sql(inner, args=args)
        names, k = df.columns, sum(len(p[2]) for p in places)
        names = names[: len(names) - k]
        df = df.toDF(*(f"_c{i}" for i in range(len(names) + k)))
        at = len(names)
        for i, (name, rank, ways) in enumerate(places):
            c = names.index(f"_place_{i}")
            names[c] = name
            df = place(df, f"_c{c}", [(f"_c{at + j}", *way) for j, way in enumerate(ways)], rank)
            at += len(ways)
        df = df.select(df.columns[: len(names)]).toDF(*names)
        return df.orderBy(*(_directed(F.expr(e), *way) for e, *way in order)) if order else df
    except AnalysisException:  # an ORDER BY of columns that are not shown, or a type that files don't have
        return spark.sql(text, args=args)


def in_subquery(df: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    other = sub.toDF("_k").where("_k is not null")
    return df.join(other, F.col(column) == F.col("_k"), "left_semi")


def not_in_subquery(df: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    """NULLs of the subquery do not count; a NULL value is not selected."""
    other = sub.toDF("_k").where("_k is not null")
    return df.where(F.col(column).isNotNull()).join(other, F.col(column) == F.col("_k"), "left_anti")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def top_per_key(left: DataFrame, right: DataFrame, on: str, order: list[Column], k: int, how: str = "inner") -> DataFrame:
    """LATERAL (… ORDER BY … LIMIT k): the first k right rows of each key, joined to the left."""
    w = Window.partitionBy(on).orderBy(*order)
    best = right.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return left.join(best, on, how)


def limit_subquery(df: DataFrame, count: DataFrame) -> DataFrame:
    """LIMIT (SELECT …): a single number, fetched first."""
    rows = count.limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        raise ValueError("LIMIT needs a subquery of one row and one column")
    n = rows[0][0]
    return df if n is None else df.limit(max(0, int(n)))


def intersect_all_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row that is in the right, with all its copies."""
    return _by_membership(left, right, "left_semi")


def except_all_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows of which the right has none, with all their copies."""
    return _by_membership(left, right, "left_anti")


def _by_membership(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    r = right.toDF(*(f"_{i}" for i in range(len(right.columns)))).distinct()
    cond = F.lit(True)
    for i, c in enumerate(left.columns):
        cond = cond & left[c].eqNullSafe(r[f"_{i}"])
    return left.join(r, cond, how)


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE … UNION [ALL]: repeat ``step`` on the newest rows until none are new.

    Each round is written to the shared checkpoint folder. Past ``limit`` rounds an error is raised.
    """
    from sparkloom.store.files import materialize

    new = materialize(start.distinct() if distinct else start)
    done = new
    for _ in range(limit):
        nxt = step(new).toDF(*start.columns)
        if distinct:
            nxt = except_all_set(nxt.distinct(), done)
        new = materialize(nxt)
        if not new.head(1):
            return done
        done = done.unionAll(new)
    raise RuntimeError(f"recursion did not end in {limit} rounds")
