"""Changes of tables as DataFrame transformations: old rows in, new rows out.

Nothing here collects. Where the order of source rows decides (the first or last
of several wins), the caller names ordering columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(source: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One source row for each key by the order given; rows with NULL keys never conflict and all stay."""
    by = [F.desc(c) if last and isinstance(c, str) else c for c in order] or [F.lit(1)]
    ranked = source.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return ranked.where((F.col("_n") == 1) | ~whole).drop("_n")


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, object] | None = None, auto: str | None = None, order: list | None = None) -> DataFrame:
    """Append rows; missing columns take their default or NULL, ``auto`` numbers on from the maximum."""
    return target.unionByName(complete(target, rows, defaults, auto, order))


def complete(target: DataFrame, rows: DataFrame, defaults: dict[str, object] | None = None, auto: str | None = None, order: list | None = None, bucket: Column | None = None) -> DataFrame:
    """New rows with all columns of the target, in its order and types.

    Numbers of ``auto`` follow ``order``. ``bucket`` says which stretch of that order a
    row lies in, so that each stretch is numbered by itself from the rows before it;
    without it all rows without a number are ordered in one place.
    """
    defaults = defaults or {}
    cols = []
    for f in target.schema.fields:
        c = F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    out = rows.select(*cols)
    if auto:
        top = target.agg(F.coalesce(F.max(auto), F.lit(0)).alias("_top"))
        given = out.where(F.col(auto).isNotNull())
        most = given.agg(F.coalesce(F.max(auto), F.lit(0)).alias("_most"))
        by = order or [F.lit(1)]
        keep = [c for c in order or [] if isinstance(c, str) and c in rows.columns]
        part = (bucket if bucket is not None else F.lit(0)).cast("bigint").alias("_part")
        open_ = rows.withColumn("_part", part).where(F.col(auto).isNull() if auto in rows.columns else F.lit(True))
        open_ = open_.select(*cols, "_part", *(F.col(c).alias(f"_by_{c}") for c in keep))
        counts = open_.groupBy("_part").agg(F.count("*").alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
        counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        by = [F.col(f"_by_{c}") if c in keep else c for c in by]
        open_ = open_.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
        open_ = open_.join(counts, "_part").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(most))
        kind = target.schema[auto].dataType
        open_ = open_.withColumn(auto, (F.greatest("_top", "_most") + F.col("_before") + F.col("_r")).cast(kind)).select(target.columns)
        out = given.unionByName(open_)
    return out


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None, order: list | None = None) -> DataFrame:
    """INSERT … ON CONFLICT (keys): DO NOTHING without ``update``, else DO UPDATE SET.

    In ``update``, ``t.c`` is the old and ``excluded.c`` the new value. Of new rows with
    one key the first is inserted and, with ``update``, the last one's values win.
    """
    rows = _first(rows, keys, order or [], last=update is not None)
    same = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    fresh = rows.alias("excluded").join(target.alias("t"), on, "left_anti").select(target.columns)
    if update is None:
        return target.unionByName(fresh)
    hit = F.col("excluded._hit").isNotNull()
    joined = target.alias("t").join(rows.withColumn("_hit", F.lit(1)).alias("excluded"), on, "left")
    kept = joined.select(*(F.when(hit, update[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in update else F.col(f"t.{c}").alias(c) for c in target.columns))
    return kept.unionByName(fresh)


def update(target: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE … SET … WHERE: rows for which the condition is not true stay."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return target.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in target.columns))


def update_from(target: DataFrame, source: DataFrame, on: Column, changes: dict[str, Column], key: list[str], order: list) -> DataFrame:
    """UPDATE t SET … FROM s WHERE on: the first source row by ``order`` wins. ``key`` identifies target rows.

    Columns are named t.c and s.c in ``on`` and ``changes``.
    """
    hits = target.alias("t").join(source.alias("s"), on, "inner")
    new = hits.select(*(F.col(f"t.{k}").alias(k) for k in key), *(c.cast(target.schema[n].dataType).alias(f"_new_{n}") for n, c in changes.items()), F.row_number().over(Window.partitionBy(*(F.col(f"t.{k}") for k in key)).orderBy(*order)).alias("_n")).where("_n = 1")
    out = target.join(new, key, "left")
    return out.select(*(F.when(F.col("_n").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns))


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False))) if where is not None else target.limit(0)


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    return target.alias("t").join(source.alias("s"), on, "left_anti")


@dataclass
class When:
    """One WHEN clause: matched or not, a further condition, and what to do."""

    matched: bool
    action: str  # update, delete, insert or nothing
    values: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, on: list[tuple[str, str]], clauses: list[When], order: list) -> DataFrame:
    """MERGE INTO t USING s ON t.a = s.b …: the first fitting WHEN acts on each row.

    Of several source rows with one key, the first by ``order`` counts; columns are
    t.c and s.c in conditions and values.
    """
    right = [b for _, b in on]
    source = _first(source, right, order)
    cond = None
    for a, b in on:
        c = F.col(f"t.{a}") == F.col(f"s.{b}")
        cond = c if cond is None else cond & c
    t, s = target.withColumn("_t", F.lit(1)).alias("t"), source.withColumn("_s", F.lit(1)).alias("s")
    both = t.join(s, cond, "full")
    is_t, is_s = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()
    step = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(clauses))):
        fits = (is_t & is_s) if w.matched else (~is_t & is_s)
        step = F.when(fits & (F.coalesce(w.condition, F.lit(False)) if w.condition is not None else F.lit(True)), F.lit(i)).otherwise(step)
    both = both.withColumn("_do", step)
    gone = [i for i, w in enumerate(clauses) if w.action == "delete"]
    makes = [i for i, w in enumerate(clauses) if w.action == "insert"]
    alive = (is_t & ~F.coalesce(F.col("_do").isin(gone), F.lit(False))) | (~is_t & F.coalesce(F.col("_do").isin(makes), F.lit(False)))
    cols = []
    for c in target.columns:
        value = F.col(f"t.{c}")
        for i, w in enumerate(clauses):
            if w.action in ("update", "insert"):
                new = w.values.get(c, F.col(f"t.{c}") if w.action == "update" else F.lit(None))
                value = F.when(F.col("_do") == i, new).otherwise(value)
        cols.append(value.cast(target.schema[c].dataType).alias(c))
    return both.where(alive).select(*cols)


# --- constraints: rows that break them ---


def check_violations(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a CHECK is not true; NULL counts as broken."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def not_null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return rows.where(bad)


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a NULL never do."""
    whole = rows
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fk_violations(child: DataFrame, parent: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose key, where not NULL, has no parent."""
    cond = None
    for a, b in columns:
        c = F.col(f"c.{a}") == F.col(f"p.{b}")
        cond = c if cond is None else cond & c
    rows = child
    for a, _ in columns:
        rows = rows.where(F.col(a).isNotNull())
    return rows.alias("c").join(parent.alias("p"), cond, "left_anti")
