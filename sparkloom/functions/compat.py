"""Rules that differ from standard SQL, each behind a name of its own."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def compat_not(p: Column) -> Column:
    """Two-valued NOT: unknown counts as false, so its negation is true."""
    return ~F.coalesce(p, F.lit(False))


def compat_in(value: Column, items: list) -> Column:
    """IN that skips NULL items and is false for a NULL value."""
    return F.coalesce(value.isin([i for i in items if i is not None]), F.lit(False))


def compat_not_in(value: Column, items: list) -> Column:
    """NOT IN that skips NULL items and is false for a NULL value."""
    return value.isNotNull() & ~value.isin([i for i in items if i is not None])


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division that truncates toward zero; an error for 0."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def avg_trunc(c) -> Column:
    """Grouped average as a whole number, truncated toward zero."""
    return F.call_function("div", F.sum(c).cast("bigint"), F.nullif(F.count(c), F.lit(0)))


def ntile_spread(n: int, w: WindowSpec, partition: list[str]) -> Column:
    """NTILE that spreads the remainder: floor(i n / total) + 1."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return (F.floor((F.row_number().over(w) - 1) * max(n, 1) / total) + 1).cast("bigint")


def lpad_tail(s: Column, size: int, pad: str) -> Column:
    """Whole pads in front until long enough, then the last ``size`` characters."""
    if not pad:
        return s
    reps = F.ceil(F.greatest(F.lit(size) - F.length(s), F.lit(0)) / len(pad)).cast("int")
    return F.call_function("right", F.concat(F.call_function("repeat", F.lit(pad), reps), s), F.lit(size))


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("bigint")


def concat_skip(*cols: Column) -> Column:
    """CONCAT that skips NULL."""
    return F.concat_ws("", *cols)


def substr_clamped(s: Column, start: int, size: int | None = None) -> Column:
    """SUBSTR with start below 1 taken as 1 and a negative size as 0."""
    start = max(start, 1)
    return s.substr(F.lit(start), F.lit(max(size, 0)) if size is not None else F.greatest(F.length(s), F.lit(0)))


def int_pow(a: Column, b: Column) -> Column:
    """Whole-number power; 1 for a negative exponent, an error beyond 64 bits."""
    a, b = a.cast("bigint"), b.cast("bigint")
    # Powers of -1, 0 and 1 need the exponent's parity only, all others overflow before the 64th factor.
    factors = F.when(F.abs(a) < 2, F.when(b == 0, F.lit(0)).otherwise(F.lit(2) - b % 2)).otherwise(F.least(b, F.lit(64)))
    product = F.aggregate(F.array_repeat(a.cast("decimal(38,0)"), F.greatest(factors, F.lit(0)).cast("int")), F.lit(1).cast("decimal(38,0)"), lambda x, y: (x * y).cast("decimal(38,0)"))
    return F.when(a.isNotNull() & (b < 0), F.lit(1).cast("bigint")).when(b >= 0, product.cast("bigint"))


def int_sqrt(a: Column) -> Column:
    """Floor of the square root; an error below 0."""
    a = a.cast("bigint")
    near = F.floor(F.sqrt(a)).cast("bigint")
    square = lambda r: r.cast("decimal(20,0)") * r.cast("decimal(20,0)")
    exact = F.when(square(near) > a, near - 1).when(square(near + 1) <= a, near + 1).otherwise(near)
    return F.when(a < 0, F.raise_error(F.lit("square root of a negative number")).cast("bigint")).otherwise(exact)


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_bool(s: Column) -> Column:
    """Text to boolean: true/1/yes, false/0/no in any case, else an error."""
    v = F.lower(s)
    return F.when(s.isNull(), F.lit(None).cast("boolean")).when(v.isin("true", "1", "yes"), F.lit(True)).when(v.isin("false", "0", "no"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def fnv1a32(s: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    hexes = F.hex(F.encode(s, "UTF-8"))
    places = F.when(F.length(hexes) > 0, F.sequence(F.lit(0), (F.length(hexes) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    numbers = F.transform(places, lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.aggregate(numbers, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))
