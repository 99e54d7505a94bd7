"""JSON operators as column expressions. Only containment of a part that is itself a column needs Python."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sparkloom.shipping import ship


def path_of(*steps: str | int) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in steps)


def get(doc: Column, *steps: str | int) -> Column:
    """-> and #>: the value as JSON text; NULL where it is missing or JSON null."""
    return F.to_json(F.try_variant_get(F.parse_json(doc), path_of(*steps), "variant"))


def get_text(doc: Column, *steps: str | int) -> Column:
    """->> and #>>: the value as text."""
    return F.get_json_object(doc, path_of(*steps).replace('["', "['").replace('"]', "']"))


def _any(doc: Column, test: Column) -> Column:
    return F.coalesce(test, F.when(doc.isNotNull(), F.lit(False)))


def has_key(doc: Column, key: str) -> Column:
    return _any(doc, F.array_contains(F.json_object_keys(doc), key))


def has_any(doc: Column, keys: list[str]) -> Column:
    return _any(doc, F.arrays_overlap(F.json_object_keys(doc), F.array(*map(F.lit, keys))))


def has_all(doc: Column, keys: list[str]) -> Column:
    return _any(doc, F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(doc))) == 0)


def holds(a, b) -> bool:
    """Objects by key, arrays by elements, scalars by equality."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and holds(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_plain(x) == _plain(y) for x in a) for y in b)
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _plain(v) -> str:
    """A value as text that is the same for equal values."""
    return json.dumps(v if not isinstance(v, float) or v % 1 else int(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def contains_sql(doc: str, part: str) -> str:
    """SQL of ``doc @> part`` for a part that is known: a test of each of its leaves, all in the JVM."""
    tests: list[str] = []

    def quoted(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def walk(path: str, v) -> None:
        at = f"try_variant_get(_v, {quoted(path)}, 'variant')"
        if isinstance(v, dict):
            tests.append(f"schema_of_variant({at}) LIKE 'OBJECT<%'")
            for k, w in v.items():
                key = json.dumps(k, ensure_ascii=False)
                walk(f"{path}[{key}]", w)
        elif isinstance(v, list):
            items = f"try_variant_get(_v, {quoted(path)}, 'array<variant>')"
            tests.append(f"schema_of_variant({at}) LIKE 'ARRAY<%'")
            tests.extend(f"exists({items}, _x -> to_json(_x) = {quoted(_plain(w))})" for w in v)
        elif v is None:
            tests.append(f"is_variant_null({at})")
        else:
            tests.append(f"coalesce(to_json({at}) = {quoted(_plain(v))}, false)")

    walk("$", json.loads(part))
    every = " AND ".join(f"coalesce({t}, false)" for t in tests)
    return f"(CASE WHEN {doc} IS NOT NULL THEN element_at(transform(array(parse_json({doc})), _v -> {every}), 1) END)"


@F.pandas_udf(BooleanType())
def _contains(doc: pd.Series, part: pd.Series) -> pd.Series:
    known: dict[str, object] = {}

    def load(s):
        if s not in known:
            if len(known) > 10_000:
                known.clear()
            known[s] = json.loads(s)
        return known[s]

    return pd.Series([None if a is None or b is None else holds(load(a), load(b)) for a, b in zip(doc, part, strict=True)], dtype=object)


def contains(doc: Column | str, part: Column | str) -> Column:
    """@>: does ``doc`` contain ``part``; NULL for NULL, an error for text that is no JSON.

    With a column's name and the part's own text it stays in the JVM.
    """
    if isinstance(part, str) and isinstance(doc, str):
        return F.expr(contains_sql(f"`{doc}`", part))
    ship()
    return _contains(F.col(doc) if isinstance(doc, str) else doc, F.lit(part) if isinstance(part, str) else part)


def is_valid(doc: Column) -> Column:
    """Is the text one whole JSON value; NULL for NULL.

    Spark's parser ignores what follows a value, so the text is parsed as an array's and as an
    object's only value: whatever follows a value is wrong in one of them. Objects with a key
    twice are not valid unless spark.sql.variant.allowDuplicateKeys is set.
    """
    one, two = F.concat(F.lit("["), doc, F.lit("]")), F.concat(F.lit('{"a":'), doc, F.lit("}"))
    return F.when(doc.isNotNull(), F.try_parse_json(one).isNotNull() & F.try_parse_json(two).isNotNull())


VALID_SQL = "(try_parse_json(concat('[', {0}, ']')) IS NOT NULL AND try_parse_json(concat('{{\"a\":', {0}, '}}')) IS NOT NULL)"
