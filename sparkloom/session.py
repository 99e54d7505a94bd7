"""The engine: SQL text in, DataFrames out; tables, transactions, views, prepared statements."""

from __future__ import annotations

import copy
import hashlib
import secrets
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkloom.dialect import Tok, close, find, join, rewrite, split, tokens
from sparkloom.functions import json as json_functions
from sparkloom.functions import text_search
from sparkloom.fts.index import Index
from sparkloom.operators.relational import query as select
from sparkloom.operators.relational import recursive_union
from sparkloom.shipping import ship
from sparkloom.store import dml
from sparkloom.store.partition import Partitioning
from sparkloom.store.tables import TYPES, ColumnDef, Store, TableDef, partitioning


@dataclass
class Transaction:
    """Versions pinned at first use, and what has been staged on them."""

    pinned: dict[str, int] = field(default_factory=dict)
    staged: dict[str, TableDef | None] = field(default_factory=dict)
    explicit: bool = False


class Engine:
    """One session. ``warehouse`` is a folder that all executors can read and write."""

    def __init__(self, spark: SparkSession, warehouse: str, database: str = "main"):
        self.spark, self.store, self.db = spark, Store(spark, warehouse), database
        self.tx = Transaction()
        self.prepared: dict[str, str] = {}
        self.views: dict[str, str] = {}
        self.indexes: dict[str, Index] = {}
        self.index_sources: dict[str, tuple[str, list[str]]] = {}
        self.procedures: dict[str, object] = {}
        self.functions: dict[str, object] = {}
        self.triggers: dict[str, dict] = {}
        self.users: dict[str, dict] = {}
        self.counters: Counter = Counter()
        self.frames: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
        if database not in self.store.databases():
            self.store.files.create(f"{self.store.root}/{database}/.database", "")
        self._register()

    # --- entry points ---

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Run one statement. Queries are lazy; changes return one row with the number of rows affected."""
        from sparkloom.pl import statements as pl

        if pl.STATEMENT.match(text):
            return pl.run(self, text, args)
        toks = tokens(text)
        while toks and toks[-1] == ";":
            toks.pop()
        if not toks:
            raise ValueError("empty statement")
        if isinstance(args, (list, tuple)):
            args = {f"p{i + 1}": v for i, v in enumerate(args)}
        self.counters["queries"] += 1
        head = " ".join(t.up() for t in toks[:2])
        for words, handler in self._routes():
            if head.startswith(words):
                return handler(toks, text, args)
        return self.query(text, args)

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame readable by name."""
        self.frames[name.lower()] = df

    def _routes(self):
        return [
            ("CREATE TABLE", self._create_table), ("DROP TABLE", self._drop_table), ("ALTER TABLE", self._alter_table), ("TRUNCATE", self._truncate),
            ("INSERT", self._insert), ("UPDATE", self._update), ("DELETE", self._delete), ("MERGE", self._merge),
            ("CREATE OR", self._create_view), ("CREATE VIEW", self._create_view), ("DROP VIEW", self._drop_view),
            ("CREATE FULLTEXT", self._create_fulltext), ("DROP FULLTEXT", self._drop_fulltext), ("REINDEX", self._reindex), ("CREATE UNIQUE", self._create_index), ("CREATE INDEX", self._create_index), ("DROP INDEX", self._drop_index),
            ("BEGIN", self._begin), ("START", self._begin), ("COMMIT", self._commit), ("ROLLBACK", self._rollback),
            ("PREPARE", self._prepare), ("EXECUTE", self._execute), ("DEALLOCATE", self._deallocate),
            ("SHOW", self._show), ("EXPLAIN", self._explain), ("CREATE DATABASE", self._create_database), ("DROP DATABASE", self._drop_database), ("USE", self._use),
            ("CREATE USER", self._user), ("DROP USER", self._user), ("ALTER USER", self._user), ("GRANT", self._grant), ("REVOKE", self._grant),
        ]

    # --- queries ---

    def query(self, text: str, args: dict | None = None) -> DataFrame:
        toks = tokens(text)
        self._show_tables_to_spark(toks)
        toks = self._limit(toks, args)
        recursive = self._recursive(toks, args)
        return recursive if recursive is not None else select(self.spark, rewrite(join(toks), self._integral(toks, args)), args)

    def _integral(self, toks: list[Tok], args: dict | None = None) -> Callable[[str, str], bool]:
        """Whether an expression of a query is a whole number, by what Spark's analysis says of it."""
        head = join(toks[: _ctes_end(toks)])
        known: dict[tuple[str, str], bool] = {}

        def integral(expression: str, clause: str) -> bool:
            if (expression, clause) not in known:
                known[expression, clause] = False
                for before in dict.fromkeys((head, "")):
                    try:
                        kind = self.spark.sql(f"{rewrite(before) if before else ''} SELECT {expression} AS v {clause}", args=args).schema[0].dataType
                    except PySparkException:  # an outer column, say: Spark's own division stays
                        continue
                    known[expression, clause] = isinstance(kind, IntegralType)
                    break
            return known[expression, clause]

        return integral

    def _show_tables_to_spark(self, toks: list[Tok]) -> None:
        words = {t.lower().strip('`"') for t in toks if t.kind in ("word", "quoted")}
        if "information_schema" in words:
            self._information_schema()
        if "system" in words:
            self._system()
        for v, text in self.views.items():
            if v in words:
                self._show_tables_to_spark(tokens(text))
                self.spark.sql(rewrite(text)).createOrReplaceTempView(v)
        for name in words & (set(self.store.tables(self.db)) | set(self.tx.staged) | set(self.frames)) - set(self.views):
            if self.tx.staged.get(name, True) is not None:
                d = None if name in self.frames else self.definition(name)
                rows = self.store.read(d, self._parts(toks, d)) if d and d.partition else self.table(name)
                rows.createOrReplaceTempView(name)

    def _parts(self, toks: list[Tok], d: TableDef) -> list[str] | None:
        """Partitions that a query of one table can find rows in, by the comparisons that its WHERE joins by AND; None for all."""
        w = find(toks, "WHERE")
        if w < 0 or toks[0].up() not in ("SELECT", "UPDATE", "DELETE") or sum(t.up() in ("SELECT", "JOIN") for t in toks) > (toks[0].up() == "SELECT"):
            return None
        end = min([len(toks), *(k for x in ("GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW") if (k := find(toks, x, w)) > 0)])
        body, how = toks[w + 1 : end], partitioning(d)
        if find(body, "OR") >= 0:
            return None
        parts = set(how.names())
        for test in split(body, "AND"):
            if len(test) > 2 and test[1] == ".":
                test = test[2:]
            if len(test) < 3 or test[0].lower() != how.column.lower():
                continue
            values = [int(t) if t.kind == "number" and t.isdigit() else t[1:-1] if t.kind == "string" else None for t in test[2:] if t.kind in ("number", "string")]
            if not values or None in values:
                continue
            if len(test) == 3 and test[1] in ("=", "<", "<=", ">", ">="):
                parts &= set(how.prune(str(test[1]), values[0]))
            elif len(test) == 3 and test[1].up() == "BETWEEN":
                parts &= set(how.prune(">=", values[0]))
            elif test[1].up() == "IN" and test[2] == "(" and len(values) == len(split(test[3:-1])):
                parts &= set(how.prune("in", values))
        return [n for n in how.names() if n in parts]

    def table(self, name: str) -> DataFrame:
        name = name.lower()
        if name in self.frames:
            return self.frames[name]
        if name in self.views:
            return self.query(f"SELECT * FROM {name}")
        return self.store.read(self.definition(name))

    def definition(self, name: str) -> TableDef:
        name = name.lower()
        if name in self.tx.staged:
            d = self.tx.staged[name]
            if d is None:
                raise ValueError(f"no table {name}")
            return d
        return self.store.load(self.db, name, self._pin(name))

    def _pin(self, name: str) -> int:
        if name in self.tx.pinned:
            return self.tx.pinned[name]
        v = self.store.version(self.db, name)
        if not v:
            raise ValueError(f"no table {name}")
        if self.tx.explicit:
            self.tx.pinned[name] = v
        return v

    def _limit(self, toks: list[Tok], args: dict | None) -> list[Tok]:
        """LIMIT (SELECT …) at the top: the number is fetched first."""
        i = find(toks, "LIMIT")
        if i >= 0 and i + 2 < len(toks) and toks[i + 1] == "(" and toks[i + 2].up() in ("SELECT", "WITH"):
            j = close(toks, i + 1)
            rows = self.spark.sql(rewrite(join(toks[i + 2 : j])), args=args).limit(2).collect()
            if len(rows) != 1 or len(rows[0]) != 1:
                raise ValueError("LIMIT needs a subquery of one row and one column")
            n = rows[0][0]
            return [*toks[:i], *([Tok("LIMIT", "word"), Tok(str(max(0, int(n))), "number")] if n is not None else []), *toks[j + 1 :]]
        return toks

    def _recursive(self, toks: list[Tok], args: dict | None) -> DataFrame | None:
        """WITH RECURSIVE with any number of CTEs, of which at least one is recursive by UNION, not UNION ALL."""
        if len(toks) < 3 or toks[0].up() != "WITH" or toks[1].up() != "RECURSIVE":
            return None
        parts: list[tuple[str, list[str] | None, list[Tok], int]] = []
        i = 2
        while True:
            name, columns = str(toks[i]), None
            i += 1
            if toks[i] == "(":
                j = close(toks, i)
                columns = [join(c) for c in split(toks[i + 1 : j])]
                i = j + 1
            j = close(toks, i + 1)
            body = toks[i + 2 : j]
            u = find(body, "UNION")
            own = any(t.lower() == name.lower() for t in body) and u >= 0
            parts.append((name, columns, body, 0 if not own else 1 if body[u + 1].up() == "ALL" else 2))
            i = j + 1
            if i >= len(toks) or toks[i] != ",":
                break
            i += 1
        if not any(kind == 2 for *_, kind in parts):
            return None
        for name, columns, body, kind in parts:
            if kind == 2:
                u = find(body, "UNION")
                base = self.spark.sql(rewrite(join(body[:u]), self._integral(body[:u], args)), args=args)
                base = base.toDF(*columns) if columns else base
                step = join(body[u + 1 :])

                def once(new: DataFrame, name: str = name, step: str = step) -> DataFrame:
                    new.createOrReplaceTempView(name)
                    return self.spark.sql(rewrite(step, self._integral([], args)), args=args)

                found = recursive_union(base, once)
            else:
                names = f"({', '.join(columns)})" if columns else ""
                found = self.spark.sql(rewrite(f"WITH {'RECURSIVE ' if kind else ''}{name}{names} AS ({join(body)}) SELECT * FROM {name}", self._integral([], args)), args=args)
            found.createOrReplaceTempView(name)
        return self.spark.sql(rewrite(join(toks[i:]), self._integral([], args)), args=args)

    # --- changes ---

    def _done(self, message: str, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(message, n)], "message string, rows_affected bigint")

    def _put(self, name: str, d: TableDef | None) -> None:
        name = name.lower()
        if not self.tx.explicit:
            base = self.store.last(self.db, name) if d is None or name not in self.tx.pinned else self.tx.pinned[name]
            self.store.commit(self.db, name, base if self.store.version(self.db, name) else self.store.last(self.db, name), d)
            return
        if name not in self.tx.pinned:
            self.tx.pinned[name] = self.store.last(self.db, name)
        self.tx.staged[name] = d

    def _replace(self, name: str, rows: DataFrame, d: TableDef | None = None) -> None:
        d = copy.deepcopy(d or self.definition(name))
        d.paths = [self.store.stage(self.db, name, rows, d)]
        self._put(name, d)

    def _begin(self, toks, text, args) -> DataFrame:
        if self.tx.explicit:
            raise ValueError("a transaction is open")
        self.tx = Transaction(explicit=True, pinned={t: self.store.version(self.db, t) for t in self.store.tables(self.db)})
        return self._done("BEGIN")

    def _commit(self, toks, text, args) -> DataFrame:
        """All staged tables or none: versions are checked first, then written one after another."""
        tx, self.tx = self.tx, Transaction()
        from sparkloom.store.tables import ConflictError

        for name in tx.staged:
            if self.store.last(self.db, name) != tx.pinned[name]:
                raise ConflictError(f"{name} has changed since the transaction began")
        for name, d in tx.staged.items():
            self.store.commit(self.db, name, tx.pinned[name], d)
        self.counters["commits"] += 1
        return self._done("COMMIT")

    def _rollback(self, toks, text, args) -> DataFrame:
        self.tx = Transaction()
        self.counters["rollbacks"] += 1
        return self._done("ROLLBACK")

    def _validate(self, d: TableDef, rows: DataFrame, fresh: DataFrame | None = None) -> None:
        """Constraints on ``fresh`` rows (all by default) and keys over ``rows``."""
        new = fresh if fresh is not None else rows
        bad = dml.not_null_violations(new, [c.name for c in d.columns if c.not_null or c.name in d.key])
        if bad.head(1):
            raise ValueError(f"NULL in a NOT NULL column of {d.name}")
        for check in d.checks:
            if dml.check_violations(new, F.expr(rewrite(check))).head(1):
                raise ValueError(f"CHECK ({check}) of {d.name} does not hold")
        for key in [k for k in [d.key, *d.unique] if k]:
            if dml.unique_violations(rows, key).head(1):
                raise ValueError(f"duplicate key {key} in {d.name}")
        for fk in d.foreign:
            parent = rows if fk["table"].lower() == d.name.lower() else self.table(fk["table"])
            if dml.fk_violations(new, parent, list(zip(fk["columns"], fk["to"], strict=True))).head(1):
                raise ValueError(f"{d.name} has rows without a parent in {fk['table']}")

    def _restrict(self, name: str, rows: DataFrame) -> None:
        """No other table may lose a parent."""
        for child in self.store.tables(self.db):
            if child != name.lower():
                for fk in self.definition(child).foreign:
                    if fk["table"].lower() == name.lower() and dml.fk_violations(self.table(child), rows, list(zip(fk["columns"], fk["to"], strict=True))).head(1):
                        raise ValueError(f"{child} has rows that refer to {name}")

    def _fire(self, name: str, when: str, event: str, rows: DataFrame, old: DataFrame | None = None) -> None:
        if any(t["table"] == name.lower() and t["event"] == event and t["when"] == when for t in self.triggers.values()):
            from sparkloom.pl import statements as pl

            pl.fire(self, name, when, event, rows, old)

    def _create_table(self, toks, text, args) -> DataFrame:
        i = 2
        exists_ok = [t.up() for t in toks[2:5]] == ["IF", "NOT", "EXISTS"]
        i += 3 * exists_ok
        name = toks[i].lower()
        if self.store.version(self.db, name) or self.tx.staged.get(name):
            if exists_ok:
                return self._done(f"table {name} exists")
            raise ValueError(f"table {name} exists")
        j = close(toks, i + 1)
        d = TableDef(name, [])
        for item in split(toks[i + 2 : j]):
            self._column_or_constraint(d, item)
        rest = toks[j + 1 :]
        u = find(rest, "USING")
        d.storage = rest[u + 1].lower() if u >= 0 else "row"
        p = find(rest, "PARTITION")
        if p >= 0:
            d.partition = self._partition(rest[p + 2 :])
        self._put(name, d)
        return self._done(f"table {name} created")

    def _partition(self, toks: list[Tok]) -> dict:
        kind = toks[0].lower()
        j = close(toks, 1)
        out = {"kind": kind, "column": str(toks[2]), "bounds": [], "lists": [], "buckets": 0}
        rest = toks[j + 1 :]
        if kind == "hash":
            out["buckets"] = next((int(t) for t in rest if t.kind == "number"), 1)
        else:
            a = next(k for k, t in enumerate(rest) if t == "(")
            for item in split(rest[a + 1 : close(rest, a)]):
                values = [v for v in item if v.kind in ("number", "string") or v.up() == "MAXVALUE"]
                plain = [None if v.up() == "MAXVALUE" else int(v) if v.kind == "number" else v.strip("'") for v in values]
                (out["bounds"] if kind == "range" else out["lists"]).append([str(item[1]), plain[0] if kind == "range" else plain])
        Partitioning(kind, out["column"], [tuple(b) for b in out["bounds"]], [tuple(b) for b in out["lists"]], out["buckets"]).validate()
        return out

    def _column_or_constraint(self, d: TableDef, item: list[Tok]) -> None:
        names = lambda i: [join(c) for c in split(item[i + 1 : close(item, i)])]
        first = item[0].up()
        if first == "CONSTRAINT":
            return self._column_or_constraint(d, item[2:])
        if first == "PRIMARY":
            d.key = names(2)
        elif first == "UNIQUE":
            d.unique.append(names(1))
        elif first == "CHECK":
            d.checks.append(join(item[2 : close(item, 1)]))
        elif first == "FOREIGN":
            j = close(item, 2)
            d.foreign.append({"columns": names(2), "table": str(item[j + 2]), "to": names(j + 3)})
        else:
            kind = item[1].up()
            if kind not in TYPES:
                raise ValueError(f"unknown type {item[1]}")
            c = ColumnDef(str(item[0]), TYPES[kind], declared=kind)
            i = 2 if len(item) < 3 or item[2] != "(" else close(item, 2) + 1
            while i < len(item):
                w = item[i].up()
                if w == "NOT":
                    c.not_null, i = True, i + 2
                elif w == "PRIMARY":
                    d.key, i = [c.name], i + 2
                elif w == "UNIQUE":
                    d.unique.append([c.name])
                    i += 1
                elif w == "AUTO_INCREMENT":
                    c.auto, i = True, i + 1
                elif w == "CHECK":
                    j = close(item, i + 1)
                    d.checks.append(join(item[i + 2 : j]))
                    i = j + 1
                elif w == "REFERENCES":
                    d.foreign.append({"columns": [c.name], "table": str(item[i + 1]), "to": names(i + 2)})
                    i = close(item, i + 2) + 1
                elif w == "DEFAULT":
                    j = i + 2 + (item[i + 1] in ("-", "+"))
                    if j < len(item) and item[j] == "(":
                        j = close(item, j) + 1
                    c.default, i = join(item[i + 1 : j]), j
                else:
                    i += 1
            d.columns.append(c)
        return None

    def _drop_table(self, toks, text, args) -> DataFrame:
        name = toks[-1].lower()
        if toks[2].up() == "IF" and not self.store.version(self.db, name):
            return self._done(f"no table {name}")
        self.definition(name)
        self._put(name, None)
        return self._done(f"table {name} dropped")

    def _alter_table(self, toks, text, args) -> DataFrame:
        name, what = toks[2].lower(), [t.up() for t in toks[3:]]
        d, rows = copy.deepcopy(self.definition(name)), self.table(name)
        if what[0] == "ADD":
            item = toks[4 + (what[1] == "COLUMN") :]
            self._column_or_constraint(d, item)
            c = d.columns[-1]
            rows = rows.withColumn(c.name, F.expr(c.default or "NULL").cast(c.type))
        elif what[0] == "DROP":
            gone = toks[-1].lower()
            d.columns = [c for c in d.columns if c.name.lower() != gone]
            rows = rows.drop(gone)
        elif what[:2] == ["RENAME", "TO"]:
            new = toks[5].lower()
            d.name = new
            d.paths = [self.store.stage(self.db, new, rows, d)]
            self._put(name, None)
            self._put(new, d)
            return self._done(f"table {name} renamed")
        else:
            i = 5 if what[1] == "COLUMN" else 4
            old, new = str(toks[i]), str(toks[i + 2])
            d.column(old).name = new
            d.key = [new if k == old else k for k in d.key]
            if d.partition and d.partition["column"].lower() == old.lower():
                d.partition["column"] = new
            rows = rows.withColumnRenamed(old, new)
        self._replace(name, rows, d)
        return self._done(f"table {name} altered")

    def _truncate(self, toks, text, args) -> DataFrame:
        d = copy.deepcopy(self.definition(toks[-1]))
        n, d.paths = self.table(toks[-1]).count(), []
        self._restrict(toks[-1], self.spark.createDataFrame([], d.schema()))
        self._put(toks[-1], d)
        return self._done("truncated", n)

    def _insert(self, toks, text, args) -> DataFrame:
        name, i = toks[2].lower(), 3
        d, old = self.definition(name), self.table(name)
        columns = [c.name for c in d.columns]
        if toks[i] == "(" and toks[i + 1].up() not in ("SELECT", "WITH", "VALUES"):
            j = close(toks, i)
            columns, i = [join(c) for c in split(toks[i + 1 : j])], j + 1
        on = next((k for k in range(i, len(toks) - 1) if toks[k].up() == "ON" and toks[k + 1].up() == "CONFLICT"), len(toks))
        source = toks[i:on]
        if source[0].up() == "VALUES":
            lists = [split(v[1 : close(v, 0)]) for v in split(source[1:])]
            if any(len(v) != len(columns) for v in lists):
                raise ValueError("as many values as columns are needed")
            picks = []
            for v in lists:
                picks.append("SELECT " + ", ".join((d.column(c).default or "NULL") if x[0].up() == "DEFAULT" else join(x) for c, x in zip(columns, v, strict=True)))
            rows = self.query(" UNION ALL ".join(f"({p})" for p in picks), args).toDF(*columns)
        else:
            rows = self.query(join(source), args).toDF(*columns)
        # The order of the statement's rows decides numbers and conflicts; they are numbered once and written.
        rows = self._written(rows.withColumn("_seq", F.monotonically_increasing_id()))
        missing = {c.name: c.default for c in d.columns if c.name not in columns and c.default is not None}
        for c, text_ in missing.items():
            rows = rows.withColumn(c, F.expr(text_))
        auto = next((c.name for c in d.columns if c.auto), None)
        new = self._complete(d, old, rows, auto)
        self._fire(name, "BEFORE", "INSERT", new.drop("_seq"))
        if on < len(toks):
            rest = toks[on + 2 :]
            keys = [join(c) for c in split(rest[1 : close(rest, 0)])] if rest[0] == "(" else d.key
            do = find(rest, "DO")
            changes = None
            if rest[do + 1].up() == "UPDATE":
                changes = {}
                for item in split(rest[do + 3 :]):
                    changes[join(item[:1])] = F.expr(self._qualified(item[2:], d, "t"))
            result = dml.upsert(old, new, keys, changes, ["_seq"])
            fresh = result
        else:
            fresh = new.drop("_seq")
            result = old.unionByName(fresh)
        self._validate(d, result, fresh)
        n = new.count()
        if on < len(toks):
            self._replace(name, result)
        else:
            d = copy.deepcopy(d)
            d.paths = [*d.paths, self.store.stage(self.db, name, fresh, d)]
            self._put(name, d)
        self._fire(name, "AFTER", "INSERT", new.drop("_seq"))
        self.counters["rows_inserted"] += n
        return self._done("inserted", n)

    def _written(self, rows: DataFrame) -> DataFrame:
        from sparkloom.store.files import materialize

        return materialize(rows)

    def _complete(self, d: TableDef, old: DataFrame, rows: DataFrame, auto: str | None) -> DataFrame:
        new = dml.complete(old.withColumn("_seq", F.lit(0).cast("bigint")), rows, auto=auto, order=["_seq"], bucket=F.shiftright("_seq", 33))
        return self._written(new)

    def _qualified(self, toks: list[Tok], d: TableDef, alias: str) -> str:
        """Bare column names of the table get its alias; EXCLUDED and other qualifiers stay."""
        names = {c.name.lower() for c in d.columns}
        out = []
        for k, t in enumerate(toks):
            bare = t.kind == "word" and t.lower() in names and (k == 0 or toks[k - 1] != ".") and (k + 1 >= len(toks) or toks[k + 1] not in (".", "("))
            own = t.kind == "word" and t.lower() == d.name.lower() and k + 1 < len(toks) and toks[k + 1] == "."
            out.append(Tok(f"{alias}.{t}" if bare else alias if own else str(t), "word"))
        return rewrite(join(out))

    def _sets(self, toks: list[Tok], d: TableDef, alias: str) -> dict[str, Column]:
        out = {}
        for item in split(toks):
            eq = next(k for k, t in enumerate(item) if t == "=")
            out[d.column(item[eq - 1]).name] = F.expr(self._qualified(item[eq + 1 :], d, alias))
        return out

    def _bind(self, toks: list[Tok], args: dict | None) -> list[Tok]:
        """Parameters as literals, for parts that become column expressions."""

        def literal(v) -> str:
            return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

        return [Tok(literal(args[f"p{t[1:]}"]), "word") if t.kind == "param" else t for t in toks]

    def _update(self, toks, text, args) -> DataFrame:
        toks = self._bind(toks, args)
        name = toks[1].lower()
        d, old = self.definition(name), self.table(name)
        s, f, w = find(toks, "SET"), find(toks, "FROM"), find(toks, "WHERE")
        toks, most = self._most(toks)
        end = min(x for x in (f, w, len(toks)) if x >= 0)
        where = toks[w + 1 :] if w >= 0 else None
        if f >= 0:
            other = str(toks[f + 1])
            alias = next((str(t) for t in toks[f + 2 : w if w >= 0 else None] if t.up() != "AS"), other)
            old = self._written(old.withColumn("_row", F.monotonically_increasing_id()))
            mine = alias_of(toks[2:s], name)
            fix = lambda ts: [Tok("t" if t.lower() == mine.lower() and k + 1 < len(ts) and ts[k + 1] == "." else "s" if t.lower() == alias.lower() and k + 1 < len(ts) and ts[k + 1] == "." else str(t), t.kind) for k, t in enumerate(ts)]
            source = self._written(self.query(f"SELECT * FROM {other}").withColumn("_seq", F.monotonically_increasing_id()))
            sets = self._sets(fix(toks[s + 1 : end]), d, "t")
            new = dml.update_from(old, source, F.expr(self._qualified(fix(where), d, "t")), sets, ["_row"], [F.col("s._seq")])
            n = old.alias("t").join(source.alias("s"), F.expr(self._qualified(fix(where), d, "t")), "left_semi").count()
            new = new.drop("_row")
            changed = new.exceptAll(old.drop("_row"))
        else:
            cond = self._condition(where, name)
            flagged = self._first(self._flag(old, cond, name), most)
            n = flagged.where("_hit").count()
            self._fire(name, "BEFORE", "UPDATE", flagged.where("_hit").drop("_hit"))
            new = self._apply(flagged, toks[s + 1 : end], d)
            changed = self._apply(flagged.where("_hit"), toks[s + 1 : end], d)
        self._validate(d, new)
        self._restrict(name, new)
        changed = self._written(changed) if any(t["event"] == "UPDATE" and t["when"] == "AFTER" for t in self.triggers.values()) else changed
        self._replace(name, new)
        self._fire(name, "AFTER", "UPDATE", changed)
        self.counters["rows_updated"] += n
        return self._done("updated", n)

    def _most(self, toks: list[Tok]) -> tuple[list[Tok], int | None]:
        """A statement without its LIMIT, and the number there."""
        i = find(toks, "LIMIT")
        return (toks, None) if i < 0 else (toks[:i], int(toks[i + 1]))

    def _first(self, flagged: DataFrame, most: int | None) -> DataFrame:
        """Of the rows that are hit only the first ``most``, in the order in which they are stored."""
        if most is None:
            return flagged
        rows = self._written(flagged.withColumn("_row", F.monotonically_increasing_id()))
        chosen = rows.where("_hit").select("_row").orderBy("_row").limit(most).withColumn("_one", F.lit(True))
        return rows.join(chosen, "_row", "left").withColumn("_hit", F.coalesce("_one", F.lit(False))).drop("_row", "_one")

    def _condition(self, where: list[Tok] | None, name: str) -> str:
        return join(where) if where else "true"

    def _flag(self, rows: DataFrame, cond: str, name: str) -> DataFrame:
        """Rows with _hit: is the condition (with subqueries, if it has any) true."""
        toks = tokens(cond)
        self._show_tables_to_spark(toks)
        rows.createOrReplaceTempView(name)
        return self.spark.sql(rewrite(f"SELECT {name}.*, coalesce(({cond}), false) AS _hit FROM {name}", self._integral([])))

    def _apply(self, flagged: DataFrame, toks: list[Tok], d: TableDef) -> DataFrame:
        flagged.createOrReplaceTempView(d.name)
        sets = {}
        for item in split(toks):
            eq = next(k for k, t in enumerate(item) if t == "=")
            sets[d.column(item[eq - 1]).name] = join(item[eq + 1 :])
        cols = ", ".join(f"CAST(CASE WHEN _hit THEN ({sets[c.name]}) ELSE {c.name} END AS {c.type}) AS {c.name}" if c.name in sets else c.name for c in d.columns)
        return self.spark.sql(rewrite(f"SELECT {cols} FROM {d.name}", self._integral([])))

    def _delete(self, toks, text, args) -> DataFrame:
        toks = self._bind(toks, args)
        name = toks[2].lower()
        d, old = self.definition(name), self.table(name)
        u, w = find(toks, "USING"), find(toks, "WHERE")
        gone = None
        if u >= 0:
            other = str(toks[u + 1])
            alias = next((str(t) for t in toks[u + 2 : w] if t.up() != "AS"), other)
            cond = self._qualified([Tok("s" if t.lower() == alias.lower() and k + 1 < len(toks[w + 1 :]) and toks[w + 1 :][k + 1] == "." else str(t), t.kind) for k, t in enumerate(toks[w + 1 :])], d, "t")
            new = dml.delete_using(old, self.query(f"SELECT * FROM {other}"), F.expr(cond))
        else:
            toks, most = self._most(toks)
            flagged = self._first(self._flag(old, self._condition(toks[w + 1 :] if w >= 0 else None, name), name), most)
            self._fire(name, "BEFORE", "DELETE", flagged.where("_hit").drop("_hit"))
            new = flagged.where("NOT _hit").drop("_hit")
            gone = self._written(flagged.where("_hit").drop("_hit")) if any(t["event"] == "DELETE" and t["when"] == "AFTER" for t in self.triggers.values()) else None
        n = old.count() - new.count()
        self._restrict(name, new)
        self._replace(name, new)
        if gone is not None:
            self._fire(name, "AFTER", "DELETE", gone)
        self.counters["rows_deleted"] += n
        return self._done("deleted", n)

    def _merge(self, toks, text, args) -> DataFrame:
        """MERGE INTO t [AS a] USING s|(query) [AS b] ON a.x = b.y WHEN … THEN …"""
        toks = self._bind(toks, args)
        name = toks[2].lower()
        d, old = self.definition(name), self.table(name)
        u, on = find(toks, "USING"), find(toks, "ON")
        mine = alias_of(toks[3:u], name)
        if toks[u + 1] == "(":
            j = close(toks, u + 1)
            source, alias = self.query(join(toks[u + 2 : j])), alias_of(toks[j + 1 : on], "s")
        else:
            source, alias = self.query(f"SELECT * FROM {toks[u + 1]}"), alias_of(toks[u + 2 : on], str(toks[u + 1]))
        source = self._written(source.withColumn("_seq", F.monotonically_increasing_id()))
        first = find(toks, "WHEN")

        def fix(ts: list[Tok]) -> list[Tok]:
            return [Tok("t" if t.lower() in (mine.lower(), name) and k + 1 < len(ts) and ts[k + 1] == "." else "s" if t.lower() == alias.lower() and k + 1 < len(ts) and ts[k + 1] == "." else str(t), t.kind) for k, t in enumerate(ts)]

        keys = []
        for part in split([t for t in fix(toks[on + 1 : first]) if t not in ("(", ")")], "AND"):
            eq = next(k for k, t in enumerate(part) if t == "=")
            a, b = part[:eq], part[eq + 1 :]
            if b[0] == "t":
                a, b = b, a
            keys.append((str(a[-1]), str(b[-1])))
        clauses = []
        for c in split(toks[first + 1 :], "WHEN"):
            matched = c[0].up() == "MATCHED"
            then = find_flat(c, "THEN")
            cond = c[1 + (not matched) : then]
            cond = F.expr(self._qualified(fix(cond[1:]), d, "t")) if cond else None
            act = c[then + 1 :]
            kind = act[0].up()
            values: dict[str, Column] = {}
            if kind == "UPDATE":
                values = self._sets(fix(act[2:]), d, "t")
            elif kind == "INSERT":
                names = [x.name for x in d.columns]
                k = 1
                if act[1] == "(":
                    k = close(act, 1) + 1
                    names = [join(x) for x in split(act[2 : k - 1])]
                items = split(act[k + 2 : close(act, k + 1)])
                values = {d.column(x).name: F.expr(rewrite(join(fix(v)))) for x, v in zip(names, items, strict=True)}
            clauses.append(dml.When(matched, {"UPDATE": "update", "DELETE": "delete", "INSERT": "insert"}.get(kind, "nothing"), values, cond))
        new = self._written(dml.merge(old, source, keys, clauses, ["_seq"]))
        self._validate(d, new)
        self._restrict(name, new)
        self._replace(name, new)
        return self._done("merged", source.count())

    # --- views, indexes, prepared statements, catalog ---

    def _create_view(self, toks, text, args) -> DataFrame:
        v = find(toks, "VIEW")
        name = toks[v + 1].lower()
        a = find(toks, "AS")
        body = join(toks[a + 1 :])
        if toks[v + 2] == "(":
            columns = join(toks[v + 3 : close(toks, v + 2)])
            body = f"SELECT * FROM ({body}) AS _v({columns})"
        if name in self.views and toks[1].up() != "OR":
            raise ValueError(f"view {name} exists")
        self.views[name] = body
        self.query(f"SELECT * FROM {name}")
        return self._done(f"view {name} created")

    def _drop_view(self, toks, text, args) -> DataFrame:
        name = toks[-1].lower()
        if self.views.pop(name, None) is None and toks[2].up() != "IF":
            raise ValueError(f"no view {name}")
        self.spark.catalog.dropTempView(name)
        return self._done(f"view {name} dropped")

    def _create_index(self, toks, text, args) -> DataFrame:
        unique = toks[1].up() == "UNIQUE"
        i = find(toks, "INDEX")
        name, table = str(toks[i + 1]), toks[i + 3].lower()
        columns = [join(c) for c in split(toks[i + 5 : close(toks, i + 4)])]
        d = copy.deepcopy(self.definition(table))
        if unique:
            if dml.unique_violations(self.table(table), columns).head(1):
                raise ValueError(f"duplicate keys in {table}")
            d.unique.append(columns)
        d.indexes[name] = {"columns": columns, "unique": unique}
        self._put(table, d)
        return self._done(f"index {name} created")

    def _drop_index(self, toks, text, args) -> DataFrame:
        name = str(toks[-1])
        for t in self.store.tables(self.db):
            d = copy.deepcopy(self.definition(t))
            if name in d.indexes:
                own = d.indexes.pop(name)
                d.unique = [u for u in d.unique if not (own["unique"] and u == own["columns"])]
                self._put(t, d)
                return self._done(f"index {name} dropped")
        raise ValueError(f"no index {name}")

    def _create_fulltext(self, toks, text, args) -> DataFrame:
        i = find(toks, "INDEX")
        name, table = str(toks[i + 1]), toks[i + 3].lower()
        columns = [join(c) for c in split(toks[i + 5 : close(toks, i + 4)])]
        if name in self.indexes:
            raise ValueError(f"index {name} exists")
        self.index_sources[name] = (table, columns)
        self._build_index(name)
        return self._done(f"index {name} created")

    def _build_index(self, name: str) -> None:
        """Write postings and documents to the warehouse, sorted by term, so that a search reads its terms only."""
        table, columns = self.index_sources[name]
        d = self.definition(table)
        path = f"{self.store.root}/.indexes/{self.db}/{name}-{uuid.uuid4().hex}"
        Index.build(self.table(table), (d.key or [d.columns[0].name])[0], *columns).save(path)
        self.indexes[name] = Index.load(self.spark, path)
        self.register(name, self.indexes[name].postings)

    def _reindex(self, toks, text, args) -> DataFrame:
        """REINDEX name: the index as its table is now."""
        name = str(toks[-1])
        if name not in self.indexes:
            raise ValueError(f"no index {name}")
        self._build_index(name)
        return self._done(f"index {name} built anew")

    def _drop_fulltext(self, toks, text, args) -> DataFrame:
        if self.indexes.pop(str(toks[-1]), None) is None:
            raise ValueError(f"no index {toks[-1]}")
        self.index_sources.pop(str(toks[-1]))
        self.frames.pop(toks[-1].lower(), None)
        return self._done(f"index {toks[-1]} dropped")

    def search(self, index: str, query: str) -> DataFrame:
        """(doc_id, score) by a full-text index."""
        return self.indexes[index].search(query)

    def _prepare(self, toks, text, args) -> DataFrame:
        a = find(toks, "AS")
        self.prepared[toks[1].lower()] = join(toks[a + 1 :])
        return self._done(f"prepared {toks[1]}")

    def _execute(self, toks, text, args) -> DataFrame:
        name = toks[1].lower()
        if name not in self.prepared:
            raise ValueError(f"nothing is prepared as {name}")
        values = [self.spark.sql(f"SELECT {join(v)} AS v").first()[0] for v in split(toks[3 : close(toks, 2)])] if len(toks) > 2 and toks[2] == "(" and toks[3] != ")" else []
        return self.sql(self.prepared[name], {f"p{i + 1}": v for i, v in enumerate(values)})

    def _deallocate(self, toks, text, args) -> DataFrame:
        if toks[-1].up() == "ALL":
            self.prepared.clear()
        elif self.prepared.pop(toks[-1].lower(), None) is None:
            raise ValueError(f"nothing is prepared as {toks[-1]}")
        return self._done("deallocated")

    def _show(self, toks, text, args) -> DataFrame:
        what = toks[1].up()
        if what == "TABLES":
            return self.spark.createDataFrame([(t,) for t in self.store.tables(self.db)], "table_name string")
        if what == "DATABASES":
            return self.spark.createDataFrame([(t,) for t in sorted({self.db, *self.store.databases()})], "database_name string")
        if what == "CREATE":
            return self.spark.createDataFrame([(self.ddl(toks[-1]),)], "statement string")
        raise ValueError(f"SHOW {what} is not known")

    def ddl(self, name: str) -> str:
        d = self.definition(name)
        parts = []
        for c in d.columns:
            parts.append(" ".join(filter(None, [c.name, c.declared or c.type.upper(), "NOT NULL" if c.not_null else "", f"DEFAULT {c.default}" if c.default else "", "AUTO_INCREMENT" if c.auto else ""])))
        parts += [f"PRIMARY KEY ({', '.join(d.key)})"] if d.key else []
        parts += [f"CHECK ({c})" for c in d.checks] + [f"FOREIGN KEY ({', '.join(f['columns'])}) REFERENCES {f['table']}({', '.join(f['to'])})" for f in d.foreign]
        return f"CREATE TABLE {d.name} ({', '.join(parts)})"

    def _explain(self, toks, text, args) -> DataFrame:
        analyze = toks[1].up() == "ANALYZE"
        df = self.query(join(toks[1 + analyze :]), args)
        lines = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n")
        if analyze:
            t = time.time()
            lines += [f"rows: {df.count()}", f"seconds: {time.time() - t:.3f}"]
        return self.spark.createDataFrame([(x,) for x in lines], "plan string")

    def _create_database(self, toks, text, args) -> DataFrame:
        self.store.files.create(f"{self.store.root}/{toks[-1].lower()}/.database", "")
        return self._done(f"database {toks[-1]} created")

    def _drop_database(self, toks, text, args) -> DataFrame:
        if toks[-1].lower() == self.db:
            raise ValueError("the database is in use")
        self.store.files.delete(f"{self.store.root}/{toks[-1].lower()}")
        return self._done(f"database {toks[-1]} dropped")

    def _use(self, toks, text, args) -> DataFrame:
        if toks[-1].lower() not in self.store.databases() and toks[-1].lower() != self.db:
            raise ValueError(f"no database {toks[-1]}")
        self.db = toks[-1].lower()
        return self._done(f"using {self.db}")

    def _user(self, toks, text, args) -> DataFrame:
        name = str(toks[2])
        if toks[0].up() == "DROP":
            name = str(toks[-1])
            if self.users.pop(name, None) is None and toks[2].up() != "IF":
                raise ValueError(f"no user {name}")
            return self._done(f"user {name} dropped")
        if toks[0].up() == "ALTER" and name not in self.users:
            raise ValueError(f"no user {name}")
        user = self.users.setdefault(name, {"privileges": []})
        secret = next((t for t in toks[3:] if t.kind == "string"), None)
        if secret is not None:
            salt = secrets.token_hex(8)
            user["password"] = (salt, hashlib.pbkdf2_hmac("sha256", secret[1:-1].encode(), salt.encode(), 100_000).hex())
        return self._done(f"user {name}")

    def _grant(self, toks, text, args) -> DataFrame:
        """Kept in the catalog; nothing enforces it."""
        on, to = find(toks, "ON"), max(find(toks, "TO"), find(toks, "FROM"))
        own = self.users.setdefault(str(toks[to + 1]), {"privileges": []})["privileges"]
        for p in split(toks[1:on]):
            item = (join(p).upper(), str(toks[on + 1]))
            if toks[0].up() == "GRANT":
                own.append(item)
            elif item in own:
                own.remove(item)
        return self._done(toks[0].lower())

    def _information_schema(self) -> None:
        defs = [self.definition(t) for t in self.store.tables(self.db)]
        self.spark.createDataFrame([(self.db, d.name, "BASE TABLE") for d in defs] + [(self.db, v, "VIEW") for v in self.views], "table_schema string, table_name string, table_type string").createOrReplaceTempView("_is_tables")
        self.spark.createDataFrame([(self.db, d.name, c.name, i + 1, c.declared or c.type.upper(), "NO" if c.not_null or c.name in d.key else "YES", c.default) for d in defs for i, c in enumerate(d.columns)], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string").createOrReplaceTempView("_is_columns")
        rules = [(self.db, d.name, k, t) for d in defs for k, t in [*((f"{d.name}_pk", "PRIMARY KEY") for _ in [0] if d.key), *((f"{d.name}_unique_{i}", "UNIQUE") for i in range(len(d.unique))), *((f"{d.name}_check_{i}", "CHECK") for i in range(len(d.checks))), *((f"{d.name}_fk_{i}", "FOREIGN KEY") for i in range(len(d.foreign)))]]
        self.spark.createDataFrame(rules, "table_schema string, table_name string, constraint_name string, constraint_type string").createOrReplaceTempView("_is_table_constraints")

    def _system(self) -> None:
        """system.tables, .columns, .indexes, .transactions, .statistics and .memory."""
        defs = [self.definition(t) for t in self.store.tables(self.db)]
        put = lambda name, rows, ddl: self.spark.createDataFrame(rows, ddl).createOrReplaceTempView(f"_sys_{name}")
        put("tables", [(self.db, d.name, d.storage, self.store.version(self.db, d.name), len(d.columns)) for d in defs], "database_name string, table_name string, storage string, version bigint, columns int")
        put("columns", [(d.name, c.name, c.declared or c.type.upper(), i + 1) for d in defs for i, c in enumerate(d.columns)], "table_name string, column_name string, data_type string, position int")
        put("indexes", [(n, d.name, ",".join(x["columns"]), x["unique"], "btree") for d in defs for n, x in d.indexes.items()] + [(n, t, ",".join(c), False, "fulltext") for n, (t, c) in self.index_sources.items()], "index_name string, table_name string, columns string, is_unique boolean, kind string")
        put("transactions", [(self.db, len(self.tx.pinned), len(self.tx.staged))] if self.tx.explicit else [], "database_name string, pinned int, staged int")
        put("statistics", sorted(self.counters.items()), "name string, value bigint")
        memory = self.spark._jvm.java.lang.Runtime.getRuntime()
        put("memory", [("heap_used", memory.totalMemory() - memory.freeMemory()), ("heap_max", memory.maxMemory())], "name string, bytes bigint")

    def statistics(self) -> DataFrame:
        """Counters of this session."""
        return self.spark.createDataFrame(sorted(self.counters.items()) or [("queries", 0)], "name string, value bigint")

    def prometheus(self) -> str:
        return "".join(f"# TYPE engine_{k} counter\nengine_{k} {v}\n" for k, v in sorted(self.counters.items()))

    def _register(self) -> None:
        """Functions that rewritten SQL calls by name."""
        ship(self.spark)
        self.spark.udf.register("json_contains", json_functions._contains)
        word = "regexp_replace(w, '[^a-z0-9]', '')"
        flat = "split(trim(regexp_replace(lower(t), '[\\\\s]+', ' ')), ' ')"
        stop = ", ".join(f"'{w}'" for w in text_search.STOP_WORDS)
        docs = f"transform(filter(transform({flat}, w -> {word}), w -> length(w) > 1), w -> {stem_sql('w')})"
        # A vector made by to_tsvector holds its stems in quotes.
        docs = f"CASE WHEN t RLIKE '^\\'[^\\']*\\':[0-9]' THEN regexp_extract_all(t, '\\'([^\\']*)\\':[0-9]', 1) ELSE {docs} END"
        clean = "regexp_replace(trim(regexp_replace(lower(t), '[\\\\s]+', ' ')), '[^a-z0-9 ]', '')"
        placed = f"sort_array(filter(transform(split(regexp_replace({clean}, {quoted(text_search.CUT)}, ''), ' '), (s, i) -> named_struct('s', s, 'p', i + 1)), x -> x.s <> ''))"
        vector = f"array_join(transform({placed}, x -> concat('\\'', x.s, '\\':', CAST(x.p AS STRING))), ' ')"
        for pattern, new in (text_search.SAME_NEXT, text_search.SAME_AGAIN):
            vector = f"regexp_replace({vector}, {quoted(pattern)}, {quoted(new)})"
        operator = "w IN ('&', '|', '!')"
        tsquery = f"array_join(transform(filter(split(trim(regexp_replace(lower(q), '[\\\\s]+', ' ')), ' '), w -> {operator} OR length({word}) > 0 AND NOT array_contains(array({stop}), {word})), w -> CASE WHEN {operator} THEN w ELSE concat('\\'', {stem_sql(word)}, '\\'') END), ' ')"
        # As text_search.headline: patterns go through the text up to the third hit.
        once = lambda value, name, use: f"element_at(transform(array({value}), {name} -> {use}), 1)"
        loose = f"replace(replace(regexp_replace(x, '(.)', {quoted('$1' + text_search.NOISE)}), 'k', '{text_search.K}'), 'i', '{text_search.I}')"
        own = f"CASE WHEN {stem_sql('x')} = x THEN '' END, CASE WHEN {stem_sql("concat(x, 's')")} = x THEN {quoted('s' + text_search.NOISE)} END, CASE WHEN length(x) > 2 THEN {quoted(text_search.ENDING)} END"
        stems = f"transform(filter(transform({flat.replace('lower(t)', 'lower(q)')}, w -> {word}), w -> length(w) > 0), w -> {stem_sql('w')})"
        pattern = once(stems, "own", f"CASE WHEN size(own) = 0 THEN '' ELSE concat({quoted(text_search.NOISE + '(?:')}, array_join(transform(own, x -> concat({loose}, '(?:', concat_ws('|', {own}), ')')), '|'), ')(?![^ ])') END")
        upto = lambda rest: f"regexp_extract({rest}, concat({quoted(text_search.BEFORE)}, hit), 0)"
        more = lambda part: once(upto(f"substring(flat, length({part}) + 1)"), "own", f"CASE WHEN own <> '' THEN concat({part}, own) END")
        marked = "regexp_replace(concat_ws(' ', head, nullif(tail, '')), concat('(?i)(?<![^ ])', hit), '<b>$0</b>')"
        stretch = f"concat(CASE WHEN length(head) < length(part) THEN '...' ELSE '' END, {marked}, CASE WHEN length(tail) < length(rest) THEN '...' ELSE '' END)"
        stretch = once("substring_index(part, ' ', -6)", "head", once("substring(flat, length(part) + 2)", "rest", once("substring_index(rest, ' ', 4)", "tail", stretch)))
        found = once(more("a"), "b", once(more("b"), "c", f"array_join(transform(filter(array(a, b, c), part -> part IS NOT NULL), part -> {stretch}), ' ... ')"))
        first = "concat(substring_index(flat, ' ', 10), '...')"
        shown = f"CASE WHEN flat IS NULL OR hit IS NULL THEN NULL WHEN flat = '' THEN '' WHEN hit = '' THEN {first} ELSE {once(upto('flat'), 'a', f"CASE WHEN a = '' THEN {first} ELSE {found} END")} END"
        shown = once(f"trim(regexp_replace(t, {quoted(text_search.UNEVEN)}, ' '))", "flat", once(pattern, "hit", shown))
        terms = f"transform(filter(transform({flat}, w -> {word}), w -> length(w) > 0 AND NOT array_contains(array({stop}), w)), w -> {stem_sql('w')})"
        for name, args, kind, body in (
            ("fts_stems", "t STRING", "ARRAY<STRING>", docs),
            ("fts_terms", "t STRING", "ARRAY<STRING>", terms),
            ("fts_match", "doc STRING, query STRING", "BOOLEAN", "arrays_overlap(fts_stems(doc), fts_terms(query)) AND size(fts_terms(query)) > 0"),
            ("ts_rank", "doc STRING, query STRING", "DOUBLE", "CASE WHEN size(fts_stems(doc)) = 0 THEN 0D ELSE aggregate(zip_with(fts_terms(query), array_repeat(fts_stems(doc), size(fts_terms(query))), (q, s) -> size(filter(s, x -> x = q))), 0, (a, b) -> a + b) / size(fts_stems(doc)) END"),
            ("to_tsquery", "q STRING", "STRING", tsquery),
            ("plainto_tsquery", "q STRING", "STRING", "array_join(transform(fts_terms(q), x -> concat('\\'', x, '\\'')), ' & ')"),
            ("websearch_to_tsquery", "q STRING", "STRING", tsquery),
            ("ts_headline", "t STRING, q STRING", "STRING", shown),
            ("int_power", "a BIGINT, b BIGINT", "BIGINT", f"CASE WHEN a IS NOT NULL AND b < 0 THEN 1 WHEN b >= 0 THEN CAST(aggregate(array_repeat(CAST(a AS DECIMAL(38,0)), CAST(CASE WHEN abs(a) < 2 THEN CASE WHEN b = 0 THEN 0 ELSE 2 - b % 2 END ELSE least(b, 64) END AS INT)), CAST(1 AS DECIMAL(38,0)), (x, y) -> CAST(x * y AS DECIMAL(38,0))) AS BIGINT) END"),
            ("int_root", "a BIGINT, r BIGINT", "BIGINT", "CASE WHEN CAST(r AS DECIMAL(20,0)) * CAST(r AS DECIMAL(20,0)) > a THEN r - 1 WHEN CAST(r + 1 AS DECIMAL(20,0)) * CAST(r + 1 AS DECIMAL(20,0)) <= a THEN r + 1 ELSE r END"),
            ("int_sqrt", "a BIGINT", "BIGINT", "CASE WHEN a < 0 THEN CAST(raise_error('square root of a negative number') AS BIGINT) ELSE int_root(a, CAST(floor(sqrt(a)) AS BIGINT)) END"),
            ("to_tsvector", "t STRING", "STRING", vector),
        ):
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def quoted(text: str) -> str:
    """Text as a literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stem_sql(w: str) -> str:
    """The stem of a word as SQL text."""
    out = f"CASE WHEN length({w}) > 3 AND endswith({w}, 's') AND NOT endswith({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"
    for s in reversed(text_search.SUFFIXES):
        out = f"CASE WHEN length({w}) > {len(s) + 2} AND endswith({w}, '{s}') THEN left({w}, length({w}) - {len(s)}) ELSE {out} END"
    return out


def _ctes_end(toks: list[Tok]) -> int:
    """Place behind the CTEs of a query that begins with WITH; 0 for others."""
    if not toks or toks[0].up() != "WITH":
        return 0
    i = 1 + (len(toks) > 1 and toks[1].up() == "RECURSIVE")
    while True:
        i += 1
        if toks[i] == "(":
            i = close(toks, i) + 1
        i = close(toks, i + 1) + 1
        if i >= len(toks) or toks[i] != ",":
            return i
        i += 1


def alias_of(toks: list[Tok], default: str) -> str:
    names = [str(t) for t in toks if t.kind == "word" and t.up() != "AS"]
    return names[0] if names else default


def find_flat(toks: list[Tok], word: str) -> int:
    """Place of a word that no CASE holds."""
    depth = 0
    for i, t in enumerate(toks):
        depth += (t.up() == "CASE") - (t.up() == "END")
        if depth == 0 and t.up() == word:
            return i
    return -1
