"""CREATE, DROP, SHOW and CALL of procedures, functions and triggers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.dialect import close, find, join, split, tokens

from .interpreter import Block, Interpreter, Returned, parse

ROUTINE = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?P<kind>PROCEDURE|FUNCTION)\s+(?P<unless>IF\s+NOT\s+EXISTS\s+)?(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?:RETURNS\s+(?P<returns>\w+)\s*)?(?:LANGUAGE\s+\w+\s*)?AS\s+\$\$(?P<body>.*)\$\$\s*(?:LANGUAGE\s+(?P<language>\w+))?\s*;?\s*\Z", re.IGNORECASE | re.DOTALL)
TRIGGER = re.compile(r"\s*CREATE\s+TRIGGER\s+(?P<unless>IF\s+NOT\s+EXISTS\s+)?(?P<name>\w+)\s+(?P<when>BEFORE|AFTER|INSTEAD\s+OF)\s+(?P<event>INSERT|UPDATE|DELETE)\s+ON\s+(?P<table>\w+)\s+(?:FOR\s+EACH\s+(?P<each>ROW|STATEMENT)\s+)?EXECUTE\s+(?:FUNCTION|PROCEDURE)\s+(?P<fn>\w+)\s*\(\s*\)\s*;?\s*\Z", re.IGNORECASE)
STATEMENT = re.compile(r"\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION|TRIGGER)|CALL|DROP\s+(?:PROCEDURE|FUNCTION|TRIGGER)|SHOW\s+(?:TRIGGERS|PROCEDURES|FUNCTIONS))\b", re.IGNORECASE)


@dataclass
class Routine:
    name: str
    args: list[tuple[str, str]]  # mode, name
    body: Block
    returns: str | None
    language: str


def run(engine, text: str, args: dict | None = None) -> DataFrame:
    if m := ROUTINE.match(text):
        home = engine.procedures if m["kind"].upper() == "PROCEDURE" else engine.functions
        name = m["name"].lower()
        if name in home and m["unless"]:
            return engine._done(f"{name} exists")
        params = []
        for p in filter(None, (x.strip() for x in m["args"].split(","))):
            words = p.split()
            mode = words[0].upper() if words[0].upper() in ("IN", "OUT", "INOUT") else "IN"
            params.append((mode, words[1 if mode == words[0].upper() else 0].lower()))
        home[name] = Routine(name, params, parse(m["body"]), m["returns"], m["language"] or "plpgsql")
        return engine._done(f"{m['kind'].lower()} {name} created")
    if m := TRIGGER.match(text):
        name = m["name"].lower()
        if name in engine.triggers:
            if m["unless"]:
                return engine._done(f"trigger {name} exists")
            raise ValueError(f"trigger {name} exists")
        engine.triggers[name] = {"when": re.sub(r"\s+", " ", m["when"].upper()), "event": m["event"].upper(), "table": m["table"].lower(), "each": (m["each"] or "ROW").upper(), "function": m["fn"].lower()}
        return engine._done(f"trigger {name} created")
    toks = tokens(text.strip().rstrip(";"))
    if toks[0].up() == "CREATE":
        raise ValueError("the statement is not complete")
    if toks[0].up() == "CALL":
        return call(engine, toks)
    kind = toks[1].up().rstrip("S")
    home = {"PROCEDURE": engine.procedures, "FUNCTION": engine.functions, "TRIGGER": engine.triggers}[kind]
    if toks[0].up() == "SHOW":
        table = toks[3].lower() if kind == "TRIGGER" and len(toks) > 3 and toks[2].up() in ("ON", "FROM") else None
        return engine.spark.createDataFrame([(n,) for n in sorted(home) if table is None or home[n]["table"] == table], "name string")
    exists = toks[2].up() == "IF"
    name = toks[4 if exists else 2].lower()
    if home.pop(name, None) is None and not exists:
        raise ValueError(f"no {kind.lower()} {name}")
    return engine._done(f"{kind.lower()} {name} dropped")


def call(engine, toks) -> DataFrame:
    """CALL name(values): one row of the OUT and INOUT arguments, or of the value returned."""
    name = toks[1].lower()
    routine = engine.procedures.get(name) or engine.functions.get(name)
    if routine is None:
        raise ValueError(f"no procedure {name}")
    given = [] if toks[3] == ")" else split(toks[3:-1])
    machine = Interpreter(engine)
    takes = [n for mode, n in routine.args if mode != "OUT"]
    if len(given) not in (len(takes), len(routine.args)):
        raise ValueError(f"{name} takes {len(takes)} values")
    if len(given) == len(routine.args):
        given = [g for g, (mode, _) in zip(given, routine.args, strict=True) if mode != "OUT"]
    values = [machine.value(g) for g in given]
    machine.scope.update({n: None for _, n in routine.args} | dict(zip(takes, values, strict=True)))
    result = None
    try:
        machine.run(routine.body)
    except Returned as r:
        result = r.value
    out = {n: machine.scope[n] for mode, n in routine.args if mode != "IN"}
    if not out:
        out = {"result": result}
    cols = ", ".join(f"{Interpreter.literal(v)} AS {n}" for n, v in out.items())
    return engine.spark.sql(f"SELECT {cols}")


def fire(engine, table: str, when: str, event: str, rows: DataFrame, old: DataFrame | None = None) -> None:
    """Run the triggers of an event: for each row with new_column (or old_column) bound, or once a statement.

    Bodies that only insert values run for all rows at once, others row by row on the driver.
    """
    for t in list(engine.triggers.values()):
        if (t["table"], t["when"], t["event"]) != (table.lower(), when, event):
            continue
        routine = engine.functions.get(t["function"]) or engine.procedures.get(t["function"])
        if routine is None:
            raise ValueError(f"no function {t['function']}")
        prefix = "old_" if event == "DELETE" else "new_"
        at_once = _inserts(routine.body) if t["each"] == "ROW" else None
        if at_once:
            shown = [F.col(c).alias(prefix + c.lower()) for c in rows.columns] + [F.lit(event).alias("tg_op"), F.lit(table).alias("tg_table_name")]
            engine.register("_changed", rows.select(*shown))
            for target, values in at_once:
                engine.sql(f"INSERT INTO {join(target)} SELECT {join(values)} FROM _changed")
            engine.frames.pop("_changed")
            continue
        bindings = ({prefix + k.lower(): v for k, v in r.asDict().items()} for r in rows.toLocalIterator()) if t["each"] == "ROW" else iter([{}])
        for scope in bindings:
            try:
                Interpreter(engine, scope | {"tg_op": event, "tg_table_name": table}).run(routine.body)
            except Returned:
                pass


def _inserts(body: Block) -> list[tuple[list, list]] | None:
    """Of a body that only inserts one row of values into each of several tables: (table and columns, values).

    Such a trigger runs as one statement over all changed rows. None for any other body.
    """
    if body.declared or body.handler is not None:
        return None
    out = []
    for s in body.body:
        if s[0] == "return":
            break
        toks = s[1] if s[0] == "sql" else []
        v = find(toks, "VALUES")
        if v < 0 or toks[0].up() != "INSERT" or toks[v + 1] != "(" or close(toks, v + 1) != len(toks) - 1 or any(x.up() == "DEFAULT" for x in toks):
            return None
        out.append((toks[2:v], toks[v + 2 : -1]))
    return out if len({t[0].lower() for t, _ in out}) == len(out) else None
