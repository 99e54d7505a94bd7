"""A small procedural language, run on the driver; its SQL runs on the cluster."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from sparkloom.dialect import Tok, close, find, join, split, tokens


class Leave(Exception):
    """EXIT."""


class Again(Exception):
    """CONTINUE."""


class Returned(Exception):
    def __init__(self, value: Any):
        self.value = value


class Raised(RuntimeError):
    """RAISE EXCEPTION."""


@dataclass
class Block:
    declared: list[tuple[str, list[Tok]]] = field(default_factory=list)
    body: list[list] = field(default_factory=list)
    handler: list[list] | None = None


class Parser:
    """Tokens of a body to nested lists: [kind, ...]."""

    def __init__(self, toks: list[Tok]):
        self.t, self.i = toks, 0

    def at(self, *words: str) -> bool:
        return [x.up() for x in self.t[self.i : self.i + len(words)]] == list(words)

    def skip(self, *words: str) -> None:
        if not self.at(*words):
            raise ValueError(f"{' '.join(words)} expected at {join(self.t[self.i : self.i + 5])!r}")
        self.i += len(words)

    def until(self, *ends: str) -> list[Tok]:
        """Tokens up to one of the words or ';' outside brackets and CASE; the end is consumed."""
        start, depth, case = self.i, 0, 0
        while self.i < len(self.t):
            x = self.t[self.i]
            depth += (x in ("(", "[")) - (x in (")", "]"))
            if depth == 0 and case == 0 and (x in ends or x.up() in ends):
                self.i += 1
                return self.t[start : self.i - 1]
            case += (x.up() == "CASE") - (x.up() == "END" and case > 0)
            self.i += 1
        raise ValueError(f"{' or '.join(ends)} expected")

    def block(self) -> Block:
        b = Block()
        if self.at("DECLARE"):
            self.i += 1
            while not self.at("BEGIN"):
                item = self.until(";")
                k = next((k for k, x in enumerate(item) if x == ":=" or x.up() == "DEFAULT"), len(item))
                b.declared.append((item[0].lower(), item[k + 1 :]))
        self.skip("BEGIN")
        b.body = self.statements("END", "EXCEPTION")
        if self.at("EXCEPTION"):
            self.skip("EXCEPTION", "WHEN", "OTHERS", "THEN")
            b.handler = self.statements("END")
        self.skip("END")
        if self.i < len(self.t) and self.t[self.i] == ";":
            self.i += 1
        return b

    def statements(self, *ends: str) -> list[list]:
        out = []
        while not any(self.at(e) for e in ends):
            if self.i >= len(self.t):
                raise ValueError(f"{ends[0]} expected")
            out.append(self.statement())
        return out

    def loop(self) -> list[list]:
        body = self.statements("END")
        self.skip("END", "LOOP")
        self.until(";")
        return body

    def statement(self) -> list:
        if self.at("BEGIN") or self.at("DECLARE"):
            return ["block", self.block()]
        if self.at("IF"):
            self.i += 1
            arms = [(self.until("THEN"), self.statements("ELSIF", "ELSE", "END"))]
            while self.at("ELSIF"):
                self.i += 1
                arms.append((self.until("THEN"), self.statements("ELSIF", "ELSE", "END")))
            if self.at("ELSE"):
                self.i += 1
                arms.append((None, self.statements("END")))
            self.skip("END", "IF")
            self.until(";")
            return ["if", arms]
        if self.at("WHILE"):
            self.i += 1
            return ["while", self.until("LOOP"), self.loop()]
        if self.at("LOOP"):
            self.i += 1
            return ["while", None, self.loop()]
        if self.at("FOR"):
            name = self.t[self.i + 1].lower()
            self.i += 2
            self.skip("IN")
            over = self.until("LOOP")
            return ["for", name, over, self.loop()]
        s = self.until(";")
        kind = s[0].up()
        if len(s) > 1 and s[1] == ":=":
            return ["set", s[0].lower(), s[2:]]
        if kind in ("EXIT", "CONTINUE"):
            return [kind.lower(), s[2:] if len(s) > 1 else None]
        if kind in ("RETURN", "RAISE"):
            return [kind.lower(), s[1:]]
        if kind == "PERFORM":
            return ["perform", s[1:]]
        into = find(s, "INTO") if kind == "SELECT" else -1
        if into >= 0:
            frm = find(s, "FROM", into)
            names = [n[0].lower() for n in split(s[into + 1 : frm if frm >= 0 else None])]
            return ["into", names, [*s[:into], *(s[frm:] if frm >= 0 else [])]]
        return ["sql", s]


class Interpreter:
    """Runs one call. ``scope`` holds variables; results of RAISE NOTICE are in ``notices``."""

    def __init__(self, engine, scope: dict[str, Any] | None = None):
        self.engine, self.scope, self.notices = engine, dict(scope or {}), []

    @staticmethod
    def literal(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v) if v >= 0 else f"({v})"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def bound(self, toks: list[Tok]) -> str:
        """SQL with variables as literals; r.c is a column of a loop's record."""
        out, i = [], 0
        while i < len(toks):
            t = toks[i]
            name = t.lower()
            free = t.kind == "word" and (i == 0 or toks[i - 1] != ".") and name in self.scope
            record = self.scope.get(name)
            if free and isinstance(record, dict) and i + 2 < len(toks) and toks[i + 1] == ".":
                out.append(Tok(self.literal(record[toks[i + 2].lower()]), "word"))
                i += 3
                continue
            if free and not isinstance(record, dict) and not (i + 1 < len(toks) and toks[i + 1] in ("(", ".")):
                out.append(Tok(self.literal(record), "word"))
            else:
                out.append(t)
            i += 1
        return join(out)

    def value(self, toks: list[Tok]) -> Any:
        return self.engine.query(f"SELECT {self.bound(toks)} AS v").first()[0]

    def run(self, block: Block) -> None:
        for name, init in block.declared:
            self.scope[name] = self.value(init) if init else None
        try:
            self.all(block.body)
        except (Leave, Again, Returned):
            raise
        except Exception as e:
            if block.handler is None:
                raise
            self.scope["sqlerrm"] = str(e)
            self.all(block.handler)

    def all(self, body: list[list]) -> None:
        for s in body:
            getattr(self, f"do_{s[0]}")(*s[1:])

    def do_block(self, b: Block) -> None:
        self.run(b)

    def do_set(self, name: str, e: list[Tok]) -> None:
        self.scope[name] = self.value(e)

    def do_if(self, arms) -> None:
        for cond, body in arms:
            if cond is None or self.value(cond) is True:
                return self.all(body)
        return None

    def _turn(self, body) -> bool:
        try:
            self.all(body)
        except Again:
            pass
        except Leave:
            return False
        return True

    def do_while(self, cond, body) -> None:
        while cond is None or self.value(cond) is True:
            if not self._turn(body):
                break

    def do_for(self, name: str, over: list[Tok], body) -> None:
        dots = next((i for i in range(len(over) - 1) if over[i] == "." and over[i + 1] == "."), -1)
        if dots >= 0:
            back = over[0].up() == "REVERSE"
            a, b = int(self.value(over[back:dots])), int(self.value(over[dots + 2 :]))
            values: Any = range(max(a, b), min(a, b) - 1, -1) if back else range(a, b + 1)
        else:
            if over[0] == "(" and close(over, 0) == len(over) - 1:
                over = over[1:-1]
            values = ({k.lower(): v for k, v in r.asDict().items()} for r in self.engine.query(self.bound(over)).toLocalIterator())
        for v in values:
            self.scope[name] = v
            if not self._turn(body):
                break

    def do_exit(self, cond) -> None:
        if cond is None or self.value(cond) is True:
            raise Leave

    def do_continue(self, cond) -> None:
        if cond is None or self.value(cond) is True:
            raise Again

    def do_return(self, e: list[Tok]) -> None:
        raise Returned(self.value(e) if e and e[0].up() not in ("NEW", "OLD") else None)

    def do_raise(self, toks: list[Tok]) -> None:
        level = toks[0].up() if toks and toks[0].kind == "word" else "EXCEPTION"
        parts = split(toks[1:] if toks and toks[0].kind == "word" else toks)
        text = parts[0][0].strip("'") if parts and parts[0] else ""
        for p in parts[1:]:
            text = text.replace("%", str(self.value(p)), 1)
        if level == "EXCEPTION":
            raise Raised(text)
        self.notices.append(f"{level}: {text}")

    def do_perform(self, toks: list[Tok]) -> None:
        self.engine.query(self.bound([Tok("SELECT", "word"), *toks] if toks[0].up() != "SELECT" else toks)).write.format("noop").mode("overwrite").save()

    def do_into(self, names: list[str], query: list[Tok]) -> None:
        row = self.engine.query(self.bound(query)).first()
        for i, n in enumerate(names):
            self.scope[n] = row[i] if row is not None else None

    def do_sql(self, toks: list[Tok]) -> None:
        out = self.engine.sql(self.bound(toks))
        if isinstance(out, DataFrame) and toks[0].up() in ("SELECT", "WITH"):
            out.write.format("noop").mode("overwrite").save()


def parse(body: str) -> Block:
    p = Parser(tokens(body))
    b = p.block()
    if p.i < len(p.t):
        raise ValueError(f"text behind END: {join(p.t[p.i :])!r}")
    return b
