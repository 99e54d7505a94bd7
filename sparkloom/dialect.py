"""Rewrites of SQL that Spark does not read: tokens in, Spark SQL out.

Handled here: DISTINCT ON, JSON and text-search operators, MATCH … AGAINST,
DATE_ADD/DATE_SUB with INTERVAL, EXTRACT(SECOND …), ``$n`` parameters, type names
of CAST, CONCAT that skips NULL, division of whole numbers, information_schema,
NULL order (NULL is greater than everything: last ascending, first descending).
LIMIT (subquery) and recursive UNION need data and are handled by the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from sparkloom.functions.json import VALID_SQL, contains_sql
from sparkloom.store.tables import TYPES

TOKEN = re.compile(
    r"(?P<space>(?:\s+|--[^\n]*|/\*.*?\*/)+)|(?P<string>'(?:[^'\\]|\\.|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`]*`)"
    r"|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[LlDd]?\b)|(?P<param>\$\d+)|(?P<word>[^\W\d]\w*)"
    r"|(?P<op>->>|->|#>>|#>|@>|<@|@@|\?\||\?&|\?|<=>|<=|>=|<>|!=|\|\||::|:=|=>|[-+*/%=<>(),.;\[\]{}:&|^~!@])",
    re.DOTALL,
)
PRIMARY_END = {"word", "string", "quoted", "number", "param"}
CLAUSE = {"LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ROWS", "RANGE", "GROUPS", "FETCH", "WINDOW"}
UNITS = {"YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "WEEK", "QUARTER"}


#: Text-search calls and the arguments that count; a configuration before and options behind them do not.
TEXT_CALLS = {"TO_TSVECTOR": 1, "TO_TSQUERY": 1, "PLAINTO_TSQUERY": 1, "WEBSEARCH_TO_TSQUERY": 1, "TS_RANK": 2, "TS_HEADLINE": 2}


class Tok(str):
    kind: str

    def __new__(cls, text: str, kind: str):
        t = super().__new__(cls, text)
        t.kind = kind
        return t

    def up(self) -> str:
        return self.upper() if self.kind == "word" else ""


def tokens(text: str) -> list[Tok]:
    """Tokens without white space and comments; an error for anything unreadable."""
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable SQL at {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append(Tok(m[0], m.lastgroup))
        at = m.end()
    return out


def join(toks) -> str:
    return re.sub(r" ?\. ?", ".", " ".join(toks)) if all("'" not in t for t in toks) else _join_strings(toks)


def _join_strings(toks) -> str:
    out = ""
    for t in toks:
        glue = "" if not out or t == "." or out.endswith(".") and not out.endswith("'") else " "
        out += glue + t
    return out


def close(toks: list[Tok], i: int) -> int:
    """Place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j] in ("(", "[")) - (toks[j] in (")", "]"))
        if depth == 0:
            return j
    raise ValueError("unbalanced brackets")


def split(toks: list[Tok], by: str = ",") -> list[list[Tok]]:
    """Parts between separators outside brackets."""
    out: list[list[Tok]] = [[]]
    depth = 0
    for t in toks:
        depth += (t in ("(", "[")) - (t in (")", "]"))
        if depth == 0 and (t == by or t.up() == by):
            out.append([])
        else:
            out[-1].append(t)
    return out


def find(toks: list[Tok], word: str, start: int = 0) -> int:
    """Place of a word outside brackets, or -1."""
    depth = 0
    for i in range(start, len(toks)):
        depth += (toks[i] in ("(", "[")) - (toks[i] in (")", "]"))
        if depth == 0 and toks[i].up() == word:
            return i
    return -1


def _left(toks: list[Tok], i: int) -> int:
    """Start of the primary expression that ends before i."""
    j = i - 1
    if toks[j] in (")", "]"):
        depth = 0
        while True:
            depth += (toks[j] in (")", "]")) - (toks[j] in ("(", "["))
            if depth == 0:
                break
            j -= 1
        if j and toks[j - 1].kind == "word" and toks[j - 1].up() not in ("AND", "OR", "NOT", "WHERE", "SELECT", "IN", "ON", "BY", "WHEN", "THEN"):
            j -= 1
    while j >= 2 and toks[j - 1] == ".":
        j -= 2
    return j


def _right(toks: list[Tok], i: int) -> int:
    """End (exclusive) of the primary expression that starts at i."""
    j = i + 1
    while j < len(toks) and toks[j] == "." and j + 1 < len(toks):
        j += 2
    if j < len(toks) and toks[i].kind == "word" and toks[j] in ("(", "["):
        return close(toks, j) + 1
    if toks[i] in ("(", "["):
        return close(toks, i) + 1
    return j


def _path(literal: str) -> str:
    parts = [p.strip().strip('"') for p in literal.strip("'").strip("{}").split(",")]
    return "'$" + "".join(f"[\"{p}\"]" if not re.fullmatch(r"\w+", p) else f".{p}" for p in parts) + "'"


def _json(op: str, left: str, right: list[Tok]) -> str:
    r = join(right)
    if op in ("->", "->>"):
        if right[0].kind == "number":
            path = f"'$[{r}]'"
        elif r.startswith("'"):
            path = "'$." + r.strip("'") + "'" if re.fullmatch(r"'\w+'", r) else f"'$[\"{r.strip(chr(39))}\"]'"
        else:
            path = f"concat('$.', {r})"
        return f"get_json_object({left}, {path})" if op == "->>" else f"to_json(try_variant_get(parse_json({left}), {path}, 'variant'))"
    if op in ("#>", "#>>"):
        return f"get_json_object({left}, {_path(r)})" if op == "#>>" else f"to_json(try_variant_get(parse_json({left}), {_path(r)}, 'variant'))"
    if op == "?":
        return f"coalesce(array_contains(json_object_keys({left}), {r}), CASE WHEN {left} IS NOT NULL THEN false END)"
    keys = f"array({join(right[2:-1])})" if right[0].up() == "ARRAY" else r
    if op == "?|":
        return f"coalesce(arrays_overlap(json_object_keys({left}), {keys}), CASE WHEN {left} IS NOT NULL THEN false END)"
    if op == "?&":
        return f"coalesce(size(array_except({keys}, json_object_keys({left}))) = 0, CASE WHEN {left} IS NOT NULL THEN false END)"
    if op == "<@":
        left, r = r, left
    if op in ("@>", "<@"):
        return contains_sql(left, r[1:-1].replace("\\'", "'")) if re.fullmatch(r"'(?:[^'\\]|\\')*'", r) else f"json_contains({left}, {r})"
    return f"fts_match({left}, {r})"


OPERATORS = {"->", "->>", "#>", "#>>", "@>", "<@", "@@", "?", "?|", "?&"}


def operators(toks: list[Tok]) -> list[Tok]:
    """JSON and text-search operators become calls, innermost (leftmost) first."""
    while True:
        i = next((i for i, t in enumerate(toks) if t.kind == "op" and t in OPERATORS and not (t == "->" and _lambda(toks, i))), -1)
        if i < 0:
            return toks
        a, b = _left(toks, i), _right(toks, i + 1)
        call = _json(toks[i], join(toks[a:i]), operators(list(toks[i + 1 : b])))
        toks = [*toks[:a], *tokens(call), *toks[b:]]


def _lambda(toks: list[Tok], i: int) -> bool:
    """x -> … and (x, y) -> … as arguments of a higher-order function, not a JSON step."""
    if i + 1 >= len(toks) or toks[i + 1].kind in ("string", "number"):
        return False
    a = _left(toks, i)
    return a > 0 and toks[a - 1] in (",", "(")


def calls(toks: list[Tok]) -> list[Tok]:
    """MATCH … AGAINST, DATE_ADD/DATE_SUB with INTERVAL, EXTRACT(SECOND …), LEN."""
    out: list[Tok] = []
    i = 0
    while i < len(toks):
        t, nxt = toks[i].up(), toks[i + 1] if i + 1 < len(toks) else ""
        if t == "MATCH" and nxt == "(":
            j = close(toks, i + 1)
            if j + 1 < len(toks) and toks[j + 1].up() == "AGAINST":
                k = close(toks, j + 2)
                inner = toks[j + 3 : k]
                cut = find(inner, "IN")
                cols, query = join(toks[i + 2 : j]), join(inner[:cut] if cut >= 0 else inner)
                doc = f"concat_ws(' ', {cols})"
                out += tokens(f"(CASE WHEN fts_match({doc}, {query}) THEN 1.0D ELSE 0.0D END)" if cut >= 0 else f"ts_rank({doc}, {query})")
                i = k + 1
                continue
        if t in ("DATE_ADD", "DATE_SUB") and nxt == "(":
            j = close(toks, i + 1)
            args = split(toks[i + 2 : j])
            if len(args) == 2 and args[1] and args[1][0].up() == "INTERVAL" and args[1][-1].up().rstrip("S") in UNITS:
                unit = args[1][-1].up().rstrip("S")
                n = join(calls(args[1][1:-1])).strip("'")
                out += tokens(f"timestampadd({unit}, {'-' if t == 'DATE_SUB' else ''}({n}), {join(calls(args[0]))})")
                i = j + 1
                continue
        if t == "EXTRACT" and nxt == "(" and toks[i + 2].up() == "SECOND" and toks[i + 3].up() == "FROM":
            j = close(toks, i + 1)
            out += tokens(f"second({join(calls(toks[i + 4 : j]))})")
            i = j + 1
            continue
        if t in TEXT_CALLS and nxt == "(":
            j = close(toks, i + 1)
            args = split(toks[i + 2 : j])
            n = TEXT_CALLS[t]
            if len(args) > n and (n == 1 or args[0][0].kind == "string" and len(args[0]) == 1 and t == "TS_HEADLINE"):
                args = args[1:]  # a configuration's name
            out += [toks[i], Tok("(", "op")]
            for k, a in enumerate(args[:n]):
                out += ([Tok(",", "op")] if k else []) + calls(a)
            out.append(Tok(")", "op"))
            i = j + 1
            continue
        if t in ("CAST", "TRY_CAST") and nxt == "(":
            j = close(toks, i + 1)
            inner = toks[i + 2 : j]
            cut, k = -1, find(inner, "AS")
            while k >= 0:
                cut, k = k, find(inner, "AS", k + 1)
            if cut > 0 and cut + 1 < len(inner):
                out += tokens(_cast(t, join(calls(inner[:cut])), inner[cut + 1 :]))
                i = j + 1
                continue
        if t == "CONCAT" and nxt == "(":
            out += tokens("concat_ws('',")
            i += 2
            continue
        if t in ("INFORMATION_SCHEMA", "SYSTEM") and nxt == "." and i + 2 < len(toks):
            out.append(Tok(f"_{'is' if t[0] == 'I' else 'sys'}_{toks[i + 2].lower()}", "word"))
            i += 3
            continue
        if t == "LEN" and nxt == "(":
            out.append(Tok("length", "word"))
            i += 1
            continue
        out.append(toks[i])
        i += 1
    return out


def _cast(call: str, value: str, kind: list[Tok]) -> str:
    """CAST to one of the dialect's types; text that becomes JSON must be JSON."""
    name, size = kind[0].up(), join(kind[1:])
    if name in ("JSON", "JSONB"):
        wrong = "NULL" if call == "TRY_CAST" else "CAST(raise_error('not JSON') AS STRING)"
        return f"(CASE WHEN {value} IS NULL THEN NULL WHEN {VALID_SQL.format(value)} THEN CAST({value} AS STRING) ELSE {wrong} END)"
    if name in ("DECIMAL", "NUMERIC") and size:
        return f"{call}({value} AS DECIMAL {size})"
    if name in ("TIMESTAMP", "DATETIME"):
        return f"{call}({value} AS TIMESTAMP)"
    return f"{call}({value} AS {TYPES[name] if name in TYPES else join(kind)})"


def whole_numbers(toks: list[Tok], integral: Callable[[str, str], bool]) -> list[Tok]:
    """Whole numbers divide, and have powers and roots, as whole numbers.

    ``integral`` takes an expression and the FROM clause around it and tells whether
    its type is a whole number's.
    """
    names = {"POWER": "int_power", "POW": "int_power", "SQRT": "int_sqrt"}
    i = 0
    while i < len(toks):
        t = toks[i]
        if t.up() in names and i + 1 < len(toks) and toks[i + 1] == "(":
            j = close(toks, i + 1)
            inner = whole_numbers(toks[i + 2 : j], lambda e, _f, around=_from(toks, i): integral(e, around))
            if all(integral(join(a), _from(toks, i)) for a in split(inner)):
                t = Tok(names[t.up()], "word")
            toks = [*toks[:i], t, toks[i + 1], *inner, *toks[j:]]
            i += 1
        elif t == "/" and t.kind == "op":
            a, b = _chain(toks, i), _factor(toks, i + 1)
            if integral(join(toks[a:i]), _from(toks, i)) and integral(join(toks[i + 1 : b]), _from(toks, i)):
                toks = [*toks[:a], *tokens(f"({join(toks[a:i])} div {join(toks[i + 1 : b])})"), *toks[b:]]
                i = a + (b - a) + 2
                continue
        i += 1
    return toks


def _chain(toks: list[Tok], i: int) -> int:
    """Start of the product that ends before i."""
    a = _left(toks, i)
    while a >= 2 and toks[a - 1].kind == "op" and toks[a - 1] in ("*", "/", "%"):
        a = _left(toks, a - 1)
    return a


def _factor(toks: list[Tok], i: int) -> int:
    return _right(toks, i + (toks[i] in ("-", "+")))


def _from(toks: list[Tok], i: int) -> str:
    """The FROM clause of the SELECT around place i, or nothing."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j] in ("(", "[")) - (toks[j] in (")", "]"))
        if depth < 0:
            break
        if depth == 0 and toks[j].up() == "FROM":
            ends = [k for w in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW") if (k := find(toks, w, j)) > 0]
            stop = min([len(toks), *ends, *(k for k in [_closes(toks, j)] if k > 0)])
            return join(toks[j:stop])
    # Behind the FROM clause: look back for it.
    depth = 0
    for j in range(i, -1, -1):
        depth += (toks[j] in (")", "]")) - (toks[j] in ("(", "["))
        if depth < 0:
            return ""
        if depth == 0 and toks[j].up() == "FROM":
            return _from(toks, j)
    return ""


def _closes(toks: list[Tok], i: int) -> int:
    """Place of the bracket that closes what is open at i, or -1."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j] in ("(", "[")) - (toks[j] in (")", "]"))
        if depth < 0:
            return j
    return -1


def null_order(toks: list[Tok]) -> list[Tok]:
    """Every ORDER BY item says where NULLs go."""
    out: list[Tok] = []
    i = 0
    while i < len(toks):
        out.append(toks[i])
        if toks[i].up() == "ORDER" and i + 1 < len(toks) and toks[i + 1].up() == "BY":
            out.append(toks[i + 1])
            j, depth = i + 2, 0
            while j < len(toks):
                depth += (toks[j] in ("(", "[")) - (toks[j] in (")", "]"))
                if depth < 0 or depth == 0 and (toks[j].up() in CLAUSE or toks[j] == ";"):
                    break
                j += 1
            items = []
            for item in split(toks[i + 2 : j]):
                inner = null_order(item)
                if find(item, "NULLS") < 0:
                    inner += tokens("NULLS FIRST" if item and item[-1].up() == "DESC" else "NULLS LAST")
                items.append(inner)
            for k, item in enumerate(items):
                out += ([Tok(",", "op")] if k else []) + item
            i = j
            continue
        i += 1
    return out


def distinct_on(toks: list[Tok]) -> list[Tok]:
    """SELECT DISTINCT ON (keys) … becomes the first row of each key by ROW_NUMBER."""
    for i in range(len(toks) - 3):
        if toks[i].up() == "SELECT" and toks[i + 1].up() == "DISTINCT" and toks[i + 2].up() == "ON" and toks[i + 3] == "(":
            k = close(toks, i + 3)
            end, depth = len(toks), 0
            for j in range(k + 1, len(toks)):
                depth += (toks[j] in ("(", "[")) - (toks[j] in (")", "]"))
                if depth < 0:
                    end = j
                    break
            body = toks[k + 1 : end]
            keys = join(toks[i + 4 : k])
            order, limit = find(body, "ORDER"), min((p for w in ("LIMIT", "OFFSET") if (p := find(body, w)) >= 0), default=len(body))
            by = join(body[order + 2 : limit]) if order >= 0 else keys
            frm = find(body, "FROM")
            core = body[frm : order if order >= 0 else limit]
            inner = f"SELECT {join(body[:frm])}, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS _first {join(core)}"
            # The order holds for the result as far as its columns are there.
            shown = {join(c[-1:]).lower() for c in split(body[:frm])}
            kept = [join(c) for c in split(tokens(by)) if join(c[:1]).lower() in shown or "*" in shown]
            last = f"ORDER BY {', '.join(kept)}" if order >= 0 and kept else ""
            text = f"SELECT * EXCEPT (_first) FROM ({inner}) WHERE _first = 1 {last} {join(body[limit:])}"
            return distinct_on([*toks[:i], *tokens(text), *toks[end:]])
    return toks


def ordering(item: list[Tok]) -> tuple[str, bool, bool]:
    """Expression of an ORDER BY item that says where NULLs go; descending; NULLs first."""
    desc = item[-3].up() == "DESC"
    return join(item[: -3 if desc or item[-3].up() == "ASC" else -2]), desc, item[-1].up() == "FIRST"


def global_places(text: str) -> tuple[str, list[tuple[str, bool, list[tuple[bool, bool]]]], list[tuple[str, bool, bool]]] | None:
    """A SELECT whose columns are, among others, row_number() or rank() over all rows; None for others.

    Takes what ``rewrite`` gave. The query without these columns (NULL for the i-th one, _place_i, and its
    keys at the end); for each its name, whether it is a rank, and its keys' directions; the ORDER BY.
    """
    toks = tokens(text)
    frm = find(toks, "FROM")
    if frm < 0 or toks[0].up() != "SELECT" or toks[1].up() in ("DISTINCT", "ALL"):
        return None
    if any(find(toks, w) >= 0 for w in ("UNION", "INTERSECT", "EXCEPT", "MINUS", "LIMIT", "OFFSET", "WINDOW", "QUALIFY", "CLUSTER", "DISTRIBUTE", "SORT")):
        return None
    items, keys, places = [], [], []
    for item in split(toks[1:frm]):
        items.append(join(item))
        if len(item) < 8 or item[0].up() not in ("ROW_NUMBER", "RANK") or join(item[1:3]) != "( )" or item[3].up() != "OVER" or item[4] != "(":
            continue
        j = close(item, 4)
        inner, rest = item[5:j], [t for t in item[j + 1 :] if t.up() != "AS"]
        if [t.up() for t in inner[:2]] != ["ORDER", "BY"] or len(rest) != 1 or rest[0].kind not in ("word", "quoted") or any(find(inner, w) >= 0 for w in ("ROWS", "RANGE", "GROUPS")):
            continue
        by = [ordering(x) for x in split(inner[2:])]
        items[-1] = f"CAST(NULL AS INT) AS _place_{len(places)}"
        keys += [f"{x[0]} AS _key_{len(keys) + k}" for k, x in enumerate(by)]
        places.append((rest[0].strip("`\""), item[0].up() == "RANK", [x[1:] for x in by]))
    if not places:
        return None
    order = find(toks, "ORDER", frm)
    last = [ordering(x) for x in split(toks[order + 2 :])] if order >= 0 else []
    return f"SELECT {', '.join(items + keys)} {join(toks[frm : order if order >= 0 else len(toks)])}", places, last


def parameters(toks: list[Tok]) -> list[Tok]:
    return [Tok(f":p{t[1:]}", "word") if t.kind == "param" else t for t in toks]


def rewrite(text: str, integral: Callable[[str, str], bool] | None = None) -> str:
    """One query in Spark's dialect; with ``integral``, whole numbers divide as such."""
    # A doubled quote stands for one quote; Spark would join the two literals without it.
    toks = [Tok("'" + t[1:-1].replace("''", "\\'") + "'", t.kind) if t.kind == "string" else t for t in tokens(text)]
    while toks and toks[-1] == ";":
        toks.pop()
    toks = parameters(null_order(operators(calls(distinct_on(toks)))))
    if integral and any(t == "/" or t.up() in ("POWER", "POW", "SQRT") for t in toks):
        toks = whole_numbers(toks, integral)
    return join(toks)
