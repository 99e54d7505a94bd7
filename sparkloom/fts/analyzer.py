"""Analysis of texts and queries: words, stop words, a stemmer, query syntax."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from sparkloom.functions.text_search import STOP_WORDS as FEWER

# Further stop words of the index.
STOP_WORDS = frozenset(FEWER) | frozenset(
    (
        "do does did doing would could might must shall about above after again against am any because been before being "
        "below between down during further here herself himself if into itself myself off once out over ourselves she them "
        "themselves then there these those through under until up us while whom yours yourself yourselves her him his"
    ).split()
)
LEAST, MOST = 2, 64

# Suffixes and what takes their place; the longest that fits is taken.
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
ADJECTIVES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Endings in the order in which they are tried.
ENDINGS = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

WORD = re.compile(r"[^\W_]+")


def _vowel(s: str) -> bool:
    return any(c in "aeiou" for c in s)


def _undouble(w: str) -> str:
    return w[:-1] if len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz" else w


def _exchange(w: str, table: dict[str, str]) -> str:
    fits = [s for s in table if w.endswith(s) and len(w) - len(s) > 2]
    s = max(fits, key=len, default=None)
    return w if s is None else w[: len(w) - len(s)] + table[s]


def porter(w: str) -> str:
    """Stem of a lower-case word; words of fewer than three bytes stay."""
    if len(w.encode()) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        w = w[:-1]
    cut = next((n for s, n, least in (("ed", 2, 4), ("ing", 3, 5)) if w.endswith(s) and len(w) > least and _vowel(w[:-n])), 0)
    if w.endswith("eed") and len(w) > 4:
        w = w[:-1]
    elif cut:
        w = w[:-cut]
        w = w + "e" if w.endswith(("at", "bl", "iz")) else _undouble(w)
    if w.endswith("y") and len(w) > 2 and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _exchange(_exchange(w, DERIVED), ADJECTIVES)
    end = next((s for s in ENDINGS if w.endswith(s) and len(w) - len(s) > 3), None)
    if end and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: len(w) - len(end)]
    if w.endswith("e") and len(w) > 3:
        w = w[:-1]
    return _undouble(w) if len(w) > 2 else w


def analyze(text: str | None) -> list[tuple[str, int]]:
    """(term, position): stop words take a position but are left out; words of other lengths take none."""
    out, at = [], 0
    for m in WORD.finditer(text or ""):
        w = m[0].lower()
        if not LEAST <= len(w.encode()) <= MOST:
            continue
        if w not in STOP_WORDS:
            out.append((porter(w), at))
        at += 1
    return out


@F.pandas_udf(ArrayType(StructType().add("term", StringType()).add("pos", IntegerType())))
def analyzed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"term": w, "pos": p} for w, p in analyze(t)])


@dataclass(frozen=True)
class Term:
    """A part of a query. ``phrase`` holds the terms of a quoted phrase with their distances."""

    term: str = ""
    required: bool = False
    excluded: bool = False
    prefix: bool = False
    fuzzy: bool = False
    phrase: tuple[tuple[str, int], ...] = ()


def parse_query(query: str) -> list[Term]:
    """"phrase" (required), +required, -excluded, prefix*, fuzzy~, and plain words."""
    out: list[Term] = []
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query):
        if quoted:
            terms = analyze(quoted)
            if terms:
                out.append(Term(required=True, phrase=tuple((t, p - terms[0][1]) for t, p in terms)))
            continue
        required, excluded = word.startswith("+"), word.startswith("-")
        word = word.lstrip("+-")
        prefix, fuzzy = word.endswith("*"), word.endswith("~")
        found = WORD.findall(word.lower())
        for w in found:
            if prefix or fuzzy:
                out.append(Term(w, required, excluded, prefix, fuzzy))
            elif w not in STOP_WORDS and LEAST <= len(w.encode()) <= MOST:
                out.append(Term(porter(w), required, excluded))
    return out


def highlight(text: str, query: str, context: int = 3) -> list[str]:
    """Snippets of ``context`` words on each side of every hit."""
    wanted = {t.term for t in parse_query(query) if not t.excluded} | {w for t in parse_query(query) for w, _ in t.phrase}
    words = list(WORD.finditer(text))
    out = []
    for i, m in enumerate(words):
        if porter(m[0].lower()) in wanted or m[0].lower() in wanted:
            a, b = words[max(0, i - context)].start(), words[min(len(words) - 1, i + context)].end()
            out.append(("..." if a > 0 else "") + text[a:b] + ("..." if b < len(text) else ""))
    return out
