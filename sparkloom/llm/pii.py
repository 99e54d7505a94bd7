"""Surrogates for personal data: keyed, of the same type and format, one to one.

Every entity is written as numbers in a mixed radix (one place for each digit,
letter, octet or list entry that may change; all else is kept), and a keyed
permutation of that domain gives its surrogate. The permutation P^-1(P(x) + 1)
has no fixed point, so nothing is replaced by itself, and being one to one it
keeps distinct entities distinct and equal ones equal over the whole corpus
without exchanging any of them between machines. Where a form leaves no other
choice (one single member, or none but itself), a keyed word takes its place:
no entity is ever returned unchanged. Each worker also checks every new surrogate
against those it has given out; ``collisions`` checks a table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, kept_bytes, replace_columns

#: Setting that holds the key; without it a random key is kept in the shared folder.
KEY_SETTING = "spark.sparkloom.surrogates.key"
#: Entities whose surrogates a worker keeps.
CACHE = 200_000

# Titles by gender, given names by gender and script, gendered family name endings.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "госпожа"],
    "": ["Dr", "Prof", "Doctor", "Professor"],
}
NAMES = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Paul", "Peter", "Mark", "George", "Andrew", "Stephen", "Karl", "Hans", "Jürgen", "Pierre", "Jean", "Carlos", "Juan", "Miguel", "José"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Sarah", "Karen", "Nancy", "Margaret", "Helen", "Sandra", "Laura", "Julia", "Greta", "Ursula", "Heidi", "Marie", "Claire", "Carmen", "Lucía", "Sofía", "Maria"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Андрей", "Михаил"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}
#: Names of vowels in names of letters; ranges of code points whose letters are taken together.
VOWELS = {"A", "E", "I", "O", "U", "AE", "OE", "ALPHA", "EPSILON", "ETA", "IOTA", "OMICRON", "UPSILON", "OMEGA", "IE", "YERU", "YU", "YA", "IO"}
RANGES = [(0x00, 0x80), (0x80, 0x180), (0x370, 0x400), (0x430, 0x450), (0x400, 0x460), (0x530, 0x590), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4)]
ENDINGS = ["ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ez", "son", "mann"]
PUBLIC_OCTETS = [o for o in range(1, 224) if o not in (10, 127, 169, 172, 192)]


class Permutation:
    """Keyed one-to-one map of range(size) without fixed points, by a balanced Feistel network."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest()

    def _f(self, r: int, x: int) -> int:
        h = hashlib.blake2b(bytes([r]) + x.to_bytes(self.half // 8 + 1, "big"), key=self.key, digest_size=min(64, self.half // 8 + 9)).digest()
        return int.from_bytes(h, "big") & self.mask

    def _walk(self, x: int, rounds) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            if rounds.step > 0:
                for r in rounds:
                    a, b = b, a ^ self._f(r, b)
            else:
                for r in rounds:
                    a, b = b ^ self._f(r, a), a
            x = a << self.half | b
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        y = self._walk(x, range(self.ROUNDS))
        return self._walk((y + 1) % self.size, range(self.ROUNDS - 1, -1, -1))


def mapped(key: bytes, kind: str, places: list[tuple[str, int, int]]) -> list[str]:
    """Replace the changeable places. A place is (alphabet, -1, index) or (literal, 0, 0)."""
    shape = kind + "\0" + "\0".join(a if n else f"={a}" for a, n, _ in places)
    size = value = 0
    size = 1
    for a, n, i in places:
        if n:
            value = value * len(a) + i
            size *= len(a)
    value = Permutation(key, shape, size)(value)
    out: list[str] = []
    for a, n, _ in reversed(places):
        if n:
            value, i = divmod(value, len(a))
            out.append(a[i])
        else:
            out.append(a)
    return out[::-1]


def _place(c: str, alphabets: tuple[str, ...]) -> tuple[str, int, int]:
    for a in alphabets:
        i = a.find(c)
        if i >= 0:
            return a, -1, i
    return (c, 0, 0) if c.isascii() else _letter(c)


def _letter(c: str) -> tuple[str, int, int]:
    a = alphabet(c)
    return (a, -1, a.index(c)) if len(a) > 1 else (c, 0, 0)


DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
CAPITALS = SMALL.upper()


def _text(key: bytes, kind: str, s: str, alphabets: tuple[str, ...], keep=()) -> str:
    return "".join(mapped(key, kind, [(c, 0, 0) if i in keep else _place(c, alphabets) for i, c in enumerate(s)]))


def _luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def _card(key: bytes, s: str) -> str:
    off = (int(s[-1]) - _luhn(s[:-1])) % 10  # 0 for a valid number, which stays valid
    body = _text(key, "card", s[:-1], (DIGITS,), keep=(0,))
    return body + str((_luhn(body) + off) % 10)


def _octets(key: bytes, s: str) -> str:
    parts = [int(p) for p in s.split(".")]
    bytes_ = "".join(map(chr, range(256)))
    places: list[tuple[str, int, int]] = []
    head = parts[0]
    if head in PUBLIC_OCTETS:
        places.append(("".join(map(chr, PUBLIC_OCTETS)), -1, PUBLIC_OCTETS.index(head)))
        kept = 1
    else:
        kept = 2 if head in (169, 172, 192) else 1
        places += [(chr(p), 0, 0) for p in parts[:kept]]
    places += [(bytes_, -1, p) for p in parts[kept:]]
    return ".".join(str(ord(c)) for c in mapped(key, "ip", places))


def _email(key: bytes, s: str) -> str:
    local, domain = s.rsplit("@", 1)
    body, top = domain.rsplit(".", 1)
    return _text(key, "email", f"{local}@{body}", (SMALL, DIGITS)) + "." + top


_PLACES = {n: "".join(map(chr, range(n))) for n in (1000, 10_000)}
_EXCHANGES = _PLACES[1000].replace(chr(555), "")


def _phone(key: bytes, s: str) -> str:
    """s: digits, the last ten the number itself; the exchange 555 is kept, and no other number gets it."""
    head, own = s[:-10], s[-10:]
    area, exchange, line = int(own[:3]), int(own[3:6]), int(own[6:])
    middle = (chr(555), 0, 0) if exchange == 555 else (_EXCHANGES, -1, _EXCHANGES.index(chr(exchange)))
    made = mapped(key, "phone", [(_PLACES[1000], -1, area), middle, (_PLACES[10_000], -1, line)])
    return head + "".join(f"{ord(c):0{n}}" for c, n in zip(made, (3, 3, 4), strict=True))


@functools.cache
def _base(c: str) -> tuple[str, bool, bool] | None:
    """(script, is a vowel, is plain) of a small letter that has a capital of its own, or of a letter without case."""
    name = unicodedata.name(c, "")
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo") or kind == "Ll" and not (len(c.upper()) == 1 and c.upper().lower() == c != c.upper()):
        return None
    if kind == "Lo":
        return name.split(" ")[0], False, True
    m = re.match(r"(\w+)(?: SMALL)? LETTER (?:SHORT )?([\w ]+?)( WITH .*)?\Z", name)
    if not m:
        return name.split(" ")[0], False, False
    return m[1], m[2] in VOWELS, not m[3]


@functools.cache
def alphabet(c: str) -> str:
    """The letters that may stand for c: of its script, vowel for vowel, accented for accented. c alone if there are none."""
    own = _base(c)
    if own is None:
        return c
    lo, hi = _range(c)
    return "".join(d for d in map(chr, range(lo, hi)) if _base(d) == own and _range(d) == (lo, hi)) or c


def _range(c: str) -> tuple[int, int]:
    return next(((a, b) for a, b in RANGES if a <= ord(c) < b), (ord(c) & ~0xFF, (ord(c) & ~0xFF) + 256))


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def gender_of(name: str) -> str:
    return next((g for (g, _), names in NAMES.items() if name.casefold() in {n.casefold() for n in names}), "")


def _listed(s: str) -> tuple[str, str, list[str]] | None:
    return next(((g, script, low) for (g, script), names in NAMES.items() if s in (low := [n.lower() for n in names])), None)


def _given(key: bytes, s: str) -> str:
    """A listed name for a listed one of its gender and script; else other letters. Its last letter, which
    tells the gender of many names, stays if it is a vowel."""
    known = _listed(s)
    if known is None:
        return _name(key, "given", s, s[-1] if len(s) > 2 and (_base(s[-1]) or ("", False))[1] else "")
    g, script, low = known
    return low[ord(mapped(key, f"given-{g}-{script}", [("".join(map(chr, range(len(low)))), -1, low.index(s))])[0])]


def _ending(s: str) -> str:
    return next((e for e in ENDINGS if s.endswith(e) and len(s) > len(e) + 1), "")


def _family(key: bytes, s: str) -> str:
    return _name(key, "family", s, _ending(s))


def _name(key: bytes, kind: str, s: str, ending: str) -> str:
    """Vowels for vowels and consonants for consonants, before the ending; walks on until the result is of s's own
    class (its ending, not a listed name), so that classes do not meet."""
    made = s
    while True:
        head = made[: len(made) - len(ending)]
        made = "".join(mapped(key, f"{kind}-{ending}", [_letter(c) for c in head])) + ending
        if made == s:
            return ""  # no other name has this form
        if (kind != "family" or _ending(made) == ending) and _listed(made) is None:
            return made


def _word(key: bytes, kind: str, s: str) -> str:
    """A keyed word of sixteen letters, for what has no other member of its form."""
    n = int.from_bytes(hashlib.blake2b(f"{kind}\0{s}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).digest(), "big")
    return "".join(SMALL[n // 26**i % 26] for i in range(16))


MAKERS = {
    "email": _email,
    "phone": _phone,
    "card": _card,
    "ip": _octets,
    "ssn": lambda k, s: _text(k, "ssn", s, (DIGITS,)),
    "hex": lambda k, s: _text(k, "hex", s, (DIGITS + "abcdef",)),
    "secret": lambda k, s: _text(k, "secret", s, (SMALL, CAPITALS, DIGITS)),
    "given": _given,
    "family": _family,
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NUMBERS = re.compile(
    rf"(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<phone2>(?<![\w.])\+\d{11,14}(?!\d))"
    r"|(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w))"
)
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
SECRET = re.compile(r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|passwor[dt]|passwd)[\"']?\s{0,3}[=:]\s{0,3}([\"'])([^\"'\s]{8,})\1")
LOCAL = re.compile(r"[\w.%+\-]{1,64}\Z")
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_WORD = r"[^\W\d_]+(?:[-’'][^\W\d_]+)?"
PERSON = re.compile(rf"(?<!\w)(?P<title>{_TITLE})(?P<gap>\.? )(?P<one>{_WORD})(?: (?P<two>{_WORD}))?")

#: A listed given name and a word with a capital behind it, without a title.
_NAMES = "|".join(sorted({re.escape(n) for names in NAMES.values() for n in names}, key=len, reverse=True))
KNOWN = re.compile(rf"(?<!\w)(?P<one>{_NAMES})[ ](?P<two>[^\W\d_a-z]{_WORD})")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order, not overlapping."""
    spans: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        local, domain = LOCAL.search(text, max(0, at - 64), at), DOMAIN.match(text, at + 1)
        if local and domain and (name := local[0].lstrip(".")) and len(name) > name.count("."):
            a = at - len(name)
            spans.append((a, domain.end(), "email", text[a : domain.end()].lower()))
        at = text.find("@", at + 1)
    if any(d in text for d in DIGITS):
        spans += [(*m.span(2), "hex" if re.fullmatch("[0-9A-Fa-f]{16,}", m[2]) else "secret", m[2]) for m in SECRET.finditer(text)]
        spans += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
        for m in NUMBERS.finditer(text):
            kind, s = m.lastgroup.rstrip("2"), m[0]
            if kind == "phone":
                s = re.sub(r"\D", "", s)
                s = s if len(s) > 10 else "1" + s
            elif kind == "card":
                s = re.sub(r"\D", "", s)
                if _luhn(s[:-1]) != int(s[-1]) and not (len(s) == 16 and s[0] in "23456"):
                    continue
            spans.append((*m.span(), kind, s))
    else:
        spans += [(*m.span(2), "secret", m[2]) for m in SECRET.finditer(text)]
    people: dict[str, str] = {}
    for m in [*PERSON.finditer(text), *KNOWN.finditer(text)]:
        if not m["one"][0].isupper():
            continue
        two = m["two"] if m["two"] and m["two"][0].isupper() else None
        for group, kind in (("one", "given"), ("two", "family")) if two else (("one", "family"),):
            spans.append((*m.span(group), kind, m[group].lower()))
            if len(m[group]) > 2:
                people.setdefault(m[group], kind)
    if people:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, people), key=len, reverse=True))})(?!\w)")
        spans += [(*m.span(), people[m[0]], m[0].lower()) for m in again.finditer(text)]
    out: list[tuple[int, int, str, str]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s if s[2] != "hex" else (*s[:3], s[3].lower()))
    return out


def dressed(kind: str, seen: str, made: str) -> str:
    """A surrogate's normal form in the mention's own layout and capitals."""
    if kind in ("phone", "card"):
        digits = iter(made[-sum(c.isdigit() for c in seen) :])
        return "".join(next(digits) if c.isdigit() else c for c in seen)
    if kind in ("given", "family"):
        return made.upper() if seen.isupper() and len(seen) > 1 else "-".join(p.capitalize() for p in made.split("-"))
    if kind in ("email", "hex") and len(seen) == len(made):
        if seen.upper() == seen and seen.lower() != seen:
            return made.upper()
        return "".join(b.upper() if a.isupper() else b for a, b in zip(seen, made, strict=True))
    return made


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self.given: dict[tuple[str, str], str] = {}
        self.owner: dict[tuple[str, str], str] = {}

    def of(self, kind: str, s: str) -> str:
        made = self.given.get((kind, s))
        if made is None:
            made = MAKERS[kind](self.key, s)
            if made in ("", s):
                made = _word(self.key, kind, s)
            if len(self.given) > CACHE:
                self.given.clear()
                self.owner.clear()
            if self.owner.setdefault((kind, made), s) != s:
                raise ValueError(f"two entities of kind {kind} share a surrogate")
            self.given[kind, s] = made
        return made

    def clean(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and (kind, start, end, surrogate) in the old text."""
        parts, at, found = [], 0, []
        for a, b, kind, s in find(text):
            new = dressed(kind, text[a:b], self.of(kind, s))
            parts += [text[at:a], new]
            found.append((kind, a, b, new))
            at = b
        return ("".join([*parts, text[at:]]) if found else text), found


def _clean(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        make = Surrogates(key)
        for pdf in batches:
            got = [make.clean(t) if isinstance(t, str) else (None, []) for t in pdf["text"]]
            yield {"doc_id": pdf["doc_id"], "text": [g[0] for g in got], "n_entities": [len(g[1]) for g in got], "entities": [[dict(zip(("kind", "start", "end", "surrogate"), e, strict=True)) for e in g[1]] for g in got]}

    return run


def run_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING, or else a random one that the first run leaves in the shared folder."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return hashlib.blake2b(named.encode(), digest_size=32).digest()
    return kept_bytes(spark, "surrogates.key", lambda: secrets.token_bytes(32))


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """Replace personal data in every text (doc_id, text); ``key`` decides by what.

    Null texts stay null; texts without entities are unchanged; repeated rows get
    equal results; null doc_ids stay; other columns are not read; an empty table
    gives no rows. Returns doc_id, text, n_entities, entities (kind, start, end
    in the old text, surrogate).
    """
    return batch_map(docs.select("doc_id", "text"), _clean(key), "doc_id long, text string, n_entities int, entities array<struct<kind string, start int, end int, surrogate string>>")


def collisions(given: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity: (kind, surrogate, n) of (kind, entity, surrogate) rows."""
    pairs = given.select("kind", "entity", "surrogate").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"), run_key(spark))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, personal data replaced; n_chars, where it is a column of numbers, is that of the new text."""
    key, counted = run_key(spark), dict(docs.dtypes).get("n_chars") in ("int", "bigint")

    def clean(batch) -> dict:
        make = Surrogates(key)
        texts = [make.clean(t)[0] if isinstance(t, str) else None for t in batch.column("text").to_pylist()]
        out = {"text": texts}
        if counted:
            out["n_chars"] = [n if t is None else len(t) for n, t in zip(batch.column("n_chars").to_pylist(), texts, strict=True)]
        return out

    return replace_columns(docs, clean)
