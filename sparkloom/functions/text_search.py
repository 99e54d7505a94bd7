"""Light text search as column expressions: words, stems, match, rank, vectors.

All of it stays in the JVM: split, transform, filter and aggregate over the
words of a text. Positions count all words, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words of the SQL functions.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with this but they "
    "have had what when where who which why how all each every both few more most other some such no nor not only "
    "own same so than too very can just should now i me my we our you your"
).split()
# Suffixes in the order in which they are tried.
SUFFIXES = "ing ed es er ly tion ness ment ful less able ible ous ive al".split()

# Patterns for Java. Characters that do not count in a word; letters that have further capitals.
NOISE, K, I = "[^a-z0-9 \u212a\u0130]*", "[k\u212a]", "[i\u0130]"
# White space that is not one blank; what stands before the first hit.
UNEVEN, BEFORE = r"[\t\n\x0B\f\r]\s*| \s+", "(?is)^(?:|.*? )"
ENDING = "|".join("".join({"k": K, "i": I}.get(c, c) + NOISE for c in s) for s in SUFFIXES)

# What a vector leaves out of clean text: one-letter and stop words, and the ending that ``stem`` drops (no suffix ends with
# another, and the leftmost match is the longest). Then neighbours of one stem become one.
CUT = rf"\b(?:[a-z0-9]|{'|'.join(STOP_WORDS)})\b|(?<=[a-z0-9]{{3}})(?:{'|'.join(SUFFIXES)}|(?<!s)s)\b"
SAME_NEXT, SAME_AGAIN = (r"'([a-z0-9]+)':([0-9]+) (?='\1':)", "'$1':$2,"), (",'[a-z0-9]+':", ",")


def stem(word: Column) -> Column:
    """Drop the first fitting suffix that leaves more than two letters, else a plural s."""
    out = F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)
    for s in reversed(SUFFIXES):
        out = F.when((F.length(word) > len(s) + 2) & word.endswith(s), word.substr(F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def words(text: Column) -> Column:
    """Lower-case words by white space, of a-z and 0-9 only; words of nothing else stay as ''."""
    return F.transform(F.split(F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " ")), " "), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))


def stems(text: Column, least: int = 2) -> Column:
    """Stems of the words of at least ``least`` characters, stop words included."""
    return F.transform(F.filter(words(text), lambda w: F.length(w) >= least), stem)


def query_stems(query: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.transform(F.filter(words(query), lambda w: (F.length(w) > 0) & ~F.array_contains(stop, w)), stem)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _is(word: Column, wanted: Column) -> Column:
    """Is ``wanted`` the word's stem. A stem begins its word, so other words need none."""
    return word.startswith(wanted) & (stem(word) == wanted)


def match(text: Column, query: Column) -> Column:
    """True if any stem of the query that is no stop word is in the text; NULL for NULL."""
    long = F.filter(words(text), lambda w: F.length(w) > 1)
    return _once(query_stems(query), lambda q: F.exists(long, lambda w: F.exists(q, lambda x: _is(w, x))) & (F.size(q) > 0))


def rank(text: Column, query: Column) -> Column:
    """Sum over the query's terms of their share of the text's words."""
    long = F.filter(words(text), lambda w: F.length(w) > 1)

    def share(own: Column) -> Column:
        hits = F.aggregate(query_stems(query), F.lit(0).cast("bigint"), lambda n, q: n + F.size(F.filter(own, lambda w: _is(w, q))))
        return F.when(F.size(own) > 0, hits.cast("double") / F.size(own)).otherwise(F.lit(0.0))

    return _once(long, share)


def to_tsvector(text: Column) -> Column:
    """'stem':positions, by stem; stop words and one-letter words have none."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " ")), "[^a-z0-9 ]", "")
    placed = F.transform(F.split(F.regexp_replace(clean, CUT, ""), " "), lambda s, i: F.struct(s.alias("s"), (i + 1).alias("p")))
    placed = F.sort_array(F.filter(placed, lambda x: x["s"] != ""))
    each = F.array_join(F.transform(placed, lambda x: F.concat(F.lit("'"), x["s"], F.lit("':"), x["p"].cast("string"))), " ")
    return F.regexp_replace(F.regexp_replace(each, *SAME_NEXT), *SAME_AGAIN)


def to_tsquery(query: Column, plain: bool = False) -> Column:
    """Quoted stems; operators & | ! standing alone are kept unless ``plain``, which joins by &."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    raw = F.split(F.trim(F.regexp_replace(F.lower(query), r"[\s]+", " ")), " ")
    is_op = lambda w: w.isin("&", "|", "!")
    clean = lambda w: F.regexp_replace(w, "[^a-z0-9]", "")
    kept = F.filter(raw, lambda w: F.when(is_op(w), F.lit(not plain)).otherwise((F.length(clean(w)) > 0) & ~F.array_contains(stop, clean(w))))
    parts = F.transform(kept, lambda w: F.when(is_op(w), w).otherwise(F.concat(F.lit("'"), stem(clean(w)), F.lit("'"))))
    return F.array_join(parts, " & " if plain else " ")


def hit_pattern(query: Column) -> Column:
    """Java's pattern of a word whose stem is one of the query's; '' without any. NULL for NULL."""
    stems = F.transform(F.filter(words(query), lambda w: F.length(w) > 0), stem)

    def term(x: Column) -> Column:
        # A stem's words are itself and itself with an ending, as far as their stem is the same.
        own, plural = F.when(stem(x) == x, F.lit("")), F.when(stem(F.concat(x, F.lit("s"))) == x, F.lit("s" + NOISE))
        return F.concat(loose(x), F.lit("(?:"), F.concat_ws("|", own, plural, F.when(F.length(x) > 2, F.lit(ENDING))), F.lit(")"))

    return _once(stems, lambda own: F.when(F.size(own) == 0, F.lit("")).otherwise(F.concat(F.lit(f"{NOISE}(?:"), F.array_join(F.transform(own, term), "|"), F.lit(")(?![^ ])"))))


def loose(word: Column) -> Column:
    """Pattern of a lower-case word in any case, with characters between that do not count."""
    return F.replace(F.replace(F.regexp_replace(word, "(.)", f"$1{NOISE}"), F.lit("k"), F.lit(K)), F.lit("i"), F.lit(I))


def headline(text: Column, query: Column) -> Column:
    """Up to three stretches of ten words around hits, hits in <b>; else the first ten words and '...'.

    Patterns go through the text up to the third hit; only stretches are taken apart.
    """
    flat = F.trim(F.regexp_replace(text, UNEVEN, " "))

    def shown(flat: Column, hit: Column) -> Column:
        first = F.concat(F.substring_index(flat, " ", 10), F.lit("..."))
        upto = lambda rest: F.call_function("regexp_extract", rest, F.concat(F.lit(BEFORE), hit), F.lit(0))
        behind = lambda part: F.call_function("substring", flat, F.length(part) + 1)

        def stretch(part: Column) -> Column:
            head, rest = F.substring_index(part, " ", -6), F.call_function("substring", flat, F.length(part) + 2)
            tail = F.substring_index(rest, " ", 4)
            words = F.regexp_replace(F.concat_ws(" ", head, F.when(tail != "", tail)), F.concat(F.lit("(?i)(?<![^ ])"), hit), F.lit("<b>$0</b>"))
            return F.concat(F.when(F.length(head) < F.length(part), F.lit("...")).otherwise(F.lit("")), words, F.when(F.length(tail) < F.length(rest), F.lit("...")).otherwise(F.lit("")))

        def more(part: Column) -> Column:
            return _once(upto(behind(part)), lambda own: F.when(own == "", F.lit(None)).otherwise(F.concat(part, own)))

        def found(a: Column) -> Column:
            return _once(more(a), lambda b: _once(more(b), lambda c: F.array_join(F.transform(F.filter(F.array(a, b, c), lambda x: x.isNotNull()), stretch), " ... ")))

        some = _once(upto(flat), lambda a: F.when(a == "", first).otherwise(found(a)))
        return F.when(flat.isNull(), F.lit(None)).when(flat == "", F.lit("")).when(F.coalesce(hit, F.lit("")) == "", first).otherwise(some)

    return _once(flat, lambda own: _once(hit_pattern(query), lambda hit: shown(own, hit)))


def normalize_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows that match, with their rank."""
    return df.where(match(F.col(column), F.lit(query))).withColumn("rank", rank(F.col(column), F.lit(query)))
