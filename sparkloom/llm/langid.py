"""Language identification by words first, with back-off to character n-grams.

A word of the training sample scores by its log frequency in each language. Any
other word is broken into character n-grams (bytes, with marks at both ends);
those of the greatest order of which the sample knows at least one score it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import batch_map, crc_mod, materialize, remove

#: Documents of each language that the fit may see (about), chosen by a hash of doc_id, and languages, the most frequent ones.
SAMPLE = 1500
LANGS = 64
#: Tasks of the fit at most.
FIT_TASKS = 8
#: Word forms kept, the most frequent of those seen LEAST times.
WORDS = 200_000
LEAST = 3
ORDERS = (6, 5, 4, 3, 2, 1)
#: Counters of each order of n-grams and language; rows sent to the driver are bounded by them.
GRAMS = 1 << 17
#: Occurrences that each language is given beyond those seen.
PRIOR = 10
#: Words of a text that count as independent evidence in its score.
EVIDENCE = 50

#: All ASCII but letters separates.
ONLY_LETTERS = T.PLAIN.copy()
ONLY_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0


def lowered(pdf: pd.DataFrame) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]


def marked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each between two marks, and the offsets of the words."""
    size = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(size)))
    flat = np.ones(int(at[-1]), np.uint8)
    inner = np.ones(len(flat), bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    pos = np.arange(len(flat)) - np.repeat(at[:-1] + 1, size) + np.repeat(starts, size)
    flat[inner] = buf[pos[inner]]
    return flat, at


def grams(flat: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of the n-grams of one order and the word each lies in; shorter words have none."""
    n = len(flat) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = T.ngram_hashes(flat.astype(np.uint64) + np.uint64(1), order)
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = word[:n] == word[order - 1 :]
    return (key[inside] >> np.uint64(20)).astype(np.int64) & (GRAMS - 1), word[:n][inside]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=True):
            for lo, hi in T.groups(list(part["text"]), 1 << 22):
                for buf, starts, ends, hashes, _ in T.windows(lowered(part.iloc[lo:hi]), ONLY_LETTERS):
                    if not len(hashes):
                        continue
                    words, first, n = np.unique(hashes, return_index=True, return_counts=True)
                    yield {"lang": [lang] * len(words), "kind": [0] * len(words), "key": words.view(np.int64), "cnt": n}
                    flat, at = marked(buf, starts[first], ends[first])
                    for order in ORDERS:
                        g, word = grams(flat, at, order)
                        c = np.bincount(g, weights=n[word], minlength=GRAMS).astype(np.int64)
                        some = np.flatnonzero(c)
                        yield {"lang": [lang] * len(some), "kind": [order] * len(some), "key": some, "cnt": c[some]}


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed by PRIOR occurrences spread evenly, so that a language of few documents gains nothing by what it lacks."""
    return np.log((counts + PRIOR / max(1, len(counts))) / (counts.sum(axis=0, keepdims=True) + PRIOR)).astype(np.float32)


def fit(docs: DataFrame) -> dict | None:
    """Word and n-gram tables from a bounded sample of each language outside the held-out fold; None without any."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(crc_mod("doc_id", 4) != 2)
    # Every language gives as many documents, so that rare ones are learned as well.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    shares = spark.createDataFrame([(r["lang"], min(1.0, SAMPLE / r["n"])) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.select("text", F.col("lang").alias("lang"), place.alias("place")).join(F.broadcast(shares), "lang").where("place < share").select("text", "lang")
    sample = materialize(sample)
    counts = batch_map(sample.coalesce(FIT_TASKS), _counts, "lang string, kind int, key long, cnt long").groupBy("lang", "kind", "key").agg(F.sum("cnt").alias("cnt"))
    common = counts.where("kind = 0").groupBy("key").agg(F.sum("cnt").alias("n")).where(f"n >= {LEAST}").orderBy(F.desc("n"), "key").limit(WORDS).select("key")
    kept = counts.where("kind > 0").unionByName(counts.where("kind = 0").join(common, "key", "left_semi").select(counts.columns)).toPandas()
    remove(spark, sample)
    if not len(kept):
        return None
    langs = sorted(kept["lang"].unique())
    code = kept["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    is_word = (kept["kind"] == 0).to_numpy()
    keys = np.unique(kept["key"].to_numpy()[is_word].view(np.uint64))
    table = np.zeros((len(keys), len(langs)))
    np.add.at(table, (np.searchsorted(keys, kept["key"].to_numpy()[is_word].view(np.uint64)), code[is_word]), kept["cnt"].to_numpy()[is_word])
    model = {"langs": langs, "keys": keys, "words": _log_shares(table), "grams": {}}
    for order in ORDERS:
        own = (kept["kind"] == order).to_numpy()
        table = np.zeros((GRAMS, len(langs)))
        np.add.at(table, (kept["key"].to_numpy()[own], code[own]), kept["cnt"].to_numpy()[own])
        model["grams"][order] = (table.sum(axis=1) > 0, _log_shares(table))
    return model


def _unseen(model: dict, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of words that the sample does not have, by the longest n-grams that it has."""
    out = np.zeros((len(at) - 1, len(model["langs"])))
    open_ = np.ones(len(at) - 1, bool)
    for order in ORDERS:
        if not open_.any():
            break
        known, shares = model["grams"][order]
        g, word = grams(flat, at, order)
        use = known[g] & open_[word]
        g, word = g[use], word[use]
        if not len(g):
            continue
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        n = np.diff(np.append(first, len(word)))
        out[word[first]] = np.add.reduceat(shares[g].astype(np.float64), first, axis=0) / n[:, None]
        open_[word[first]] = False
    return out


def predict(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Language number of each text (-1 without words) and the probability of it."""
    total = np.zeros((len(texts), len(model["langs"])))
    n = np.zeros(len(texts), np.int64)
    for buf, starts, ends, hashes, owner in T.windows(texts, ONLY_LETTERS):
        if not len(hashes):
            continue
        words, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(model["keys"], words), max(0, len(model["keys"]) - 1))
        known = model["keys"][at] == words if len(model["keys"]) else np.zeros(len(words), bool)
        scores = np.zeros((len(words), len(model["langs"])))
        scores[known] = model["words"][at[known]]
        if not known.all():
            scores[~known] = _unseen(model, *marked(buf, starts[first[~known]], ends[first[~known]]))
        scores -= scores.max(axis=1, keepdims=True)
        for j in range(scores.shape[1]):
            total[:, j] += np.bincount(owner, weights=scores[inverse, j], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    best = np.where(n > 0, total.argmax(axis=1), -1)
    share = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
    share = np.exp(share - share.max(axis=1, keepdims=True))
    return best, share.max(axis=1) / share.sum(axis=1)


def _predict(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        model = shared.value
        for pdf in batches:
            texts = list(pdf["text"])
            for lo, hi in T.groups(texts):
                part = pdf.iloc[lo:hi]
                best, share = predict(model, lowered(part))
                for i in range(hi - lo):
                    # Bytes beyond ASCII count as letters above; a text may still have none.
                    if best[i] >= 0 and not any(c.isalpha() for c in texts[lo + i]):
                        best[i] = -1
                yield {"doc_id": part["doc_id"], "lang_pred": [model["langs"][b] if b >= 0 else "und" for b in best], "score": np.where(best >= 0, share, 0.0)}

    return run


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Language of every document (doc_id, text; train also lang, docs by default).

    Null texts and texts without a letter are ``und`` with score 0, as are all
    where nothing could be learned. Repeated rows get equal answers; a null doc_id
    has held_out false; an empty table gives no rows; other columns are not read.
    Returns doc_id, held_out, lang_pred, score.
    """
    model = fit(docs if train is None else train)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = batch_map(docs.select("doc_id", "text"), _predict(shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held, "lang_pred", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
