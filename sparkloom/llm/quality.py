"""Quality classifier: random-indexing vectors, pooled, and a two-layer network.

Every word stands for two units, the word itself and its shape (capitals, small
letters, digits, punctuation as it is). A unit's vector is the sum of the sparse
ternary index vectors of the units around it, over the training sample. A
document is the mean of its words' vectors, mean and spread of its shapes'
vectors and a few plain figures; a network of one hidden layer scores it, its
logits divided by a temperature fitted on rows kept from training.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import batch_map, crc_mod, filter_texts, materialize, remove, texts_of, utf8

#: Labelled documents that the fit may see, chosen by a hash of doc_id.
SAMPLE = 8000
#: Tasks of the fit at most; their matrices of 2 x UNITS x DIM numbers are summed in one task, and the driver gets the sum, compressed.
FIT_TASKS = 8
UNITS = 1 << 14
DIM = 48
WINDOW = 2
NONZERO = 6
HIDDEN = 24
THRESHOLD = 0.3
#: Words whose contexts are added at once.
CHUNK = 1 << 17
#: Bytes (unless one text has more) and texts that are pooled together.
GROUP_BYTES, GROUP_TEXTS = 1 << 18, 128

#: Bytes as shapes: A-Z, a-z and bytes beyond ASCII, digits; others as they are.
SHAPES = T.PLAIN.copy()
SHAPES[65:91] = 66
SHAPES[97:123] = 97
SHAPES[128:] = 97
SHAPES[48:58] = 48


def index_vectors() -> np.ndarray:
    """A fixed sparse ternary vector for each unit."""
    rng = np.random.default_rng(20)
    out = np.zeros((2 * UNITS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(2 * UNITS), rng.integers(0, DIM, 2 * UNITS)] += rng.choice([-1, 1], 2 * UNITS)
    return out


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word units, shape units (from UNITS on), word hashes and the offsets of each text."""
    words, shapes, at = T.word_hashes(texts, T.PLAIN, SHAPES)
    one, two = ((h >> np.uint64(30)).astype(np.int64) & (UNITS - 1) for h in (words, shapes))
    return one, two + UNITS, words, at


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Sums of the index vectors around each unit. They are whole numbers, added up for each place of the matrix."""
    index = index_vectors()
    total = np.zeros(2 * UNITS * DIM)
    place = np.zeros((2 * UNITS, NONZERO), np.int64)
    value = np.zeros((2 * UNITS, NONZERO))
    row, column = np.nonzero(index)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    place[row, nth], value[row, nth] = column, index[row, column]
    for pdf in batches:
        for lo, hi in T.groups(list(pdf["text"]), 1 << 20):
            words, shapes, _, at = units(texts_of(pdf, lo, hi))
            text = np.repeat(np.arange(hi - lo), np.diff(at))
            for a in range(0, len(words), CHUNK):
                own = np.arange(a, min(len(words), a + CHUNK))
                for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                    here = own[(own + step >= 0) & (own + step < len(words))]
                    here = here[text[here] == text[here + step]]
                    for around in (words[here + step], shapes[here + step]):
                        for target in (words[here], shapes[here]):
                            total += np.bincount((target[:, None] * DIM + place[around]).ravel(), value[around].ravel(), len(total))
    yield {"sums": [total.astype("<i4").tobytes()]}


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for r in _contexts(batches):
        yield {"sums": [zlib.compress(b, 1) for b in r["sums"]]}


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    total = np.zeros(2 * UNITS * DIM, np.int64)
    for pdf in batches:
        for b in pdf["sums"]:
            total += np.frombuffer(zlib.decompress(b), "<i4")
    yield {"sums": [zlib.compress(total.astype("<i8").tobytes(), 1)]}


def _tables(sums: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pooling tables of the summed contexts, made by each worker from what the driver holds compressed."""
    total = np.frombuffer(zlib.decompress(sums), "<i8").reshape(2 * UNITS, DIM).astype(float)
    return pooling_table((total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def _pool(table: np.ndarray, unit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the sum of its units' rows: a dense count matrix over the units that occur, times their rows."""
    used = np.flatnonzero(np.bincount(unit, minlength=len(table)))
    column = np.zeros(len(table), np.int64)
    column[used] = np.arange(len(used))
    counts = np.bincount(text * len(used) + column[unit], minlength=n * len(used)).astype(np.float32)
    return counts.reshape(n, len(used)) @ table[used]


def _distinct(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each text, by one sort of (text, 48 bits of the hash)."""
    key = np.sort(text.astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(48)).astype(np.int64), minlength=n)


def pooling_table(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word units, and of shape units with their squares beside them."""
    shapes = vectors[UNITS:]
    return np.ascontiguousarray(vectors[:UNITS]), np.hstack((shapes, shapes * shapes))


def features(texts: list[bytes], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row for each text: pooled vectors and plain figures; texts without words are zeros."""
    out = np.zeros((len(texts), 3 * DIM + 6))
    # Groups are small, so that what is held for a group is, and a count matrix stays in the cache.
    for a, b in T.groups(texts, GROUP_BYTES):
        for lo in range(a, b, GROUP_TEXTS):
            hi = min(b, lo + GROUP_TEXTS)
            words, shapes, full, at = units(texts[lo:hi])
            n = np.diff(at)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            text = np.repeat(np.arange(hi - lo), n)
            each = np.maximum(n, 1)[:, None].astype(float)
            mean = _pool(tables[0], words, text, hi - lo) / each
            both = _pool(tables[1], shapes - UNITS, text, hi - lo) / each
            flat, square = both[:, :DIM], both[:, DIM:]
            runs = T.ngram_hashes(full, 3)
            whole = text[: len(runs)] == text[2:]
            size = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
            lines = np.fromiter((t.count(b"\n") for t in texts[lo:hi]), np.int64, hi - lo)
            plain = np.stack(
                (
                    np.log1p(n),
                    _distinct(full, text, hi - lo) / each[:, 0],
                    _distinct(runs[whole], text[: len(runs)][whole], hi - lo) / np.maximum(n - 2, 1),
                    size / each[:, 0],
                    lines / each[:, 0],
                    np.ones(hi - lo),
                ),
                axis=1,
            )
            rows = np.hstack((mean, flat, np.sqrt(np.maximum(square - flat * flat, 0)), plain))
            out[lo + some] = rows[some]
    return out


def _features(sums):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        tables = _tables(sums.value)
        for pdf in batches:
            for lo, hi in T.groups(list(pdf["text"])):
                part = pdf.iloc[lo:hi]
                yield {"doc_id": part["doc_id"], "label": part["label"], "x": [r.astype("<f8").tobytes() for r in features(texts_of(part), tables)]}

    return run


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """The network, fitted on all rows in a fixed order; nothing where fewer than two classes are labelled."""
    rows = sorted(r for pdf in batches for r in zip(pdf["doc_id"].tolist(), pdf["label"].tolist(), pdf["x"], strict=True))
    if len({label for _, label, _ in rows}) == 2:
        x = np.stack([np.frombuffer(b, "<f8") for _, _, b in rows])
        yield {"net": [pickle.dumps(train(x, np.array([label for _, label, _ in rows], float)))]}


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40) -> dict:
    """Two-layer network by Adam on four fifths of the rows; temperature on the rest."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    kept = rng.random(len(z)) < 0.2 if len(z) >= 50 else np.zeros(len(z), bool)
    a, b = z[~kept], y[~kept]
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for s in range(0, len(a), 128):
            q, t = a[order[s : s + 128]], b[order[s : s + 128]]
            h = np.tanh(q @ w[0] + w[1])
            d = (1 / (1 + np.exp(-(h @ w[2] + w[3][0]))) - t) / len(q)
            back = np.outer(d, w[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((q.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.003 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "w": w, "temperature": 1.0}
    if kept.any():
        logit, t = _logits(model, x[kept]), y[kept]
        loss = lambda c: np.mean(np.logaddexp(0, logit / c) - t * logit / c)
        model["temperature"] = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return model


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    w = model["w"]
    return np.tanh(z @ w[0] + w[1]) @ w[2] + w[3][0]


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_logits(model, x) / model["temperature"], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame):
    """Contexts (broadcast, as _tables takes them) and network from a bounded sample of labelled documents outside the held-out fold.

    Matrices and features stay on the executors; the driver gets the summed contexts, compressed, and the network.
    None where fewer than two classes are labelled.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod("doc_id", 5) != 0)
    known = known.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    chosen = spark.createDataFrame(known.collect(), "doc_id long, label int")
    # The sample is written, so that few tasks can read it; sums of whole numbers do not depend on their order.
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    sums = materialize(batch_map(sample.coalesce(FIT_TASKS), _packed, "sums binary"))
    total = batch_map(sums.coalesce(1), _sum, "sums binary").collect()
    made, nets = [sample, sums], []
    if total:
        shared = spark.sparkContext.broadcast(bytes(total[0]["sums"]))
        made.append(materialize(batch_map(sample.coalesce(FIT_TASKS), _features(shared), "doc_id long, label int, x binary")))
        nets = batch_map(made[-1].coalesce(1), _train, "net binary").collect()
    for t in made:
        remove(spark, t)
    return (shared, pickle.loads(nets[0]["net"])) if nets else None


def _scored(net: dict, tables, texts: list[bytes]) -> np.ndarray:
    """Scores of many texts; features are held for one group of them at a time."""
    parts = [score(net, features(texts[lo:hi], tables)) for lo, hi in T.groups(texts)]
    return np.concatenate(parts) if parts else np.empty(0)


def _scores(sums, net: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        tables = _tables(sums.value)
        for pdf in batches:
            yield {"doc_id": pdf["doc_id"], "score": _scored(net, tables, texts_of(pdf))}

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document (doc_id, text) for quality.

    Null texts score as empty ones; repeated rows score alike; a null doc_id is
    held out of nothing (held_out false); an empty table gives no rows. Where
    labels of both classes are missing, every score is 1. Other columns are not
    read. Returns doc_id, held_out, score, predicted (1 from THRESHOLD on).
    """
    spark = docs.sparkSession
    model = fit(docs, labels)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    out = batch_map(docs.select("doc_id", "text"), _scores(*model), "doc_id long, score double")
    return out.select("doc_id", held, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    sums, net = model
    tables = []

    def good(texts: list[str | None]) -> np.ndarray:
        if not tables:
            tables.append(_tables(sums.value))
        return _scored(net, tables[0], utf8(texts)) >= THRESHOLD

    return filter_texts(docs, good)
