"""Best-two-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so a packing is a set of patterns
with multiplicities over the histogram of lengths: the planner sees at most
``capacity`` counts whatever the number of documents. A bin is filled greedily
with the largest that fits; then its smallest document is replaced by two
unpacked ones if they fill its expanded gap more tightly, as long as that helps.
Documents find their place by their rank among those of equal length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as T
from .common import batch_map, materialize

CAPACITY = 1024
EOD = 2
#: Pieces of one length that one sort holds, on average.
RANK_ROWS = 20_000


def token_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only a longer one is cut, the first piece may be shorter."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    at = ([(0, head)] if head else []) + [(s, capacity) for s in range(head, length, capacity)]
    return at


def _two_fit(left: list[int], room: int, more_than: int) -> tuple[int, int] | None:
    """The two available lengths of largest sum in (more_than, room]; left[l] counts length l."""
    best, pair = more_than, None
    have = [x for x in range(1, room) if left[x]]
    lo, hi = 0, len(have) - 1
    while lo <= hi:
        s = have[lo] + have[hi]
        if s > room:
            hi -= 1
            continue
        if s > best and (lo != hi or left[have[lo]] > 1):
            best, pair = s, (have[hi], have[lo])
            if best == room:
                break
        lo += 1
    return pair


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (largest first) with the number of bins of each."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        own = [top]
        left[top] -= 1
        gap = capacity - top
        fit = min(gap, top)
        while gap:
            fit = min(fit, gap)
            while fit and not left[fit]:
                fit -= 1
            if not fit:
                break
            own.append(fit)
            left[fit] -= 1
            gap -= fit
        while gap and len(own) > 1:
            small = own[-1]
            pair = _two_fit(left, gap + small, small)
            if pair is None:
                break
            own.pop()
            left[small] += 1
            own += pair
            left[pair[0]] -= 1
            left[pair[1]] -= 1
            gap += small - sum(pair)
            own.sort(reverse=True)
        need: dict[int, int] = {}
        for x in own:
            need[x] = need.get(x, 0) + 1
        times = 1 + min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= (times - 1) * k
        out.append((tuple(own), times))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, copies in a bin, first bins and offsets (runs of copies) of its patterns."""
    rows: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for own, times in patterns:
        at = 0
        for length in dict.fromkeys(own):
            k = own.count(length)
            rows.setdefault(length, []).append([ranks.get(length, 0), k, first, at])
            ranks[length] = ranks.get(length, 0) + k * times
            at += k * length
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def _pieces(path: str, capacity: int, eod: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        from .bpe import Encoder

        encoder = Encoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            docs = pdf["doc_id"].to_list()
            for lo, hi in T.groups(texts):
                ids, at = encoder.encode(texts[lo:hi])
                cols: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for i in range(hi - lo):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(eod)).astype("<u4")
                    for p, (start, length) in enumerate(cut(len(own), capacity)):
                        for c, v in zip(cols, (docs[lo + i], p, start, length, zlib.crc32(own[start : start + length].tobytes())), strict=True):
                            cols[c].append(v)
                yield cols

    return run


def _place(table):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        known = table.value
        for pdf in batches:
            lengths, ranks = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            seq, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                lows, copies, bins, starts = known[int(length)]
                j = np.searchsorted(lows, ranks[at], side="right") - 1
                within = ranks[at] - lows[j]
                seq[at] = bins[j] + within // copies[j]
                offset[at] = starts[j] + within % copies[j] * length
            yield {c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": seq, "offset": offset}

    return run


COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, eod: int = EOD) -> DataFrame:
    """Pack the token ids of every document (doc_id, text) into sequences of at most ``capacity``.

    A document is its ids by the tokenizers file at ``path`` and then ``eod``;
    null and empty texts are the one id. Rows that repeat are packed as often as
    they come; null doc_ids stay null; other columns are ignored; an empty table
    gives no rows. Returns one row for each piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = materialize(batch_map(docs.select("doc_id", "text"), _pieces(path, capacity, eod), COLUMNS))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # bounded by the capacity
    split = F.lit(math.ceil(max(counts.values(), default=1) / RANK_ROWS))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), split).cast("int"))
    parts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("row", F.row_number().over(order)).join(parts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))
    return batch_map(ranked, _place(table), f"{COLUMNS}, sequence_id long, offset long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_path())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents that are left, packed."""
    return pack(docs, token_path())
