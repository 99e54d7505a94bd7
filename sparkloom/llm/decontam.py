"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MATCH words that a document shares with a test item; no tile
can be without one, so documents and items that share none are never compared.
For the others, the longest stretches that item and document share are found by
running Karp-Rabin hashes and marked, longest first and not overlapping, until
none of MATCH words is left. The marked share of the item is its coverage:
passages count wherever they stand in the document and in whatever order.

The benchmark is the query set: it is taken in blocks of bounded size, and every
block meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import batch_map, materialize, replace_columns

#: Words of the shortest tile.
MATCH = 5
#: Share of an item's words that must be covered.
COVERAGE = 0.5
#: Words of a block of the benchmark; what is broadcast is bounded by them (about 50 MB).
BLOCK_WORDS = 2_000_000

def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without punctuation, and offsets."""
    return T.word_hashes([t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts], T.LETTERS)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, from one running sum."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = T.powers(len(words) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return (sums[size:] - sums[:n]) * down[:n]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` words without a mark."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[size:] == sums[: len(sums) - size]) if len(marked) >= size else np.empty(0, np.int64)


def _longest(item: np.ndarray, doc: np.ndarray, used_i: np.ndarray, used_d: np.ndarray, least: int, most: int) -> int:
    """Length of the longest unmarked stretch that both have, by bisection over window sizes; 0 if below ``least``."""

    def shares(size: int) -> bool:
        a, b = rolling(item, size)[_free(used_i, size)], rolling(doc, size)[_free(used_d, size)]
        return bool(len(a) and len(b) and np.isin(a, b).any())

    if not shares(least):
        return 0
    lo, hi = least, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if shares(mid) else (lo, mid - 1)
    return lo


def tile(item: np.ndarray, doc: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, length), longest first, by greedy string tiling."""
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= least:
        most = _longest(item, doc, used_i, used_d, least, most)
        if not most:
            break
        at_d = _free(used_d, most)
        in_d = rolling(doc, most)[at_d]
        order = np.argsort(in_d, kind="stable")
        in_d, at_d = in_d[order], at_d[order]
        for i in _free(used_i, most):
            if used_i[i : i + most].any():
                continue
            key = rolling(item[i : i + most], most)
            for k in range(np.searchsorted(in_d, key[0]), len(in_d)):
                d = int(at_d[k])
                if in_d[k] != key[0]:
                    break
                if not used_d[d : d + most].any() and np.array_equal(item[i : i + most], doc[d : d + most]):
                    used_i[i : i + most] = used_d[d : d + most] = True
                    tiles.append((int(i), d, most))
                    break
        most -= 1
    return tiles


def index_block(items: list[tuple[int, str]], least: int = MATCH) -> dict:
    """Seeds of a block of items. Items of fewer than ``least`` words have none and are never found."""
    words, at = words_of([t for _, t in items])
    seeds = T.ngram_hashes(words, least)
    owner = np.repeat(np.arange(len(items)), np.diff(at))
    n = len(seeds)
    inside = owner[:n] == owner[least - 1 :] if n else np.empty(0, bool)
    seeds, owner, place = seeds[inside], owner[:n][inside], np.arange(n)[inside]
    order = np.argsort(seeds, kind="stable")
    return {"ids": [i for i, _ in items], "words": words, "at": at, "seeds": seeds[order], "owner": owner[order], "place": place[order] - at[:-1][owner[order]]}


def cover(index: dict, doc: np.ndarray, runs: np.ndarray, coverage: float, least: int = MATCH) -> list[tuple[int, float, int]]:
    """(item number, coverage, tiles) of the items that a document's seeds can cover enough."""
    lo, hi = np.searchsorted(index["seeds"], runs, "left"), np.searchsorted(index["seeds"], runs, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return []
    size = hi[hit] - lo[hit]
    rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[hit], size)
    owner = index["owner"][rows]
    order = np.argsort(owner, kind="stable")
    rows, owner = rows[order], owner[order]
    out = []
    for part in np.split(rows, np.flatnonzero(owner[1:] != owner[:-1]) + 1):
        k = index["owner"][part[0]]
        item = index["words"][index["at"][k] : index["at"][k + 1]]
        could = np.zeros(len(item) + 1, np.int64)
        places = index["place"][part]
        np.add.at(could, places, 1)
        np.add.at(could, np.minimum(places + least, len(item)), -1)
        if (np.cumsum(could)[:-1] > 0).sum() < coverage * len(item):
            continue  # tiles lie within these words
        tiles = tile(item, doc, least)
        out.append((int(k), sum(t[2] for t in tiles) / len(item), len(tiles)))
    return out


def _scan(shared, coverage: float, least: int):
    """Of texts: coverage of the most covered item, its tiles, and the items that are covered enough."""

    def run(texts: list[str | None]) -> tuple[list[float], list[int], list[list[int]]]:
        index = shared.value
        seeds = index["seeds"]
        table = np.zeros(1 << 20, bool)
        table[(seeds >> np.uint64(44)).astype(np.int64)] = True
        top: list[tuple] = []
        ids: list[list[int]] = []
        for lo, hi in T.groups(texts, 1 << 22):
            words, at = words_of(texts[lo:hi])
            runs = T.ngram_hashes(words, least)
            maybe = np.flatnonzero(table[(runs >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[np.isin(runs[maybe], seeds)] if len(maybe) else maybe
            got: list[list[tuple]] = [[] for _ in range(hi - lo)]
            for i in np.unique(np.searchsorted(at, maybe, "right") - 1):
                a, b = int(at[i]), int(at[i + 1])
                got[i] = cover(index, words[a:b], np.unique(runs[a : max(a, b - least + 1)]), coverage, least)
            top += [max(g, key=lambda x: x[1], default=(0, 0.0, 0)) for g in got]
            ids += [sorted(index["ids"][k] for k, c, _ in g if c >= coverage) for g in got]
        return [t[1] for t in top], [t[2] for t in top], ids

    return run


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The benchmark's items (item_id, text), not null, in lists of bounded size."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


#: Names of the columns that are added.
NEW = ("coverage", "n_tiles", "item_ids", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MATCH, names: tuple[str, ...] = NEW) -> DataFrame:
    """Mark documents that hold test items.

    Returns all columns of ``docs`` (with a text column) and coverage (of the
    most covered item; 0 where shared seeds cannot cover enough of any), n_tiles
    (its tiles), item_ids (items covered by ``coverage`` or more, sorted) and
    contaminated, under ``names``. Null texts and texts of fewer than ``least``
    words have no tiles, nor have such items; repeated rows are marked alike; an
    empty benchmark marks nothing; an empty table gives no rows. Columns of docs
    named as those added are replaced; no other column is converted.

    A benchmark of one block is scanned for in one pass without a shuffle. Of more
    blocks, each pass gives only what it has found (by two hashes of the text);
    what all passes found is joined to the documents once.
    """
    spark = docs.sparkSession
    one, two, three, flag = names
    docs = docs.drop(*names)
    found = f"`{one}` double, `{two}` int, `{three}` array<long>"
    blocks = benchmark_blocks(benchmark)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        out = docs.select("*", F.lit(0.0).alias(one), F.lit(0).alias(two), F.array().cast("array<long>").alias(three))
    elif following is None:
        scan = _scan(spark.sparkContext.broadcast(index_block(block, least)), coverage, least)
        out = replace_columns(docs, lambda batch: dict(zip(names, scan(batch.column("text").to_pylist()), strict=False)), found)
    else:
        out = _by_blocks(docs, chain((block, following), blocks), coverage, least, names)
    return out.withColumn(flag, F.size(three) > 0)


def _by_blocks(docs: DataFrame, blocks, coverage: float, least: int, names: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    keys = [F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    texts = docs.where("text is not null").select(keys[0].alias("k1"), keys[1].alias("k2"), "text")
    passes = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(index_block(block, least))

        def hits(batches: Iterator[pd.DataFrame], scan=_scan(shared, coverage, least)) -> Iterator[dict]:
            for pdf in batches:
                c, n, ids = scan(list(pdf["text"]))
                some = [i for i, v in enumerate(c) if v > 0]
                yield {"k1": pdf["k1"].iloc[some], "k2": pdf["k2"].iloc[some], "c": [c[i] for i in some], "n": [n[i] for i in some], "ids": [ids[i] for i in some]}

        passes.append(materialize(batch_map(texts, hits, "k1 long, k2 long, c double, n int, ids array<long>").dropDuplicates(["k1", "k2"])))
        shared.unpersist()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    # A text has one row for each pass at most.
    every = every.groupBy("k1", "k2").agg(F.max(F.struct("c", "n")).alias("top"), F.flatten(F.collect_list("ids")).alias("ids"))
    marks = every.select(F.col("k1").alias("_mark_1"), F.col("k2").alias("_mark_2"), "top", F.array_sort(F.array_distinct("ids")).alias("ids"))
    one, two, three, _ = names
    joined = docs.select(F.struct("*").alias("row"), keys[0].alias("k1"), keys[1].alias("k2")).join(marks, [F.col("k1") == F.col("_mark_1"), F.col("k2") == F.col("_mark_2")], "left")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.coalesce("top.c", F.lit(0.0)).alias(one), F.coalesce("top.n", F.lit(0)).alias(two), F.coalesce("ids", F.array().cast("array<long>")).alias(three))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no test item. Columns stay as they are, whatever their names."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    marked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=tuple(mark + n for n in NEW))
    return marked.where(~F.col(f"{mark}contaminated")).select(docs.columns)
