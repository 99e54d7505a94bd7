"""Embedding near-duplicates by a forest of random-projection trees.

Trees split recursively at the median of a random projection, with a band around
it that goes to both sides. They are fitted on a bounded sample, and beyond the
depth that it supports go on with the projections of its last nodes. Vectors are
compared within leaves only, exactly; a pair that shares several leaves counts
in the least of them. Vectors of equal bytes are one node with a weight. A leaf
sends on what each vector has found and one edge to join it, never its pairs.
A vector goes to its leaves once, in the width that it came in; only leaves that
are too large for one block are asked for their size first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, components, grouped_map, materialize, remove, shuffle_parts

COSINE = 0.98
TREES = 4
#: Vectors that a leaf holds, about.
LEAF = 512
#: Share of a node's vectors on each side of its median that go to both sides.
SPILL = 0.06
#: Vectors that the trees are fitted on, chosen by a hash of their bytes; sent to the driver.
SAMPLE = 16_384
#: Sample vectors of the last node that has a median of its own.
SUPPORT = 24
#: Vectors of a square block of a larger leaf.
BLOCK = 2048
#: Lengths of vectors that have a forest of their own, the most frequent ones; those of any other length are one leaf.
FORESTS = 8
#: Larger leaves whose sizes may be broadcast (16 bytes each).
BROADCAST_LEAVES = 500_000


def read(column, kind: str) -> np.ndarray:
    """Unit vectors in double precision from rows of little-endian floats."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            data = []
            for v in pdf["embedding"]:
                x = np.array([math.nan if c is None else c for c in v], kind) if v is not None and len(v) else None
                data.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield {"vec_id": pdf["vec_id"], "label": pdf["label"], "dim": [None if d is None else len(v) for d, v in zip(data, pdf["embedding"], strict=True)], "vector": data}

    return run


class Forest:
    """Trees over unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.dirs = rng.standard_normal((trees, max(depth, 1), sample.shape[1])) / math.sqrt(sample.shape[1])
        self.known = min(depth, max(0, int(math.log2(max(1, len(sample) / SUPPORT)))))
        self.leaf_count = trees << depth
        self.low: list[list[np.ndarray]] = []
        self.high: list[list[np.ndarray]] = []
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            lows, highs = [], []
            for level in range(depth):
                width = 1 << min(level, self.known)
                p = sample @ self.dirs[t, level]
                lo, mid, hi = np.zeros(width), np.zeros(width), np.zeros(width)
                order = np.argsort(node, kind="stable")
                at = np.searchsorted(node[order], np.arange(width + 1))
                everywhere = np.quantile(p, (0.5 - spill, 0.5, 0.5 + spill)) if len(p) else np.zeros(3)
                for k in range(width):
                    own = p[order[at[k] : at[k + 1]]]
                    lo[k], mid[k], hi[k] = np.quantile(own, (0.5 - spill, 0.5, 0.5 + spill)) if len(own) else everywhere
                lows.append(lo)
                highs.append(hi)
                if level < self.known:
                    node = node * 2 + (p >= mid[node])
            self.low.append(lows)
            self.high.append(highs)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, all trees; leaf numbers are distinct between trees."""
        rows, leaves = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = x @ self.dirs[t, level]
                k = node >> max(0, level - self.known)
                left, right = p[row] <= self.high[t][level][k], p[row] >= self.low[t][level][k]
                row, node = np.concatenate((row[left], row[right])), np.concatenate((node[left] * 2, node[right] * 2 + 1))
            rows.append(row)
            leaves.append(node * self.trees + t)
        return np.concatenate(rows), np.concatenate(leaves)


def _assign(shared, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        forests: dict[int, Forest] = shared.value
        for pdf in batches:
            for dim, own in pdf.groupby("dim", sort=True):
                for lo in range(0, len(own), 2048):
                    part = own.iloc[lo : lo + 2048]
                    forest = forests.get(int(dim))
                    if forest is None:
                        parts = [np.zeros(1, "<i4")] * len(part)
                    else:
                        row, leaf = forest.leaves(read(part["vector"], kind))
                        order = np.lexsort((leaf, row))
                        row, leaf = row[order], leaf[order].astype("<i4" if forest.leaf_count < 1 << 31 else "<i8")
                        parts = np.split(leaf, np.searchsorted(row, np.arange(1, len(part))))
                    yield {"node": part["node"], "label": part["label"], "weight": part["weight"], "dim": part["dim"], "vector": part["vector"], "leaves": [v.tolist() for v in parts], "codes": [v.tobytes() for v in parts]}

    return run


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        a = self.find(i)
        for j in others:
            b = self.find(int(j))
            if a != b:
                a, b = min(a, b), max(a, b)
                self.up[b] = a


def compare(leaf: int, part: np.ndarray, other: np.ndarray, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, leaves: list[bytes], width: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One leaf or one block of it: (vector, links found here, least vector joined to it here).

    ``part`` and ``other`` are the rows that meet; equal arrays meet each pair once.
    """
    found = np.zeros(len(ids), np.int64)
    union = _Union(len(ids))
    same = part is other
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(v, len(kinds)) for v in leaves])
    sets = [frozenset(np.frombuffer(b, f"<i{width}").tolist()) for b in kinds]
    first: dict[tuple[int, int], bool] = {}
    for lo in range(0, len(part), 256):
        rows = part[lo : lo + 256]
        near = x[rows] @ x[other].T >= cosine
        for r, i in enumerate(rows):
            js = other[near[r]]
            js = js[ids[js] > ids[i]] if same else js
            if not len(js):
                continue
            union.join(int(i), js)
            mine = []
            for k in np.unique(kind[js]):
                pair = (kind[i], k)
                if pair not in first:
                    first[pair] = min(sets[pair[0]] & sets[k]) == leaf
                if first[pair]:
                    mine.append(js[kind[js] == k])
            if mine:
                js = np.concatenate(mine)
                found[i] += weight[js].sum()
                found[js] += weight[i]
    roots = np.array([union.find(i) for i in range(len(ids))])
    some = np.flatnonzero((roots != np.arange(len(ids))) | (found > 0))
    return ids[some], found[some], ids[roots[some]]


def _leaf(cosine: float, kind: str, widths: dict[int, int]):
    def run(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        leaf, dim, bi, bj, own, node, weight = (pdf[c].to_numpy(np.int64) for c in ("leaf", "dim", "bi", "bj", "own", "node", "weight"))
        vectors, codes = pdf["vector"].to_numpy(), pdf["codes"].to_numpy()
        out: tuple[list, ...] = ([], [], [])
        for a, b in zip(starts, ends, strict=True):
            if b - a < 2:
                continue
            part, other = np.flatnonzero(own[a:b] == bi[a]), np.flatnonzero(own[a:b] == bj[a])
            other = part if bi[a] == bj[a] else other
            got = compare(int(leaf[a]), part, other, node[a:b], weight[a:b], read(vectors[a:b], kind), list(codes[a:b]), widths.get(int(dim[a]), 4), cosine)
            for o, v in zip(out, got, strict=True):
                o.append(v)
        if out[0]:
            yield dict(zip(("node", "found", "root"), map(np.concatenate, out), strict=True))

    return run


def _links(nodes: DataFrame, kind: str, cosine: float, leaf: int, trees: int) -> DataFrame:
    """(node, found, root) of all leaves, for nodes (node, label, weight, dim, vector)."""
    spark = nodes.sparkSession
    dims = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(FORESTS).collect()
    forests = {}
    for r in dims:
        some = nodes.where(F.col("dim") == r["dim"]).select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE).select("vector").collect()
        forests[r["dim"]] = Forest(read([v["vector"] for v in some], kind), max(0, math.ceil(math.log2(max(1, r["n"] / leaf)))), trees)
    widths = {d: 4 if f.leaf_count < 1 << 31 else 8 for d, f in forests.items()}
    shared = spark.sparkContext.broadcast(forests)
    rows = materialize(batch_map(nodes, _assign(shared, kind), "node long, label long, weight long, dim int, vector binary, leaves array<long>, codes binary"))
    key = ["label", "dim", "leaf"]
    sizes = rows.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    sizes = materialize(sizes)
    few = sizes.count() <= BROADCAST_LEAVES
    spread = rows.select("node", "label", "weight", "dim", "vector", "codes", F.explode("leaves").alias("leaf"))
    spread = spread.join(F.broadcast(sizes) if few else sizes, key, "left").withColumn("side", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("side")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, side - 1)")))
    spread = spread.withColumn("bi", F.least("own", "with")).withColumn("bj", F.greatest("own", "with"))
    spread = spread.select("node", "label", "weight", "dim", "vector", "codes", "leaf", "own", "bi", "bj")
    parts = max(shuffle_parts(spark), math.ceil(sum(r["n"] for r in dims) * trees / 50_000))
    out = materialize(grouped_map(spread, [*key, "bi", "bj"], _leaf(cosine, kind, widths), "node long, found long, root long", parts))
    for t in (rows, sizes):
        remove(spark, t)
    return out


def _label(column: str, kind: str):
    """A label as one number: whole numbers as they are, all else by a hash of the value itself."""
    c = F.col(column)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    if kind in ("float", "double"):
        c = c + F.lit(0.0)  # no -0.0
    return F.when(c.isNotNull(), F.xxhash64(c))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, trees: int = TREES) -> DataFrame:
    """Links and components of vectors (vec_id, embedding, label) of equal labels with cosine >= ``cosine``.

    Labels of any type are compared as they are. Null labels, and embeddings that
    are null, empty, zero or hold null or non-finite components, link with
    nothing; so do vectors of unequal lengths with one another. Rows of equal
    label and vector are copies and link with one another. Repeated vec_ids count
    as vectors of their own and share the id's component. Vectors with a null
    vec_id are compared as all others, but name no component: theirs is the least
    id in it, null if there is none, and they are not kept. An empty table gives
    no rows; other columns are ignored. Returns vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    kind = "<f4" if types["embedding"] == "array<float>" else "<f8"
    source = vectors.select("vec_id", _label("label", types["label"]).alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    ready = batch_map(source, _prepare(kind), "vec_id long, label long, dim int, vector binary")
    ready = materialize(ready.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64("vector", F.lit(1))))
    good = ready.where("vector is not null and label is not null")
    key = ["label", "dim", "k1", "k2"]
    # One copy of each vector, and a number of its own for each, written so that it stays the same.
    nodes = good.groupBy(*key).agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.any_value("vector").alias("vector"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = _links(nodes.select("node", "label", "weight", "dim", "vector"), kind, cosine, leaf, trees)
    counts = found.groupBy("node").agg(F.sum("found").alias("found"))
    members = materialize(good.select("vec_id", *key).join(nodes.select(*key, "node", "weight", "least"), key).select("vec_id", "node", "weight", "least"))
    # A vec_id that repeats with other values is one point of the graph: it joins its nodes.
    ids = members.where("vec_id is not null").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = members.join(ids.select("vec_id", "a"), "vec_id").select("a", F.col("node").alias("b")).where("a <> b")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(same))
    named = nodes.select("node", "least").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = named.select("node", "root").join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = members.join(counts, "node", "left").join(named, "node").select("vec_id", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id")
    lone = ready.where("vector is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    out = materialize(out)
    for t in (ready, nodes, found, members):
        remove(spark, t)
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
