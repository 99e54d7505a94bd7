"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

1. A count sketch of all shingles (fixed size, over every document) orders them
   rare first; two sets with Jaccard >= t share one of their first
   n - ceil(t n) + 1 shingles in that order.
2. Documents that share such a shingle and lie in one size band or the next are
   candidates. Those that have their least member in common form one tile, so the
   many shingles of one passage or of one group of copies make few tiles.
   Documents of equal sets are one node throughout.
3. In a tile, members of different components meet in square blocks, where sizes
   and the bit counts of hashed bitmaps bound each overlap from above. Members of
   the tile's largest component need not meet one another: they are dealt once to
   each block of the others. At first only the members of one block meet all, and
   each passes on only its most promising partner; these are intersected exactly
   on sorted arrays and components grow. Tiles that held back pairs and still hold
   several components come again, in the end with all such pairs.
   No component is lost: of a pair that shares a tile, either it was intersected,
   or a bound excludes it, or both ends were joined before.
4. Every link lies inside a component, so the links are counted there: all pairs
   of a component's sets are intersected exactly, in square blocks, and only the
   sums of each node leave a block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .common import batch_map, components, grouped_map, materialize, remove, ship, shuffle_parts, texts_of

#: Counters of the sketch; what is broadcast is bounded by them (2**20 longs: 8 MB, compressed), and so is what the driver gets.
SKETCH = 1 << 20
SKETCH_TASKS = 8
#: A shingle that occurs in more documents than this, as far as the sketch tells, is dealt out in blocks.
HOT_ROWS = 400_000
#: Postings of one shingle that are looked at pair by pair.
SMALL = 8
#: Postings that one task sorts, on average.
TASK_ROWS = 600_000
#: Rows of a square block of a tile.
BLOCK = 1024
#: Shingles that a square block of a component's sets holds on each side, on average (32 MB).
BLOCK_SHINGLES = 1 << 22
#: Columns of a dense piece of a block's incidence matrix; shingles of at most RARE sets are counted pair by pair.
COLUMNS, RARE = 4096, 6
#: Time after time: best pairs that each member of a tile passes on (None: all), and whether all blocks meet.
#: At last nothing is held back.
TIMES = ((1, False), (1, True), (None, True))
#: Bits a shingle of the bitmaps from the second time on, when few tiles are left; a tight bound leaves few pairs.
WIDE = 16
#: Candidate documents whose ids may be broadcast (64 MB); beyond, Spark shuffles.
BROADCAST_IDS = 4_000_000


def _signed(v: int) -> int:
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def _set_key(s: np.ndarray) -> int:
    """One 64-bit key for a set: equal sets have equal keys. The empty set has none."""
    return _signed(int(T.mix(s).sum(dtype=np.uint64)) ^ len(s) * 0x9E3779B97F4A7C15)


def _check_key(s: np.ndarray) -> int:
    """A second key, independent of the first: sets that agree in both are taken as equal."""
    return _signed(int(T.mix(T.mix(s ^ np.uint64(0xD1342543DE82EF95)) + np.uint64(len(s))).sum(dtype=np.uint64)))


def _node(s: np.ndarray, renamed: dict) -> int:
    """The set's name: its key, unless another set has the same key and this one had to be renamed."""
    key = _set_key(s)
    return renamed[key].get(_check_key(s), key) if key in renamed else key


def _new_name(key: int, check: int) -> int:
    return _signed(int(T.mix(np.array([key & (1 << 64) - 1], np.uint64) ^ T.mix(np.array([check & (1 << 64) - 1], np.uint64)))[0]))


def _bucket(s: np.ndarray) -> np.ndarray:
    """The sketch's counter of each shingle."""
    return (s >> np.uint64(40)).astype(np.int64) & (SKETCH - 1)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n that must be posted: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap_bits(n: int, each: int = 2) -> int:
    """Width of a set's bitmap: a power of two, ``each`` to twice as many bits a shingle, from 128 bits to 131072."""
    return min(1 << 17, max(128, 1 << (each * n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of hashed shingles as 64-bit words; a wider one folds to a narrower one by OR."""
    words = np.zeros(bits // 64, np.uint64)
    at = s >> np.uint64(17) & np.uint64(bits - 1)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, bits // 64), axis=0)


def overlap_bound(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Upper bound of |A & B|: every bit set in A alone stands for a shingle that B lacks."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def linked(inter, na, nb, percent: int):
    """percent * union <= 100 * intersection, in integers."""
    return 100 * inter >= percent * (na + nb - inter)


def _describe(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        sketch = np.zeros(SKETCH, np.int64)
        done: set[tuple] = set()
        for pdf in batches:
            for lo, hi in T.groups(list(pdf["text"])):
                sets = T.shingle_sets(texts_of(pdf, lo, hi), k)
                sketch += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH)
                nodes = [_set_key(s) if len(s) else None for s in sets]
                checks = [_check_key(s) if len(s) else None for s in sets]
                bits = []
                for node, check, s in zip(nodes, checks, sets, strict=True):
                    bits.append(None if node is None or (node, check) in done else bitmap(s, bitmap_bits(len(s))).tobytes())
                    done.add((node, check))
                yield {"doc_id": pdf["doc_id"].iloc[lo:hi], "n": [len(s) for s in sets], "node": nodes, "chk": checks, "k1": pdf["k1"].iloc[lo:hi], "k2": pdf["k2"].iloc[lo:hi], "bits": bits, "sketch": [None] * len(sets)}
        if sketch.any():
            yield {"doc_id": [None], "n": [-1], "node": [None], "chk": [None], "k1": [None], "k2": [None], "bits": [None], "sketch": [zlib.compress(sketch.astype("<i8").tobytes(), 1)]}

    return run


def _sum_sketches(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    total = np.zeros(SKETCH, np.int64)
    for pdf in batches:
        for b in pdf["sketch"]:
            total += np.frombuffer(zlib.decompress(b), "<i8")
    if total.any():
        yield {"sketch": [zlib.compress(total.astype("<i8").tobytes(), 1)]}


def _frequencies(described: DataFrame) -> tuple[bytes, int]:
    """The sketch summed over all tasks (compressed), and the count up to which a counter may be mere noise.

    The tasks' sketches are summed in three rounds, so that the driver gets one.
    """
    rows = described.where("sketch is not null").select("sketch")
    made = []
    for tasks in (SKETCH_TASKS**2, SKETCH_TASKS):
        rows = materialize(batch_map(rows.coalesce(tasks), _sum_sketches, "sketch binary"))
        made.append(rows)
    one = batch_map(rows.coalesce(1), _sum_sketches, "sketch binary").collect()
    for t in made:
        remove(described.sparkSession, t)
    out = bytes(one[0]["sketch"]) if one else zlib.compress(bytes(8 * SKETCH))
    mean = np.frombuffer(zlib.decompress(out), "<i8").sum() / SKETCH
    return out, int(mean + 6 * math.sqrt(mean) + 8)


def _postings(k: int, percent: int, counts, renamed: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        packed, noise = counts.value
        common = np.frombuffer(zlib.decompress(packed), "<i8")
        done: set[int] = set()
        for pdf in batches:
            for lo, hi in T.groups(list(pdf["text"])):
                tokens, nodes, sizes, rests = [], [], [], []
                for s in T.shingle_sets(texts_of(pdf, lo, hi), k):
                    n = len(s)
                    if not n or (key := _node(s, renamed)) in done:
                        continue
                    done.add(key)
                    # Any order will do that is the same for all; the noise of small counts does no harm.
                    first = s[np.argsort(common[_bucket(s)], kind="stable")[: prefix_length(n, percent)]]
                    tokens.append(first)
                    nodes.append(np.full(len(first), key, np.int64))
                    sizes.append(np.full(len(first), n, np.int64))
                    rests.append(n - np.arange(len(first)))
                if not tokens:
                    continue
                token, node, size, rest = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes), np.concatenate(rests)
                # Size and the share of the set from this place on (rounded up to 255ths) go in one number.
                size = size << 8 | -(-rest * 255 // size)
                parts = -(-np.maximum(common[_bucket(token)] - noise, 0) // HOT_ROWS)
                if (parts > 1).any():
                    # A hot shingle's documents are dealt to blocks; each pair of blocks meets once.
                    keep = parts <= 1
                    more = [(token[keep], node[keep], size[keep])]
                    for i in np.flatnonzero(~keep):
                        p = int(parts[i])
                        own = (int(node[i]) & (1 << 62) - 1) % p
                        other = np.arange(p)
                        pair = np.minimum(own, other) * p + np.maximum(own, other) + 1
                        more.append((T.mix(token[i] + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.full(p, node[i]), np.full(p, size[i])))
                    token, node, size = (np.concatenate(c) for c in zip(*more, strict=True))
                yield {"token": token.view(np.int64), "node": node, "size": size}

    return run


def size_band(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets with Jaccard >= percent/100 lie in one band or in neighbouring ones."""
    return np.floor(np.log(n) / math.log(100 / percent) + 1e-9).astype(np.int64)


def viable(key: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Whether a posting has a partner under the same (sorted) key with which this can be the first common shingle.

    Of sets of n and m shingles that are linked, percent / (100 + percent) of n + m are
    common, all of them in what is left of both sets from the first common one on.
    Groups of up to SMALL postings are looked at pair by pair; larger ones stay as they are.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    count = np.diff(np.append(starts, len(key)))
    out = np.repeat(count > SMALL, count)
    left = np.repeat(starts + count, count)
    small = ~out
    for step in range(1, SMALL):
        a = np.flatnonzero(small[: len(key) - step])
        a = a[a + step < left[a]]
        b = a + step
        need = percent * (n[a] + n[b])
        fits = ((100 + percent) * np.minimum(rest[a], rest[b]) >= need) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        out[a[fits]] = out[b[fits]] = True
    return out


def _tiles(percent: int):
    """Members of tiles from the postings of whole shingles.

    The documents of a shingle in bands b and b + 1 are candidates of one another;
    with the least of them, and b, they name the tile that they go to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        kept = [[b[c].to_numpy() for c in ("token", "node", "size")] for b in batches if len(b)]
        if not kept:
            return
        key, node, n = (np.concatenate(c) for c in zip(*kept, strict=True))
        del kept
        # Most shingles have one document; they are put aside before anything is sorted by more than the key.
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        key, order = key[several], order[several]
        node, n = node[order], n[order]
        order = np.lexsort((node, key))
        key, node, n = key[order], node[order], n[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]
        key, node, n = key[fresh], node[fresh], n[fresh]
        n, rest = n >> 8, (n & 255) * (n >> 8) / 255
        good = viable(key, n, rest, percent)
        key, node, n = key[good], node[good], n[good]
        if not len(key):
            return
        run_of = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        band = size_band(n, percent)
        # A document of band v is in the tile of v, and in that of v - 1 as the larger one.
        run_of, band, low = np.tile(run_of, 2), np.concatenate((band, band - 1)), np.repeat((1, 0), len(band))
        node, n = np.tile(node, 2), np.tile(n, 2)
        order = np.lexsort((node, band, run_of))
        run_of, band, low, node, n = run_of[order], band[order], low[order], node[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], (run_of[1:] != run_of[:-1]) | (band[1:] != band[:-1]))))
        count = np.diff(np.append(starts, len(node)))
        lows = np.add.reduceat(low, starts)
        # The group before is that of the next smaller band, if the shingle has it.
        covered = np.concatenate(([False], (run_of[starts[1:]] == run_of[starts[:-1]]) & (band[starts[1:]] == band[starts[:-1]] + 1) & (lows[:-1] > 0)))
        good = (count > 1) & (lows > 0) & ~((lows == count) & covered)
        two = np.flatnonzero(good & (count == 2))
        one, other = n[starts[two]], n[starts[two] + 1]
        good[two[100 * np.minimum(one, other) < percent * np.maximum(one, other)]] = False
        leader = np.repeat(node[starts], count)
        tile = T.mix(T.mix(leader.view(np.uint64)) + band.astype(np.uint64)).view(np.int64)
        inside = np.repeat(good, count)
        tile, node, n, leader = tile[inside], node[inside], n[inside], leader[inside]
        order = np.lexsort((node, tile))
        tile, node, n, leader = tile[order], node[order], n[order], leader[order]
        fresh = np.concatenate(([True], (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])))[: len(tile)]
        if len(tile):
            yield {"tile": tile[fresh], "node": node[fresh], "n": n[fresh], "leader": leader[fresh]}

    return run


def _sets(k: int, renamed: dict, wide: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for lo, hi in T.groups(list(pdf["text"])):
                sets = [s for s in T.shingle_sets(texts_of(pdf, lo, hi), k) if len(s)]
                data = [(bitmap(s, bitmap_bits(len(s), WIDE)) if wide else s).tobytes() for s in sets]
                yield {"node": [_node(s, renamed) for s in sets], "n": [len(s) for s in sets], "bits" if wide else "items": data}

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            good = np.zeros(len(pdf), bool)
            for i, (na, nb, a, b) in enumerate(zip(pdf["na"], pdf["nb"], pdf["bits_a"], pdf["bits_b"], strict=True)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                bits = 64 * min(len(x), len(y))
                good[i] = linked(overlap_bound(fold(x, bits), na, fold(y, bits), nb), na, nb, percent)
            yield {"a": pdf["a"].to_numpy()[good], "b": pdf["b"].to_numpy()[good]}

    return run


def _exact(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            good = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["items_a"], pdf["items_b"], strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(b, a)
                inter = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                good[i] = linked(inter, len(a), len(b), percent)
            yield {"a": pdf["a"].to_numpy()[good], "b": pdf["b"].to_numpy()[good]}

    return run


def _both_ends(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pairs (a, b) with columns of each end's node: a column c named in ``columns`` as x becomes xa, xb."""
    side = lambda s: table.select(F.col("node").alias(s), *(F.col(c).alias(x + s) for c, x in columns.items()))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _bound(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of the node pairs (a, b), those that sizes and bitmaps leave."""
    both = _both_ends(pairs, bits, {"n": "n", "bits": "bits_"})
    fits = (F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)
    return batch_map(both.where(fits), _bounded(percent), "a long, b long")


def _fetch(wanted: DataFrame, wide: bool, docs: DataFrame, nodes: DataFrame, k: int, renamed: dict) -> DataFrame:
    """Sets (node, n, items), or their wide bitmaps (node, n, bits), of the nodes wanted, from the texts of one document of each."""
    ids = materialize(wanted.join(nodes, "node").select("least").where("least is not null").distinct().withColumnRenamed("least", "doc_id"))
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.where("text is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    chosen = chosen.unionByName(docs.where("text is not null and doc_id is null")).select("text")
    sets = batch_map(chosen, _sets(k, renamed, wide), f"node long, n long, {'bits' if wide else 'items'} binary")
    out = materialize(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    remove(docs.sparkSession, ids)
    return out


def _intersect(pairs: DataFrame, fetch, percent: int) -> DataFrame:
    """Of the node pairs (a, b), those that are linked."""
    sets = fetch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), False)
    out = materialize(batch_map(_both_ends(pairs, sets, {"items": "items_"}), _exact(percent), "a long, b long"))
    remove(pairs.sparkSession, sets)
    return out


def _cross(percent: int, best: int | None):
    """Pairs of square blocks of tiles, of different components, that sizes and bitmaps leave.

    Each member passes on its ``best`` most promising pairs (None: all), and a tile
    that holds others back, here or in blocks that do not meet yet (``more``), is
    named (a row without a pair).
    """

    def run(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        tile, node, n, root, own, bi, bj, more = (pdf[c].to_numpy(np.int64) for c in ("tile", "node", "n", "root", "own", "bi", "bj", "more"))
        bits = [np.frombuffer(b, np.uint64) for b in pdf["bits"]]
        width = np.fromiter(map(len, bits), np.int64, len(bits))
        left, right, again = [], [], []
        for s, e in zip(starts, ends, strict=True):
            rows = np.arange(s, e)
            if more[s]:
                again.append(tile[s])
            x, y = (rows, rows) if bi[s] == bj[s] else (rows[own[s:e] == bi[s]], rows[own[s:e] == bj[s]])
            if not len(x) or not len(y):
                continue
            ok = (root[x][:, None] != root[y]) & (100 * np.minimum(n[x][:, None], n[y]) >= percent * np.maximum(n[x][:, None], n[y]))
            if x is y:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            narrow = int(width[s:e].min())
            flat = np.stack([fold(bits[r], 64 * narrow) for r in rows])
            most = np.concatenate([overlap_bound(flat[x[i[k : k + 32768]] - s], n[x[i[k : k + 32768]]], flat[y[j[k : k + 32768]] - s], n[y[j[k : k + 32768]]]) for k in range(0, len(i), 32768)])
            a, b = x[i], y[j]
            good = linked(most, n[a], n[b], percent)
            a, b, most = a[good], b[good], most[good]
            if best is not None and len(a) > best:
                share = most / (n[a] + n[b] - most)
                member = np.concatenate((a, b))
                order = np.lexsort((-np.tile(share, 2), member))
                member = member[order]
                first = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1])))
                place = np.arange(len(member)) - np.repeat(first, np.diff(np.append(first, len(member))))
                pick = np.unique(order[place < best] % len(a))
                if len(pick) < len(a):
                    again.append(tile[s])
                a, b = a[pick], b[pick]
            left.append(node[a])
            right.append(node[b])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            yield {"a": pairs[0], "b": pairs[1], "tile": [None] * pairs.shape[1]}
        if again:
            yield {"a": [None] * len(again), "b": [None] * len(again), "tile": again}

    return run


def _grid(tiles: DataFrame, bits: DataFrame, percent: int, best: int | None, full: bool) -> DataFrame:
    """Members (tile, node, root) of tiles of several components against each other in square blocks: a, b, tile.

    Blocks of the largest component come behind those of the others, and meet
    those only. Unless ``full``, only the first block meets all.
    """
    kinds = tiles.groupBy("tile", "root").agg(F.count("*").alias("cnt"))
    kinds = kinds.groupBy("tile").agg(F.sum("cnt").alias("members"), F.max("cnt").alias("most"), F.max_by("root", F.struct("cnt", "root")).alias("main"))
    rows = tiles.join(kinds, "tile").join(bits.select("node", "n", "bits"), "node")
    rows = rows.withColumn("first", F.ceil((F.col("members") - F.col("most")) / BLOCK).cast("int")).withColumn("last", F.ceil(F.col("most") / BLOCK).cast("int"))
    main, hashed = F.col("root") == F.col("main"), F.xxhash64("node")
    rows = rows.withColumn("own", F.when(main, F.col("first") + F.pmod(hashed, F.col("last"))).otherwise(F.pmod(hashed, F.col("first"))).cast("int"))
    everything = F.sequence(F.lit(0), F.col("first") + F.col("last") - 1)
    if full:
        others = F.when(main, F.sequence(F.lit(0), F.col("first") - 1)).otherwise(everything)
    else:
        others = F.when(F.col("own") == 0, everything).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("other", F.explode(others)).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    rows = rows.select("tile", "bi", "bj", "own", "node", "n", "root", "bits", (F.lit(not full) & (F.col("first") > 1)).cast("int").alias("more"))
    return grouped_map(rows, ["tile", "bi", "bj"], _cross(percent, best), "a long, b long, tile long", 2 * shuffle_parts(tiles.sparkSession))


def _link(tiles: DataFrame, bits: DataFrame, fetch, percent: int) -> DataFrame:
    """Components (node, root) of the nodes of tiles (tile, node, leader, members)."""
    spark = tiles.sparkSession
    pairs = tiles.where("members = 2 and node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = materialize(_bound(pairs, bits, percent))
    used = [pairs]
    links = _intersect(pairs, fetch, percent)
    roots = components(links)
    open_ = tiles.where("members > 2").select("tile", "node")
    wide = None
    for time, (best, full) in enumerate(TIMES):
        named = open_.join(roots, "node", "left").select("tile", "node", F.coalesce("root", "node").alias("root"))
        mixed = named.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tile")
        rest = materialize(named.join(mixed, "tile"))
        used.append(rest)
        if time == 1:
            wide = fetch(rest.select("node").distinct(), True)
            used.append(wide)
        found = materialize(_grid(rest, bits if wide is None else wide, percent, best, full))
        used.append(found)
        pairs = found.where("a is not null").select("a", "b").distinct()
        if pairs.head(1):
            used.append(links)
            links = materialize(links.unionByName(_intersect(pairs, fetch, percent)))
            roots = components(links)
        open_ = rest.select("tile", "node").join(found.where("a is null").select("tile").distinct(), "tile", "left_semi")
        if not open_.head(1):
            break
    for t in [*used, links]:
        remove(spark, t)
    return roots


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|A & B| for each of the sets x and each of the sets y, exactly (x and y are equal or disjoint)."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, times_of = row[order], np.repeat(times, times)
    inter = np.zeros((len(sets), len(sets)), np.float32)  # counts to 2**24 are exact
    for d in range(2, RARE + 1):
        own = row[times_of == d].reshape(-1, d)
        for i, j in combinations(range(d), 2):
            np.add.at(inter, (own[:, i], own[:, j]), 1)
            np.add.at(inter, (own[:, j], own[:, i]), 1)
    out = inter[np.ix_(x, y)]
    dense = times_of > RARE
    row, column = row[dense], np.repeat(np.arange((times > RARE).sum()), times[times > RARE])
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part[x] @ part[y].T
    return out.astype(np.int64)


def _count_links(percent: int):
    """Of each set of a square block, the documents of the others that it is linked with."""

    def run(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[dict]:
        node, n, weight, own, bi, bj = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "weight", "own", "bi", "bj"))
        found = np.zeros(len(node), np.int64)
        for s, e in zip(starts, ends, strict=True):
            same = bi[s] == bj[s]
            x = np.flatnonzero(own[s:e] == bi[s])
            y = x if same else np.flatnonzero(own[s:e] == bj[s])
            if not len(x) or not len(y) or same and len(x) < 2:
                continue
            inter = overlaps([np.frombuffer(b, np.uint64) for b in pdf["items"].iloc[s:e]], x, y)
            good = linked(inter, n[s + x][:, None], n[s + y], percent)
            if same:
                np.fill_diagonal(good, False)
            found[s + x] += good @ weight[s + y]
            if not same:
                found[s + y] += weight[s + x] @ good
        some = found > 0
        yield {"node": node[some], "found": found[some]}

    return run


def _links(roots: DataFrame, nodes: DataFrame, fetch, percent: int) -> DataFrame:
    """(node, found): the documents of other nodes that are linked with each node, by all pairs of its component."""
    spark = nodes.sparkSession
    info = materialize(roots.join(nodes.select("node", "weight", "size"), "node"))
    sides = info.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("side"))
    sets = fetch(info.select("node"), False)
    grid = info.join(sides, "root").join(sets.select("node", "n", "items"), "node")
    grid = grid.withColumn("own", F.pmod(F.xxhash64("node"), F.col("side")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, side - 1)")))
    grid = grid.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    grid = grid.select("root", "bi", "bj", "own", "node", "n", "weight", "items")
    out = grouped_map(grid, ["root", "bi", "bj"], _count_links(percent), "node long, found long", 2 * shuffle_parts(spark))
    out = materialize(out.groupBy("node").agg(F.sum("found").alias("found")))
    for t in (info, sets):
        remove(spark, t)
    return out


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, links: bool = True) -> DataFrame:
    """Components and numbers of links of documents with Jaccard >= percent/100 over k-word shingle sets.

    Words are runs without x20, x09-x0D, A-Z lower-cased. A text of fewer than k
    words has its whole sequence as one shingle. Null and empty texts have no
    shingles and link with nothing. Rows of one doc_id are rows of their own that
    share the id (their components meet in it only through links); a null doc_id
    stays null and does not name a component unless all its members are null.
    Equal sets link. Other columns are ignored; an empty table gives no rows.
    Returns doc_id, n_shingles, component_id, node (the set's key, null if empty),
    root (a node of the component), k1 and k2 (hashes of the text)
    and, with ``links``, n_links: how many other documents the row is linked with,
    copies counted each.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))
    described = materialize(batch_map(hashed, _describe(k), "doc_id long, n long, node long, chk long, k1 long, k2 long, bits binary, sketch binary"))
    rows, nodes, renamed = _names(described)
    shared = described.where("bits is not null").select("node", "chk", "n", "bits")
    counts = spark.sparkContext.broadcast(_frequencies(described))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (100 - percent) / 100 / TASK_ROWS))
    posted = batch_map(docs.where("text is not null").select("text"), _postings(k, percent, counts, renamed), "token long, node long, size long")
    tiles = batch_map(posted.repartition(parts, "token"), _tiles(percent), "tile long, node long, n long, leader long")
    tiles = materialize(tiles.dropDuplicates(["tile", "node"]))
    sizes = tiles.groupBy("tile").agg(F.count("*").alias("members"))
    sized = tiles.join(sizes, "tile")
    bits = _renamed(shared, renamed).select("node", "n", "bits").join(tiles.select("node").distinct(), "node", "left_semi")
    bits = materialize(bits.dropDuplicates(["node"]))
    fetch = lambda wanted, wide: _fetch(wanted, wide, docs, nodes, k, renamed)
    roots = _link(sized, bits, fetch, percent)
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = named.select("node", "root").join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    out = rows.join(named, "node", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node", "root", "k1", "k2"]
    if links:
        found = _links(roots, nodes, fetch, percent)
        out = out.join(nodes.join(found, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("linked")), "node", "left")
        columns.append(F.coalesce("linked", F.lit(0)).alias("n_links"))
    out = materialize(out.select(*columns))
    for t in (described, nodes, tiles, bits, roots):
        remove(spark, t)
    return out


def _names(described: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Rows (doc_id, n, node), nodes (node, least doc_id, weight, size) and the sets that had to be renamed.

    Sets that share a key but not the second one are few (about n * n / 2**65 of n
    sets); all but one of each key get another name, by {key: {second key: name}}.
    """
    spark = described.sparkSession
    rows = described.where("n >= 0").select("doc_id", "n", "node", "chk", "k1", "k2")
    of_node = lambda r: r.where("node is not null").groupBy("node")
    least, weight, size = F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.max("n").alias("size")
    nodes = materialize(of_node(rows).agg(least, weight, size, F.min("chk").alias("chk"), F.max("chk").alias("top")))
    renamed: dict[int, dict[int, int]] = {}
    clash = nodes.where("chk <> top").select("node", F.col("chk").alias("kept"))
    if clash.head(1):
        for r in rows.join(clash, "node").where("chk <> kept").select("node", "chk").distinct().collect():
            renamed.setdefault(r["node"], {})[r["chk"]] = _new_name(r["node"], r["chk"])
        remove(spark, nodes)
        rows = _renamed(rows, renamed)
        nodes = materialize(of_node(rows).agg(least, weight, size))
    return rows.select("doc_id", "n", "node", "k1", "k2"), nodes.select("node", "least", "weight", "size"), renamed


def _renamed(table: DataFrame, renamed: dict) -> DataFrame:
    """``table`` (node, chk, ...) with the new names of renamed sets."""
    if not renamed:
        return table
    few = table.sparkSession.createDataFrame([(n, c, new) for n, own in renamed.items() for c, new in own.items()], "node long, chk long, new long")
    return table.join(F.broadcast(few), ["node", "chk"], "left").withColumn("node", F.coalesce("new", "node")).drop("new")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents, five-word shingles, Jaccard of 0.75 or more."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=False).select("doc_id", "n_shingles", "component_id")


def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2, with every link verified and the number of each document's links."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, that with the least doc_id (null after all others).

    Rows are told apart by doc_id and text, so a row with another text under an id
    that is removed stays if its own component keeps it. Of rows equal in both, one
    stays (any, if they differ in other columns). Rows without words are components
    of their own and stay.
    """
    found = ngram_jaccard_join(docs, links=False)
    key = ["doc_id", "k1", "k2"]
    rows = found.where("node is not null").select("root", *key)
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), *key)).alias("kept")).select("root", *(F.col(f"kept.{c}").alias(f"{c}_kept") for c in key))
    gone = rows.join(kept, "root").where("not (doc_id <=> doc_id_kept and k1 = k1_kept and k2 = k2_kept)").select(*key).distinct()
    gone = materialize(gone)
    several = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    several = materialize(several.join(gone, [several[c].eqNullSafe(gone[c]) for c in key], "left_anti"))

    def at(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        """Rows of ``docs`` with (left_semi) or without (left_anti) a match in ``named``."""
        few = named.select(*(F.col(c).alias(f"_{c}_of") for c in key))
        few = F.broadcast(few) if few.count() <= BROADCAST_IDS else few
        own = (F.col("doc_id"), F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
        return rows.join(few, [o.eqNullSafe(F.col(f"_{c}_of")) for o, c in zip(own, key, strict=True)], how)

    left = at(docs, gone, "left_anti")
    if not several.head(1):
        return left
    one = at(left, several, "left_semi").withColumn("_k", F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1)))).dropDuplicates(["doc_id", "_k"]).drop("_k")
    return at(left, several, "left_anti").unionByName(one)
