"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities; a transport problem says how
many bytes go from each old shard to each new one, at the least cost of moved
bytes. Blocks (hash buckets of an old shard) are moved whole along that flow.
Blocks that a flow boundary cuts are cut into smaller ones, and those that it
cuts again are dealt out by documents, largest first to the shard that lacks
most. Shards that gain or lose rows are then written anew, all others stay.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import materialize, shared_dir, shuffle_parts

#: Rows that a block holds on average, and blocks at most (beyond, they grow); the driver sees one row for each block.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 200_000
#: Blocks of an old shard at least, so that few rows lie in cut blocks.
LEAST_BLOCKS = 64
#: Rows that the pieces of a cut block hold on average; the driver sees one row for each piece, and deals out the rows of
#: those pieces that are cut again, about one for each pair of an old and a new shard with flow.
SMALL_ROWS = 500
#: Bytes of text that a written file holds, about.
FILE_BYTES = 1 << 27
#: Mean-sized rows that each flow keeps for dealing out one by one, so that shards end near their capacity.
SPARE_ROWS = 48


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Cheapest transport of ``supply`` to ``demand`` (equal sums) by successive shortest paths.

    Returns flow[i][j]. Dijkstra with potentials on the bipartite residual graph;
    the graph has shards as nodes, so its size does not depend on the data.
    """
    m, n = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    flow = [[0] * n for _ in range(m)]
    left, need = list(supply), list(demand)
    pot = [0.0] * m + [min((cost[i][j] for i in range(m)), default=0.0) for j in range(n)]
    while any(left):
        dist = [math.inf] * (m + n)
        back = [-1] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                dist[i] = 0.0
                heap.append((0.0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            steps = ((m + j, cost[v][j]) for j in range(n)) if v < m else ((i, -cost[i][v - m]) for i in range(m) if flow[i][v - m])
            for w, c in steps:
                nd = d + max(0.0, c + pot[v] - pot[w])
                if nd < dist[w] - 1e-12:
                    dist[w], back[w] = nd, v
                    heapq.heappush(heap, (nd, w))
        end = min((m + j for j in range(n) if need[j]), key=lambda v: dist[v] + pot[v])
        far = dist[end]
        pot = [p + min(d, far) for p, d in zip(pot, dist, strict=True)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[end - m], *(flow[w][v - m] for v, w in zip(path, path[1:], strict=False) if v >= m))
        for v, w in zip(path, path[1:], strict=False):
            if v < m:
                flow[v][w - m] += amount
            else:
                flow[w][v - m] -= amount
        left[path[0]] -= amount
        need[end - m] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def move_cost(old: int, new: int) -> list[list[float]]:
    """0 for bytes that stay in their shard, 1 for bytes that move."""
    return [[0.0 if i == j else 1.0 for j in range(new)] for i in range(old)]


def plan_blocks(blocks: list[tuple[int, int, int, int]], flow: list[list[int]]) -> tuple[dict, dict]:
    """(old shard, block, bytes, rows) along the flow: whole blocks to a shard, and for each
    old shard the cut blocks with the bytes that each new shard still lacks."""
    whole: dict[tuple[int, int], int] = {}
    cut: dict[int, tuple[list[int], dict[int, int]]] = {}
    by_old = defaultdict(list)
    total: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for old, block, size, n in blocks:
        by_old[old].append((block, size))
        total[old][0] += size
        total[old][1] += n
    for old, own in by_old.items():
        want = {j: f for j, f in enumerate(flow[old]) if f}
        targets = sorted(want, key=lambda j: (j != old, j))
        rest: list[int] = []
        spare = SPARE_ROWS * total[old][0] // max(1, total[old][1])
        at = 0
        for block, size in sorted(own):
            while at < len(targets) and want[targets[at]] <= spare:
                at += 1
            if at < len(targets) and size <= want[targets[at]] - spare:
                whole[old, block] = targets[at]
                want[targets[at]] -= size
            else:
                rest.append(block)
        if rest:
            cut[old] = rest, want
    return whole, cut


def deal(rows: list[tuple], lack: dict[int, int]) -> list[int]:
    """Largest first, each row to the shard that lacks most bytes. rows: (…, size) in order."""
    heap = [(-v, j) for j, v in sorted(lack.items())]
    heapq.heapify(heap)
    out = []
    for r in rows:
        v, j = heap[0]
        heapq.heapreplace(heap, (v + r[-1], j))
        out.append(j)
    return out


class Layout:
    """Where every row of a table goes.

    ``base`` holds the rows (doc: the row itself, row: its number, old, size, crc);
    they were written once, so that numbers stay the same. ``placed`` says where
    blocks go, ``singles`` where the rows of cut blocks go; both are bounded.
    """

    def __init__(self, base: DataFrame, old_count: int, capacities: list[int] | None, shards: int, costs: list[list[float]] | None):
        spark = base.sparkSession
        self.base = base
        n = base.count()
        per_old = max(LEAST_BLOCKS, math.ceil(min(MAX_BLOCKS, n / BLOCK_ROWS) / old_count))
        self.per_old, self.small = per_old, 1
        self.cut_frame: DataFrame | None = None
        blocks = self._sizes(self._blocks())
        supply = [0] * old_count
        for old, _, size, _ in blocks:
            supply[old] += size
        capacities = capacities or even_capacities(sum(supply), shards)
        self.shards = len(capacities)
        flow = min_cost_flow(supply, capacities, costs or move_cost(old_count, self.shards))
        whole, cut = plan_blocks(blocks, flow)
        rows_of = {(o, b): rows for o, b, _, rows in blocks}
        cut_rows = {(o, b): rows_of[o, b] for o, (bs, _) in cut.items() for b in bs}
        if cut_rows:
            self.small = min(math.ceil(max(cut_rows.values()) / SMALL_ROWS), max(1, MAX_BLOCKS // len(cut_rows)))
            pairs = [(o, b, per_old + i * self.small) for i, (o, b) in enumerate(sorted(cut_rows))]
            self.cut_frame = spark.createDataFrame(pairs, "old int, block int, first int")
            smaller = self._sizes(self._blocks().where(F.col("block") >= per_old))
            left = [[cut[o][1].get(j, 0) if o in cut else 0 for j in range(self.shards)] for o in range(old_count)]
            more, cut = plan_blocks(smaller, left)
            whole |= more
            rows_of |= {(o, b): rows for o, b, _, rows in smaller}
        # Places: first the whole blocks of a shard, then its single rows.
        taken = [0] * self.shards
        placed, moves = [], set()
        for (o, b), j in sorted(whole.items()):
            placed.append((o, b, j, taken[j]))
            taken[j] += rows_of[o, b]
            moves.add((o, j))
        pairs = [(o, b) for o, (bs, _) in sorted(cut.items()) for b in bs]
        singles = []
        if pairs:
            some = self._blocks().join(F.broadcast(spark.createDataFrame(pairs, "old int, block int")), ["old", "block"])
            by_old = defaultdict(list)
            for r in some.select("old", "row", "size").collect():
                by_old[r["old"]].append((r["row"], r["size"]))
            for o, (_, lack) in sorted(cut.items()):
                own = sorted(by_old[o], key=lambda r: (-r[1], r[0]))
                for (row, _), j in zip(own, deal(own, lack), strict=True):
                    singles.append((row, j, taken[j]))
                    taken[j] += 1
                    moves.add((o, j))
        self.placed = spark.createDataFrame(placed, "old int, block int, to int, base long")
        self.singles = spark.createDataFrame(singles, "row long, one int, place long")
        self.touched = sorted({s for o, j in moves if o != j for s in (o, j)})
        self.sizes = capacities

    def _blocks(self) -> DataFrame:
        """The rows with the block that each lies in."""
        hashed = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
        rows = self.base.withColumn("block", hashed(0, self.per_old))
        if self.cut_frame is None:
            return rows
        rows = rows.join(F.broadcast(self.cut_frame), ["old", "block"], "left")
        return rows.withColumn("block", F.coalesce(F.col("first") + hashed(1, self.small), "block")).drop("first")

    @staticmethod
    def _sizes(rows: DataFrame) -> list[tuple[int, int, int, int]]:
        got = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        return [(r["old"], r["block"], r["bytes"], r["rows"]) for r in got]

    def rows(self, files: int) -> DataFrame:
        """The rows with shard and slot; rows that are written to one file of a shard lie in one partition."""
        rows = self._blocks().join(F.broadcast(self.placed), ["old", "block"], "left").join(F.broadcast(self.singles), "row", "left")
        rows = rows.withColumn("shard", F.coalesce("to", "one").cast("int")).withColumn("file", F.pmod(F.xxhash64("old", "block"), F.lit(files)))
        order = Window.partitionBy("shard", "file", "old", "block").orderBy(F.desc("size"), "crc", "row")
        slot = F.coalesce(F.col("base") + F.row_number().over(order) - 1, F.col("place")).cast("long")
        return rows.repartition(max(shuffle_parts(self.base.sparkSession), self.shards * files), "shard", "file").withColumn("slot", slot)


def _numbered(docs: DataFrame, old_shard: Column, old_count: int, whole: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")
    old = F.pmod(F.coalesce(old_shard, F.lit(0)), F.lit(old_count)).cast("int").alias("old")
    doc = F.struct("*") if whole else F.struct("doc_id")
    return materialize(docs.select(doc.alias("doc"), F.monotonically_increasing_id().alias("row"), old, size, crc))


def reshard(docs: DataFrame, old_shard: Column, old_count: int, capacities: list[int] | None = None, shards: int = 16, costs: list[list[float]] | None = None) -> DataFrame:
    """Assign each row of ``docs`` (doc_id, text, ...) to a new shard.

    ``old_shard`` is an int column, 0 to old_count - 1; null counts as 0.
    ``capacities`` are bytes of each new shard (near-equal shares of the whole by
    default) and must sum to the data's size. Returns doc_id, size, text_crc32,
    old_shard, shard, slot. Size is the text's UTF-8 bytes (null: none) plus 1;
    the CRC of a null text is that of no bytes, 0. Rows that are equal in all
    columns are rows of their own and each gets a place; null doc_ids are rows as
    any other; an empty table gives no rows. Further columns are ignored.

    Sent to the driver: one row for each block (MAX_BLOCKS in all, or LEAST_BLOCKS
    of each old shard) and the rows of the pieces of blocks that the flow cuts
    (SMALL_ROWS or few more of each).
    """
    base = _numbered(docs, old_shard, old_count, False)
    rows = Layout(base, old_count, capacities, shards, costs).rows(shuffle_parts(docs.sparkSession))
    return rows.select("doc.doc_id", "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", "slot")


def rewrite(docs: DataFrame, old_shard: Column, old_count: int, out_dir: str, capacities: list[int] | None = None, shards: int = 16, costs: list[list[float]] | None = None) -> tuple[list[int], DataFrame]:
    """Reshard ``docs`` and write the shards that gain or lose rows as ``out_dir/shard=N`` (parquet).

    Every row of a shard that is written is written once, with all columns of docs
    and its slot and old_shard (columns of docs of these names and shard are
    replaced); a second run replaces the shards that it writes. Shards of which
    all rows stay and none come are not touched. Returns the numbers of the
    written shards, and the rows of the others (columns of docs, old_shard, slot,
    shard). Sizes, nulls and repeats are as for ``reshard``.
    """
    layout = Layout(_numbered(docs, old_shard, old_count, True), old_count, capacities, shards, costs)
    files = max(1, math.ceil(sum(layout.sizes) / FILE_BYTES / layout.shards))
    names = [c for c in docs.columns if c not in ("old_shard", "slot", "shard")]
    rows = layout.rows(files).select(*(F.col("doc").getField(c).alias(c) for c in names), F.col("old").alias("old_shard"), "slot", "shard")
    moved = rows.where(F.col("shard").isin(layout.touched))
    moved.write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("shard").parquet(out_dir)
    return layout.touched, rows.where(~F.col("shard").isin(layout.touched))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, laid out so far in 16 shards by source (uneven), written anew as 16 even shards; told from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out_dir = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    now = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(16)).cast("int")
    touched, others = rewrite(docs, now, 16, out_dir)
    schema = StructType([*(f for f in others.schema.fields if f.name != "shard"), StructField("shard", IntegerType())])
    rows = others if not touched else spark.read.schema(schema).parquet(out_dir)
    if touched and len(touched) < 16:
        rows = rows.select(others.columns).unionByName(others)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return rows.select("doc_id", size, crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
