"""Shared plumbing: shared-folder tables, connected components, functions over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine sees: spark.checkpoint.dir, or our own where it is unset and there is one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loom-checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    root = shared_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loom-" in folder and root.split(":", 1)[-1].lstrip("/") in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)


def kept_bytes(spark: SparkSession, name: str, make) -> bytes:
    """Bytes under ``name`` in the shared folder; where there are none, ``make`` gives them, and the first writer's stay."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Exception:  # another writer was first
            if not fs.exists(path):
                raise
        else:
            out.write(bytearray(make()))
            out.close()
    return bytes(spark.read.format("binaryFile").load(path.toString()).select("content").first()[0])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, m: int):
    """crc32(col as text) mod m, the fold of a document."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


#: Edges that one task joins by itself (16 MB); more go through rounds over the cluster.
LOCAL_EDGES = 1_000_000


def _union(batches):
    """Components of a bounded edge list by union-find: (node, root)."""
    import numpy as np

    got = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches if len(b)]
    if not got:
        return
    u, v = (np.concatenate(c) for c in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    up = list(range(len(nodes)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    yield {"node": nodes, "root": nodes[[find(i) for i in range(len(nodes))]]}


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a, b) of longs.

    Up to LOCAL_EDGES distinct edges are joined in one task. Beyond, alternates large-star and small-star rounds (Kiveris et al., 2014), each a
    map-side combined minimum and a join that AQE may split, until every node
    points at the least id of its component. Every round is written to the
    shared folder. Returns (node, root) for each node that has an edge; self
    loops and repeated edges are allowed, null ends are dropped.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    cur = materialize(
        edges.where("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if cur.count() <= LOCAL_EDGES:
        return materialize(batch_map(cur.coalesce(1), _union, "node long, root long"))
    loops = cur.where("u = v").select(F.col("u").alias("node"))
    cur_edges = cur.where("u <> v")

    def state(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen, prev = state(cur_edges), None
    for _ in range(max_rounds):
        if seen[0] == 0 or seen == prev:
            break
        prev = seen
        both = cur_edges.unionByName(cur_edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.where("u <> v").distinct())
        old, cur_edges = cur_edges, nxt
        if prev is not None and old is not cur.where("u <> v") and old.inputFiles() != cur.inputFiles():
            remove(spark, old)
        seen = state(cur_edges)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = cur_edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = cur_edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    named = leaves.unionByName(roots)
    alone = loops.distinct().join(named.select("node").distinct(), "node", "left_anti").select("node", F.col("node").alias("root"))
    return named.unionByName(alone)


def batch_map(df: DataFrame, fn, ddl: str) -> DataFrame:
    """mapInArrow over a generator function of pandas batches.

    ``fn`` takes an iterator of pandas frames and yields dicts of columns. Integer
    columns with nulls come as objects, so that no id passes through a float.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for cols in fn(b.to_pandas(integer_object_nulls=True) for b in small(batches)):
            arrays = [pa.array(cols[f.name], type=f.type, from_pandas=True) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)


#: Bytes of a piece of a batch that is converted at once, unless one row has more.
PIECE = 8 << 20


def give_back() -> None:
    """What a worker has freed goes back to the system, also from the C library's heap where that can be told so."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small(batches):
    """Arrow batches in pieces of PIECE bytes, so that a worker holds few Python objects; memory goes back before and after."""
    give_back()
    for b in batches:
        rows = max(1, int(b.num_rows * PIECE / max(PIECE, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def filter_texts(df: DataFrame, keep) -> DataFrame:
    """Rows of ``df`` for which ``keep``, given the texts of a batch, has True. No column is converted on the way."""
    from pyspark.sql.types import StructType

    ship(df.sparkSession)

    def run(batches):
        for b in small(batches):
            yield b.filter(pa.array(keep(b.column("text").to_pylist()), pa.bool_()))

    return df.mapInArrow(run, StructType(df.schema.fields))


def replace_columns(df: DataFrame, fn, ddl: str = "") -> DataFrame:
    """``df`` with columns made from the texts: ``fn`` takes a record batch and returns a dict of columns.

    Columns that df has are replaced in place, others (of types ``ddl``) are added
    behind; all else passes through as it is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    added = StructType.fromDDL(ddl).fields if ddl else []
    schema = StructType([*(f for f in df.schema.fields if f.name not in {a.name for a in added}), *added])
    types = to_arrow_schema(schema)

    def run(batches):
        for b in small(batches):
            made = fn(b)
            arrays = [pa.array(made[f.name], type=f.type) if f.name in made else b.column(f.name) for f in types]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(types, arrays, strict=True)]))

    return df.mapInArrow(run, schema)


def utf8(texts) -> list[bytes]:
    """UTF-8 of texts; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def texts_of(pdf, lo: int = 0, hi: int | None = None) -> list[bytes]:
    """UTF-8 of the texts of a batch; null is empty."""
    return utf8(pdf["text"].iloc[lo:hi])


def grouped_map(df: DataFrame, keys: list[str], fn, ddl: str, parts: int) -> DataFrame:
    """Rows dealt and sorted by long columns ``keys``; ``fn`` takes (batch, starts, ends) of whole groups.

    Groups are handed over many at a time, which spares the cost of a call for
    each; a group that spans batches is put together first.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        rest: list = []

        def whole(frame):
            k = frame[keys].to_numpy(np.int64)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            return frame, np.concatenate(([0], cut)), np.concatenate((cut, [len(frame)]))

        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[keys].to_numpy(np.int64)
            other = np.flatnonzero((k != k[-1]).any(axis=1))
            if rest and (rest[-1][keys].iloc[-1].to_numpy(np.int64) != k[-1]).any() or len(other):
                cut = int(other[-1]) + 1 if len(other) else 0
                yield from fn(*whole(pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)))
                rest = [pdf.iloc[cut:]]
            else:
                rest.append(pdf)
        if rest:
            yield from fn(*whole(pd.concat(rest, ignore_index=True)))

    return batch_map(df.repartition(parts, *keys).sortWithinPartitions(*keys), run, ddl)
