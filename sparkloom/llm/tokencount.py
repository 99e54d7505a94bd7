"""Token counts by a scan for separators in flat, unindexed token data.

A stream is one flat run of token ids, cut into blocks that know nothing of
documents. Every block is searched for the end-of-document id at once; it tells
its tokens, its separators and where the last one lies. A prefix scan over these
summaries, in two levels so that no task holds a whole stream, gives each block
the place of the last separator before it, and with it the length of the
document that its first separator ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as T
from .common import batch_map, materialize, ship
from .packing import token_path

#: Tokens of a block.
BLOCK = 1 << 16
#: Blocks of a stream that are scanned together before their own totals are.
SPAN = 1024
EOD = 50256
#: A flat file of more bytes is read in ranges, of RANGE bytes at least, by records of RECORD tokens at most.
WHOLE, RANGE, RECORD = 1 << 26, 1 << 25, 1 << 20

SUMMARY = "stream long, block long, tokens long, ends array<long>, docs array<long>"


def summarise(stream: int, block: int, ids: np.ndarray, eod: int, docs: list | None = None) -> dict:
    """One block's summary row; ends are the places just behind its separators."""
    return {"stream": [stream], "block": [block], "tokens": [len(ids)], "ends": [np.flatnonzero(ids == eod) + 1], "docs": [docs]}


def stitch(summaries: DataFrame) -> DataFrame:
    """Lengths of documents from block summaries (stream, block, tokens, ends, docs).

    Blocks of a stream are numbered in order; gaps do not matter. Returns stream, ordinal
    (of the document in its stream, from 0), start (absolute), n_tokens (without
    the separator), closed (false for tokens behind the last separator, which
    are a document only if there are any) and doc_id (null where not told).
    """
    rows = summaries.withColumn("span", F.floor(F.col("block") / SPAN))
    small = rows.select("stream", "span", "block", "tokens", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    own = Window.partitionBy("stream", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("stream", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    inner = small.withColumn("at", F.coalesce(F.sum("tokens").over(own), F.lit(0))).withColumn("nth", F.coalesce(F.sum("n").over(own), F.lit(0)))
    inner = inner.withColumn("open", F.max(F.col("at") + F.col("last")).over(own)).withColumn("closing", F.max(F.col("at") + F.col("last")).over(upto))
    spans = inner.groupBy("stream", "span").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.max("closing").alias("last"), F.max("block").alias("block"))
    over = Window.partitionBy("stream").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("span_at", F.coalesce(F.sum("tokens").over(over), F.lit(0))).withColumn("span_nth", F.coalesce(F.sum("n").over(over), F.lit(0)))
    spans = spans.withColumn("span_open", F.coalesce(F.max(F.col("span_at") + F.col("last")).over(over), F.lit(0)))
    carry = inner.join(spans.select("stream", "span", "span_at", "span_nth", "span_open"), ["stream", "span"])
    carry = carry.select("stream", "block", (F.col("span_at") + F.col("at")).alias("at"), (F.col("span_nth") + F.col("nth")).alias("nth"), F.coalesce(F.col("span_at") + F.col("open"), F.col("span_open")).alias("open"))
    full = rows.where(F.size("ends") > 0).select("stream", "block", "ends", "docs").join(carry, ["stream", "block"])
    full = full.select("stream", "at", "nth", "open", "ends", "docs", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("at") + F.try_element_at("ends", F.col("k")))
    closed = full.select("stream", (F.col("nth") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("end") - start - 1).alias("n_tokens"), F.lit(True).alias("closed"), F.try_element_at("docs", F.col("k") + 1).alias("doc_id"))
    whole = spans.groupBy("stream").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.max(F.coalesce(F.col("span_at") + F.col("last"), F.lit(0))).alias("end"))
    tail = whole.where("tokens > end").select("stream", F.col("n").alias("ordinal"), F.col("end").alias("start"), (F.col("tokens") - F.col("end")).alias("n_tokens"), F.lit(False).alias("closed"), F.lit(None).cast("long").alias("doc_id"))
    return closed.unionByName(tail)


def _cells(tokens: int, dtype: str, eod: int, block: int, stream: int):
    """Blocks of a run of records (index, bytes) of ``tokens`` tokens each, cut where ``block`` divides the place in the file.

    Numbers grow along the file: of a block that two runs share, each has its own.
    """

    def run(records) -> Iterator[tuple]:
        waiting, held, at = [], 0, None

        def finish(size: int):
            nonlocal waiting, held, at
            ids = np.concatenate(waiting)
            row = (stream, 2 * (at // block) + (at % block > 0), size, (np.flatnonzero(ids[:size] == eod) + 1).tolist(), None)
            waiting, held, at = [ids[size:]], len(ids) - size, at + size
            return row

        for index, data in records:
            at = index * tokens if at is None else at
            waiting.append(np.frombuffer(bytes(data), np.dtype(dtype)))
            held += tokens
            while held >= block - at % block:
                yield finish(block - at % block)
        if held:
            yield finish(held)

    return run


def _ranges(spark: SparkSession, path: str, length: int, stream: int, dtype: str, eod: int, block: int) -> DataFrame:
    """Block summaries of one file, read by Spark in ranges of whole records; the largest divisor of its tokens is a record."""
    ship(spark)
    width = np.dtype(dtype).itemsize
    tokens = length // width
    record = max(d for k in range(1, min(math.isqrt(tokens), RECORD) + 1) if tokens % k == 0 for d in (k, tokens // k) if d <= RECORD)
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record * width), "mapreduce.input.fileinputformat.split.minsize": str(max(RANGE, (block + record) * width))}
    name = re.sub(r"[\\,*?\[\]{}]", lambda m: r"{\,}" if m[0] == "," else f"\\{m[0]}", path)  # Hadoop splits at bare commas
    records = spark.sparkContext.newAPIHadoopFile(name, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    return spark.createDataFrame(records.mapPartitions(_cells(record, dtype, eod, block, stream)), SUMMARY, verifySchema=False)


def scan_files(spark: SparkSession, path: str, dtype: str = "<u4", eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """Documents of flat token files (one stream each, a name's hash), of any size.

    Files of up to WHOLE bytes are read whole, larger ones in ranges. Bytes behind
    the last whole token of a file are an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for stream, data in zip(pdf["stream"], pdf["content"], strict=True):
                ids = np.frombuffer(data, np.dtype(dtype))
                for b in range(0, len(ids), block):
                    yield summarise(stream, b // block, ids[b : b + block], eod)

    files = spark.read.format("binaryFile").load(path)
    named = F.xxhash64("path").alias("stream")
    large = files.where(F.col("length") > WHOLE).select("path", "length", named).collect()  # names only
    if odd := [f["path"] for f in large if f["length"] % np.dtype(dtype).itemsize]:
        raise ValueError(f"bytes behind the last whole token: {odd[0]}")
    summaries = batch_map(files.where(F.col("length") <= WHOLE).select(named, "content"), run, SUMMARY)
    for f in large:
        summaries = summaries.unionByName(_ranges(spark, f["path"], f["length"], f["stream"], dtype, eod, block))
    return stitch(materialize(summaries))


def _streams(path: str, eod: int, block: int):
    """Each task's documents as one stream of ids, cut into blocks and scanned as they fill."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        from pyspark import TaskContext

        from .bpe import Encoder

        stream, number = TaskContext.get().partitionId(), 0
        encoder = Encoder(path)
        waiting, held = [], 0
        names: list = []  # documents whose separator is not in a finished block yet

        def finish(size: int):
            nonlocal number, waiting, held
            ids = np.concatenate(waiting)
            out = summarise(stream, number, ids[:size], eod)
            found = len(out["ends"][0])
            out["docs"] = [names[:found]]
            del names[:found]
            number += 1
            waiting, held = [ids[size:]], len(ids) - size
            return out

        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            docs = pdf["doc_id"].to_list()
            for lo, hi in T.groups(texts, 1 << 20):
                ids, at = encoder.encode(texts[lo:hi])
                flat = np.insert(ids, at[1:], eod)
                names += docs[lo:hi]
                waiting.append(flat)
                held += len(flat)
                while held >= block:
                    yield finish(block)
        if held:
            yield finish(held)

    return run


def count_tokens(docs: DataFrame, path: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """Token counts of documents (doc_id, text) by laying them end to end and scanning for ends.

    Null and empty texts count 0 tokens; special strings in a text are ordinary
    text, so only ends are separators. Repeated rows count each; null doc_ids
    stay null; other columns are ignored; an empty table gives no rows.
    Returns doc_id, n_tokens, stream, ordinal, start.
    """
    blocks = materialize(batch_map(docs.select("doc_id", "text"), _streams(path, eod, block), SUMMARY))
    return stitch(blocks).select("doc_id", "n_tokens", "stream", "ordinal", "start")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_path())
