"""Inverted index: build, boolean and phrase retrieval, BM25 ranking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.shipping import ship

from .analyzer import Term, analyzed, parse_query

K1, B = 1.2, 0.75


@dataclass
class Index:
    """postings(term, doc_id, tf, positions) and docs(doc_id, len)."""

    postings: DataFrame
    docs: DataFrame

    @classmethod
    def build(cls, df: DataFrame, key: str, *columns: str) -> Index:
        ship(df.sparkSession)
        text = F.concat_ws(" ", *columns)
        words = df.select(F.col(key).alias("doc_id"), analyzed(text).alias("w"))
        postings = words.select("doc_id", F.explode("w").alias("w")).groupBy(F.col("w.term").alias("term"), "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("w.pos")).alias("positions"))
        return cls(postings, words.select("doc_id", F.size("w").alias("len")))

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"))

    def remove(self, ids: DataFrame) -> Index:
        """Without the documents of ``ids`` (doc_id)."""
        return Index(self.postings.join(ids, "doc_id", "left_anti"), self.docs.join(ids, "doc_id", "left_anti"))

    def stats(self) -> DataFrame:
        a = self.docs.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
        return a.crossJoin(self.postings.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings")))

    def matching(self, t: Term) -> DataFrame:
        """Documents (doc_id) that one part of a query finds."""
        p = self.postings
        if t.phrase:
            return self.phrase(t.phrase)
        if t.prefix:
            p = p.where(F.col("term").startswith(t.term))
        elif t.fuzzy:
            p = p.where(F.levenshtein("term", F.lit(t.term), 2) >= 0)
        else:
            p = p.where(F.col("term") == t.term)
        return p.select("doc_id").distinct()

    def phrase(self, terms: tuple[tuple[str, int], ...]) -> DataFrame:
        """Documents with the terms at these distances from the first."""
        hits = self.postings.where(F.col("term").isin([t for t, _ in terms])).select("doc_id", "term", F.explode("positions").alias("p"))
        steps = reduce(lambda a, b: a.unionByName(b), [hits.where(F.col("term") == t).select("doc_id", (F.col("p") - d).alias("at"), F.lit(i).alias("i")) for i, (t, d) in enumerate(terms)])
        return steps.groupBy("doc_id", "at").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(terms)).select("doc_id").distinct()

    def retrieve(self, query: str) -> DataFrame:
        """Documents by the query: all required parts; any optional one if none is required; no excluded one."""
        parts = parse_query(query)
        need, may, no = ([t for t in parts if f(t)] for f in (lambda t: t.required, lambda t: not t.required and not t.excluded, lambda t: t.excluded))
        if need:
            out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), map(self.matching, need))
        elif may:
            out = reduce(lambda a, b: a.unionByName(b), map(self.matching, may)).distinct()
        else:
            return self.docs.select("doc_id").limit(0)
        return reduce(lambda a, b: a.join(b, "doc_id", "left_anti"), map(self.matching, no), out)

    def search(self, query: str) -> DataFrame:
        """(doc_id, score) of the documents found; prefix, fuzzy and phrase parts add nothing to a score."""
        terms = [t.term for t in parse_query(query) if not (t.excluded or t.prefix or t.fuzzy or t.phrase)]
        weights = self.postings.where(F.col("term").isin(terms)) if terms else self.postings.limit(0)
        df_ = weights.groupBy("term").agg(F.count("*").alias("df"))
        whole = self.docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
        times = {t: terms.count(t) for t in terms}
        many = reduce(lambda acc, kv: F.when(F.col("term") == kv[0], F.lit(kv[1])).otherwise(acc), times.items(), F.lit(0))
        idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        found = self.retrieve(query)
        scored = weights.join(found, "doc_id", "left_semi").join(df_, "term").join(self.docs, "doc_id").crossJoin(F.broadcast(whole))
        scored = scored.groupBy("doc_id").agg(F.sum(idf * tf * many).alias("score"))
        return found.join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
