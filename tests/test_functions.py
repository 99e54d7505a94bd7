"""Facts of functions, text search, partitioning and changes of tables on small literal rows."""

import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.fts import analyzer
from sparkloom.fts.index import Index
from sparkloom.functions import compat, json, text_search
from sparkloom.operators import relational as rel
from sparkloom.store import dml
from sparkloom.store.partition import MAXVALUE, Partitioning, read, write
from sparkloom.streaming import events


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_compat_functions(spark):
    s = F.lit
    r = one(spark, compat.lpad_tail(s("abcdef"), 3, "x"), compat.lpad_tail(s("ab"), 4, "xyz"), compat.int_div(s(-7), s(2)), compat.int_pow(s(2), s(3)), compat.int_pow(s(2), s(-1)), compat.int_sqrt(s(25)), compat.trim_all(s(" \t x\n")), compat.byte_length(s("né")), compat.substr_clamped(s("hello"), 0, 3), compat.substr_clamped(s("hello"), 2, -1), compat.fnv1a32(s("abc")), compat.fnv1a32(s("")), compat.compat_not(s(None).cast("boolean")))
    assert tuple(r) == ("def", "yzab", -3, 8, 1, 5, "x", 3, "hel", "", 440920331, 2166136261, True)


def test_frames_and_ntile(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "id int, value int")
    w = Window.orderBy("id")
    assert [r[0] for r in df.select(F.sum("value").over(w.rowsBetween(-1, 1))).collect()] == [30, 60, 90, 120, 90]
    assert [r[0] for r in df.select(F.avg("value").over(w.rowsBetween(-2, 0))).collect()] == [10, 15, 20, 30, 40]
    six = spark.range(6).withColumn("g", F.lit(1))
    assert [r[0] for r in six.select(compat.ntile_spread(4, Window.partitionBy("g").orderBy("id"), ["g"])).collect()] == [1, 1, 2, 3, 3, 4]


def test_json(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c": 2}]}, "d": null, "e": "x"}',), (None,), ("[1, 2]",)], "j string")
    got = df.select(json.get(F.col("j"), "a", "b"), json.get_text(F.col("j"), "e"), json.has_key(F.col("j"), "a"), json.contains(F.col("j"), F.lit('{"a": {}}')), json.is_valid(F.col("j"))).collect()
    assert tuple(got[0]) == ('[1,{"c":2}]', "x", True, True, True)
    assert tuple(got[1]) == (None, None, None, None, None) and tuple(got[2])[2:] == (False, False, True)
    assert json.holds([1, 2, "a"], [2]) and not json.holds([True], [1]) and not json.holds({"a": 1}, {"a": 1, "b": 2})


def test_text_search(spark):
    docs = ["The quick brown fox jumps", "A lazy dog sleeps", "Cats and dogs are friends", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    assert [r["id"] for r in df.where(text_search.match(F.col("t"), F.lit("fox"))).collect()] == [0]
    assert [r["id"] for r in df.where(text_search.match(F.col("t"), F.lit("dogs & the"))).collect()] == [1, 2]
    r = one(spark, text_search.to_tsvector(F.lit("Running the runners run")), text_search.to_tsquery(F.lit("running & ! the cat")), text_search.to_tsquery(F.lit("running cats"), True), text_search.rank(F.lit("a fox fox dog"), F.lit("fox")), text_search.headline(F.lit("one two fox"), F.lit("fox")), text_search.normalize_text(F.lit("  A  B\n")))
    assert tuple(r) == ("'run':4 'runn':1 'runner':3", "'runn' & ! 'cat'", "'runn' & 'cat'", 2 / 3, "one two <b>fox</b>", "a b")


def test_headline_takes_only_stretches_apart(spark):
    shown = lambda t, q: one(spark, text_search.headline(F.lit(t), F.lit(q)))[0]
    assert shown("a b\n c d e f  Fox-es, g h i j k l m fox n", "foxes") == "...b c d e f <b>Fox-es,</b> g h i j... ... ...i j k l m <b>fox</b> n"
    assert shown("fox fox fox fox end", "fox") == " ... ".join(["<b>fox</b> <b>fox</b> <b>fox</b> <b>fox</b> end"] * 3)
    assert shown("\u212aiss k\u0130sses kissed less lesss", "kiss less") == " ... ".join(["<b>\u212aiss</b> <b>k\u0130sses</b> <b>kissed</b> <b>less</b> lesss"] * 3)
    assert shown(" \n", "fox") == "" and shown("one two", "") == "one two..." and shown("one two", "- \u00e9") == "one two..." and shown(None, "fox") is None
    long = spark.range(1).select(F.concat(F.repeat(F.lit("dull \U0001f600 words "), 200_000), F.lit("fox")).alias("t")).select(text_search.headline(F.col("t"), F.lit("fox")))
    assert long.first()[0] == "...\U0001f600 words dull \U0001f600 words <b>fox</b>"
    # Words of the text itself are not made an array; the query's are.
    text = spark.createDataFrame([("a", "b")], "t string, q string").select(text_search.headline(F.col("t"), F.col("q")))
    assert not re.search(r"split\(trim\(regexp_replace\((?!lower)", text._jdf.queryExecution().optimizedPlan().toString())


def test_vector_of_a_long_text(spark):
    """Work grows with the words, not with words times stems."""
    vector = lambda t: one(spark, text_search.to_tsvector(F.lit(t)))[0]
    assert vector("Does \u2014 the pious x ness runs, RUN-NING lessing less kisses able") == "'able':12 'doe':1 'kiss':11 'less':9,10 'ness':6 'piou':4 'run':7 'runn':8"
    assert vector("the a \n") == vector("") == "" and vector(None) is None
    n = 30_000
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("W"), (i % (n // 2)).cast("string"))), " ").alias("t"))
    began = time.perf_counter()
    got = long.select(text_search.to_tsvector("t")).first()[0].split(" ")
    assert time.perf_counter() - began < 20
    assert got == [f"'w{i}':{i + 1},{i + 1 + n // 2}" for i in sorted(range(n // 2), key=str)]


def test_porter_and_queries():
    assert [analyzer.porter(w) for w in ("caresses", "ponies", "cats", "hopping", "agreed", "relational", "happy", "fox")] == ["caress", "poni", "cat", "hop", "agre", "relat", "happi", "fox"]
    assert analyzer.analyze("The quick fox, a dog!") == [("quick", 1), ("fox", 2), ("dog", 3)]
    parts = analyzer.parse_query('"quick fox" +dog -cat pre* fuz~ word')
    assert [(t.required, t.excluded, t.prefix, t.fuzzy, bool(t.phrase)) for t in parts] == [(True, False, False, False, True), (True, False, False, False, False), (False, True, False, False, False), (False, False, True, False, False), (False, False, False, True, False), (False, False, False, False, False)]
    assert analyzer.highlight("one two quick three four five", "quick", 1) == ["...two quick three..."]


def test_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "the lazy dog"), (3, "quick quick quick fox"), (4, None)], "id bigint, t string")
    ix = Index.build(df, "id", "t")
    ids = lambda q: sorted(r["doc_id"] for r in ix.retrieve(q).collect())
    assert ids("quick") == [1, 3] and ids('"quick fox"') == [3] and ids("+fox -brown") == [3] and ids("qui*") == [1, 3] and ids("dogg~ ") == [2] and ids("elephant") == []
    scores = {r["doc_id"]: r["score"] for r in ix.search("lazy").collect()}
    assert list(scores) == [2] and scores[2] == pytest.approx(0.8472978 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.25)), rel=1e-6)
    ix.save(str(tmp_path))
    again = Index.load(spark, str(tmp_path)).remove(spark.createDataFrame([(3,)], "doc_id bigint"))
    assert [r["doc_id"] for r in again.retrieve("quick").collect()] == [1] and again.stats().first()["docs"] == 3


def test_partitioning(spark, tmp_path):
    r = Partitioning("range", "y", bounds=[("a", 10), ("b", 20), ("c", MAXVALUE)])
    df = spark.createDataFrame([(5,), (10,), (25,), (None,)], "y int")
    assert [x[0] for x in df.select(r.route()).collect()] == ["a", "b", "c", None]
    assert r.prune("=", 10) == ["b"] and r.prune("<", 10) == ["a"] and r.prune("in", [1, 30]) == ["a", "c"]
    write(df, r, str(tmp_path / "r"))
    assert [x[0] for x in read(spark, str(tmp_path / "r"), r, ">", 10).collect()] == [25]
    h = Partitioning("hash", "s", buckets=4)
    names = spark.createDataFrame([("abc",), ("né",)], "s string")
    assert [x[0] for x in names.select(h.route()).collect()] == [h.prune("=", "abc")[0], h.prune("=", "né")[0]]
    for bad in (Partitioning("range", "y", bounds=[("a", 2), ("b", 1)]), Partitioning("range", "y", bounds=[("a", None), ("b", 1)]), Partitioning("list", "y", lists=[("a", [1]), ("b", [1])]), Partitioning("hash", "y", buckets=0)):
        with pytest.raises(ValueError):
            bad.validate()


def test_changes_with_ties_and_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 3), (None, "m", 4)], "k int, v string, o int")
    got = dml.upsert(t, s, ["k"], {"v": F.col("excluded.v")}, ["o"]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x"), (2, "b"), (3, "z"), (None, "m"), (None, "n")]
    got = dml.update_from(t, s, F.col("t.k") == F.col("s.k"), {"v": F.col("s.v")}, ["k"], [F.col("s.o")]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "y"), (2, "b"), (None, "n")]
    assert sorted(tuple(r) for r in dml.delete(t, F.col("k") > 1).select("v").collect()) == [("a",), ("n",)]
    m = dml.merge(t, s, [("k", "k")], [dml.When(True, "nothing", condition=F.col("s.o") == 1), dml.When(True, "delete"), dml.When(False, "insert", {"k": F.col("s.k"), "v": F.lit("new")})], ["o"])
    assert sorted(map(tuple, m.collect()), key=str) == [(1, "a"), (2, "b"), (3, "new"), (None, "n"), (None, "new")]
    assert dml.unique_violations(t.unionAll(t), ["k"]).count() == 2


def test_sets_and_recursion(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,), (2,)], "x int"), spark.createDataFrame([(1,), (None,)], "x int")
    assert sorted(map(tuple, rel.intersect_all_set(a, b).collect()), key=str) == [(1,), (1,), (None,)]
    assert [tuple(r) for r in rel.except_all_set(a, b).collect()] == [(2,)]
    got = rel.recursive_union(spark.range(1).select(F.lit(1).alias("n")), lambda new: new.select((F.col("n") * 2 % 7).alias("n")))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 4]
    with pytest.raises(RuntimeError):
        rel.recursive_union(spark.range(1).select(F.lit(1).alias("n")), lambda new: new.select((F.col("n") + 1).alias("n")), limit=3)


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), batch.schema, 10)
    events.run_once(events.windowed(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.windowed(batch).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) * 0.5
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()
