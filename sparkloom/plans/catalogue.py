"""The queries of the engine's own operators and their SQL twins.

``same`` takes SQL that both engines read (after the dialect's rewriting on our
side); ``pair`` takes a DataFrame plan and the SQL that says the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.dialect import rewrite
from sparkloom.functions import compat, json, text_search
from sparkloom.fts.index import Index
from sparkloom.operators import relational as rel
from sparkloom.session import Engine
from sparkloom.sources import tables as src
from sparkloom.store import dml, partition
from sparkloom.store.files import shared_dir
from sparkloom.store.partition import Partitioning
from sparkloom.store.shards import Shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def pair(name: str, plan: Callable[..., DataFrame], oracle: str | None) -> None:
    """``plan`` takes a function that reads a table by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(lambda t: src.table(spark, sf_dir, t))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def same(name: str, text: str, oracle: str | None = None, args: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src.views(spark, sf_dir, text)
        return rel.query(spark, rewrite(text), args)

    QUERIES[name] = run
    ORACLES[name] = oracle or text


# --- scans, projection, filters ---
same("scan_project", "SELECT o_orderkey, o_totalprice AS price, o_orderstatus FROM orders")
same("expr_project", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_custkey + 1 AS next_cust, -o_custkey AS neg FROM orders")
pair("point_lookup", lambda t: src.point_lookup(t("orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
pair("range_lookup", lambda t: src.range_lookup(t("orders"), "o_orderkey", 100, 199).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
pair("columnar_scan_predicate", lambda t: t("lineitem").where((F.col("l_quantity") >= 45) & (F.col("l_discount") < 0.02)).select("l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02")
same("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
same("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '1-URGENT'")
same("comparison_ops", "SELECT o_orderkey FROM orders WHERE o_custkey <> 5 AND o_custkey >= 10 AND o_custkey <= 400 AND o_totalprice < 200000 AND o_orderkey > 3 AND o_orderstatus != 'P'")
same("in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
pair(
    "in_list_null_compat",
    lambda t: t("customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')")).where(compat.compat_not_in(F.col("seg"), ["MACHINERY", None])).select("c_custkey", "seg"),
    "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY')",
)
same("not_in_list_null", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', 'AUTOMOBILE')")
pair("in_subquery_semi", lambda t: rel.in_subquery(t("customer"), "c_custkey", t("orders").where("o_totalprice > 400000").select("o_custkey")).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
pair(
    "not_in_subquery_anti",
    lambda t: rel.not_in_subquery(t("customer"), "c_custkey", t("orders").select(F.expr("nullif(o_custkey, 3)"))).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE nullif(o_custkey, 3) = c_custkey)",
)
same("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_custkey NOT BETWEEN 10 AND 20")
same("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r%' AND p_name NOT LIKE '%g_t'")
same("ilike", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'ECO%' AND p_name NOT ILIKE 'RED%'")
same("is_null", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS no_nation, nullif(c_nationkey, 3) IS NOT NULL AS has_nation FROM customer")
same("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
same("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' END AS size FROM orders")
pair("compat_not_null_logic", lambda t: t("customer").where(compat.compat_not(F.expr("nullif(c_nationkey, 3) = 5"))).select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) = 5, false)")
pair("arith_int_div", lambda t: t("orders").select("o_orderkey", compat.int_div(F.col("o_orderkey") - 5000, F.lit(7)).alias("q")), "SELECT o_orderkey, ((o_orderkey - 5000) // 7)::BIGINT AS q FROM orders")
same("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
same("boolean_subquery", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")
same("exists_corr", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)")
same("not_exists_corr", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
same("corr_scalar_avg", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
same("corr_in", "SELECT c_custkey FROM customer c WHERE 'F' IN (SELECT o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey)")
same("prepared_params", "SELECT o_orderkey FROM orders WHERE o_custkey = $1 OR o_orderstatus = $2 AND o_totalprice > $3", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F' AND o_totalprice > 400000", args={"p1": 7, "p2": "F", "p3": 400000})
same("cast_matrix", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS as_text, CAST('12' AS INT) AS as_int, CAST(o_custkey AS INT) AS narrowed, CAST(o_orderkey % 2 AS BOOLEAN) AS flag, CAST('2024-03-01' AS DATE) AS d FROM orders")
pair("cast_text_bool", lambda t: t("orders").select("o_orderkey", compat.to_bool(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'false' END")).alias("b")), "SELECT o_orderkey, o_orderkey % 2 = 0 AS b FROM orders")
pair("cast_ts_text", lambda t: t("orders").select("o_orderkey", compat.rfc3339(F.col("o_orderdate")).alias("s")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS s FROM orders")

# --- joins ---
same("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
same("join_theta", "SELECT a.n_name AS lo, b.n_name AS hi FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
same("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
same("join_full", "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey * 3")
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
same("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey")
same("join_derived", "SELECT c_name, x.total FROM customer JOIN (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey) x ON x.o_custkey = c_custkey")
same("join_cte", "WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000) SELECT c_name, o_orderkey FROM customer JOIN big ON c_custkey = o_custkey")
same("join_multi", "SELECT c_name, o_orderkey, l_linenumber, s_name, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_totalprice > 300000")
pair(
    "join_lateral_topk",
    lambda t: rel.top_per_key(t("customer").select(F.col("c_custkey").alias("k"), "c_name"), t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice"), "k", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select(F.col("k").alias("c_custkey"), "o_orderkey"),
    "SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x",
)
pair(
    "join_left_lateral",
    lambda t: rel.top_per_key(t("customer").select(F.col("c_custkey").alias("k")), t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", [F.asc("o_orderkey")], 1, "left").select(F.col("k").alias("c_custkey"), "o_orderkey"),
    "SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1) x ON true",
)
same("join_lateral_agg", "SELECT c_custkey, x.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) x")

# --- aggregation ---
same("agg_global", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_open, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderpriority) AS hi FROM orders")
same("agg_empty", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
same("agg_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority")
same(
    "groupby_having",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
)
pair("agg_avg_trunc", lambda t: t("orders").groupBy("o_orderstatus").agg(compat.avg_trunc("o_custkey").alias("a")), "SELECT o_orderstatus, (sum(o_custkey) // count(o_custkey))::BIGINT AS a FROM orders GROUP BY o_orderstatus")
same("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
same("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
same("agg_expression_group", "SELECT o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_custkey % 10")
same("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_custkey) AS lo FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
same("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
same("grouping_fn", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same("grouping_mixed", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP (o_orderpriority)")
same("grouping_having", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING count(*) > 500")
same("agg_over_cte", "WITH x AS (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_custkey < 500) SELECT s, count(*) AS n, round(avg(p), 4) AS a FROM x GROUP BY s")
same("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
same("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# --- windows ---
_W = "PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey"
for _name, _expr in {
    "row_number": f"row_number() OVER ({_W})",
    "rank": "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey)",
    "dense_rank": "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey)",
    "ntile": f"ntile(4) OVER ({_W})",
    "lag": f"lag(o_orderkey) OVER ({_W})",
    "lag_default": f"lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_W})",
    "lead": f"lead(o_orderkey, 1) OVER ({_W})",
    "first": f"first_value(o_orderkey) OVER ({_W})",
    "last": f"last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "last_running": f"last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "nth": f"nth_value(o_orderkey, 2) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sum_frame": f"CAST(sum(o_orderkey) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT)",
    "count_frame": f"count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "avg_frame": f"round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)",
    "min_frame": f"min(o_totalprice) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)",
    "max_frame": f"max(o_totalprice) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)",
    "running_default": f"CAST(sum(o_orderkey) OVER ({_W}) AS BIGINT)",
    "partition_total": "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT)",
}.items():
    same(f"win_{_name}", f"SELECT o_orderkey, {_expr} AS w FROM orders")
pair(
    "win_ntile_compat",
    lambda t: t("orders").select("o_orderkey", compat.ntile_spread(4, Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), ["o_custkey"]).alias("w")),
    f"SELECT o_orderkey, ((row_number() OVER ({_W}) - 1) * 4 // count(*) OVER (PARTITION BY o_custkey) + 1)::BIGINT AS w FROM orders",
)
same("win_over_group", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey")

# --- sort, limit, set operations ---
# The places of all rows, past the border between NULL and the rest.
same("order_nulls_place", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F'), o_orderkey) AS place FROM orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') NULLS LAST, o_orderkey) AS place FROM orders")
same("order_nulls_desc_place", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey) AS place FROM orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey) AS place FROM orders")
same("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
pair("limit_subquery", lambda t: rel.limit_subquery(t("orders").select("o_orderkey").orderBy("o_orderkey"), t("region").agg(F.count("*"))), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM region)")
same("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
same("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
same("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
same("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
same("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
same("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
pair("intersect_all_compat", lambda t: rel.intersect_all_set(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").where("s_suppkey < 10").select("s_nationkey")), "SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 10)")
pair("except_all_compat", lambda t: rel.except_all_set(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").where("s_suppkey < 10").select("s_nationkey")), "SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 10)")
same("setop_order_limit", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k LIMIT 5 OFFSET 2")
same("setop_chain", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_regionkey FROM nation")
same("setop_with", "WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000) SELECT k FROM a UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")

# --- common table expressions, views ---
same("cte_multi", "WITH a(k, p) AS (SELECT o_custkey, o_totalprice FROM orders), b AS (SELECT k, max(p) AS top FROM a GROUP BY k) SELECT k, top FROM b WHERE top > 300000")
same("cte_setop", "WITH u AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) SELECT count(*) AS n FROM u")
same("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")
pair(
    "cte_recursive_union",
    lambda t: rel.recursive_union(
        t("nation").where("n_nationkey = 7").select(F.col("n_nationkey").alias("k")),
        lambda new: new.join(t("nation"), F.col("k") == F.col("n_regionkey")).select((F.col("n_nationkey") % 11).alias("k")),
    ).select(F.col("k").cast("int").alias("k")),
    "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 7 UNION SELECT n_nationkey % 11 FROM r JOIN nation ON k = n_regionkey) SELECT k FROM r",
)


def _view(t) -> DataFrame:
    t("orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey").createOrReplaceTempView("big_orders_view")
    return t("orders").sparkSession.sql("SELECT o_custkey, count(*) AS n FROM big_orders_view GROUP BY o_custkey")


pair("view_query", _view, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey")

# --- scalar functions ---
same("fn_string_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, reverse(p_name) AS r, replace(p_name, 'red', 'blue') AS rep FROM part")
pair("fn_length_bytes", lambda t: t("documents").select("doc_id", compat.byte_length(F.col("text")).alias("b"), F.length("text").cast("long").alias("c")), "SELECT doc_id, strlen(text)::BIGINT AS b, length(text)::BIGINT AS c FROM documents")
pair("fn_concat_skip", lambda t: t("part").select("p_partkey", compat.concat_skip(F.col("p_name"), F.expr("nullif(p_type, 'ECONOMY')"), F.lit("!")).alias("s")), "SELECT p_partkey, concat(p_name, nullif(p_type, 'ECONOMY'), '!') AS s FROM part")
pair("fn_substr", lambda t: t("part").select("p_partkey", compat.substr_clamped(F.col("p_name"), 0, 3).alias("a"), compat.substr_clamped(F.col("p_name"), 2, 4).alias("b"), compat.substr_clamped(F.col("p_name"), 50, 2).alias("c")), "SELECT p_partkey, substr(p_name, 1, 3) AS a, substr(p_name, 2, 4) AS b, substr(p_name, 50, 2) AS c FROM part")
same("fn_trim", "SELECT p_partkey, trim(concat('  ', p_name, ' ')) AS t, ltrim(concat('  ', p_name)) AS l, rtrim(concat(p_name, '  ')) AS r FROM part")
same("fn_position", "SELECT p_partkey, CAST(position('e' IN p_name) AS INT) AS p FROM part")
same("fn_repeat", "SELECT p_partkey, repeat(p_brand, 2) AS r FROM part")
pair("fn_lpad_compat", lambda t: t("part").select("p_partkey", compat.lpad_tail(F.col("p_name"), 9, "xyz").alias("s")), "SELECT p_partkey, right(concat(repeat('xyz', ceil(greatest(9 - length(p_name), 0) / 3)::INT), p_name), 9) AS s FROM part")
same("fn_pad", "SELECT p_partkey, lpad(p_name, 12, '*') AS l, rpad(p_name, 12, 'ab') AS r FROM part")
same("fn_conditional", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, nullif(c_nationkey, 4) AS n FROM customer")
same("fn_math", "SELECT o_orderkey, abs(o_custkey - 500) AS a, o_custkey % 7 AS m, round(o_totalprice, 1) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c FROM orders")
pair("fn_math_int", lambda t: t("part").select("p_partkey", compat.int_pow(F.col("p_size"), F.lit(2)).alias("sq"), compat.int_sqrt(F.col("p_partkey")).alias("root")), "SELECT p_partkey, (p_size * p_size)::BIGINT AS sq, floor(sqrt(p_partkey))::BIGINT AS root FROM part")
same("fn_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d FROM orders")
same("fn_time_parts", "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s FROM events")
same("fn_extract", "SELECT event_id, CAST(EXTRACT(YEAR FROM ts) AS INT) AS y, CAST(EXTRACT(SECOND FROM ts) AS INT) AS s FROM events")
same("fn_date_add", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS m, DATE_SUB(o_orderdate, INTERVAL 3 DAY) AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 3 DAY AS d FROM orders")
pair("fn_now", lambda t: t("region").select("r_regionkey", (F.current_timestamp() >= F.lit("2024-01-01").cast("timestamp")).alias("later"), (F.date_trunc("day", F.current_timestamp()) <= F.current_timestamp()).alias("today")), "SELECT r_regionkey, true AS later, true AS today FROM region")

# --- JSON ---
same("json_get_text", "SELECT event_id, props->>'k' AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
same("json_get", "SELECT event_id, props->'k' AS k FROM events WHERE props->>'k' = '7'", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events WHERE json_extract_string(props, '$.k') = '7'")
same("json_path", "SELECT event_id, concat('{\"a\": ', props, '}') #>> '{a,k}' AS k FROM events", "SELECT event_id, json_extract_string(concat('{\"a\": ', props, '}'), '$.a.k') AS k FROM events")
pair("json_has_key", lambda t: t("events").select("event_id", json.has_key(F.col("props"), "k").alias("h"), json.has_key(F.col("props"), "x").alias("n")), "SELECT event_id, list_contains(json_keys(props), 'k') AS h, list_contains(json_keys(props), 'x') AS n FROM events")
pair("json_any_all", lambda t: t("events").select("event_id", json.has_any(F.col("props"), ["x", "k"]).alias("some"), json.has_all(F.col("props"), ["x", "k"]).alias("every")), "SELECT event_id, list_has_any(json_keys(props), ['x', 'k']) AS some, list_has_all(json_keys(props), ['x', 'k']) AS every FROM events")
pair("json_contains", lambda t: t("events").where(json.contains("props", '{"k": 7}')).select("event_id"), "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
pair("json_valid", lambda t: t("events").select("event_id", json.is_valid(F.concat("props", F.expr("CASE WHEN event_id % 2 = 0 THEN '' ELSE '}' END"))).alias("v")), "SELECT event_id, event_id % 2 = 0 AS v FROM events")


# --- text search ---
def _stem_sql(w: str) -> str:
    out = f"CASE WHEN length({w}) > 3 AND right({w}, 1) = 's' AND right({w}, 2) <> 'ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
    for s in reversed(text_search.SUFFIXES):
        n = len(s)
        out = f"CASE WHEN length({w}) > {n + 2} AND right({w}, {n}) = '{s}' THEN left({w}, length({w}) - {n}) ELSE {out} END"
    return out


def _stems_sql(text: str) -> str:
    words = f"list_transform(string_split_regex(trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g'))"
    return f"list_transform(list_filter({words}, lambda w: length(w) > 1), lambda w: {_stem_sql('w')})"


pair("fts_match", lambda t: t("part").where(text_search.match(F.col("p_name"), F.lit("red rings"))).select("p_partkey", "p_name"), f"SELECT p_partkey, p_name FROM part WHERE list_has_any({_stems_sql('p_name')}, ['red', 'ring', 'r'])")
pair("fts_match_docs", lambda t: t("documents").where(text_search.match(F.col("text"), F.lit("whether herself"))).select("doc_id"), f"SELECT doc_id FROM documents WHERE list_has_any({_stems_sql('text')}, ['wheth', 'herself'])")
pair(
    "fts_rank",
    lambda t: t("documents").select("doc_id", F.round(text_search.rank(F.col("text"), F.lit("oner eating")), 8).alias("r")),
    f"SELECT doc_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE round((len(list_filter(s, lambda x: x = 'oner')) + len(list_filter(s, lambda x: x = 'eat'))) / len(s)::DOUBLE, 8) END AS r FROM (SELECT doc_id, {_stems_sql('text')} AS s FROM documents)",
)
_WORDS = "list_transform(string_split_regex(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in text_search.STOP_WORDS) + ")"
# Part names are small beside the work on them, so their files make fewer tasks than there are cores; rows are dealt out first.
pair(
    "fts_tsvector",
    lambda t: t("part").select("p_partkey", "p_name").repartition("p_partkey").select("p_partkey", text_search.to_tsvector(F.concat_ws(" ", "p_name", F.lit("of the"), "p_name")).alias("v")),
    f"WITH w AS (SELECT p_partkey, {_WORDS.format("p_name || ' of the ' || p_name")} AS ws FROM part), u AS (SELECT p_partkey, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w), s AS (SELECT p_partkey, {_stem_sql('w')} AS s, i FROM u WHERE length(w) > 1 AND w NOT IN {_STOP}), g AS (SELECT p_partkey, s, string_agg(i::VARCHAR, ',' ORDER BY i) AS p FROM s GROUP BY ALL) SELECT p_partkey, string_agg('''' || s || ''':' || p, ' ' ORDER BY s) AS v FROM g GROUP BY p_partkey",
)
_QUOTED = f"'''' || {_stem_sql('w')} || ''''"
pair(
    "fts_tsquery",
    lambda t: t("part").select("p_partkey", text_search.to_tsquery(F.concat(F.lit("the | "), F.concat_ws(" & ", F.split("p_name", " ")))).alias("q"), text_search.to_tsquery(F.concat(F.lit("The "), "p_name"), True).alias("plain")),
    f"SELECT p_partkey, '| ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_QUOTED}), ' & ') AS q, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_QUOTED}), ' & ') AS plain FROM part",
)
_HIT = f"list_transform({_WORDS.format("array_to_string(ws, ' ')")}, lambda w: {_stem_sql('w')} IN ('the', 'oner'))"
pair(
    "fts_headline",
    lambda t: t("documents").select("doc_id", text_search.headline(F.col("text"), F.lit("the oner")).alias("h")),
    f"WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents), h AS (SELECT doc_id, ws, len(ws) AS n, {_HIT} AS hit FROM w), p AS (SELECT *, list_filter(range(1, n + 1), lambda i: hit[i])[1:3] AS places FROM h) "
    "SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN len(places) = 0 THEN array_to_string(ws[1:10], ' ') || '...' ELSE array_to_string(list_transform(places, lambda i: CASE WHEN i > 6 THEN '...' ELSE '' END || array_to_string(list_transform(range(greatest(i - 5, 1), least(i + 4, n) + 1), lambda j: CASE WHEN hit[j] THEN '<b>' || ws[j] || '</b>' ELSE ws[j] END), ' ') || CASE WHEN i + 4 < n THEN '...' ELSE '' END), ' ... ') END AS h FROM p",
)
pair("fts_normalize", lambda t: t("documents").select("doc_id", F.md5(text_search.normalize_text(F.col("text"))).alias("m")), "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS m FROM documents")


def _index(t) -> Index:
    return Index.build(t("part"), "p_partkey", "p_name")


pair("fts_boolean", lambda t: _index(t).retrieve("+red -widget"), "SELECT p_partkey AS doc_id FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND NOT list_contains(string_split(p_name, ' '), 'widget')")
pair("fts_prefix", lambda t: _index(t).retrieve("wid*"), "SELECT p_partkey AS doc_id FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: w LIKE 'wid%')) > 0")
pair("fts_fuzzy", lambda t: _index(t).retrieve("rad~"), "SELECT p_partkey AS doc_id FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: levenshtein(w, 'rad') <= 2)) > 0")
pair("fts_phrase", lambda t: _index(t).retrieve('"red widget"'), "SELECT p_partkey AS doc_id FROM part WHERE p_name LIKE 'red widget%' OR p_name LIKE '% red widget%'")
#: No two words of part names have one stem, so words stand for stems.
_POSTINGS = "WITH u AS (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS w FROM part), p AS (SELECT doc_id, w, count(*) AS tf FROM u GROUP BY ALL), d AS (SELECT doc_id, count(*) AS len FROM u GROUP BY doc_id), a AS (SELECT count(*) AS n, avg(len) AS avg_len FROM d)"
pair(
    "fts_bm25",
    lambda t: _index(t).search("small ring").select("doc_id", F.round("score", 8).alias("score")),
    _POSTINGS + ", f AS (SELECT w, count(*) AS df FROM p WHERE w IN ('small', 'ring') GROUP BY w) SELECT doc_id, round(sum(greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 8) AS score FROM p JOIN f USING (w) JOIN d USING (doc_id) CROSS JOIN a GROUP BY doc_id",
)
pair("fts_stats", lambda t: _index(t).stats().select("docs", "terms", "postings", F.round("avg_len", 8).alias("avg_len")), _POSTINGS + " SELECT n AS docs, (SELECT count(DISTINCT w) FROM p) AS terms, (SELECT count(*) FROM p) AS postings, round(avg_len, 8) AS avg_len FROM a")

# --- changes of tables: the rows after the change ---
pair(
    "insert_select_defaults",
    lambda t: dml.insert(t("nation"), t("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")), {"n_regionkey": 0}),
    "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 0 FROM region",
)
pair(
    "insert_auto_increment",
    lambda t: dml.insert(t("nation"), t("region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey")), auto="n_nationkey", order=["n_regionkey"]),
    "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey))::INT, r_name, r_regionkey FROM region",
)
_NEW = "SELECT c_custkey + 700 AS c_custkey, concat('new ', c_name) AS c_name, c_nationkey, 1.5 AS c_acctbal, c_mktsegment FROM customer"
pair(
    "upsert_nothing",
    lambda t: dml.upsert(t("customer"), t("customer").selectExpr("c_custkey + 700 c_custkey", "concat('new ', c_name) c_name", "c_nationkey", "1.5D c_acctbal", "c_mktsegment"), ["c_custkey"]),
    f"SELECT * FROM customer UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)",
)
pair(
    "upsert_update",
    lambda t: dml.upsert(t("customer"), t("customer").selectExpr("c_custkey + 700 c_custkey", "concat('new ', c_name) c_name", "c_nationkey", "1.5D c_acctbal", "c_mktsegment"), ["c_custkey"], {"c_name": F.col("excluded.c_name"), "c_acctbal": F.col("t.c_acctbal") + F.col("excluded.c_acctbal")}),
    f"SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, c.c_nationkey, c.c_acctbal + coalesce(n.c_acctbal, 0)::DOUBLE AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN ({_NEW}) n ON n.c_custkey = c.c_custkey UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)",
)
pair("update_where", lambda t: dml.update(t("orders"), {"o_totalprice": F.lit(0.0)}, F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
pair(
    "update_from",
    lambda t: dml.update_from(t("orders"), t("customer"), F.col("t.o_custkey") == F.col("s.c_custkey"), {"o_orderpriority": F.col("s.c_mktsegment")}, ["o_orderkey"], [F.col("s.c_custkey")]).select("o_orderkey", "o_orderpriority"),
    "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
pair("delete_where", lambda t: dml.delete(t("orders"), F.expr("nullif(o_orderstatus, 'P') = 'F'")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
pair("delete_using", lambda t: dml.delete_using(t("orders"), t("customer").where("c_acctbal < 0"), F.col("t.o_custkey") == F.col("s.c_custkey")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
pair(
    "merge_full",
    lambda t: dml.merge(
        t("supplier").select("s_suppkey", "s_name", "s_acctbal"),
        t("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal"),
        [("s_suppkey", "c_custkey")],
        [
            dml.When(True, "delete", condition=F.col("s.c_acctbal") < 0),
            dml.When(True, "update", {"s_acctbal": F.col("t.s_acctbal") + F.col("s.c_acctbal")}),
            dml.When(False, "insert", {"s_suppkey": F.col("s.c_custkey"), "s_name": F.col("s.c_name"), "s_acctbal": F.col("s.c_acctbal")}, F.col("s.c_acctbal") > 5000),
        ],
        ["c_custkey"],
    ).withColumn("s_acctbal", F.round("s_acctbal", 4)),
    "SELECT s_suppkey, s_name, round(CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE s_acctbal + c_acctbal END, 4) AS s_acctbal FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON s_suppkey = c_custkey WHERE c_custkey IS NULL OR c_acctbal >= 0 UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 4) FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal > 5000 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
pair("truncate", lambda t: dml.delete(t("region")), "SELECT * FROM region WHERE false")
pair("check_violations", lambda t: dml.check_violations(t("customer"), F.expr("nullif(c_nationkey, 3) < 20")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) < 20, false)")
pair("not_null_violations", lambda t: dml.not_null_violations(t("customer").withColumn("n", F.expr("nullif(c_nationkey, 3)")), ["n", "c_name"]).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
pair("unique_violations", lambda t: dml.unique_violations(t("lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
pair("fk_violations", lambda t: dml.fk_violations(t("orders"), t("customer").where("c_nationkey <> 3"), [("o_custkey", "c_custkey")]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")

# --- partitioning ---
_RANGE = Partitioning("range", "o_custkey", bounds=[("p0", 100), ("p1", 500), ("p2", None)])
_LIST = Partitioning("list", "c_mktsegment", lists=[("north", ["BUILDING", "MACHINERY"]), ("south", ["HOUSEHOLD"])])
_HASH = Partitioning("hash", "c_name", buckets=4)
pair("partition_range_route", lambda t: t("orders").select("o_orderkey", _RANGE.route().alias("p")), "SELECT o_orderkey, CASE WHEN o_custkey < 100 THEN 'p0' WHEN o_custkey < 500 THEN 'p1' ELSE 'p2' END AS p FROM orders")
pair("partition_list_route", lambda t: t("customer").select("c_custkey", _LIST.route().alias("p")), "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'north' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'south' END AS p FROM customer")
pair(
    "partition_hash_route",
    lambda t: t("customer").select("c_custkey", _HASH.route().alias("p")),
    "SELECT c_custkey, concat('p', (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 4)::VARCHAR) AS p FROM customer",
)
def _kept(df: DataFrame, write: Callable[[DataFrame, str], None]) -> tuple[SparkSession, str]:
    """``df`` written to a new folder of the shared one."""
    path = f"{shared_dir(df.sparkSession)}/engine-{uuid.uuid4().hex}"
    write(df, path)
    return df.sparkSession, path


def _pruned(t) -> DataFrame:
    spark, path = _kept(t("orders").select("o_orderkey", "o_custkey"), lambda df, p: partition.write(df, _RANGE, p))
    return partition.read(spark, path, _RANGE, ">=", 500).select("o_orderkey")


pair("partition_prune", _pruned, "SELECT o_orderkey FROM orders WHERE o_custkey >= 500")
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(o_custkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_SHARDS = Shards("o_custkey", 6)
pair("shard_route", lambda t: t("orders").select("o_orderkey", _SHARDS.route().alias("shard")), f"SELECT o_orderkey, ({_FNV} * 6 // 4294967296)::INT AS shard FROM orders")
pair("shard_key_lookup", lambda t: _SHARDS.read(*_kept(t("orders"), _SHARDS.write), 77).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77")
pair("shard_scatter_gather", lambda t: _SHARDS.read(*_kept(t("orders"), _SHARDS.write)).groupBy("o_custkey").agg(F.count("*").alias("n")), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")


def _columns(t) -> DataFrame:
    frames = {n: t(n) for n in ("region", "nation")}
    return src.information_schema(frames["region"].sparkSession, frames)["columns"].select("table_name", "column_name", "ordinal_position")


pair("information_schema_columns", _columns, "SELECT * FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) AS v(table_name, column_name, ordinal_position)")

pair("json_contains_column", lambda t: t("events").where(json.contains(F.concat(F.lit('{"a": '), "props", F.lit("}")), F.concat(F.lit('{"a": '), "props", F.lit("}")))).select("event_id"), "SELECT event_id FROM events")

# --- whole numbers beyond 2**53 ---
_BIG = "SELECT o_orderkey, o_orderkey % 1000 * 600000000000001 + 9007199254740993 AS big, o_custkey % 5 AS small FROM orders"
pair(
    "whole_number_rules",
    lambda t: (
        t("orders")
        .selectExpr("o_orderkey", "o_orderkey % 1000 * 600000000000001 + 9007199254740993 AS big", "o_custkey % 5 AS small")
        .select("o_orderkey", compat.int_div(F.col("big"), F.col("small") - 7).alias("d"), compat.int_pow(F.col("small") - 2, F.lit(39)).alias("p"), compat.int_pow(F.lit(3), F.lit(39)).alias("q"), compat.int_sqrt(F.col("big")).alias("r"))
    ),
    f"SELECT o_orderkey, big // (small - 7) AS d, CASE small WHEN 0 THEN -549755813888 WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 549755813888 END AS p, 4052555153018976267 AS q, (SELECT max(x) FROM (SELECT unnest([sqrt(big)::BIGINT - 1, sqrt(big)::BIGINT, sqrt(big)::BIGINT + 1]) AS x) WHERE x::HUGEINT * x <= big) AS r FROM ({_BIG})",
)
pair("avg_trunc_big", lambda t: t("orders").selectExpr("o_custkey", "o_orderkey % 10 * 600000000000001 AS big").groupBy("o_custkey").agg(compat.avg_trunc("big").alias("a")), "SELECT o_custkey, (sum(o_orderkey % 10 * 600000000000001) // count(*))::BIGINT AS a FROM orders GROUP BY o_custkey")


# --- statements of a session, in a warehouse of their own in the shared folder ---
def engine(name: str, tables: str, statements: list[str], final: str, oracle: str, args: list | None = None) -> None:
    """``statements`` change tables of a new warehouse; ``final`` tells the result. ``tables`` can be read by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}")
        for t in tables.split():
            session.register(t, src.table(spark, sf_dir, t))
        for text in statements:
            session.sql(text)
        return session.sql(final, args)

    QUERIES[name] = run
    ORACLES[name] = oracle


_CUST = "CREATE TABLE cust (id BIGINT PRIMARY KEY, name TEXT NOT NULL, bal DOUBLE CHECK (bal > -100000), seg TEXT DEFAULT 'NONE', nation INT)"
_FILL = "INSERT INTO cust (id, name, bal, nation) SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer"
_ROWS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, 'NONE' AS seg, c_nationkey AS nation FROM customer"
engine("sql_create_insert_select", "customer", [_CUST, _FILL], "SELECT * FROM cust", _ROWS)
engine("sql_insert_values", "", ["CREATE TABLE v (id INT, name TEXT, ok BOOL, at TIMESTAMP)", "INSERT INTO v VALUES (1, 'a', true, NULL), (2, 'it''s', false, NULL), (3, NULL, NULL, NULL)"], "SELECT id, name, ok FROM v", "SELECT * FROM (VALUES (1, 'a', true), (2, 'it''s', false), (3, NULL, NULL)) AS v(id, name, ok)")
engine("sql_insert_auto_increment", "region", ["CREATE TABLE r (id INT AUTO_INCREMENT PRIMARY KEY, name TEXT)", "INSERT INTO r (id, name) VALUES (10, 'ten')", "INSERT INTO r (name) SELECT r_name FROM region ORDER BY r_regionkey"], "SELECT id, name FROM r", "SELECT 10 AS id, 'ten' AS name UNION ALL SELECT (10 + row_number() OVER (ORDER BY r_regionkey))::INT, r_name FROM region")
engine("sql_upsert_nothing", "customer", [_CUST, _FILL, "INSERT INTO cust (id, name, bal, nation) SELECT c_custkey + 700, 'again', 0, 0 FROM customer ON CONFLICT (id) DO NOTHING"], "SELECT id, name FROM cust", f"SELECT id, name FROM ({_ROWS}) UNION ALL SELECT c_custkey + 700, 'again' FROM customer WHERE c_custkey + 700 NOT IN (SELECT c_custkey FROM customer)")
engine(
    "sql_upsert_update",
    "customer",
    [_CUST, _FILL, "INSERT INTO cust (id, name, bal, nation) SELECT c_custkey + 700, 'again', 2.5, 0 FROM customer ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, bal = bal + EXCLUDED.bal"],
    "SELECT id, name, ROUND(bal, 4) AS bal FROM cust",
    "WITH n AS (SELECT c_custkey + 700 AS k FROM customer) SELECT c_custkey AS id, CASE WHEN k IS NULL THEN c_name ELSE 'again' END AS name, round(c_acctbal + CASE WHEN k IS NULL THEN 0 ELSE 2.5 END, 4) AS bal FROM customer LEFT JOIN n ON k = c_custkey UNION ALL SELECT k, 'again', 2.5 FROM n WHERE k NOT IN (SELECT c_custkey FROM customer)",
)
engine("sql_update_where", "customer", [_CUST, _FILL, "UPDATE cust SET nation = nation / 2, seg = CONCAT(seg, '-', NULL, name) WHERE id % 2 = 0"], "SELECT id, nation, seg FROM cust", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey // 2 ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'NONE-' || c_name ELSE 'NONE' END AS seg FROM customer")
engine("sql_update_subquery", "customer orders", [_CUST, _FILL, "UPDATE cust SET seg = 'BUYER' WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"], "SELECT id, seg FROM cust", "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'BUYER' ELSE 'NONE' END AS seg FROM customer")
engine("sql_update_from", "customer nation", [_CUST, _FILL, "UPDATE cust SET seg = n.n_name FROM nation n WHERE cust.nation = n.n_nationkey AND n.n_regionkey = 1"], "SELECT id, seg FROM cust", "SELECT c_custkey AS id, CASE WHEN n_regionkey = 1 THEN n_name ELSE 'NONE' END AS seg FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
engine("sql_delete_where", "customer", [_CUST, _FILL, "DELETE FROM cust WHERE bal < 0 OR id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"], "SELECT id FROM cust", "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0 AND c_nationkey <> 3")
engine("sql_delete_using", "customer nation", [_CUST, _FILL, "DELETE FROM cust USING nation n WHERE nation = n.n_nationkey AND n.n_regionkey = 2"], "SELECT id FROM cust", "SELECT c_custkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
engine(
    "sql_merge",
    "customer supplier",
    [_CUST, _FILL, "MERGE INTO cust AS t USING supplier AS s ON t.id = s.s_suppkey WHEN MATCHED AND s.s_acctbal < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET name = s.s_name, bal = t.bal + s.s_acctbal WHEN NOT MATCHED THEN INSERT (id, name, bal) VALUES (s.s_suppkey, s.s_name, 0.0)"],
    "SELECT id, name, ROUND(bal, 4) AS bal FROM cust",
    "SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, round(c_acctbal + coalesce(s_acctbal, 0), 4) AS bal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE coalesce(s_acctbal, 0) >= 0 UNION ALL SELECT s_suppkey, s_name, 0.0 FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
)
engine("sql_truncate", "customer", [_CUST, _FILL, "TRUNCATE TABLE cust", "INSERT INTO cust (id, name, bal) VALUES (1, 'one', 0.0)"], "SELECT id, name, seg FROM cust", "SELECT 1::BIGINT AS id, 'one' AS name, 'NONE' AS seg")
engine(
    "sql_alter_table",
    "customer",
    [_CUST, _FILL, "ALTER TABLE cust ADD COLUMN note TEXT DEFAULT 'new'", "ALTER TABLE cust RENAME COLUMN name TO label", "ALTER TABLE cust DROP COLUMN nation", "ALTER TABLE cust RENAME TO people", "UPDATE people SET note = label WHERE id < 10"],
    "SELECT * FROM people",
    "SELECT c_custkey AS id, c_name AS label, c_acctbal AS bal, 'NONE' AS seg, CASE WHEN c_custkey < 10 THEN c_name ELSE 'new' END AS note FROM customer",
)
engine("sql_views", "customer", [_CUST, _FILL, "CREATE VIEW rich AS SELECT id, bal FROM cust WHERE bal > 5000", "CREATE OR REPLACE VIEW richest (key, amount) AS SELECT id, bal FROM rich WHERE bal > 9000", "DELETE FROM cust WHERE id % 3 = 0"], "SELECT * FROM richest", "SELECT c_custkey AS key, c_acctbal AS amount FROM customer WHERE c_acctbal > 9000 AND c_custkey % 3 <> 0")
engine("sql_prepared", "customer", [_CUST, _FILL, "PREPARE raise AS UPDATE cust SET bal = $1 WHERE nation = $2", "EXECUTE raise(1.5, 7)", "EXECUTE raise(2.5, 8)"], "SELECT id, bal FROM cust WHERE nation IN ($1, $2)", "SELECT c_custkey AS id, (CASE c_nationkey WHEN 7 THEN 1.5 ELSE 2.5 END)::DOUBLE AS bal FROM customer WHERE c_nationkey IN (7, 8)", [7, 8])
engine("sql_transaction_commit", "customer", [_CUST, "CREATE TABLE log (id BIGINT)", "BEGIN", _FILL, "INSERT INTO log SELECT id FROM cust WHERE bal < 0", "COMMIT"], "SELECT c.id FROM cust c JOIN log l ON c.id = l.id", "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0")
engine("sql_transaction_rollback", "customer", [_CUST, _FILL, "BEGIN", "DELETE FROM cust WHERE id > 5", "UPDATE cust SET name = 'gone'", "ROLLBACK", "DELETE FROM cust WHERE id = 1"], "SELECT id, name FROM cust", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey <> 1")
engine(
    "sql_procedure_call",
    "",
    [
        "CREATE TABLE logs (id INT, message TEXT)",
        "CREATE PROCEDURE fill(IN n INT) AS $$ DECLARE i INT := 0; BEGIN WHILE i < n LOOP i := i + 1; IF i % 2 = 0 THEN INSERT INTO logs VALUES (i, concat('even ', i)); END IF; END LOOP; END; $$ LANGUAGE plpgsql",
        "CALL fill(5)",
        "CALL fill(3)",
    ],
    "SELECT id, message FROM logs",
    "SELECT * FROM (VALUES (2, 'even 2'), (4, 'even 4'), (2, 'even 2')) AS v(id, message)",
)
engine(
    "sql_trigger",
    "region",
    [
        "CREATE TABLE logs (id INT, message TEXT)",
        "CREATE TABLE r (id INT, name TEXT)",
        "CREATE FUNCTION seen() RETURNS TRIGGER AS $$ BEGIN INSERT INTO logs VALUES (new_id, concat('new ', new_name)); RETURN NEW; END; $$ LANGUAGE plpgsql",
        "CREATE TRIGGER t AFTER INSERT ON r FOR EACH ROW EXECUTE FUNCTION seen()",
        "INSERT INTO r SELECT r_regionkey, r_name FROM region",
    ],
    "SELECT id, message FROM logs",
    "SELECT r_regionkey AS id, 'new ' || r_name AS message FROM region",
)
engine("sql_match_against", "part", [], "SELECT p_partkey, ROUND(MATCH(p_name) AGAINST('red rings'), 8) AS r, MATCH(p_name) AGAINST('red rings' IN BOOLEAN MODE) AS b FROM part", f"SELECT p_partkey, round((len(list_filter(s, lambda x: x = 'red')) + len(list_filter(s, lambda x: x = 'ring'))) / len(s)::DOUBLE, 8) AS r, (CASE WHEN list_has_any(s, ['red', 'ring']) THEN 1.0 ELSE 0.0 END)::DOUBLE AS b FROM (SELECT p_partkey, {_stems_sql('p_name')} AS s FROM part)")
engine(
    "sql_text_queries",
    "part",
    [],
    "SELECT p_partkey, to_tsquery(CONCAT('The & ', REPLACE(p_name, ' ', ' | '))) AS q, websearch_to_tsquery(p_name) AS w, plainto_tsquery(p_name) AS p FROM part",
    f"SELECT p_partkey, '& ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_QUOTED}), ' | ') AS q, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_QUOTED}), ' ') AS w, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_QUOTED}), ' & ') AS p FROM part",
)
engine("sql_headline", "documents", [], "SELECT doc_id, ts_headline(text, 'the oner') AS h FROM documents", ORACLES["fts_headline"])
engine(
    "sql_cast_types",
    "orders",
    [],
    "SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, CAST(CONCAT('1', o_custkey) AS BIGINT) AS b, CAST(CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE '0' END AS BOOL) AS f, CAST(CONCAT('[', o_custkey, ']') AS JSON) AS j FROM orders",
    "SELECT o_orderkey, o_orderkey::VARCHAR AS t, concat('1', o_custkey)::BIGINT AS b, o_custkey % 2 = 0 AS f, concat('[', o_custkey, ']') AS j FROM orders",
)
engine(
    "sql_whole_numbers",
    "orders",
    [],
    "SELECT o_orderkey, o_orderkey / 7 AS d, -o_orderkey / 7 AS n, o_custkey * 3 / 2 AS c, o_totalprice / 2 AS f, POWER(o_custkey % 5, 3) AS p, SQRT(o_custkey) AS r FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS d, -o_orderkey // 7 AS n, o_custkey * 3 // 2 AS c, o_totalprice / 2 AS f, ((o_custkey % 5) * (o_custkey % 5) * (o_custkey % 5))::BIGINT AS p, floor(sqrt(o_custkey))::BIGINT AS r FROM orders",
)
engine(
    "sql_information_schema",
    "",
    [_CUST, "CREATE TABLE log (id BIGINT, cust BIGINT REFERENCES cust(id))", "CREATE VIEW v AS SELECT id FROM log"],
    "SELECT t.table_name, t.table_type, c.column_name, c.data_type, c.is_nullable FROM information_schema.tables t LEFT JOIN information_schema.columns c ON t.table_name = c.table_name",
    "SELECT * FROM (VALUES ('cust', 'BASE TABLE', 'id', 'BIGINT', 'NO'), ('cust', 'BASE TABLE', 'name', 'TEXT', 'NO'), ('cust', 'BASE TABLE', 'bal', 'DOUBLE', 'YES'), ('cust', 'BASE TABLE', 'seg', 'TEXT', 'YES'), ('cust', 'BASE TABLE', 'nation', 'INT', 'YES'), ('log', 'BASE TABLE', 'id', 'BIGINT', 'YES'), ('log', 'BASE TABLE', 'cust', 'BIGINT', 'YES'), ('v', 'VIEW', NULL, NULL, NULL)) AS v(table_name, table_type, column_name, data_type, is_nullable)",
)
engine("sql_constraints_catalog", "", [_CUST, "CREATE TABLE log (id BIGINT, cust BIGINT REFERENCES cust(id))"], "SELECT table_name, constraint_type, COUNT(*) AS n FROM information_schema.table_constraints GROUP BY table_name, constraint_type", "SELECT * FROM (VALUES ('cust', 'PRIMARY KEY', 1::BIGINT), ('cust', 'CHECK', 1), ('log', 'FOREIGN KEY', 1)) AS v(table_name, constraint_type, n)")
engine("sql_show_tables", "", [_CUST, "CREATE TABLE other (id INT)", "DROP TABLE IF EXISTS nothing", "CREATE TABLE last (id INT)", "DROP TABLE other"], "SHOW TABLES", "SELECT * FROM (VALUES ('cust'), ('last')) AS v(table_name)")
engine("sql_databases", "", ["CREATE DATABASE more", "USE more", "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)", "USE main"], "SHOW DATABASES", "SELECT * FROM (VALUES ('main'), ('more')) AS v(database_name)")
_REACH = "WITH RECURSIVE reach AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 24 UNION SELECT (n.n_nationkey * 3 + n.n_regionkey) % 25 AS k FROM reach r JOIN nation n ON n.n_nationkey = r.k) SELECT k FROM reach"
engine("sql_recursive_over_table", "nation", [], _REACH, _REACH)
engine("sql_json_paths", "events", [], "SELECT event_id, CONCAT('{\"a\": ', props, '}') #> '{a,k}' AS v, CONCAT('{\"a\": ', props, '}') @> '{\"a\": {\"k\": 7}}' AS c, '{\"k\": 7}' <@ props AS w FROM events", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS v, json_extract_string(props, '$.k') = '7' AS c, json_extract_string(props, '$.k') = '7' AS w FROM events")
engine("sql_fulltext_index", "part", ["CREATE TABLE p (id INT PRIMARY KEY, name TEXT)", "INSERT INTO p SELECT p_partkey, p_name FROM part", "CREATE FULLTEXT INDEX f ON p (name)", "INSERT INTO p VALUES (-1, 'red late ring')", "REINDEX f"], "SELECT doc_id FROM f WHERE term = 'ring'", "SELECT p_partkey AS doc_id FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') UNION ALL SELECT -1")
engine("sql_indexes", "customer", [_CUST, _FILL, "CREATE UNIQUE INDEX by_id ON cust (id)", "CREATE INDEX by_nation ON cust (nation)", "DROP INDEX by_nation"], "SELECT id, name FROM cust WHERE nation = 7 OR id < 4", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 7 OR c_custkey < 4")
engine(
    "sql_partitioned_table",
    "orders",
    ["CREATE TABLE o (k BIGINT, cust INT) PARTITION BY RANGE (cust) (PARTITION p0 VALUES LESS THAN (100), PARTITION p1 VALUES LESS THAN (500), PARTITION p2 VALUES LESS THAN (MAXVALUE))", "INSERT INTO o SELECT o_orderkey, o_custkey FROM orders", "DELETE FROM o WHERE cust < 50"],
    "SELECT k, cust FROM o WHERE cust < 600",
    "SELECT o_orderkey AS k, o_custkey AS cust FROM orders WHERE o_custkey < 600 AND o_custkey >= 50",
)
engine("sql_limited_changes", "customer", [_CUST, _FILL, "DELETE FROM cust WHERE nation = 3 LIMIT 1000000", "UPDATE cust SET seg = 'SOME' WHERE nation = 4 LIMIT 2"], "SELECT COUNT(*) AS n, SUM(CASE WHEN seg = 'SOME' THEN 1 ELSE 0 END) AS some, SUM(CASE WHEN nation = 3 THEN 1 ELSE 0 END) AS three FROM cust", "SELECT count(*) AS n, least(2, sum((c_nationkey = 4)::INT))::BIGINT AS some, 0::BIGINT AS three FROM customer WHERE c_nationkey <> 3")
_TWO = "WITH RECURSIVE start AS (SELECT 24 AS k), reach AS (SELECT k FROM start UNION SELECT (n.n_nationkey * 3 + n.n_regionkey) % 25 AS k FROM reach r JOIN nation n ON n.n_nationkey = r.k), steps AS (SELECT 1 AS i UNION ALL SELECT i + 1 AS i FROM steps WHERE i < 3) SELECT k, i FROM reach CROSS JOIN steps"
engine("sql_recursive_list", "nation", [], _TWO, _TWO)
engine("sql_system_catalog", "", [_CUST, "CREATE INDEX by_nation ON cust (nation)", "CREATE TABLE p (id INT PRIMARY KEY, name TEXT)", "INSERT INTO p VALUES (1, 'red ring')", "CREATE FULLTEXT INDEX f ON p (name)"], "SELECT t.table_name, t.columns, i.index_name, i.kind FROM system.tables t JOIN system.indexes i ON i.table_name = t.table_name", "SELECT * FROM (VALUES ('cust', 5, 'by_nation', 'btree'), ('p', 2, 'f', 'fulltext')) AS v(table_name, columns, index_name, kind)")
engine("sql_partition_pruned", "orders", ["CREATE TABLE o (k BIGINT, cust INT) PARTITION BY HASH (cust) PARTITIONS 4", "INSERT INTO o SELECT o_orderkey, o_custkey FROM orders", "INSERT INTO o VALUES (-1, 77)"], "SELECT k FROM o WHERE cust = 77 AND k < 100000000", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 77 UNION ALL SELECT -1")
