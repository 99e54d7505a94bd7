"""The SQL session: dialect, tables, constraints, transactions, views, prepared statements."""

import re

import pytest

from sparkloom.dialect import rewrite
from sparkloom.session import Engine
from sparkloom.store.tables import ConflictError


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_insert_defaults_auto_increment_and_types(engine):
    engine.sql("CREATE TABLE items (id INT AUTO_INCREMENT PRIMARY KEY, name TEXT, data TEXT DEFAULT 'none', num INT DEFAULT 0)")
    engine.sql("INSERT INTO items (name) VALUES ('a'), ('b')")
    engine.sql("INSERT INTO items (id, name) VALUES (10, 'c')")
    engine.sql("INSERT INTO items (name, num) VALUES ('d', 5)")
    assert rows(engine.sql("SELECT * FROM items")) == [(1, "a", "none", 0), (10, "c", "none", 0), (11, "d", "none", 5), (2, "b", "none", 0)]
    engine.sql("INSERT INTO items (name) SELECT upper(name) FROM items WHERE num = 5")
    assert rows(engine.sql("SELECT name FROM items WHERE id = 12")) == [("D",)]


def test_constraints_reject(engine):
    engine.sql("CREATE TABLE users (id INT PRIMARY KEY, age INT NOT NULL CHECK (age >= 18))")
    engine.sql("CREATE TABLE posts (id INT PRIMARY KEY, user_id INT REFERENCES users(id))")
    engine.sql("INSERT INTO users VALUES (1, 30), (2, 40)")
    engine.sql("INSERT INTO posts VALUES (1, 1), (2, NULL)")
    for bad in ("INSERT INTO users VALUES (1, 50)", "INSERT INTO users VALUES (3, 10)", "INSERT INTO users VALUES (3, NULL)", "INSERT INTO posts VALUES (3, 9)", "DELETE FROM users WHERE id = 1", "UPDATE users SET age = 3"):
        with pytest.raises(ValueError):
            engine.sql(bad)
    assert engine.sql("SELECT count(*) FROM users").first()[0] == 2
    assert engine.sql("DELETE FROM users WHERE id = 2").first()["rows_affected"] == 1


def test_upsert(engine):
    engine.sql("CREATE TABLE u (id INT PRIMARY KEY, name TEXT, amount INT)")
    engine.sql("INSERT INTO u VALUES (1, 'Alice', 10)")
    engine.sql("INSERT INTO u VALUES (1, 'Bob', 5) ON CONFLICT (id) DO NOTHING")
    assert rows(engine.sql("SELECT * FROM u")) == [(1, "Alice", 10)]
    engine.sql("INSERT INTO u VALUES (1, 'Bob', 5), (2, 'Carol', 7), (3, 'Dan', 1) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, amount = amount + EXCLUDED.amount")
    assert rows(engine.sql("SELECT * FROM u")) == [(1, "Bob", 15), (2, "Carol", 7), (3, "Dan", 1)]


def test_update_delete_with_other_tables(engine):
    engine.sql("CREATE TABLE orders_ (id INT, customer_id INT, status TEXT)")
    engine.sql("CREATE TABLE customers_ (id INT, country TEXT)")
    engine.sql("INSERT INTO orders_ VALUES (1, 1, 'new'), (2, 2, 'new'), (3, NULL, 'new')")
    engine.sql("INSERT INTO customers_ VALUES (1, 'US'), (2, 'DE')")
    assert engine.sql("UPDATE orders_ SET status = 'us' FROM customers_ WHERE orders_.customer_id = customers_.id AND customers_.country = 'US'").first()[1] == 1
    assert rows(engine.sql("SELECT id, status FROM orders_")) == [(1, "us"), (2, "new"), (3, "new")]
    engine.sql("UPDATE orders_ SET status = concat(status, '!'), customer_id = id WHERE id IN (SELECT id FROM customers_)")
    assert rows(engine.sql("SELECT id, customer_id, status FROM orders_")) == [(1, 1, "us!"), (2, 2, "new!"), (3, None, "new")]
    assert engine.sql("DELETE FROM orders_ USING customers_ c WHERE orders_.customer_id = c.id AND c.country = 'DE'").first()[1] == 1
    assert engine.sql("TRUNCATE TABLE orders_").first()[1] == 2


def test_merge(engine):
    engine.sql("CREATE TABLE inventory (product_id INT, quantity INT)")
    engine.sql("CREATE TABLE shipment (product_id INT, quantity INT)")
    engine.sql("INSERT INTO inventory VALUES (1, 100), (2, 50)")
    engine.sql("INSERT INTO shipment VALUES (1, 25), (3, 75), (2, 0)")
    engine.sql("MERGE INTO inventory AS t USING shipment AS s ON t.product_id = s.product_id WHEN MATCHED AND s.quantity = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET quantity = t.quantity + s.quantity WHEN NOT MATCHED THEN INSERT (product_id, quantity) VALUES (s.product_id, s.quantity)")
    assert rows(engine.sql("SELECT * FROM inventory")) == [(1, 125), (3, 75)]
    engine.sql("MERGE INTO inventory t USING (SELECT product_id AS p, sum(quantity) AS q FROM shipment GROUP BY product_id) s ON t.product_id = s.p WHEN MATCHED THEN UPDATE SET quantity = s.q WHEN NOT MATCHED THEN DO NOTHING")
    assert rows(engine.sql("SELECT * FROM inventory")) == [(1, 25), (3, 75)]


def test_transactions(engine, spark, tmp_path):
    engine.sql("CREATE TABLE a (x INT)")
    engine.sql("BEGIN")
    engine.sql("INSERT INTO a VALUES (1)")
    other = Engine(spark, str(tmp_path))
    assert other.sql("SELECT * FROM a").count() == 0 and engine.sql("SELECT * FROM a").count() == 1
    engine.sql("ROLLBACK")
    assert engine.sql("SELECT * FROM a").count() == 0
    engine.sql("BEGIN")
    engine.sql("INSERT INTO a VALUES (2)")
    other.sql("INSERT INTO a VALUES (3)")
    with pytest.raises(ConflictError):
        engine.sql("COMMIT")
    assert rows(engine.sql("SELECT * FROM a")) == [(3,)]


def test_alter_views_indexes_catalog(engine):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 'one'), (2, 'two')")
    engine.sql("ALTER TABLE t ADD COLUMN n INT DEFAULT 7")
    engine.sql("ALTER TABLE t RENAME COLUMN v TO word")
    assert rows(engine.sql("SELECT * FROM t")) == [(1, "one", 7), (2, "two", 7)]
    engine.sql("ALTER TABLE t DROP COLUMN n")
    engine.sql("ALTER TABLE t RENAME TO t2")
    engine.sql("CREATE VIEW big (k) AS SELECT id FROM t2 WHERE id > 1")
    assert rows(engine.sql("SELECT k FROM big")) == [(2,)]
    engine.sql("CREATE OR REPLACE VIEW big AS SELECT id AS k FROM t2")
    assert engine.sql("SELECT * FROM big").count() == 2
    engine.sql("DROP VIEW big")
    engine.sql("CREATE UNIQUE INDEX i ON t2 (word)")
    with pytest.raises(ValueError):
        engine.sql("INSERT INTO t2 VALUES (3, 'one')")
    engine.sql("DROP INDEX i")
    engine.sql("CREATE FULLTEXT INDEX f ON t2 (word)")
    assert rows(engine.search("f", "two").select("doc_id")) == [(2,)]
    assert rows(engine.sql("SHOW TABLES")) == [("t2",)]
    assert "PRIMARY KEY (id)" in engine.sql("SHOW CREATE TABLE t2").first()[0]
    assert engine.sql("EXPLAIN ANALYZE SELECT * FROM t2").where("plan = 'rows: 2'").count() == 1
    engine.sql("DROP TABLE t2")
    with pytest.raises(ValueError):
        engine.table("t2")


def test_prepared_and_parameters(engine):
    engine.sql("CREATE TABLE p (a INT, b TEXT)")
    engine.sql("PREPARE add AS INSERT INTO p VALUES ($1, $2)")
    engine.sql("EXECUTE add (1, 'x')")
    engine.sql("EXECUTE add (2, 'y')")
    assert rows(engine.sql("SELECT a FROM p WHERE b = $1", ["y"])) == [(2,)]
    engine.sql("UPDATE p SET b = $1 WHERE a = $2", ["it's", 1])
    assert rows(engine.sql("SELECT b FROM p WHERE a = 1")) == [("it's",)]
    engine.sql("DEALLOCATE add")
    with pytest.raises(ValueError):
        engine.sql("EXECUTE add (1, 'x')")


def test_query_extensions(engine, spark):
    engine.register("d", spark.createDataFrame([("A", 1, "first"), ("A", 2, "second"), ("B", 3, "third"), ("B", None, "none")], "category string, value int, name string"))
    assert rows(engine.sql("SELECT DISTINCT ON (category) category, name FROM d ORDER BY category, value DESC")) == [("A", "second"), ("B", "none")]
    assert engine.sql("SELECT name FROM d ORDER BY value LIMIT (SELECT count(*) - 1 FROM d)").collect()[-1][0] == "third"
    assert rows(engine.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 2) % 7 FROM r) SELECT n FROM r")) == [(1,), (2,), (4,)]
    assert rows(engine.sql("""SELECT '{"a": {"b": [1, 2]}}' -> 'a' ->> 'b', '{"a":1,"b":2}' @> '{"a":1}', '{"a":1}' ? 'b'""")) == [("[1,2]", True, False)]
    assert rows(engine.sql("SELECT name FROM d WHERE name @@ to_tsquery('firsts | thirds')")) == [("first",), ("third",)]


def test_databases_users_and_counters(engine):
    engine.sql("CREATE DATABASE other")
    engine.sql("USE other")
    engine.sql("CREATE TABLE only_here (a INT) USING COLUMN PARTITION BY RANGE (a) (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN (MAXVALUE))")
    assert engine.definition("only_here").storage == "column" and engine.definition("only_here").partition["bounds"] == [["p0", 10], ["p1", None]]
    engine.sql("USE main")
    assert "other" in [r[0] for r in engine.sql("SHOW DATABASES").collect()] and engine.sql("SHOW TABLES").count() == 0
    engine.sql("CREATE USER bob")
    engine.sql("GRANT SELECT ON only_here TO bob")
    assert engine.users["bob"]["privileges"] == [("SELECT", "only_here")]
    assert "engine_queries" in engine.prometheus()


def test_rewrite_of_null_order_and_dates():
    assert "NULLS LAST" in rewrite("SELECT a FROM t ORDER BY a") and "NULLS FIRST" in rewrite("SELECT a FROM t ORDER BY a DESC")
    assert "timestampadd ( MONTH" in rewrite("SELECT DATE_ADD(ts, INTERVAL 1 MONTH) FROM t")


def test_headline_in_sql_takes_only_stretches_apart(engine, spark):
    engine.register("art", spark.createDataFrame([(1, "a b\n c d e f  Fox-es, g h i j k", "foxes"), (2, None, "fox"), (3, "one fox", None), (4, " ", "fox"), (5, "one two", "\u00e9")], "id int, body string, q string"))
    df = engine.sql("SELECT id, ts_headline(body, q) AS h FROM art")
    assert rows(df) == [(1, "...b c d e f <b>Fox-es,</b> g h i j..."), (2, None), (3, None), (4, ""), (5, "one two...")]
    assert not re.search(r"split\(trim\(regexp_replace\((?!lower)", df._jdf.queryExecution().optimizedPlan().toString())


def test_places_of_all_rows_are_not_one_tasks(engine, spark):
    data = [(i, None if i % 7 == 0 else i % 5, f"r{i}") for i in range(1000)]
    spark.createDataFrame(data, "id int, g int, n string").repartition(5).createOrReplaceTempView("many")
    plain = "SELECT *, row_number() OVER (ORDER BY g DESC NULLS FIRST, id) AS a, id + 1, rank() OVER (ORDER BY g NULLS LAST) AS b FROM many WHERE id % 3 > 0"
    df = engine.sql("SELECT *, row_number() OVER (ORDER BY g DESC, id) AS a, id + 1, RANK() OVER (ORDER BY g) b FROM many WHERE id % 3 > 0")
    want = spark.sql(plain)
    assert df.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Window [row_number" not in df._jdf.queryExecution().optimizedPlan().toString()
    # One key for all rows, and none at all.
    tied = engine.sql("SELECT id, row_number() OVER (ORDER BY id * 0) AS a, rank() OVER (ORDER BY id * 0) AS b FROM many ORDER BY a DESC").collect()
    assert [r["a"] for r in tied] == list(range(1000, 0, -1)) and {r["b"] for r in tied} == {1} and len({r["id"] for r in tied}) == 1000
    assert engine.sql("SELECT id, row_number() OVER (ORDER BY id) AS a FROM many WHERE id < 0").collect() == []
    # Keys of a GROUP BY; what is left to Spark.
    for text in (
        "SELECT g, count(*) AS n, rank() OVER (ORDER BY count(*) DESC NULLS FIRST, g NULLS LAST) AS r FROM many WHERE id < 50 GROUP BY g",
        "SELECT id, row_number() OVER (ORDER BY id DESC NULLS FIRST) AS a FROM many ORDER BY a LIMIT 3",
        "SELECT id, row_number() OVER (ORDER BY id DESC NULLS FIRST) AS a FROM many ORDER BY n DESC, id",
        "SELECT id, NULL AS x, row_number() OVER (ORDER BY id NULLS LAST) AS a FROM many",
    ):
        assert sorted(map(repr, engine.sql(text).collect())) == sorted(map(repr, spark.sql(text).collect()))


def test_text_search_in_sql(engine, spark):
    engine.register("art", spark.createDataFrame([(1, "The quick brown fox"), (2, "Running cats run"), (3, None)], "id int, body string"))
    assert rows(engine.sql("SELECT id FROM art WHERE to_tsvector('english', body) @@ to_tsquery('english', 'foxes & !cat')")) == [(1,), (2,)]  # operators do not count
    assert rows(engine.sql("SELECT to_tsvector(body), round(ts_rank(body, 'cats', 1), 4), ts_headline('english', body, 'cat') FROM art WHERE id = 2")) == [("'cat':2 'run':3 'runn':1", 0.3333, "Running <b>cats</b> run")]
    assert rows(engine.sql("SELECT id, MATCH(body) AGAINST ('fox' IN BOOLEAN MODE) FROM art WHERE MATCH(body) AGAINST ('quick') > 0")) == [(1, 1.0)]
    assert engine.sql("SELECT 'it''s' AS s").first()[0] == "it's"
    assert [r[0] for r in engine.sql("SELECT DISTINCT ON (id % 2) id FROM art ORDER BY id % 2, id DESC LIMIT 2").collect()] != []


def test_partitions_are_read_as_far_as_a_query_can_need_them(engine):
    engine.sql("CREATE TABLE p (k INT, day INT) PARTITION BY RANGE (day) (PARTITION a VALUES LESS THAN (10), PARTITION b VALUES LESS THAN (20))")
    engine.sql("INSERT INTO p VALUES (1, 5), (2, 15), (3, 19)")
    with pytest.raises(Exception, match="no partition of p takes a row"):
        engine.sql("INSERT INTO p VALUES (4, 25)")
    plan = lambda text: engine.query(text)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan("SELECT k FROM p WHERE day >= 12 AND k > 0") and "[b]" in plan("SELECT k FROM p WHERE day >= 12 AND k > 0").replace("IN (b)", "[b]").replace("= b)", "[b]")
    assert [r[0] for r in engine.sql("SELECT k FROM p WHERE day BETWEEN 12 AND 16 OR k = 1 ORDER BY k").collect()] == [1, 2]
    engine.sql("UPDATE p SET day = 6 WHERE k = 2")
    assert sorted(tuple(r) for r in engine.sql("SELECT * FROM p").collect()) == [(1, 5), (2, 6), (3, 19)]


def test_only_one_writer_gives_a_file_its_name(engine):
    files, path = engine.store.files, f"{engine.store.root}/main/once"
    assert files.create(path, "first") and not files.create(path, "second") and files.read(path) == "first"
    assert [n for n in files.names(f"{engine.store.root}/main") if n.startswith("once")] == ["once"]


def test_users_that_are_not_there(engine):
    engine.sql("CREATE USER u PASSWORD 'secret'")
    assert "secret" not in str(engine.users) and engine.users["u"]["password"]
    engine.sql("ALTER USER u PASSWORD 'other'")
    for bad in ("DROP USER nobody", "ALTER USER nobody PASSWORD 'x'"):
        with pytest.raises(ValueError, match="no user nobody"):
            engine.sql(bad)
    engine.sql("DROP USER IF EXISTS nobody")
    engine.sql("DROP USER u")
    assert not engine.users


def test_whole_number_rules_reach_subqueries_and_changes(engine):
    engine.sql("CREATE TABLE w (a BIGINT, b DOUBLE)")
    engine.sql("INSERT INTO w VALUES (7, 7.0), (9007199254740993, 1.0)")
    assert [tuple(r) for r in engine.sql("SELECT a / 2 AS x, b / 2 AS y, (SELECT MIN(a) / 2 FROM w) AS z FROM w WHERE a / 2 > 1 ORDER BY a").collect()] == [(3, 3.5, 3), (4503599627370496, 0.5, 3)]
    engine.sql("UPDATE w SET a = a / 2, b = b / 2")
    assert sorted(tuple(r) for r in engine.sql("SELECT * FROM w").collect()) == [(3, 3.5), (4503599627370496, 0.5)]
