"""Procedures, functions and triggers."""

import pytest

from sparkloom.pl.interpreter import Raised
from sparkloom.session import Engine


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE logs (id INT, message TEXT)")
    return e


def test_call_with_control_flow(engine):
    engine.sql("""CREATE PROCEDURE p(IN n INT, OUT total INT, OUT steps INT) AS $$
        DECLARE i INT := 0;
        BEGIN
            total := 0; steps := 0;
            WHILE i < n LOOP
                i := i + 1;
                CONTINUE WHEN i % 2 = 0;
                EXIT WHEN i > 7;
                total := total + i;
            END LOOP;
            FOR k IN REVERSE 1..3 LOOP steps := steps * 10 + k; END LOOP;
            IF total > 100 THEN total := -1; ELSIF total = 16 THEN steps := steps + 1; ELSE total := 0; END IF;
        END; $$ LANGUAGE plpgsql""")
    assert tuple(engine.sql("CALL p(9)").first()) == (16, 322)
    assert [r[0] for r in engine.sql("SHOW PROCEDURES").collect()] == ["p"]
    engine.sql("DROP PROCEDURE p")
    with pytest.raises(ValueError):
        engine.sql("CALL p(1)")


def test_sql_queries_and_errors(engine):
    engine.sql("""CREATE FUNCTION f(label TEXT) RETURNS INT AS $$
        DECLARE n INT;
        BEGIN
            INSERT INTO logs VALUES (1, label), (2, 'b');
            SELECT count(*) INTO n FROM logs;
            FOR r IN (SELECT id, message FROM logs WHERE id = 2) LOOP
                INSERT INTO logs VALUES (r.id + 10, r.message);
            END LOOP;
            PERFORM 1;
            BEGIN
                RAISE EXCEPTION 'bad %', n;
            EXCEPTION WHEN OTHERS THEN
                INSERT INTO logs VALUES (99, sqlerrm);
            END;
            RETURN n;
        END $$ LANGUAGE plpgsql""")
    assert engine.sql("CALL f('it')").first()[0] == 2
    assert sorted(map(tuple, engine.sql("SELECT * FROM logs").collect())) == [(1, "it"), (2, "b"), (12, "b"), (99, "bad 2")]
    engine.sql("CREATE PROCEDURE q() AS $$ BEGIN RAISE EXCEPTION 'stop'; END $$")
    with pytest.raises(Raised):
        engine.sql("CALL q()")


def test_triggers(engine):
    engine.sql("CREATE TABLE users (id INT, age INT)")
    engine.sql("INSERT INTO users VALUES (1, 30), (2, 40)")
    engine.sql("CREATE FUNCTION on_user() RETURNS TRIGGER AS $$ BEGIN INSERT INTO logs VALUES (new_id, concat('age ', new_age)); RETURN NEW; END; $$ LANGUAGE plpgsql")
    engine.sql("CREATE TRIGGER t AFTER UPDATE ON users FOR EACH ROW EXECUTE FUNCTION on_user()")
    engine.sql("UPDATE users SET age = age + 1 WHERE id = 1")
    assert [tuple(r) for r in engine.sql("SELECT * FROM logs").collect()] == [(1, "age 31")]
    engine.sql("DROP TRIGGER t ON users")
    engine.sql("UPDATE users SET age = 0")
    assert engine.sql("SELECT * FROM logs").count() == 1
    for bad in ("CREATE TRIGGER tr INSERT ON users EXECUTE FUNCTION fn()", "CREATE TRIGGER tr BEFORE INSERT users EXECUTE FUNCTION fn()"):
        with pytest.raises(ValueError):
            engine.sql(bad)
