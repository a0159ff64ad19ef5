"""G5 over a whole log: a state for every row, equal to the dry run of its text alone."""

from __future__ import annotations

import pytest

from colscope.operators import execute
from colscope.plans import fixtures as fx
from colscope.plans.registry import QUERIES
from colscope.sources.tables import register_views

# neighbours that differ in one value only, some of them with different states
TEXTS = [
    "SELECT o_orderkey FROM orders WHERE o_orderkey = 5", "SELECT o_orderkey FROM orders WHERE o_orderkey = 77",
    "SELECT no_such FROM orders WHERE o_orderkey = 5", "SELECT o_custkey FROM no_such WHERE o_orderkey = 5",
    "SELECT o_custkey FROM orders GROUP BY 1", "SELECT o_custkey FROM orders GROUP BY 9",
    "SELECT o_custkey = 5 FROM orders GROUP BY o_custkey = 5", "SELECT o_custkey = 6 FROM orders GROUP BY o_custkey = 5",
    "SELECT o_custkey + 5 FROM orders GROUP BY o_custkey + 5", "SELECT o_custkey + 6 FROM orders GROUP BY o_custkey + 5",
    "SELECT `5` FROM (SELECT 5)", "SELECT `5` FROM (SELECT 6)", "SELECT a FROM (SELECT 'a')", "SELECT a FROM (SELECT 'b')",
    "SELECT percentile(o_custkey, 1) FROM orders", "SELECT percentile(o_custkey, 5) FROM orders",
    "SELECT DATE '1995-01-01' AS d", "SELECT DATE '1995-21-01' AS d", "SELECT 1; SELECT 2", "SELECT 5 AS n, 6 AS m", "SELECT 5 AS n, 5 AS m",
    "SELECT 'a' AS x FROM orders", "SELECT 'b 5' AS x FROM orders", "SELECT 'it''s' AS x FROM nowhere", "-- a 1\nSELECT 1 AS x", "-- 'b\nSELECT 2 AS x",
    "/* a\n1 */ SELECT 1 AS x", "/* a\n' */ SELECT no_such FROM orders", "SELECT o_orderkey FROM orders LIMIT 5", "SELECT o_orderkey FROM orders LIMIT -5",
    "SELECT if(o_custkey = 5, 1, 2) AS x FROM orders WHERE o_orderstatus = 'a = 5'", "SELECT o_custkey FROM orders WHERE o_custkey = ?",
    "SELECT o_custkey FROM orders WHERE o_custkey = 3", "SELECT 1 AS \"a 5", "SELECT 1 AS \"a 5\"", "SELECT 1 AS \"b 5\" FROM orders", "", "  \n ", None, "DROP TABLE orders", "SHOW TABLES",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority = 'a'", "SELECT o_orderkey FROM orders WHERE o_orderpriority = 'it''s b'",
    "SELECT no_such FROM orders WHERE o_orderpriority = 'c'", "SELECT o_orderkey FROM orders WHERE `o_orderpriority` = 'd' AND o_custkey = 7",
    "SELECT o_orderkey FROM orders WHERE o_custkey = 'x'", "SELECT o_orderkey FROM orders WHERE o_orderdate = 'not a date'",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (33, 4, 555)",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('a', 'b')", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('c')",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 'b')", "SELECT o_orderkey FROM orders WHERE nowhere IN (1, 2)",
    "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 5 AND 7", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 50 AND 7000",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority BETWEEN 'a' AND 'b'", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 5 AND 'b'",
    "SELECT o_orderkey FROM orders LIMIT 10", "SELECT o_orderkey FROM orders LIMIT 2000", "SELECT o_orderkey FROM orders LIMIT 10 OFFSET 20",
    "SELECT o_orderpriority = 'a' FROM orders GROUP BY o_orderpriority = 'a'", "SELECT o_orderpriority = 'b' FROM orders GROUP BY o_orderpriority = 'a'",
    "SELECT o_orderpriority = 'b' FROM orders GROUP BY o_orderpriority = 'b'", "SELECT o_custkey IN (1, 2) FROM orders GROUP BY o_custkey IN (1, 3)",
    "SELECT o_custkey IN (4, 2) FROM orders GROUP BY o_custkey IN (4, 2)", "SELECT count(*) FROM orders WHERE o_orderpriority = 'zz 1' GROUP BY o_custkey",
    "SELECT `(o_orderpriority = a)` FROM (SELECT o_orderpriority = 'a' FROM orders)", "SELECT `(o_orderpriority = a)` FROM (SELECT o_orderpriority = 'b' FROM orders)",
    "SELECT (SELECT o_custkey FROM orders b WHERE b.o_orderkey = a.o_orderkey LIMIT 1) FROM orders a",
    "SELECT (SELECT o_custkey FROM orders b WHERE b.o_orderkey = a.o_orderkey LIMIT 5) FROM orders a",
    "SELECT array(1) = 'a'", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> 'a' AND o_orderdate >= DATE '1995-13-01'",
]


@pytest.mark.parametrize("batch", [2000, 3])
def test_state_of_every_row_is_that_of_its_text(spark, sf, monkeypatch, batch):
    monkeypatch.setattr(execute, "DRY_RUN_BATCH", batch)
    register_views(fx.all_tables(spark, sf))
    log = spark.createDataFrame(list(enumerate(TEXTS)), "query_id long, sql string")
    got = {r["query_id"]: (r["is_valid"], r["error_type"]) for r in execute.dry_run_log(log).collect()}
    want = {i: ((v := execute.dry_run(spark, t).verdict)["is_valid"], v["error_type"]) for i, t in enumerate(TEXTS)}
    assert {TEXTS[i]: got.get(i) for i in want if got.get(i) != want[i]} == {}


def test_all_texts_of_the_log_have_a_state(spark, sf):
    n = fx.sql_log(spark, sf).count()
    rows = QUERIES["dry_run_log"](spark, sf).collect()
    assert len(rows) == n == len({r["query_id"] for r in rows}) and n > fx.SHAPES


def test_values_make_no_forms_of_their_own(spark, sf):
    log = fx.sql_log(spark, sf).filter(f"query_id % {fx.SHAPES} in (0, 1, 9, 11, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25)")
    assert log.count() > 500 and log.select(execute._form(log["sql"])).distinct().count() < 150


def test_values_of_a_usual_log_make_no_forms(spark, sf):
    """A text for every order, each with strings, lists, ranges and limits of its own."""
    from pyspark.sql import functions as F

    o = fx.read(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    texts = [("SELECT o_orderkey FROM orders WHERE o_orderpriority = 'p", "'"), ("SELECT * FROM orders WHERE o_custkey IN (1, ", ", 3)"),
             ("SELECT * FROM orders WHERE o_custkey BETWEEN 3 AND ", ""), ("SELECT * FROM orders WHERE o_orderpriority IN ('a', 'b ", "') LIMIT 20"),
             ("SELECT o_custkey, count(*) FROM orders WHERE o_orderpriority = 'c", "' GROUP BY o_custkey"), ("SELECT o_custkey FROM orders LIMIT 1", "")]
    log = o.select("o_orderkey", F.explode(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in texts])).alias("sql"))
    assert log.select("sql").distinct().count() > 5000
    assert log.select(execute._form(log["sql"])).distinct().count() <= len(texts) + 4       # 0 is no value of its own
