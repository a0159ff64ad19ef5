from pyspark.sql import functions as F

from colscope.operators import examples, execute, guard


def _store(spark):
    return spark.createDataFrame(
        [("abc-1", "q1", "select 1", '["x"]'), ("abc-2", "q2", "select 2", "[bad"), ("xyz", "q3", "select 3", None)],
        "log_id string, question string, sql string, selected_columns string").withColumn(
        "added_at", F.current_timestamp())


def test_prefix_none_one_many(spark):
    pre = spark.createDataFrame([("abc",), ("abc-1",), ("q",), ("x",)], "prefix string")
    r = {x["prefix"]: x for x in examples.resolve_prefixes(_store(spark), pre).collect()}
    assert r["abc"]["state"] == "many" and r["abc"]["matches"] == 2
    assert r["abc-1"]["state"] == "one" and r["abc-1"]["log_id"] == "abc-1"
    assert r["q"]["state"] == "none" and r["x"]["log_id"] == "xyz"


def test_add_delete_list(spark):
    s = _store(spark)
    batch = spark.createDataFrame([("abc-1", "dup", "s"), ("new", "q4", "s4")], "log_id string, question string, sql string")
    s2 = examples.add_examples(s, batch)
    assert sorted(r["log_id"] for r in s2.collect()) == ["abc-1", "abc-2", "new", "xyz"]
    assert [r["question"] for r in s2.collect() if r["log_id"] == "abc-1"] == ["q1"]
    s3, rep = examples.delete_examples(s2, spark.createDataFrame([("abc-2",), ("nope",)], "log_id string"))
    assert {r["log_id"]: r["found"] for r in rep.collect()} == {"abc-2": True, "nope": False}
    assert s3.count() == 3
    assert examples.list_examples(s3, 2).count() == 2


def test_example_scores_not_clamped(spark):
    items = _store(spark).withColumn("vector", F.when(F.col("log_id") == "xyz", F.array(F.lit(-1.0), F.lit(0.0)))
                                     .otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    qs = spark.createDataFrame([(1, [-1.0, 0.0])], "query_id long, vector array<double>")
    hits = examples.search_examples(items, qs, top_k=3).orderBy("rank").collect()
    assert hits[0]["log_id"] == "xyz" and hits[-1]["score"] < 0
    sel = {h["log_id"]: h["selected_columns"] for h in hits}
    assert sel["abc-1"] == ["x"] and sel["abc-2"] == [] and sel["xyz"] == []
    text = examples.fewshot_text(examples.search_examples(items, qs, top_k=2)).first()["fewshot"]
    assert text.startswith("Example 1:\nQuestion: q3\nSQL: ```sql\nselect 3\n```")


TEXTS = [
    "SELECT * FROM t", "", "  \n ", "select a from t -- note", "SELECT 1; DROP TABLE x",
    "SELECT /* c */ 1", "DROP TABLE t", "SELECT 'grant' FROM t", "INSERT INTO t VALUES (1)",
    "WITH a AS (SELECT 1) SELECT * FROM a", "WITH a AS (SELECT 1) DELETE FROM t", "SHOW TABLES",
    "SELECT 1; SELECT 2", "select * from t where a = '' or '1'='1'", "SELECT x UNION SELECT NULL",
    "권한GRANT 확인", "SELECT 정상여부 FROM 품질", "(SELECT 1)", "EXPLAIN SELECT 1",
    "SELECT benchmark (1)", "SELECT /* multi\nline */ 1",
]


def test_guard_spark_equals_python_and_precedence(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "query_id int, sql string")
    got = {r["query_id"]: (r["is_valid"], r["error_type"], r["rule"]) for r in guard.audit(df).collect()}
    for i, t in enumerate(TEXTS):
        if i % 4 == 0:      # one text at a time goes through the same rules
            v = guard.validate(spark, t)
            assert got[i] == (v["is_valid"], v["error_type"], v["rule"]), t
    assert got[4][1] == guard.INJECTION        # injection checked before dangerous
    assert got[7][1] == guard.DANGEROUS        # rule hits inside literals are kept
    assert got[12][0] is True                  # two SELECTs pass the guard
    assert got[15][1] == guard.DANGEROUS       # Unicode word boundary: GRANT after Hangul? see below
    assert got[20][0] is True                  # '.' does not cross a newline


def test_guard_allow_write(spark):
    df = spark.createDataFrame([(1, "INSERT INTO t VALUES (1)"), (2, "MERGE INTO t USING s ON x")],
                               "query_id int, sql string")
    r = {x["query_id"]: x["is_valid"] for x in guard.audit(df, allow_write=True).collect()}
    assert r == {1: True, 2: False}


def test_guard_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "SELECT 1")], "query_id int, sql string")
    plan = guard.audit(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_run_sql_guard_and_preview(spark, sf):
    from colscope.plans.fixtures import all_tables
    from colscope.sources.tables import register_views
    register_views(all_tables(spark, sf))
    bad = execute.run_sql(spark, "DROP TABLE orders")
    assert bad.df is None and bad.verdict["error_type"] == guard.DANGEROUS
    err = execute.run_sql(spark, "SELECT no_such_col FROM orders")
    assert err.df is None and err.verdict["error_type"] == guard.EXECUTION_ERROR and len(err.error) <= 300
    two = execute.run_sql(spark, "SELECT 1; SELECT 2")
    assert two.df is None and two.verdict["error_type"] == guard.EXECUTION_ERROR
    ok = execute.run_sql(spark, "SELECT o_orderkey, concat('a\\n', repeat('x', 100)) AS t FROM orders")
    pv = execute.preview(ok.df, 20, 80).collect()
    assert len(pv) == 20 and all(len(r["t"]) == 80 and r["t"].endswith("...") and "\n" not in r["t"] for r in pv)
    assert execute.result_note(ok.df).startswith("rows: 1500\n... 1480 more")
    assert execute.result_note(ok.df.where("false")) == "rows: 0\nno rows returned."


def test_reconcile_flags_mismatch(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "k1 string, k2 string, v double")
    r = execute.reconcile(df, ["k1", "k2"], "v")
    assert r.where("NOT ok").count() == 0 and r.count() == 3


def test_reconcile_claims(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "k1 string, k2 string, v double")
    claims = spark.createDataFrame(
        [(0, None, None, 7.0), (1, "a", None, 3.0), (1, "b", None, 5.0), (2, "a", "y", 2.0), (1, "c", None, 1.0)],
        "level int, k1 string, k2 string, claimed double")
    r = {(x["level"], x["k1"], x["k2"]): x for x in execute.reconcile_claims(df, ["k1", "k2"], "v", claims).collect()}
    assert r[(0, None, None)]["ok"] and r[(1, "a", None)]["ok"] and r[(2, "a", "y")]["ok"]
    assert not r[(1, "b", None)]["ok"] and r[(1, "b", None)]["diff"] == 1.0
    assert r[(1, "c", None)]["actual"] is None and not r[(1, "c", None)]["ok"]


def test_literals_names_and_comments_neither_end_nor_type_a_statement(spark):
    from pyspark.sql import functions as F

    cases = [("SELECT 'a;b' AS x FROM orders", "SELECT"), ("-- daily report\nSELECT 1", "SELECT"), ("/* a;\nb */ (SELECT 1)", "SELECT"),
             ("WITH t AS (SELECT 1)\n-- main\nSELECT * FROM t", "SELECT"), ('SELECT 1 AS "x; DROP"', "SELECT"), ("SELECT 'it''s; x', `a;b`", "SELECT"),
             ("SELECT 'a\\'; b' ; SELECT 2", "SELECT,SELECT"), ("WITH t AS (SELECT 1) -- )SELECT\n DELETE FROM t", "DELETE"), ("'x'", "UNKNOWN"), ("SELECT 'open", "SELECT")]
    df = spark.createDataFrame(cases, "sql string, want string")
    for r in df.select("sql", "want", F.array_join(guard.statement_types(F.col("sql")), ",").alias("got")).collect():
        assert r["got"] == r["want"], r["sql"]


def test_repeated_ids_in_one_batch(spark):
    from colscope.operators import examples

    store = spark.createDataFrame([("x", "q", "s")], "log_id string, question string, sql string")
    batch = spark.createDataFrame([("n", "b", "2"), ("n", "a", "1"), ("x", "q2", "s2"), (None, "c", "3"), (None, "c", "3")],
                                  "log_id string, question string, sql string")
    out = examples.add_examples(store, batch).collect()
    assert len(out) == 4 and [r["question"] for r in out if r["log_id"] == "n"] == ["a"]
    assert [r["question"] for r in examples.repeated_ids(batch).collect()] == ["b"]
