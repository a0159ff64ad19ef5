from pyspark.sql import functions as F

from colscope.operators.profile import profile_tables


def _prof(spark, tables, **kw):
    return profile_tables(spark, tables, "db", **kw)


def test_samples_first_distinct_in_row_order(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c")], "k int, v string")
    p = _prof(spark, {"t": df}, sample_limit=2, order_by={"t": ["k"]})
    cols = {r["column"]: r["sample_values"] for r in p.columns.collect()}
    assert cols["v"] == ["b", "a"]          # first distinct non-null values by k
    assert cols["k"] == ["1", "2"]


def test_samples_read_only_first_ten_times_limit_rows(spark):
    # values after row 10*limit are never sampled
    rows = [(i, "x" if i < 20 else f"y{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v string")
    p = _prof(spark, {"t": df}, sample_limit=2, order_by={"t": ["k"]})
    cols = {r["column"]: r["sample_values"] for r in p.columns.collect()}
    assert cols["v"] == ["x"]


def test_null_ratio_and_distinct_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "a", None)],
                               "k int, v string, z string")
    empty = df.where("false")
    p = _prof(spark, {"t": df, "e": empty})
    r = {(x["table"], x["column"]): x for x in p.columns.collect()}
    assert r[("t", "v")]["null_ratio"] == round(1 / 3, 4)
    assert r[("t", "v")]["unique_count"] == 1
    assert r[("t", "z")]["null_ratio"] == 1.0
    assert r[("t", "z")]["unique_count"] is None        # 0 distinct -> null
    assert r[("e", "k")]["null_ratio"] is None           # empty table -> null
    assert r[("e", "k")]["unique_count"] is None
    rows = {x["table"]: x["row_count"] for x in p.tables.collect()}
    assert rows == {"t": 3, "e": 0}


def test_exact_distinct_matches_count_distinct(spark, sf):
    from colscope.plans.fixtures import lineitem_nulls
    li = lineitem_nulls(spark, sf)
    p = _prof(spark, {"lineitem": li}, inclusions=False)
    got = {r["column"]: r["unique_count"] for r in p.columns.collect()}
    exp = li.agg(*[F.countDistinct(c).alias(c) for c in li.columns]).first().asDict()
    for c, v in exp.items():
        assert got[c] == (v if v else None), c


def test_types_bytes_decimal_timestamp_nested(spark):
    df = spark.sql("SELECT 1 AS k, CAST('ab' AS BINARY) AS b, CAST(1.50 AS DECIMAL(5,2)) AS d, "
                   "TIMESTAMP_NTZ'2024-01-02 03:04:05' AS ts, array(1, 2) AS arr, map('a', 1) AS m, "
                   "named_struct('x', 1) AS st")
    p = _prof(spark, {"t": df})
    s = {r["column"]: r["sample_values"] for r in p.columns.collect()}
    assert s["b"] == ["<bytes:2>"]
    assert s["d"] == ["1.50"]
    assert s["ts"] == ["2024-01-02 03:04:05"]
    assert s["arr"] == ["[1, 2]"]
    assert s["m"] == ['{"a":1}']
    assert s["st"] == ["{1}"]


def test_candidate_keys_and_inclusions(spark):
    parent = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id int, name string")
    child = spark.createDataFrame([(i, i % 5) for i in range(30)], "cid bigint, pid bigint")
    p = _prof(spark, {"parent": parent, "child": child})
    keys = {(r["table"], r["column"]) for r in p.keys.collect()}
    assert ("parent", "id") in keys and ("child", "cid") in keys and ("child", "pid") not in keys
    inc = {(r["fk_table"], r["fk_column"], r["key_table"], r["key_column"]) for r in p.inclusions.collect()}
    assert ("child", "pid", "parent", "id") in inc      # int vs bigint compare as one family
    assert ("parent", "id", "child", "cid") in inc
    assert ("child", "cid", "parent", "id") not in inc  # 0..29 not inside 0..9


def test_approx_mode_close(spark, sf):
    from colscope.plans.fixtures import read
    o = read(spark, sf, "orders")
    p = _prof(spark, {"orders": o}, approx=True, inclusions=False)
    got = {r["column"]: r["unique_count"] for r in p.columns.collect()}
    assert abs(got["o_orderkey"] - o.count()) / o.count() < 0.1


def test_stats_pass_reads_each_table_once(spark, sf):
    from colscope.operators.profile import exact_column_sketches
    from colscope.plans.fixtures import all_tables
    from colscope.sources.tables import table_columns_meta
    t = all_tables(spark, sf)
    plan = exact_column_sketches(t, table_columns_meta("db", t))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(t)
    assert "SortAggregate" not in plan


def test_keyed_head_with_awkward_string_keys(spark):
    rows = [(f"k{i}'\\x", i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, v int")
    p = _prof(spark, {"t": df}, sample_limit=2, inclusions=False)
    got = {r["column"]: r["sample_values"] for r in p.columns.collect()}
    first = sorted(r[0] for r in rows)
    assert got["k"] == first[:2]
    head = sorted(rows)[:20]
    exp = []
    for _, v in head:
        if str(v) not in exp:
            exp.append(str(v))
    assert got["v"] == exp[:2]
