"""P4 heads, P8 sketches and composite keys, P6 stored states: against plain computation."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colscope.operators import keys, sketches
from colscope.operators.heads import head_filters
from colscope.operators.profile import (composite_candidate_keys, exact_column_sketches, fingerprints, profile_tables,
                                        stats_of_sketches)
from colscope.plans import fixtures as fx
from colscope.session import ensure_checkpoint_dir
from colscope.sources.tables import table_columns_meta

TYPES = ("a int, b double, c string, d date, e timestamp, f decimal(9,3), g boolean, h timestamp_ntz, i array<int>, j binary")


def odd_rows(rng, n):
    day, noon = dt.date(2024, 1, 1), dt.datetime(2024, 3, 31, 1, 59, 59, 999999)
    pick = lambda *xs: rng.choice(xs)
    return [(pick(None, 1, 1, 2, -5), pick(None, 0.0, -0.0, float("nan"), float("inf"), 1e300, 0.1), pick(None, "", "a'b\\", "é\n", "z" * 1500),
             pick(None, day, day + dt.timedelta(9)), pick(None, noon, noon + dt.timedelta(hours=1)), pick(None, Decimal("1.500"), Decimal("-2.001")),
             pick(None, True, False), pick(None, noon), pick(None, [1, 2], [1]), pick(None, b"x")) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_heads_hold_the_first_rows(spark, seed):
    """The filter keeps the first rows of the table, whatever columns lead, and few others."""
    rng = random.Random(seed)
    df = spark.createDataFrame(odd_rows(rng, 400), TYPES).repartition(3)
    order = rng.sample(df.columns, len(df.columns))
    filters = head_filters({"t": df, "none": df.limit(0)}, {"t": order, "none": order}, 25)
    asc = [F.col(c).asc_nulls_first() for c in order]
    text = lambda d: [str(r) for r in d.select(*order).orderBy(*asc).limit(25).collect()]
    kept = df.where(filters["t"])
    assert text(kept) == text(df)
    assert df.limit(0).where(filters["none"]).count() == 0


def test_a_head_reads_leading_columns_only(spark, sf):
    """Jobs of the search never touch the texts; the filter reaches the scan."""
    t = {"lineitem": fx.read(spark, sf, "lineitem"), "documents": fx.read(spark, sf, "documents")}
    f = head_filters(t, {n: df.columns for n, df in t.items()}, 100)
    assert "text" not in f["documents"] and "l_shipdate" not in f["lineitem"]
    for n, df in t.items():
        plan = df.where(f[n])._jdf.queryExecution().executedPlan().toString()
        assert "LessThan" in plan.split("PushedFilters")[1]
        assert 100 <= df.where(f[n]).count() < 200


def test_sketches_refute_no_true_inclusion(spark):
    rng = random.Random(3)
    base = list(range(3000))
    t = {"big": spark.createDataFrame([(i, f"v{i}") for i in base], "id long, name string"),
         "part": spark.createDataFrame([(i, f"v{i}") for i in rng.sample(base, 700)] + [(None, None)] * 3, "ref int, label string"),
         "stray": spark.createDataFrame([(2 * i, f"w{i}") for i in rng.sample(base[:1400], 700)] + [(2999, "v1")], "ref int, label string"),
         "other": spark.createDataFrame([(i + 0, f"u{i}") for i in range(0, 3000, 2)], "id long, name string")}
    p = profile_tables(spark, t, "db")
    found = {tuple(r)[:4] for r in p.inclusions.collect()}
    want = set()
    cols = {(n, c): {r[0] for r in df.select(c).collect() if r[0] is not None} for n, df in t.items() for c in df.columns}
    unique = {k for k, v in cols.items() if len(v) == t[k[0]].count()}
    for a in cols:
        for b in unique:
            kind = lambda k: "s" if isinstance(next(iter(cols[k])), str) else "i"
            if a != b and kind(a) == kind(b) and cols[a] <= cols[b]:
                want.add((*a, *b))
    assert found == want
    checks = {tuple(r)[:4]: r["state"] for r in p.inclusion_checks.collect()}
    assert want <= {k for k, s in checks.items() if s == "checked"}
    assert any(s == "refuted" for s in checks.values())
    # the figures alone would have left the refuted ones to the full check
    assert not want & {k for k, s in checks.items() if s == "refuted"}


def test_columns_meet_by_range_as_all_pairs_would(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lo = rng.choice([rng.randrange(-50, 50), rng.randrange(-2**63, 2**63 - 1), 0, 7])
        hi = min(lo + rng.choice([0, 1, 60, 2**40, 2**62]), 2**63 - 1)
        rows.append((i, rng.choice(["integral", "string"]), lo, hi, rng.randrange(1, 9), rng.random() < 0.5))
    meta = spark.createDataFrame([(r[0], "t", f"c{r[0]}", r[1]) for r in rows], "col_id int, table string, column string, family string")
    stats = spark.createDataFrame([(r[0], r[2], r[3], r[4], r[5]) for r in rows], "col_id int, min_code long, max_code long, unique_count long, is_candidate_key boolean")
    got = [(r["fk_col_id"], r["key_col_id"]) for r in keys.column_pairs(meta, stats).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows
            if a[0] != b[0] and a[1] == b[1] and b[5] and a[4] <= b[4] and b[2] <= a[2] and a[3] <= b[3]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_only_pairs_that_sketches_leave_are_checked(spark):
    a = spark.range(0, 4000, 2).select(F.col("id").alias("even"))
    b = spark.range(1, 4000, 2).select(F.col("id").alias("odd")).union(spark.range(-1, 0)).union(spark.range(4001, 4002))
    p = profile_tables(spark, {"a": a, "b": b}, "db")
    checks = {(r["fk_column"], r["key_column"]): r["state"] for r in p.inclusion_checks.collect()}
    assert checks == {("even", "odd"): "refuted"} and p.inclusions.count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_composite_keys_equal_a_search_over_all_sets(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.randrange(6), rng.randrange(6), rng.randrange(3), rng.randrange(4), rng.choice([None, 1, 2]), 7) for _ in range(rng.randrange(1, 40))})
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    got = {tuple(r["columns"]) for r in composite_candidate_keys(spark, {"t": df, "empty": df.limit(0)}, "db", 4, sample_one_in=3, sets_per_job=5).collect()}
    full = [i for i in range(6) if all(r[i] is not None for r in rows)]
    want: list[set] = []
    for n in range(1, 5):
        for some in combinations(full, n):
            if len({tuple(r[i] for i in some) for r in rows}) == len(rows) and not any(w <= set(some) for w in want):
                want.append(set(some))
    assert got == {tuple(names[i] for i in sorted(w)) for w in want if len(w) > 1}


def test_composite_keys_of_the_given_tables(spark, sf):
    import duckdb

    from colscope.plans.oracle import composite_keys_sql

    got = {(r["table"], ", ".join(r["columns"])) for r in composite_candidate_keys(spark, fx.all_tables(spark, sf), "db").collect()}
    con = duckdb.connect()
    for t in fx.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert got == set(con.execute(composite_keys_sql()).fetchall()) and len(got) > 2


def test_stats_come_from_the_sketch_rows(spark):
    df = spark.createDataFrame([(i % 50, None if i % 4 else str(i)) for i in range(900)], "k int, v string")
    meta = table_columns_meta("db", {"t": df})
    sketch = exact_column_sketches({"t": df}, meta)
    assert sketch.groupBy("col_id").count().agg(F.max("count")).first()[0] <= keys.SKETCH_SLOTS + 1
    got = {r["col_id"]: r for r in stats_of_sketches(sketch).collect()}
    assert (got[0]["row_count"], got[0]["non_null"], got[0]["distinct_count"], got[0]["min_code"], got[0]["max_code"]) == (900, 900, 50, 0, 49)
    assert (got[1]["row_count"], got[1]["non_null"], got[1]["distinct_count"]) == (900, 225, 225)
    least = fingerprints({"t": df}, meta, {0}).groupBy(keys.value_hash().bitwiseAND(keys.SKETCH_SLOTS - 1)).agg(F.min(keys.value_hash()))
    assert {r[1] for r in least.collect()} == {r["low"] for r in sketch.where("col_id = 0").collect()}


def test_states_are_united_without_the_old_rows(spark, sf):
    """Three parts, one of them twice: rows add up, estimates are those of the whole."""
    li = fx.read(spark, sf, "lineitem").withColumn("void", F.lit(None).cast("string")).withColumn("m", F.create_map(F.lit("k"), F.col("l_linenumber")))
    root = f"{ensure_checkpoint_dir(spark)}/states-{random.random()}"
    for part in range(3):
        some = li.where(F.pmod("l_orderkey", F.lit(3)) == part)
        states = sketches.update_states(spark, root, sketches.column_states({"li": some}, "db"), "db")
    got = {r["column"]: r for r in sketches.estimates(states).collect()}
    exact = li.agg(*[F.countDistinct(c).alias(c) for c in li.columns if c != "m"]).first().asDict() | {"m": 7}
    for c, n in exact.items():
        assert got[c]["row_count"] == li.count() and abs(got[c]["distinct_estimate"] - n) <= max(1, 0.1 * n), c
    assert got["void"]["null_ratio"] == 1 and got["l_tax"]["null_ratio"] == 0
    again = sketches.united(states, sketches.column_states({"li": li}, "db"))
    twice = {r["column"]: r for r in sketches.estimates(again).collect()}
    assert twice["l_orderkey"]["row_count"] == 2 * li.count() and twice["l_orderkey"]["distinct_estimate"] == got["l_orderkey"]["distinct_estimate"]
    # a table that a later part does not hold keeps its state
    sketches.update_states(spark, root, sketches.column_states({"n": spark.range(5)}, "db"), "db")
    assert {r["table"] for r in sketches.update_states(spark, root, sketches.column_states({"n": spark.range(5, 9)}, "db"), "db").collect()} == {"li", "n"}


def test_jdbc_reads_are_split_by_default():
    from colscope.sources import tables

    assert tables.jdbc_range_options("id", 1, 900, 8) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "900", "numPartitions": "8"}
    assert tables.jdbc_range_options("id", None, None, 8) == {} == tables.jdbc_range_options("id", 3, 3, 8)
    assert tables.jdbc_range_options("day", dt.date(2024, 1, 1), dt.date(2024, 2, 1), 4)["upperBound"] == "2024-02-01"
    assert tables.jdbc_bounds_query("s.t", "id") == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM s.t"
    parts = tables.jdbc_hash_predicates("code", 3, "MOD(ABS(HASHTEXT({column})), {n})")
    assert parts == ["MOD(ABS(HASHTEXT(code)), 3) = 0 OR code IS NULL", "MOD(ABS(HASHTEXT(code)), 3) = 1", "MOD(ABS(HASHTEXT(code)), 3) = 2"]


def test_a_jdbc_read_looks_its_bounds_up(monkeypatch):
    """Only the options are built; no database is asked."""
    from colscope.sources import tables

    class Reader:
        def __init__(self):
            self.opts = {}

        def format(self, _):
            return Reader()

        def option(self, k, v):
            self.opts[k] = v
            return self

        def options(self, **kw):
            self.opts.update(kw)
            return self

        def load(self):
            return self

        def first(self):
            assert self.opts["query"] == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM t"
            return (1, 100)

    class Spark:
        read = Reader()

    got = tables.load_jdbc_table(Spark(), "jdbc:x", "t", "id", upper=50, num_partitions=4, properties={"user": "u"}).opts
    assert got == {"url": "jdbc:x", "user": "u", "dbtable": "t", "partitionColumn": "id", "lowerBound": "1", "upperBound": "50", "numPartitions": "4"}
    assert tables.load_jdbc_table(Spark(), "jdbc:x", "t").opts == {"url": "jdbc:x", "dbtable": "t"}


def test_comments_reach_documents_and_requests(spark):
    from colscope.operators.annotate import column_requests
    from colscope.operators.documents import table_documents
    from colscope.sources.tables import catalog_comments, catalog_tables

    spark.sql(f"CREATE DATABASE commented LOCATION '{ensure_checkpoint_dir(spark)}/commented-{random.random()}'")
    try:
        spark.range(3).write.saveAsTable("commented.t")
        spark.sql("COMMENT ON TABLE commented.t IS 'three rows'")
        comments = catalog_comments(spark, "commented")
        assert comments == {"t": "three rows"}
        p = profile_tables(spark, catalog_tables(spark, "commented"), "commented", comments=comments)
        assert p.tables.first()["comment"] == "three rows"
        assert "three rows" in table_documents(p.tables, p.columns).first()["document"]
        assert "three rows" in column_requests(p.tables, p.columns).first()["request"]
    finally:
        spark.sql("DROP DATABASE commented CASCADE")


def test_reconcile_reads_the_details_once(spark, sf):
    from colscope.operators.execute import reconcile

    li = fx.read(spark, sf, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = reconcile(li, ["l_returnflag", "l_linestatus", "l_linenumber"], "amount")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = out.collect()
    assert {r["level"] for r in rows} == {0, 1, 2} and all(r["ok"] and r["total"] == r["parts_sum"] for r in rows)
    odd = spark.createDataFrame([(None, "a", 1), (None, None, 2), ("x", None, None), ("x", "b", 4)], "k string, l string, m long")
    got = {(r["level"], r["k"]): (r["total"], r["parts_sum"]) for r in reconcile(odd, ["k", "l"], "m").collect()}
    assert got == {(0, None): (7, 7), (1, None): (3, 3), (1, "x"): (4, 4)}


def test_a_vector_costs_time_by_its_terms_not_their_square(spark):
    """The norm of V1 is taken once per text: twenty times the terms take far less than twenty squared times as long."""
    import time

    from colscope.operators.vectors import packed_terms

    def seconds(words, rows):
        df = spark.range(rows).select(F.col("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), i))).alias("text"))
        run = lambda: packed_terms(df, "id", "text", 1 << 20).write.format("noop").mode("overwrite").save()
        run()
        t = time.time()
        run()
        return time.time() - t

    assert seconds(4000, 100) < 4 * seconds(200, 2000) + 1


def test_composite_keys_look_at_all_rows_by_one_hash(spark, monkeypatch):
    """Sets that pass the sample: rows leave with one hash; of a set with a row twice only those are compared by both."""
    rows = [(i % 100, i // 100, i % 7) for i in range(3000)] + [(5, 40, 1), (5, 40, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    texts = spark.createDataFrame([("x", [1.0])] * 3, "t string, v array<double>")
    seen, counted = [], []
    real, stats = keys.kept, keys.composite_keys
    monkeypatch.setattr(keys, "kept", lambda d, name: seen.append((name, d.columns)) or real(d, name))
    monkeypatch.setattr("colscope.operators.profile.composite_keys", lambda s, t, columns, *a, **o: counted.extend(columns) or stats(s, t, columns, *a, **o))
    got = {(r["table"], tuple(r["columns"])) for r in composite_candidate_keys(spark, {"t": df, "u": texts}, "db", sample_one_in=1 << 20).collect()}
    assert got == {("t", ("a", "b", "c"))}
    assert ("shared-hashes", ["set_id", "f1"]) in seen
    assert {c[0] for c in counted} == {"t"}        # texts and vectors can be part of no key
