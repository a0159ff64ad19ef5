import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import search
from colscope.operators.vectors import cosine_topk, packed_terms


def _items(spark, rows):
    return spark.createDataFrame(
        rows, "id string, type string, database string, table string, column string, data_type string, "
              "business_name string, vector array<double>")


def test_cosine_topk_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 16))
    Q = rng.normal(size=(23, 16))
    items = spark.createDataFrame([(int(i), X[i].tolist()) for i in range(len(X))], "id long, vector array<double>")
    qs = spark.createDataFrame([(int(i), Q[i].tolist()) for i in range(len(Q))], "query_id long, vector array<double>")
    got = cosine_topk(items, qs, 7, items_per_block=60, queries_per_block=4).collect()
    # tiny chunks: the running top-k merge across chunks gives the same answer
    small = cosine_topk(items, qs, 7, items_per_block=150, chunk_cells=50).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    S = Qn @ Xn.T
    for r in got:
        exp = np.argsort(-S[r["query_id"]], kind="stable")[r["rank"] - 1]
        assert r["id"] == exp
        assert abs(r["score"] - S[r["query_id"], exp]) < 1e-9
    assert len(got) == 23 * 7


def test_topk_ties_break_by_id_and_larger_k_contains_smaller(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(99, [0.0, 1.0])],
                                  "id long, vector array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    a = [r["id"] for r in cosine_topk(items, qs, 5, items_per_block=7).orderBy("rank").collect()]
    b = [r["id"] for r in cosine_topk(items, qs, 9, items_per_block=7).orderBy("rank").collect()]
    assert a == [0, 1, 2, 3, 4] and b[:5] == a


def test_sparse_equals_dense(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b b d"), (3, "e f"), (4, "a a a")], "id long, text string")
    qs = spark.createDataFrame([(10, "a b"), (11, "f")], "qid long, text string")
    dv, qv = packed_terms(docs, "id", "text", 64), packed_terms(qs, "qid", "text", 64)
    sp = {(r["query_id"], r["id"]): r["score"] for r in
          cosine_topk(dv, qv.withColumnRenamed("id", "query_id"), 4, sparse_dim=64).collect()}

    def dense(df):
        rows = {}
        for r in df.collect():
            v = rows.setdefault(r["id"], [0.0] * 64)
            for i, w in zip(r["idx"], r["val"]):
                v[i] += w
        return rows
    d, q = dense(dv), dense(qv)
    for (qi, di), s in sp.items():
        assert abs(s - float(np.dot(q[qi], d[di]))) < 1e-9


def _fixture(spark):
    # t1 table item close to the query; t2 table item far
    rows = [
        ("db.t1", "table", "db", "t1", None, None, "T1", [1.0, 0.1, 0.0]),
        ("db.t1.a", "column", "db", "t1", "a", "int", "A", [0.9, 0.2, 0.0]),
        ("db.t2", "table", "db", "t2", None, None, "T2", [-1.0, 0.0, 0.0]),
        ("db.t2.b", "column", "db", "t2", "b", "int", "B", [0.95, 0.0, 0.1]),
        ("db.t3.c", "column", "db", "t3", "c", "int", "C", [0.0, 1.0, 0.0]),
    ]
    return _items(spark, rows), spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, -1.0])],
                                                      "query_id long, vector array<double>")


def test_fusion_boost_only_from_candidate_tables(spark):
    items, qs = _fixture(spark)
    res = {(r["query_id"], r["id"]): r for r in search.search(items, qs, top_k=10, n_candidates=4).collect()}
    a, b = res[(1, "db.t1.a")], res[(1, "db.t2.b")]
    assert a["table_boost"] > 0.9                 # t1 table item is a candidate
    assert b["table_boost"] == 0.0               # t2 table item scores < 0 -> clamped
    assert a["score"] == pytest.approx(a["original_score"] + a["table_boost"])
    assert all(r["score"] >= r["original_score"] for r in res.values())
    # filters after the cut: only columns, t1 still boosted
    f = search.search(items, qs, top_k=10, n_candidates=4, filter_type="column").collect()
    assert {r["type"] for r in f} == {"column"}
    assert [r for r in f if r["id"] == "db.t1.a" and r["query_id"] == 1][0]["table_boost"] > 0.9


def test_more_than_n_candidates_cut(spark):
    rows = [(f"db.t.c{i}", "column", "db", "t", f"c{i}", "int", "x", [1.0, float(i) / 100]) for i in range(60)]
    items = _items(spark, rows)
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert search.search(items, qs, top_k=100, n_candidates=40).count() == 40


def test_context_seen_logic(spark):
    res = spark.createDataFrame(
        [(1, 1, "column", "db", "t1", "a", "int", "A"), (1, 2, "table", "db", "t1", None, None, "T1"),
         (1, 3, "table", "db", "t2", None, None, "T2"), (1, 4, "column", "db", "t2", "b", "int", "B"),
         (1, 5, "column", "db", "t3", "c", "int", "C")],
        "query_id long, rank int, type string, database string, table string, column string, data_type string, "
        "business_name string")
    qs = res.select("query_id").distinct().union(res.sparkSession.createDataFrame([(2,)], "query_id long"))
    ctx = {r["query_id"]: r["context"] for r in search.context_text(res, qs).collect()}
    assert ctx[1].split("\n") == ["[column] t1.a (int): A", "[table] t2 (T2)", "  - b (int): B",
                                  "[column] t3.c (int): C"]
    assert ctx[2] == search.NO_CONTEXT


def test_ambiguity_gap_at_tolerance_and_ties(spark):
    c = spark.createDataFrame(
        [(1, "x1", 0.70, 1, "column", "db", "t1", "a"), (1, "x2", 0.60, 2, "column", "db", "t2", "b"),
         (1, "x3", 0.30, 3, "column", "db", "t3", "c"),
         (2, "y1", 0.90, 1, "column", "db", "t1", "a"), (2, "y2", 0.50, 2, "column", "db", "t2", "b"),
         (3, "z1", 0.50, 1, "column", "db", "t1", "a"), (3, "z2", 0.50, 2, "column", "db", "t1", "b"),
         (3, "z3", 0.50, 3, "column", "db", "t2", "c")],
        "query_id long, id string, score double, cand_rank int, type string, database string, table string, "
        "column string").withColumn("data_type", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("int")) \
        .withColumn("business_name", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("n"))
    out = search.ambiguity(c, min_score=0.45, gap_tolerance=0.10).collect()
    q1 = sorted((r["rank"], r["table"]) for r in out if r["query_id"] == 1)
    assert q1 == [(1, "t1"), (2, "t2")]         # gap 0.10 <= tolerance; t3 below min score
    assert not [r for r in out if r["query_id"] == 2]
    q3 = sorted((r["rank"], r["table"], r["column"]) for r in out if r["query_id"] == 3)
    assert q3 == [(1, "t1", "a"), (2, "t2", "c")]   # tie inside t1: first seen wins


def test_text_search_over_catalogue(spark, sf):
    from colscope.operators.documents import index_items
    from colscope.plans.registry import annotated_catalog
    tabs, cols = annotated_catalog(spark, sf)
    items = index_items(tabs, cols)
    qs = spark.createDataFrame([(1, "orders o_totalprice totalprice"), (2, "customer c_name")], "query_id long, text string")
    res = search.text_search(items, qs, top_k=5).collect()
    top5 = {q: [r["id"] for r in sorted(res, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2)}
    assert "testdata.orders.o_totalprice" in top5[1]
    assert any(i.startswith("testdata.customer") for i in top5[2])
    ctx = {r["query_id"]: r["context"] for r in search.context_text(
        search.text_search(items, qs, top_k=5), qs).collect()}
    assert "customer" in ctx[2]


def test_rows_without_tokens_or_vectors(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "!!"), (3, None), (4, "b")], "id int, text string")
    got = {r["id"]: r for r in packed_terms(texts, "id", "text", 64).collect()}
    assert len(got) == 4 and got[2]["idx"] == [] and got[3]["val"] == []
    assert abs(sum(v * v for v in got[1]["val"]) - 1) < 1e-12
    plan = packed_terms(texts, "id", "text", 64)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    top = cosine_topk(packed_terms(texts, "id", "text", 64), packed_terms(texts, "id", "text", 64).withColumnRenamed("id", "query_id"),
                      4, sparse_dim=64).collect()
    assert {(r["query_id"], r["id"]) for r in top} == {(q, i) for q in (1, 2, 3, 4) for i in (1, 2, 3, 4)}
    dense = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0, 1.0])], "id int, vector array<double>")
    top = cosine_topk(dense, dense.withColumnRenamed("id", "query_id"), 2).collect()
    assert {(r["query_id"], r["id"]) for r in top} == {(1, 1), (3, 3)}


def test_building_a_profile_input_runs_no_job(spark):
    from colscope.operators.vectors import term_vectors
    from colscope.plans.sizing import dealt

    df = spark.range(100).groupBy((F.col("id") % 7).alias("id")).agg(F.count("*").alias("n")).withColumn("text", F.lit("a b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "")
    dealt(df), term_vectors(df, "id", "text")
    assert list(tracker.getJobIdsForGroup("build-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_topk_moves_no_item_vector_and_runs_nothing_while_built(spark, tmp_path):
    """Exchanges of the plan carry questions or scores only, broadcast or not; building runs no job."""
    rng = np.random.default_rng(4)
    spark.createDataFrame([(f"i{i % 90}", rng.normal(size=8).tolist()) for i in range(400)], "id string, vector array<float>").repartition(5).write.parquet(f"{tmp_path}/i")
    items = spark.read.parquet(f"{tmp_path}/i")
    made = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "query_id long, vector array<float>")
    made.write.parquet(f"{tmp_path}/q")
    qs = spark.read.parquet(f"{tmp_path}/q")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("topk-build", "")
    plans = [cosine_topk(items, qs, 6), cosine_topk(items, qs, 6, broadcast_bytes=100, queries_per_block=9)]
    assert list(tracker.getJobIdsForGroup("topk-build")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in plans:
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        at = next(i for i, x in enumerate(lines) if "NestedLoopJoin" in x or "CartesianProduct" in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        inner = [x for x in lines[at + 1:] if depth(x) > depth(lines[at])]
        left = inner[:next(i for i, x in enumerate(inner) if i and depth(x) == depth(inner[0]))]
        assert any("i_val" in x for x in left)
        assert not any("Exchange" in x for x in left)      # items: read and packed
    assert "BroadcastNestedLoopJoin" in plans[0]._jdf.queryExecution().executedPlan().toString()
    first, second, third = (sorted(map(tuple, p.collect())) for p in (*plans, cosine_topk(items, made, 6)))
    assert first == second == third and len(first) == 240


def test_topk_lets_kept_scores_go(spark, monkeypatch):
    from colscope.operators import vectors

    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, vector array<double>").coalesce(1)
    qs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(10)], "query_id long, vector array<double>")
    want = sorted(map(tuple, cosine_topk(items, qs, 3).collect()))
    monkeypatch.setattr(vectors, "STATE_CELLS", 1)
    assert sorted(map(tuple, cosine_topk(items, qs, 3, items_per_block=20).collect())) == want


def _lines(df):
    """(depth, text) of the lines of a frame's plan."""
    text = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(len(x) - len(x.lstrip(" :+-")), x) for x in text]


def test_topk_sorts_no_scores_before_they_are_dealt_by_question(spark):
    """A task gives a row per question; only what has been dealt by question is sorted."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    items, qs = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(rows[:9], "query_id long, vector array<double>")
    lines = _lines(cosine_topk(items, qs, 3))
    dealt_at = next(i for i, (_, x) in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert not any("Sort" in x or "WindowGroupLimit" in x for _, x in lines[dealt_at + 1:])


def test_fusion_finds_its_candidates_once(spark):
    rng = np.random.default_rng(7)
    items = _items(spark, [(f"d.t{i % 3}" + (f".c{i}" if i > 2 else ""), "table" if i < 3 else "column", "d" if i % 7 else None, f"t{i % 3}", f"c{i}" if i > 2 else None,
                            "float", f"b{i}", rng.normal(size=4).tolist()) for i in range(40)] + [("d.t0", "table", "d", "t0", None, None, "twice", [1.0, 0.0, 0.0, 0.0])])
    qs = spark.createDataFrame([(i if i else None, rng.normal(size=4).tolist()) for i in range(6)], "query_id long, vector array<double>")
    cands = search.candidates(items, qs, 30)
    got = search.fuse(cands, 12)
    assert sum("NestedLoopJoin" in x or "CartesianProduct" in x for _, x in _lines(got)) == 1
    # the same as a join with the tables among the candidates, a row per match
    rows = [r.asDict() for r in cands.collect()]
    want = []
    for r in rows:
        own = [max(t["score"], 0.0) for t in rows if t["type"] == "table" and all(t[c] is not None and t[c] == r[c] for c in ("query_id", "database", "table"))]
        for boost in own or [0.0]:
            boost = boost if r["type"] == "column" else 0.0
            want.append((r["query_id"], r["id"], r["cand_rank"], round(max(r["score"], 0.0) + boost, 9)))
    key = lambda x: (x[0] is not None, x[0], -x[3], x[2])
    best = {}
    for x in sorted(want, key=key):
        if len(best.setdefault(x[0], [])) < 12:
            best[x[0]].append(x[3])
    have = {}
    for r in got.orderBy("rank").collect():
        have.setdefault(r["query_id"], []).append(round(r["score"], 9))
    assert have == best


def test_topk_keeps_its_bound_when_it_lets_scores_go():
    import pyarrow as pa
    from colscope.operators.vectors import _Best

    best = _Best(pa.array([7, None]), 2)
    best.add(np.array([[0.9, 0.8, 0.1], [0.5, 0.5, 0.5]]), np.array([3, 4, 5]))
    rows = [r for b in best.batches(pa.int64()) for r in b.to_pylist()]
    assert [(r["_qid"], sorted((t["_iid"], t["score"]) for t in r["_top"])) for r in rows] == [(7, [(3, 0.9), (4, 0.8)]), (None, [(3, 0.5), (4, 0.5)])]
    best.add(np.array([[0.7, 0.2], [0.4, 0.6]]), np.array([1, 2]))      # only the last one can still count
    assert [[(t["_iid"], t["score"]) for t in r["_top"]] for b in best.batches(pa.int64()) for r in b.to_pylist()] == [[], [(2, 0.6)]]
    assert best.cells == 0
