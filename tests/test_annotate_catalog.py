from colscope.operators import annotate, catalog


def _catalog(spark):
    tables = spark.createDataFrame(
        [("db", "t1", None, 10, None, None, None, []), ("db", "t2", None, 0, None, "Two", "d2", [])],
        "database string, table string, schema string, row_count bigint, comment string, business_name string, "
        "description string, primary_keys array<string>")
    columns = spark.createDataFrame(
        [("db", "t1", 1, "a", "int", True, None, True, False, None, None, ["1", "2"], 0.0, 2, None, None, []),
         ("db", "t1", 2, "b", "string", False, None, False, True, "t2.x", None, [], 0.5, None, None, None, []),
         ("db", "t2", 1, "x", "int", True, None, False, False, None, None, ["7"], 0.0, 1, "X", "xd", ["k"])],
        "database string, table string, position int, column string, data_type string, nullable boolean, "
        "default string, is_primary_key boolean, is_foreign_key boolean, foreign_key_ref string, comment string, "
        "sample_values array<string>, null_ratio double, unique_count bigint, business_name string, "
        "description string, keywords array<string>")
    return tables, columns


def test_parse_states(spark):
    df = spark.createDataFrame([(1, '{"business_name": "A", "keywords": ["k"]}'), (2, "```json\n{}\n```"),
                                (3, "{broken"), (4, "[1]"), (5, None)], "key int, reply string")
    r = {x["key"]: x for x in annotate.parse_replies(df).collect()}
    assert r[1]["state"] == "ok" and r[1]["business_name"] == "A" and r[1]["keywords"] == ["k"]
    assert r[2]["state"] == "ok" and r[2]["business_name"] is None
    assert r[3]["state"] == "invalid"
    assert r[4]["state"] == "not_object"
    assert r[5]["state"] == "invalid"


def test_merge_defaults_and_failures(spark):
    tables, columns = _catalog(spark)
    replies = spark.createDataFrame(
        [("db", "t1", "a", '{"description": "da"}'), ("db", "t1", "b", "[1]")],
        "database string, table string, column string, reply string")
    out = {r["column"]: r for r in annotate.merge_column_replies(columns, annotate.parse_replies(replies)).collect()}
    assert out["a"]["business_name"] == "a" and out["a"]["description"] == "da" and out["a"]["keywords"] == []
    assert out["b"]["business_name"] is None          # failed reply: untouched
    assert out["x"]["business_name"] == "X"           # no reply: untouched


def test_strict_table_merge_raises(spark):
    tables, _ = _catalog(spark)
    replies = spark.createDataFrame([("db", "t1", None, '{"business_name": "One"}')],
                                    "database string, table string, column string, reply string")
    parsed = annotate.parse_replies(replies, schema=annotate.TABLE_REPLY)
    try:
        annotate.merge_table_replies(tables, parsed, strict=True)
        raise AssertionError("expected failure for t2 without reply")
    except ValueError:
        pass
    out = {r["table"]: r for r in annotate.merge_table_replies(tables, parsed, strict=False).collect()}
    assert out["t1"]["business_name"] == "One" and out["t1"]["description"] == ""


def test_edit_semantics(spark):
    tables, columns = _catalog(spark)
    edits = spark.createDataFrame(
        [(1, "db", "t1", "First", None, "a", None, "col a"),
         (2, "db", "t1", "Later", None, None, None, None),
         (3, "db", "nope", "x", None, None, None, None),
         (4, "db", "t1", None, "desc", "zz", "y", None),
         (5, "db", "t1", None, None, None, None, None),
         (6, "db", "t1", "", "", None, "", "")],
        "seq int, database string, table string, business_name string, description string, column string, "
        "column_business_name string, column_description string")
    t, c, rep = catalog.edit_catalog(tables, columns, edits)
    t1 = [r for r in t.collect() if r["table"] == "t1"][0]
    assert t1["business_name"] == "Later" and t1["description"] == "desc"
    a = [r for r in c.collect() if r["column"] == "a"][0]
    assert a["description"] == "col a"
    rep = {r["seq"]: r for r in rep.collect()}
    assert rep[3]["table_found"] is False and rep[3]["applied"] is False
    assert rep[4]["column_found"] is False and rep[4]["applied"] is True
    assert rep[5]["refused"] is True and rep[6]["refused"] is True
    # an all-null edit changes nothing
    t2, c2, _ = catalog.edit_catalog(tables, columns, edits.where("seq = 5"))
    assert sorted(map(tuple, t2.collect())) == sorted(map(tuple, tables.collect()))


def test_overview_detail_schema_text(spark):
    tables, columns = _catalog(spark)
    ov = {r["table"]: r for r in catalog.overview(tables, columns).collect()}
    assert ov["t1"]["row_count_text"] == "10" and ov["t2"]["row_count_text"] == "-"
    assert ov["t1"]["business_name"] == "-" and ov["t1"]["column_count"] == 2
    raw = {r["table"]: r["text"] for r in catalog.schema_text(tables, columns, "raw").collect()}
    assert raw["t1"] == "TABLE t1\n  a int; key\n  b string; references t2.x; required"
    full = {r["table"]: r["text"] for r in catalog.schema_text(tables, columns, "full").collect()}
    assert full["t2"] == "TABLE t2: Two\nd2\n  x int; means X; values 7"
    det = {r["column"]: r for r in catalog.table_detail(columns).collect()}
    assert det["a"]["flags"] == "PK" and det["b"]["flags"] == "FK" and det["a"]["samples_text"] == "1, 2"


def test_model_hook_and_skip_broken_table(spark):
    tables, columns = _catalog(spark)
    req = annotate.column_requests(tables, columns)

    def fake_model(texts):
        import json

        return [json.dumps({"business_name": json.loads(t)["item"].split(".")[1].upper()}) for t in texts]

    replies = annotate.call_model(req, fake_model)
    out = {r["column"]: r["business_name"] for r in
           annotate.merge_column_replies(columns, annotate.parse_replies(replies)).collect()}
    assert out == {"a": "A", "b": "B", "x": "X"}
    from colscope.operators.profile import profile_tables
    good = spark.createDataFrame([(1,)], "k int")

    class Broken:
        @property
        def schema(self):
            raise RuntimeError("cannot read")

    import warnings
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        p = profile_tables(spark, {"good": good, "broken": Broken()}, "db")
    assert [r["table"] for r in p.tables.collect()] == ["good"]
    assert any("broken" in str(x.message) for x in w)


def test_dense_embedding_hook(spark):
    from colscope.operators.vectors import cosine_topk, with_embeddings
    docs = spark.createDataFrame([(1, "aa"), (2, "bbbb"), (3, "aaa")], "id long, text string")

    def enc(texts):
        return [[t.count("a"), t.count("b")] for t in texts]

    v = with_embeddings(docs, "text", enc)
    q = with_embeddings(spark.createDataFrame([(9, "a")], "query_id long, text string"), "text", enc)
    top = [r["id"] for r in cosine_topk(v, q, 2).orderBy("rank").collect()]
    assert top == [1, 3]


def test_last_of_several_replies(spark):
    tables, columns = _catalog(spark)
    parsed = spark.createDataFrame([(2, "db", "t1", "a", "ok", "New", None, None), (1, "db", "t1", "a", "ok", "Old", None, None)],
                                   "seq int, database string, table string, column string, state string, business_name string, "
                                   "description string, keywords array<string>")
    out = annotate.merge_column_replies(columns, parsed).collect()
    assert len(out) == columns.count() and [r["business_name"] for r in out if r["column"] == "a"] == ["New"]


def test_a_table_that_fails_while_reading_does_not_end_the_profile(spark, tmp_path):
    import warnings

    from colscope.operators.profile import profile_tables

    path = str(tmp_path / "bad.parquet")
    spark.range(5).write.parquet(path)
    bad = spark.read.parquet(path)
    for f in (tmp_path / "bad.parquet").glob("part-*"):
        f.write_bytes(b"not parquet")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        p = profile_tables(spark, {"good": spark.createDataFrame([(1,), (2,)], "k int"), "bad": bad}, "db")
    assert any("bad" in str(w.message) for w in seen)
    assert [r["table"] for r in p.columns.select("table").distinct().collect()] == ["good"]
    assert p.columns.first()["unique_count"] == 2


def test_decimal_inclusion(spark):
    from colscope.operators.profile import profile_tables

    key = spark.createDataFrame([(i,) for i in range(50)], "v int").selectExpr("CAST(v / 4.0 AS DECIMAL(12,2)) AS d", "CAST(v AS BIGINT) AS b")
    fk = spark.createDataFrame([(i,) for i in (3, 9, 12, 12)], "v int").selectExpr("CAST(v / 4.0 AS DECIMAL(14,4)) AS d", "CAST(v AS BIGINT) AS b")
    got = {(r["fk_table"], r["fk_column"], r["key_table"], r["key_column"]) for r in profile_tables(spark, {"k": key, "f": fk}, "db").inclusions.collect()}
    assert ("f", "d", "k", "d") in got and ("f", "b", "k", "b") in got
