"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame
whose columns match the DuckDB text of the same name in
``colscope.plans.oracle.oracle_queries``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import canonical_text, name_variants
from colscope.operators import annotate, catalog, documents, examples, execute, guard, search, sketches
from colscope.operators.profile import column_stats, composite_candidate_keys, distinct_counts, null_stats, profile_tables
from colscope.operators.vectors import cosine_topk, packed_terms, term_vectors
from colscope.plans import fixtures as fx
from colscope.session import ensure_checkpoint_dir
from colscope.sources import store
from colscope.sources.tables import register_views, schema_columns, table_columns_meta

R6 = 6   # scores are compared at 6 decimals


# ------------------------------------------------------------------ helpers
def _profile(spark, sf_dir, **kw):
    return profile_tables(spark, fx.profile_inputs(spark, sf_dir), fx.DB, **kw)


def _named(p, df):
    return df.join(p.meta.select("col_id", "table", "position", "column"), "col_id")


def annotated_catalog(spark: SparkSession, sf_dir: str, annotated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Profile of the 14 given tables, merged with the model-reply fixtures."""
    p = profile_tables(spark, fx.all_tables(spark, sf_dir), fx.DB, inclusions=False,
                       primary_keys=fx.PRIMARY_KEYS, foreign_keys=fx.FOREIGN_KEYS, comments=fx.TABLE_COMMENTS)
    if not annotated:
        return p.tables, p.columns
    cols = annotate.merge_column_replies(p.columns, annotate.parse_replies(fx.column_replies(p.columns)))
    tabs = annotate.merge_table_replies(
        p.tables, annotate.parse_replies(fx.table_replies(p.tables), schema=annotate.TABLE_REPLY), strict=False)
    return tabs, cols


def _store_root(spark: SparkSession) -> str:
    """A fresh folder under the session's checkpoint folder (shared on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), f"colscope-store-{uuid.uuid4().hex}")


def _txt(c: str) -> F.Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")


# ------------------------------------------------------------------ P
def q_load_counts(spark, sf_dir):
    tabs = fx.all_tables(spark, sf_dir)
    register_views(tabs)
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table"), F.lit(len(df.columns)).alias("column_count"), "row_count")
             for t, df in sorted(tabs.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_schema_columns(spark, sf_dir):
    return schema_columns(spark, fx.DB, fx.all_tables(spark, sf_dir)).select(
        "database", "table", "position", "column", "data_type", "nullable")


def _null_stats(spark, sf_dir):
    tabs = fx.profile_inputs(spark, sf_dir)
    meta = table_columns_meta(fx.DB, tabs)
    m = spark.createDataFrame([(r[8], r[1], r[2], r[3]) for r in meta],
                              "col_id int, table string, position int, column string")
    return null_stats(tabs, meta).join(m, "col_id")


def q_row_counts(spark, sf_dir):
    return _null_stats(spark, sf_dir).where(F.col("position") == 1).select("table", "row_count")


def q_sample_values(spark, sf_dir):
    p = _profile(spark, sf_dir, inclusions=False)
    return _named(p, p.samples).select("table", "column", "position", F.col("rank").cast("bigint"), "value")


def q_null_ratio(spark, sf_dir):
    return _null_stats(spark, sf_dir).select("table", "column", "row_count", "nulls", "null_ratio")


def q_distinct_count(spark, sf_dir):
    p = _profile(spark, sf_dir, inclusions=False)
    return _named(p, p.stats).select("table", "column", "unique_count")


def q_distinct_count_approx(spark, sf_dir):
    tabs = fx.profile_inputs(spark, sf_dir)
    meta = table_columns_meta(fx.DB, tabs)
    m = spark.createDataFrame([(r[8], r[1], r[3]) for r in meta], "col_id int, table string, column string")
    return (column_stats(tabs, meta, approx=True).join(m, "col_id")
            .select("table", "column", F.col("approx_distinct")))


def _typed_lineitem(spark, sf_dir):
    li = fx.read(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("t_decimal"),
        "l_shipdate", F.col("l_shipdate").cast("date").alias("t_date"),
        (F.col("l_returnflag") == "R").alias("t_bool"),
        F.encode(F.concat("l_returnflag", "l_linestatus"), "UTF-8").alias("t_bytes"),
        "l_linestatus")


def q_canonical_text(spark, sf_dir):
    df = _typed_lineitem(spark, sf_dir)
    return df.select(*[canonical_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def q_candidate_keys(spark, sf_dir):
    p = profile_tables(spark, fx.all_tables(spark, sf_dir), fx.DB, inclusions=False)
    return p.keys.select("table", "column")


def q_candidate_keys_composite(spark, sf_dir):
    found = composite_candidate_keys(spark, fx.all_tables(spark, sf_dir), fx.DB)
    return found.select("table", F.array_join("columns", ", ").alias("columns"))


def q_inclusion_keys(spark, sf_dir):
    p = profile_tables(spark, fx.all_tables(spark, sf_dir), fx.DB)
    return p.inclusions


def _within(m, counted, exact):
    """``within``: the counted number of distinct values is at most 10 % or one value off the exact one."""
    gap = F.abs(F.coalesce("counted", F.lit(0)) - F.coalesce("distinct_count", F.lit(0)))
    return (m.join(counted, ["table", "column"]).join(exact, "col_id", "left")
            .select("table", "column", (gap <= F.greatest(F.lit(1.0), 0.1 * F.coalesce("distinct_count", F.lit(0)))).alias("within")))


def _columns_of(spark, tabs):
    meta = table_columns_meta(fx.DB, tabs)
    return meta, spark.createDataFrame([(r[8], r[1], r[3]) for r in meta], "col_id int, table string, column string")


def q_distinct_count_approx_within(spark, sf_dir):
    """Approximate against exact distinct counts."""
    tabs = fx.all_tables(spark, sf_dir)
    meta, m = _columns_of(spark, tabs)
    approx = column_stats(tabs, meta, approx=True).join(m, "col_id").select("table", "column", F.col("approx_distinct").alias("counted"))
    return _within(m, approx, distinct_counts(tabs, meta))


def q_distinct_count_merged(spark, sf_dir):
    """Stored sketches of one half of every table, updated by those of the other half, against exact counts."""
    tabs = fx.all_tables(spark, sf_dir)
    meta, m = _columns_of(spark, tabs)
    root = os.path.join(_store_root(spark), "states")
    for half in (0, 1):
        part = {t: df.where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == half) for t, df in tabs.items()}
        states = sketches.update_states(spark, root, sketches.column_states(part, fx.DB), fx.DB)
    counted = sketches.estimates(states).select("table", "column", F.col("distinct_estimate").alias("counted"))
    return _within(m, counted, distinct_counts(tabs, meta))


def q_inclusion_keys_decimal(spark, sf_dir):
    li = fx.read(spark, sf_dir, "lineitem")
    price = li.select(F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), "l_orderkey")
    return profile_tables(spark, {"sold": price, "prices": price.select(F.col("price").cast("decimal(14,4)").alias("listed")).distinct()},
                          fx.DB).inclusions.where("key_column = 'listed'")


def q_profile_partial(spark, sf_dir):
    """All given tables and one that raises when it is read: the others are profiled."""
    tabs = fx.all_tables(spark, sf_dir)
    broken = tabs["region"].select(F.when(F.col("r_regionkey") >= 0, F.raise_error(F.lit("unreadable"))).cast("int").alias("k"))
    p = profile_tables(spark, {**tabs, "broken": broken}, fx.DB, inclusions=False)
    return _named(p, p.stats).select("table", "column", "unique_count")


def q_enum_values(spark, sf_dir):
    p = _profile(spark, sf_dir, inclusions=False)
    return _named(p, p.enums).select("table", "column", "value", "frequency")


def q_profile_all(spark, sf_dir):
    p = _profile(spark, sf_dir, inclusions=False)
    return p.columns.select("database", "table", "position", "column", "data_type", "nullable", "is_primary_key",
                            "is_foreign_key", "null_ratio", "unique_count",
                            F.array_join("sample_values", " | ").alias("samples_text"))


# ------------------------------------------------------------------ C
def _catalog_rows(tables: DataFrame, columns: DataFrame) -> DataFrame:
    c = columns.select("database", "table", "column", "position", "data_type", "business_name", "description",
                       _txt("keywords").alias("keywords_text"), F.array_join("sample_values", " | ").alias("samples_text"),
                       "null_ratio", "unique_count")
    t = tables.select("database", "table", F.lit(None).cast("string").alias("column"), F.lit(0).alias("position"),
                      F.lit(None).cast("string").alias("data_type"), "business_name", "description",
                      F.lit(None).cast("string").alias("keywords_text"), F.lit(None).cast("string").alias("samples_text"),
                      F.lit(None).cast("double").alias("null_ratio"), F.col("row_count").alias("unique_count"))
    return c.unionByName(t)


def q_catalog_roundtrip(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir)
    root = _store_root(spark)
    store.save_catalog(tabs, cols, root)
    t2, c2 = store.load_catalog(spark, root, fx.DB)
    return _catalog_rows(t2, c2)


def q_catalog_list(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir)
    root = _store_root(spark)
    store.save_catalog(tabs, cols, root)
    copy = F.lit(fx.DB + "_copy").alias("database")
    store.save_catalog(tabs.select(copy, *[c for c in tabs.columns if c != "database"]),
                       cols.select(copy, *[c for c in cols.columns if c != "database"]), root)
    return store.list_catalogs(spark, root)


def _edited(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir)
    return catalog.edit_catalog(tabs, cols, fx.catalog_edits(spark, cols))


def q_catalog_edit(spark, sf_dir):
    t, c, _ = _edited(spark, sf_dir)
    return _catalog_rows(t, c).select("database", "table", "column", "business_name", "description")


def q_catalog_edit_report(spark, sf_dir):
    _, _, r = _edited(spark, sf_dir)
    return r


def q_catalog_overview(spark, sf_dir):
    return catalog.overview(*annotated_catalog(spark, sf_dir))


def q_catalog_status(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir)
    root = _store_root(spark)
    store.save_catalog(tabs, cols, root)
    t, _ = store.load_catalog(spark, root, fx.DB)
    return catalog.status(t, fx.example_pairs(spark, sf_dir)).select("database", "table_count", "age_text", "example_count")


def q_store_cleared(spark, sf_dir):
    """Rows of the catalogue columns, the index and the examples before and after clearing."""
    tabs, cols = annotated_catalog(spark, sf_dir)
    root, out = _store_root(spark), []
    stores = {"columns": cols, "index": documents.index_items(tabs, cols), "examples": fx.example_pairs(spark, sf_dir)}
    for name, df in stores.items():
        path = os.path.join(root, name)
        df.write.parquet(path)
        before = spark.read.parquet(path).count()
        store.clear_store(spark, path, df)
        out.append((name, before, spark.read.parquet(path).count()))
    return spark.createDataFrame(out, "store string, before bigint, after bigint")


def q_index_rebuild(spark, sf_dir):
    """Items after a rebuild, and after a rebuild from an empty catalogue."""
    tabs, cols = annotated_catalog(spark, sf_dir)
    path = os.path.join(_store_root(spark), "index")
    items = documents.index_items(tabs, cols)
    first = store.rebuild_index(items, path, fx.DB)
    second = store.rebuild_index(items.limit(0), path, fx.DB)
    return spark.createDataFrame([("full", first), ("empty", second)], "rebuild string, items bigint")


def q_declared_keys(spark, sf_dir):
    return annotated_catalog(spark, sf_dir, annotated=False)[1].select(
        "table", "column", "is_primary_key", "is_foreign_key", "foreign_key_ref")


def q_table_header(spark, sf_dir):
    return catalog.table_header(annotated_catalog(spark, sf_dir)[0])


def q_schema_text_database(spark, sf_dir):
    return catalog.database_text(catalog.schema_text(*annotated_catalog(spark, sf_dir), variant="full"))


def q_table_detail(spark, sf_dir):
    return catalog.table_detail(annotated_catalog(spark, sf_dir)[1])


def q_schema_text_raw(spark, sf_dir):
    return catalog.schema_text(*annotated_catalog(spark, sf_dir), variant="raw")


def q_schema_text_full(spark, sf_dir):
    return catalog.schema_text(*annotated_catalog(spark, sf_dir), variant="full")


def q_schema_text_tables(spark, sf_dir):
    return catalog.schema_text(*annotated_catalog(spark, sf_dir), variant="tables")


def q_schema_summary(spark, sf_dir):
    return catalog.schema_summary(*annotated_catalog(spark, sf_dir))


# ------------------------------------------------------------------ A
def q_annotation_requests(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir, annotated=False)
    c = annotate.column_requests(tabs, cols)
    t = annotate.table_requests(tabs, cols).withColumn("column", F.lit(None).cast("string"))
    return c.unionByName(t)


def q_annotation_parse(spark, sf_dir):
    p = annotate.parse_replies(fx.part_replies(spark, sf_dir))
    return p.select("key", "state", "business_name", "description", _txt("keywords").alias("keywords_text"))


def q_annotation_merge(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir)
    return _catalog_rows(tabs, cols).select("database", "table", "column", "business_name", "description",
                                             "keywords_text")


def q_annotation_strict(spark, sf_dir):
    """A3 in strict mode: replies for all tables are merged; one that is missing, or no object, refuses the whole run."""
    tabs, _ = annotated_catalog(spark, sf_dir, annotated=False)
    replies = fx.table_replies(tabs)
    out = []
    for name, some in (("all", replies), ("one missing", replies.where("table <> 'orders'")),
                       ("one no object", replies.withColumn("reply", F.when(F.col("table") == "part", F.lit("[1]")).otherwise(F.col("reply"))))):
        try:
            merged = annotate.merge_table_replies(tabs, annotate.parse_replies(some, schema=annotate.TABLE_REPLY), strict=True)
            out.append((name, "merged", merged.where("business_name is not null").count()))
        except ValueError as e:
            out.append((name, str(e), 0))
    return spark.createDataFrame(out, "replies string, state string, tables bigint")


# ------------------------------------------------------------------ D
def q_name_variants(spark, sf_dir):
    cols = schema_columns(spark, fx.DB, fx.all_tables(spark, sf_dir))
    return cols.select("table", "column", F.array_join(name_variants(F.col("column")), ", ").alias("variants"))


def q_table_documents(spark, sf_dir):
    return documents.table_documents(*annotated_catalog(spark, sf_dir))


def q_column_documents(spark, sf_dir):
    return documents.column_documents(annotated_catalog(spark, sf_dir)[1]).drop("position")


def q_index_items(spark, sf_dir):
    tabs, cols = annotated_catalog(spark, sf_dir)
    items = documents.index_items(tabs, cols)
    root = _store_root(spark)
    store.publish({"items": items}, os.path.join(root, "index"))
    return (store.read_index(spark, os.path.join(root, "index"), fx.DB)
            .select("id", "type", "database", "table", "column", "data_type", "business_name", "document"))


# ------------------------------------------------------------------ V
def q_term_vectors(spark, sf_dir):
    tv = term_vectors(fx.read(spark, sf_dir, "documents"), "doc_id", "text")
    return tv.select("id", F.col("bucket").cast("bigint"), F.round("weight", 9).alias("weight"))


def q_cosine_topk(spark, sf_dir):
    items = fx.vector_items(spark, sf_dir)
    top = cosine_topk(items, fx.vector_queries(spark, sf_dir), 40, item_id="id", query_id="query_id")
    return top.select("query_id", "id", F.col("rank").cast("bigint"), F.round("score", R6).alias("score"))


def _sparse_docs(spark, sf_dir):
    docs = packed_terms(fx.read(spark, sf_dir, "documents"), "doc_id", "text")
    qs = packed_terms(fx.read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed(
        "id", "query_id")
    return docs, qs


def q_cosine_topk_sparse(spark, sf_dir):
    docs, qs = _sparse_docs(spark, sf_dir)
    top = cosine_topk(docs, qs, 5, item_id="id", query_id="query_id", sparse_dim=4096)
    return top.select("query_id", "id", F.col("rank").cast("bigint"), F.round("score", R6).alias("score"))


def _cands(spark, sf_dir, n=40):
    return search.candidates(fx.vector_items(spark, sf_dir), fx.vector_queries(spark, sf_dir), n)


def _fused_cols(df):
    return df.select("query_id", F.col("rank").cast("bigint"), "id", "type", F.round("original_score", R6).alias("original_score"),
                     F.round("table_boost", R6).alias("table_boost"), F.round("score", R6).alias("score"))


def q_score_fusion(spark, sf_dir):
    return _fused_cols(search.fuse(_cands(spark, sf_dir), top_k=10))


def q_score_fusion_filtered(spark, sf_dir):
    return _fused_cols(search.fuse(_cands(spark, sf_dir), top_k=10, filter_type="column"))


def q_score_fusion_table_filter(spark, sf_dir):
    return _fused_cols(search.fuse(_cands(spark, sf_dir), top_k=10, filter_table="t3"))


def q_context_text(spark, sf_dir):
    res = search.fuse(_cands(spark, sf_dir), top_k=5)
    return search.context_text(res, fx.vector_queries(spark, sf_dir))


def q_ambiguity(spark, sf_dir):
    a = search.ambiguity(_cands(spark, sf_dir, 20), min_score=0.25, gap_tolerance=0.05, top_n=20)
    return a.select("query_id", F.col("rank").cast("bigint"), "table", "column", F.round("score", R6).alias("score"))


# ------------------------------------------------------------------ E
def _example_vectors(spark, sf_dir):
    ex = fx.example_pairs(spark, sf_dir)
    vec = packed_terms(ex, "log_id", "question").withColumnRenamed("id", "log_id")
    qs = packed_terms(fx.read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed(
        "id", "query_id")
    return ex.join(vec, "log_id"), qs


def _example_hits(spark, sf_dir):
    items, qs = _example_vectors(spark, sf_dir)
    return examples.search_examples(items, qs, top_k=5, sparse_dim=4096)


def q_examples_add(spark, sf_dir):
    s = examples.add_examples(fx.example_pairs(spark, sf_dir), fx.all_turn_pairs(spark, sf_dir))
    return s.select("log_id", "question", "sql")


def q_examples_search(spark, sf_dir):
    h = _example_hits(spark, sf_dir)
    return h.select("query_id", F.col("rank").cast("bigint"), "log_id", F.round("score", R6).alias("score"),
                    F.array_join("selected_columns", ", ").alias("selected_columns"))


def _delete_ids(spark, sf_dir):
    c = fx.read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(F.explode(F.array(F.concat(F.col("conv_id").cast("string"), F.lit("-0")),
                                      F.concat(F.col("conv_id").cast("string"), F.lit("-99")))).alias("log_id"))


def q_examples_delete(spark, sf_dir):
    _, report = examples.delete_examples(fx.example_pairs(spark, sf_dir), _delete_ids(spark, sf_dir))
    return report


def q_examples_remaining(spark, sf_dir):
    s, _ = examples.delete_examples(fx.example_pairs(spark, sf_dir), _delete_ids(spark, sf_dir))
    return s.select("log_id", "question", "sql")


def q_examples_list(spark, sf_dir):
    return examples.list_examples(fx.example_pairs(spark, sf_dir), 50)


def q_examples_prefix(spark, sf_dir):
    c = fx.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("k")).distinct()
    pre = c.select(F.explode(F.array(F.col("k"), F.concat("k", F.lit("-")), F.concat("k", F.lit("-1")))).alias("prefix"))
    return examples.resolve_prefixes(fx.example_pairs(spark, sf_dir), pre)


def q_fewshot_text(spark, sf_dir):
    return examples.fewshot_text(_example_hits(spark, sf_dir))


# ------------------------------------------------------------------ G
def _audited(spark, sf_dir):
    return guard.audit(fx.sql_log(spark, sf_dir))


def q_guard_injection(spark, sf_dir):
    return fx.sql_log(spark, sf_dir).select(
        "query_id", guard.first_hit(F.col("sql"), guard.INJECTION_PATTERNS).alias("rule_index"))


def q_guard_dangerous(spark, sf_dir):
    return fx.sql_log(spark, sf_dir).select(
        "query_id", guard.first_hit(F.col("sql"), guard.DANGEROUS_PATTERNS).alias("rule_index"))


def q_guard_statement_type(spark, sf_dir):
    return fx.sql_log(spark, sf_dir).select(
        "query_id", F.array_join(guard.statement_types(F.col("sql")), ",").alias("statement_type"))


def q_guard_verdict(spark, sf_dir):
    return _audited(spark, sf_dir).select("query_id", "is_valid", "error_type", "rule")


def q_guard_summary(spark, sf_dir):
    return guard.summary(_audited(spark, sf_dir))


GOOD_SQL = {
    "guarded_query": (
        "SELECT `n`.`n_name`, count(*) AS orders, round(sum(`o`.`o_totalprice`), 2) AS total "
        "FROM `orders` `o` JOIN `customer` `c` ON `o`.`o_custkey` = `c`.`c_custkey` "
        "JOIN `nation` `n` ON `c`.`c_nationkey` = `n`.`n_nationkey` GROUP BY `n`.`n_name`"),
    "preview": (
        "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders "
        "ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "pass_filter": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
        "WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'"),
    "pass_join": (
        "SELECT s.s_name, p.p_type, sum(l.l_quantity) AS qty FROM lineitem l "
        "JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey "
        "GROUP BY s.s_name, p.p_type"),
    "pass_semi_anti": (
        "SELECT c_custkey, c_name, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
        "AND o.o_orderstatus = 'F') THEN 1 ELSE 0 END AS has_final FROM customer c "
        "WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase')"),
    "pass_groupby": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, "
        "round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus "
        "HAVING count(*) > 10"),
    "pass_grouping_sets": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders "
        "GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"),
    "pass_window": (
        "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) "
        "AS rnk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order, "
        "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM orders"),
    "pass_topk": (
        "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "pass_setops": (
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier "
        "UNION SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey + 100 FROM region"),
    "pass_dates": (
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, "
        "min(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')) AS first_day FROM orders GROUP BY 1, 2"),
}


def _run(spark, sf_dir, name):
    register_views(fx.all_tables(spark, sf_dir))
    out = execute.run_sql(spark, GOOD_SQL[name])
    if out.df is None:
        raise ValueError(f"{name}: {out.verdict} {out.error}")
    return out.df


def q_guarded_query(spark, sf_dir):
    return _run(spark, sf_dir, "guarded_query")


def q_preview(spark, sf_dir):
    return execute.preview(_run(spark, sf_dir, "preview"), 20, 80)


def q_dry_run_log(spark, sf_dir):
    """G5 for every text of the SQL log: is it accepted, and if not, why."""
    register_views(fx.all_tables(spark, sf_dir))
    return execute.dry_run_log(fx.sql_log(spark, sf_dir)).select("query_id", "is_valid", "error_type")


def q_dry_run_audit(spark, sf_dir):
    """The first text of every shape of the SQL log, out of the dry run of the whole log."""
    first = F.min(F.struct("query_id", "is_valid", "error_type")).alias("q")
    return (q_dry_run_log(spark, sf_dir).groupBy(F.pmod("query_id", F.lit(fx.SHAPES)).alias("shape")).agg(first)
            .select("shape", "q.*"))


def q_reconcile_claims(spark, sf_dir):
    """Stated totals per return flag and in all, some of them wrong."""
    li = fx.read(spark, sf_dir, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
    stated = li.groupBy("l_returnflag").agg(F.sum("amount").alias("t")).select(
        F.lit(1).alias("level"), "l_returnflag", F.lit(None).cast("string").alias("l_linestatus"),
        (F.col("t") + F.when(F.col("l_returnflag") == "N", F.lit(1)).otherwise(F.lit(0))).alias("claimed"))
    total = li.agg(F.sum("amount").alias("t")).select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("l_returnflag"),
                                                     F.lit(None).cast("string").alias("l_linestatus"), F.col("t").alias("claimed"))
    none = total.select(F.lit(1).alias("level"), F.lit("?").alias("l_returnflag"), "l_linestatus", "claimed")
    r = execute.reconcile_claims(li, ["l_returnflag", "l_linestatus"], "amount", stated.unionByName(total).unionByName(none))
    return r.select("level", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in ("claimed", "actual", "diff")], "ok")


def q_reconcile_totals(spark, sf_dir):
    li = fx.read(spark, sf_dir, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
    r = execute.reconcile(li, ["l_returnflag", "l_linestatus"], "amount")
    return r.select("level", "l_returnflag", "l_linestatus", *[F.col(c).cast("double").alias(c)
                                                               for c in ("total", "parts_sum", "diff")], "ok")


def _pass(name):
    return lambda spark, sf_dir: _run(spark, sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_counts": q_load_counts,
    "schema_columns": q_schema_columns,
    "row_counts": q_row_counts,
    "sample_values": q_sample_values,
    "null_ratio": q_null_ratio,
    "distinct_count": q_distinct_count,
    "distinct_count_approx": q_distinct_count_approx,
    "distinct_count_merged": q_distinct_count_merged,
    "canonical_text": q_canonical_text,
    "candidate_keys": q_candidate_keys,
    "candidate_keys_composite": q_candidate_keys_composite,
    "inclusion_keys": q_inclusion_keys,
    "enum_values": q_enum_values,
    "profile_all": q_profile_all,
    "catalog_roundtrip": q_catalog_roundtrip,
    "catalog_list": q_catalog_list,
    "catalog_edit": q_catalog_edit,
    "catalog_edit_report": q_catalog_edit_report,
    "distinct_count_approx_within": q_distinct_count_approx_within,
    "inclusion_keys_decimal": q_inclusion_keys_decimal,
    "profile_partial": q_profile_partial,
    "catalog_status": q_catalog_status,
    "store_cleared": q_store_cleared,
    "index_rebuild": q_index_rebuild,
    "declared_keys": q_declared_keys,
    "table_header": q_table_header,
    "schema_text_database": q_schema_text_database,
    "score_fusion_table_filter": q_score_fusion_table_filter,
    "dry_run_audit": q_dry_run_audit,
    "dry_run_log": q_dry_run_log,
    "reconcile_claims": q_reconcile_claims,
    "catalog_overview": q_catalog_overview,
    "table_detail": q_table_detail,
    "schema_text_raw": q_schema_text_raw,
    "schema_text_full": q_schema_text_full,
    "schema_text_tables": q_schema_text_tables,
    "schema_summary": q_schema_summary,
    "annotation_requests": q_annotation_requests,
    "annotation_parse": q_annotation_parse,
    "annotation_merge": q_annotation_merge,
    "annotation_strict": q_annotation_strict,
    "name_variants": q_name_variants,
    "table_documents": q_table_documents,
    "column_documents": q_column_documents,
    "index_items": q_index_items,
    "term_vectors": q_term_vectors,
    "cosine_topk": q_cosine_topk,
    "cosine_topk_sparse": q_cosine_topk_sparse,
    "score_fusion": q_score_fusion,
    "score_fusion_filtered": q_score_fusion_filtered,
    "context_text": q_context_text,
    "ambiguity": q_ambiguity,
    "examples_add": q_examples_add,
    "examples_search": q_examples_search,
    "examples_delete": q_examples_delete,
    "examples_remaining": q_examples_remaining,
    "examples_list": q_examples_list,
    "examples_prefix": q_examples_prefix,
    "fewshot_text": q_fewshot_text,
    "guard_injection": q_guard_injection,
    "guard_dangerous": q_guard_dangerous,
    "guard_statement_type": q_guard_statement_type,
    "guard_verdict": q_guard_verdict,
    "guard_summary": q_guard_summary,
    "guarded_query": q_guarded_query,
    "preview": q_preview,
    "reconcile_totals": q_reconcile_totals,
    **{k: _pass(k) for k in GOOD_SQL if k.startswith("pass_")},
}
