"""V4-V8: candidate search with table/column score fusion, context text and
ambiguity flags, for a whole batch of questions at once.

``items`` carries the item metadata (``id, type, database, table, column,
data_type, business_name``) and the vector column(s); ``queries`` carries
``query_id`` and the query vector(s). All per-query steps are windows
partitioned by ``query_id`` over at most ``n_candidates`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.operators.vectors import cosine_topk

NO_CONTEXT = "No matching tables or columns."
META = ["id", "type", "database", "table", "column", "data_type", "business_name"]


def candidates(items: DataFrame, queries: DataFrame, n: int = 40, **vec) -> DataFrame:
    """Top-``n`` items per query by raw cosine, with item metadata and
    ``cand_rank`` (1 = most similar)."""
    top = cosine_topk(items, queries, n, item_id="id", query_id="query_id", **vec)
    meta = items.select(*[c for c in META if c in items.columns])
    return top.withColumnRenamed("rank", "cand_rank").join(meta, "id")


def fuse(cands: DataFrame, top_k: int = 10, filter_type: str | None = None,
         filter_table: str | None = None) -> DataFrame:
    """V4-V6 on candidates.

    Table score = clamp(cosine, 0) of the table's own item when it is among the
    candidates. A column scores clamp(cosine, 0) + its table's score (0 when
    the table item is not a candidate); a table keeps its own score. Filters
    apply after the candidate cut and after table scores are known. Ranked by
    score desc, then candidate rank."""
    orig = F.greatest(F.col("score"), F.lit(0.0))
    # as a left join with the candidates that are tables, a row per match, but the candidates are
    # found once only and dealt by question once for both windows
    own = ["query_id", "database", "table"]
    known = F.col("query_id").isNotNull() & F.col("database").isNotNull() & F.col("table").isNotNull()
    tscores = F.collect_list(F.when((F.col("type") == "table") & known, orig)).over(Window.partitionBy(*own))
    f = cands.repartition("query_id").withColumn("_tscores", F.when(known, tscores))
    f = f.select(*cands.columns, F.explode_outer("_tscores").alias("_tscore"))
    boost = F.when(F.col("type") == "column", F.coalesce("_tscore", F.lit(0.0))).otherwise(F.lit(0.0))
    f = f.select("query_id", *[c for c in META if c in cands.columns], "cand_rank",
                 orig.alias("original_score"), boost.alias("table_boost"))
    if filter_type is not None:
        f = f.where(F.col("type") == filter_type)
    if filter_table is not None:
        f = f.where(F.col("table") == filter_table)
    f = f.withColumn("score", F.col("original_score") + F.col("table_boost"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("cand_rank").asc())
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def search(items: DataFrame, queries: DataFrame, top_k: int = 10, n_candidates: int = 40,
           filter_type: str | None = None, filter_table: str | None = None, **vec) -> DataFrame:
    """V5: fused search for every query of the batch."""
    return fuse(candidates(items, queries, n_candidates, **vec), top_k, filter_type, filter_table)


def context_text(results: DataFrame, queries: DataFrame) -> DataFrame:
    """V7: one context text per query from ranked search results.

    In rank order: a table line only when its table has not been seen before;
    a column line nested under its table when the table was seen before, else
    prefixed with the table name; a column marks its table as seen. Queries
    without results get a fixed message."""
    first = F.min("rank").over(Window.partitionBy("query_id", "database", "table"))
    r = results.withColumn("_seen_before", F.col("rank") > first)
    line = (F.when(F.col("type") == "table",
                   F.when(~F.col("_seen_before"),
                          F.concat(F.lit("[table] "), F.col("table"), F.lit(" ("),
                                   F.coalesce("business_name", F.lit("")), F.lit(")"))))
            .otherwise(F.concat(F.when(F.col("_seen_before"), F.lit("  - "))
                                .otherwise(F.concat(F.lit("[column] "), F.col("table"), F.lit("."))),
                                F.col("column"), F.lit(" ("), F.col("data_type"), F.lit("): "),
                                F.coalesce("business_name", F.lit("")))))
    lines = (r.select("query_id", "rank", line.alias("line")).where(F.col("line").isNotNull())
             .groupBy("query_id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))),
                                           lambda s: s["line"]), "\n").alias("context")))
    return (queries.select("query_id").join(lines, "query_id", "left")
            .select("query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")))


def ambiguity(cands: DataFrame, min_score: float = 0.45, gap_tolerance: float = 0.15,
              top_n: int = 20) -> DataFrame:
    """V8: per query, the best column of each table among the top ``top_n`` raw
    candidates (columns only, clamped cosine, first seen wins ties); tables
    whose best column scores >= ``min_score`` are kept; when the best two kept
    differ by at most ``gap_tolerance`` all kept rows are returned, else none.
    Returns ``(query_id, rank, table, column, score, ...)``."""
    c = (cands.where((F.col("cand_rank") <= top_n) & (F.col("type") == "column"))
         .withColumn("s", F.greatest(F.col("score"), F.lit(0.0))))
    # best entry per (table, column) then per table; ties keep the earlier candidate
    w_tc = Window.partitionBy("query_id", "table", "column").orderBy(F.col("s").desc(), F.col("cand_rank"))
    c = c.withColumn("_r", F.row_number().over(w_tc)).where(F.col("_r") == 1)
    w_t = Window.partitionBy("query_id", "table")
    c = (c.withColumn("_first", F.min("cand_rank").over(w_t))
         .withColumn("_r", F.row_number().over(w_t.orderBy(F.col("s").desc(), F.col("cand_rank"))))
         .where((F.col("_r") == 1) & (F.col("s") >= F.lit(min_score))))
    w_q = Window.partitionBy("query_id").orderBy(F.col("s").desc(), F.col("_first"))
    c = c.withColumn("rank", F.row_number().over(w_q))
    wq = Window.partitionBy("query_id")
    c = (c.withColumn("_n", F.count(F.lit(1)).over(wq))
         .withColumn("_s1", F.max(F.when(F.col("rank") == 1, F.col("s"))).over(wq))
         .withColumn("_s2", F.max(F.when(F.col("rank") == 2, F.col("s"))).over(wq)))
    keep = (F.col("_n") >= 2) & ((F.col("_s1") - F.col("_s2")) <= F.lit(gap_tolerance))
    return c.where(keep).select("query_id", "rank", "database", "table", "column", F.col("s").alias("score"),
                                "id", "data_type", "business_name")


def text_search(items: DataFrame, questions: DataFrame, top_k: int = 10, n_candidates: int = 40,
                buckets: int = 4096, **kw) -> DataFrame:
    """V1 + V5 without a model: item ``document`` texts and question ``text``
    (with ``query_id``) become hashed term vectors, then :func:`search`."""
    from colscope.operators.vectors import packed_terms

    iv = packed_terms(items, "id", "document", buckets)
    qv = packed_terms(questions, "query_id", "text", buckets).withColumnRenamed("id", "query_id")
    return search(items.drop("vector").join(iv, "id", "left"), qv, top_k, n_candidates, sparse_dim=buckets, **kw)
