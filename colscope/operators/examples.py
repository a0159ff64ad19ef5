"""A store of question/SQL examples as a DataFrame
``(log_id, question, sql, selected_columns (JSON text), added_at)``.

Writes go to a fresh path (``colscope.sources.store.write_versioned``), never
to the path being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.operators.vectors import cosine_topk
from colscope.plans.sizing import checked_broadcast


def add_examples(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Append the batch rows whose ``log_id`` is not yet stored (anti-join);
    callers give ids (e.g. ``uuid()`` for new ones). Of batch rows with one id the first
    by (question, sql) is taken; :func:`repeated_ids` reports the others."""
    cols = store.columns
    if "log_id" not in batch.columns:
        batch = batch.withColumn("log_id", F.lit(None).cast("string"))
    # rows without an id get a random one, as ``learn`` does
    batch = batch.withColumn("log_id", F.coalesce(F.col("log_id"), F.expr("uuid()")))
    batch = _numbered(batch).where(F.col("_nr") == 1).drop("_nr")
    # ids of the batch already stored: the store streams past the broadcast
    # batch ids (size checked); the anti-join then runs on two small sides
    ids_b, _, _ = checked_broadcast(batch.select("log_id"), 1_000_000)
    taken = store.select("log_id").join(ids_b, "log_id", "left_semi")
    new = batch.join(taken, "log_id", "left_anti")
    for c in cols:
        if c not in new.columns:
            new = new.withColumn(c, F.current_timestamp() if c == "added_at" else F.lit(None).cast("string"))
    return store.unionByName(new.select(*cols))


def _numbered(batch: DataFrame) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("question", "sql") if c in batch.columns]
    return batch.withColumn("_nr", F.row_number().over(Window.partitionBy("log_id").orderBy(*order)))


def repeated_ids(batch: DataFrame) -> DataFrame:
    """The batch rows that E1 leaves out because an earlier row has their id."""
    given = batch.where(F.col("log_id").isNotNull())
    return _numbered(given).where(F.col("_nr") > 1).drop("_nr")


def search_examples(examples: DataFrame, queries: DataFrame, top_k: int = 5, **vec) -> DataFrame:
    """Most similar stored questions per query, unclamped cosine;
    ``selected_columns`` restored from JSON (bad JSON -> [])."""
    top = cosine_topk(examples, queries, top_k, item_id="log_id", query_id="query_id", **vec)
    ex = examples.select("log_id", "question", "sql", "selected_columns")
    sc = F.coalesce(F.from_json(F.col("selected_columns"), "array<string>"), F.array().cast("array<string>"))
    return (top.join(ex, "log_id")
            .select("query_id", "rank", "log_id", "question", "sql", sc.alias("selected_columns"), "score"))


def delete_examples(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove exact ids. Returns (new store, report ``(log_id, found)``)."""
    req = ids.select("log_id").distinct()
    # the id batch is the small side: broadcast behind a size check, the store
    # is only streamed past it
    req_b, _, _ = checked_broadcast(req, 1_000_000)
    found = (store.select("log_id").join(req_b, "log_id", "left_semi").distinct()
             .withColumn("found", F.lit(True)))
    report = req.join(found, "log_id", "left").select("log_id", F.coalesce("found", F.lit(False)).alias("found"))
    return store.join(req_b, "log_id", "left_anti"), report


def list_examples(store: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` examples by (added_at, log_id)."""
    return store.orderBy("added_at", "log_id").limit(limit).select("log_id", "question", "sql")


def resolve_prefixes(store: DataFrame, prefixes: DataFrame) -> DataFrame:
    """E5: match id prefixes: state 'none' / 'one' / 'many' and the full id when one.

    An equi-join on ``(length, substring)``: the distinct prefix lengths of the
    request batch (at most the longest id length) are collected, every id is
    expanded once per length, and the join is on the cut id - no theta join."""
    req = prefixes.select("prefix").distinct()
    lengths = sorted({r[0] for r in req.select(F.char_length("prefix")).distinct().collect()})
    if not lengths:
        return req.select("prefix", F.lit("none").alias("state"), F.lit(None).cast("string").alias("log_id"),
                          F.lit(0).cast("bigint").alias("matches"))
    ids = (store.select("log_id", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_len"))
           .select("log_id", F.substring("log_id", 1, F.col("_len")).alias("prefix"), "_len")
           .where(F.char_length("log_id") >= F.col("_len")))
    # the request batch is broadcast (size checked), so a prefix that matches a
    # third of all ids is never gathered by one reducer; the count per prefix
    # is then folded map-side by the partial aggregate
    req_b, _, _ = checked_broadcast(req.withColumn("_len", F.char_length("prefix")), 1_000_000)
    hits = (ids.join(req_b, ["prefix", "_len"])
            .groupBy("prefix").agg(F.count(F.lit(1)).alias("matches"), F.min("log_id").alias("_id")))
    out = req.join(hits, "prefix", "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("bigint"))
    return out.select("prefix",
                      F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one")
                      .otherwise("many").alias("state"),
                      F.when(F.col("matches") == 1, F.col("_id")).alias("log_id"), "matches")


def fewshot_text(found: DataFrame) -> DataFrame:
    """Per query, numbered question + SQL blocks in rank order."""
    block = F.concat(F.lit("Example "), F.col("rank").cast("string"), F.lit(":\nQuestion: "), F.col("question"),
                     F.lit("\nSQL: ```sql\n"), F.col("sql"), F.lit("\n```"))
    return (found.groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))),
                                          lambda s: s["b"]), "\n\n").alias("fewshot")))
