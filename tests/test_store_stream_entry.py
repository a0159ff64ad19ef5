import os
import tempfile

from pyspark.sql import functions as F

from colscope.operators import documents
from colscope.session import ensure_checkpoint_dir
from colscope.sources import store


def _root(spark):
    return tempfile.mkdtemp(dir=ensure_checkpoint_dir(spark))


def test_catalog_save_load_edit_rewrite(spark, sf):
    from colscope.plans.registry import annotated_catalog
    from colscope.operators import catalog
    tabs, cols = annotated_catalog(spark, sf)
    root = _root(spark)
    store.save_catalog(tabs, cols, root)
    store.save_catalog(tabs.withColumn("database", F.lit("other")), cols.withColumn("database", F.lit("other")), root)
    assert sorted(r[0] for r in store.list_catalogs(spark, root).collect()) == ["other", "testdata"]
    assert store.catalog_exists(spark, root, "other") and not store.catalog_exists(spark, root, "nope")
    assert store.load_catalog(spark, root, "nope") is None
    t, c = store.load_catalog(spark, root, "testdata")
    assert t.count() == 14 and c.count() == cols.count()
    # edit what was loaded from the store and save it back to the same store
    edits = spark.createDataFrame([(1, "testdata", "orders", "Orders!", None, None, None, None)],
                                  "seq int, database string, table string, business_name string, description string, "
                                  "column string, column_business_name string, column_description string")
    t2, c2, _ = catalog.edit_catalog(t, c, edits)
    store.save_catalog(t2, c2, root)
    t3, c3 = store.load_catalog(spark, root, "testdata")      # frames read before the rewrite are stale
    assert t3.where("table = 'orders'").first()["business_name"] == "Orders!"
    assert store.load_catalog(spark, root, "other")[0].count() == 14     # other partition untouched
    # index rebuild is idempotent
    items = documents.index_items(t3, c3)
    p = os.path.join(root, "index")
    store.publish({"items": items}, p)
    store.publish({"items": store.read_index(spark, p)}, p)
    assert store.read_index(spark, p).count() == items.count()
    store.clear_store(spark, p, items)
    assert spark.read.parquet(p).count() == 0 and store.read_index(spark, p) is None


def test_status(spark, sf):
    from colscope.operators import catalog
    from colscope.plans.registry import annotated_catalog
    tabs, cols = annotated_catalog(spark, sf)
    root = _root(spark)
    store.save_catalog(tabs, cols, root)
    st = catalog.status(store.read_part(spark, root, "tables"), None).first()
    assert st["table_count"] == 14 and st["age_text"] == "today" and st["example_count"] == 0


def test_stream_audit(spark, sf):
    from colscope.plans.fixtures import sql_log
    from colscope.operators.guard import audit
    from colscope.streaming import rule_counts
    src = _root(spark)
    log = sql_log(spark, sf)
    log.write.mode("overwrite").parquet(os.path.join(src, "log"))
    stream = spark.readStream.schema(log.schema).parquet(os.path.join(src, "log"))
    q = (rule_counts(audit(stream)).writeStream.outputMode("complete").format("memory")
         .queryName("rule_counts_test").option("checkpointLocation", os.path.join(src, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r["error_type"], r["rule"]): r["n"] for r in spark.sql("SELECT * FROM rule_counts_test").collect()}
    from colscope.operators import guard
    exp = {(r["error_type"], r["rule"]): r["n"] for r in guard.summary(guard.audit(log)).collect()}
    assert got == exp


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    from colscope.plans.registry import QUERIES
    assert set(QUERIES) <= set(q) and set(QUERIES) - set(o) == {"distinct_count_approx"}
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "rank", "id", "type", "original_score", "table_boost", "score"]


def test_stream_rule_counts_by_event_time(spark, sf):
    from colscope.plans.fixtures import read, sql_log
    from colscope.operators.guard import audit
    from colscope.streaming import rule_counts
    src = _root(spark)
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").alias("ts"))
    log = sql_log(spark, sf).join(o, "query_id").withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.mode("overwrite").parquet(os.path.join(src, "log"))
    stream = spark.readStream.schema(log.schema).parquet(os.path.join(src, "log"))
    q = (rule_counts(audit(stream), event_time="ts", window="365 days", watermark="3650 days")
         .writeStream.outputMode("update").format("memory").queryName("rule_counts_ts")
         .option("checkpointLocation", os.path.join(src, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT window, error_type, rule, max(n) AS n FROM rule_counts_ts GROUP BY ALL")
    assert got.agg(F.sum("n")).first()[0] == log.count()


def test_empty_rebuild_leaves_nothing(spark):
    root = _root(spark)
    p = os.path.join(root, "index")
    items = spark.createDataFrame([("a", "db"), ("b", "db"), ("c", "other")], "id string, database string")
    assert store.rebuild_index(items, p, "db") == 2 and store.rebuild_index(items, p, "other") == 1
    assert store.rebuild_index(items.limit(0), p, "db") == 0
    assert [r["id"] for r in store.read_index(spark, p).collect()] == ["c"]
    assert store.rebuild_index(store.read_index(spark, p), p, "other") == 1


def test_a_write_that_fails_leaves_the_old_version(spark, sf):
    """Also when the second part of a catalogue fails; readers see whole versions only."""
    import pytest

    root = _root(spark)
    items = spark.createDataFrame([("a", "a/b c"), ("b", "a/b c")], "id string, database string")
    assert store.rebuild_index(items, f"{root}/i", "a/b c") == 2 and store.databases(spark, f"{root}/i") == ["a/b c"]
    broken = items.withColumn("id", F.when(F.col("id") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        store.rebuild_index(broken, f"{root}/i", "a/b c")
    assert sorted(r["id"] for r in store.read_index(spark, f"{root}/i", "a/b c").collect()) == ["a", "b"]
    from colscope.plans.registry import annotated_catalog
    tabs, cols = annotated_catalog(spark, sf)
    store.save_catalog(tabs, cols, f"{root}/c")
    with pytest.raises(Exception):
        store.save_catalog(tabs.withColumn("description", F.lit("new")), cols.withColumn("column", F.raise_error(F.lit("no"))), f"{root}/c")
    t, c = store.load_catalog(spark, f"{root}/c", "testdata")
    assert t.where("description = 'new'").count() == 0 and c.count() == cols.count()


def test_versions_before_the_last_two_are_deleted(spark, monkeypatch):
    root = _root(spark)
    items = spark.createDataFrame([("a", "db")], "id string, database string")
    folders = [store.publish({"items": items}, root) for _ in range(3)]
    assert len(store._markers(spark, root, "db")) == 2 and all(os.path.isdir(f) for f in folders)
    later = store.time.time() + 100_000
    monkeypatch.setattr(store.time, "time", lambda: later)
    last = store.publish({"items": items}, root)
    assert [os.path.isdir(f) for f in [*folders, last]] == [False, False, True, True]


def test_a_cluster_needs_a_named_checkpoint_folder():
    import pytest

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
