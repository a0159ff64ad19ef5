"""The corpus pipeline against a brute-force version of its stages, and its edge cases."""

from __future__ import annotations

import numpy as np
from llm_rows import corpus
from test_neardup_tiling import bag, classes

import corpus_pipeline
from colscope.llm import quality, queries, secrets
from colscope.llm.tables import written


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_equal_brute_force(spark, sf, encoder_ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = written(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    first = spark.read.parquet(f"{sf}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.score(first, queries.quality_model(spark, sf)).collect()}
    kept = sorted((i, t) for i, t in rows_of(first) if score[i] >= 0.5)
    assert sorted(rows_of(out["quality"])) == kept
    # one of each class of near duplicates, the least id
    least = classes(kept)
    kept = [(i, t) for i, t in kept if least[i] == i]
    assert sorted(rows_of(out["near_duplicates"])) == kept
    # documents without half of a benchmark item: every leak holds the item's 5-word runs
    items = [bag(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i for i, _ in rows_of(out["decontamination"])}
    assert left <= {i for i, _ in kept}
    for i, t in kept:
        have = bag(t)
        share = max(sum((have & x).values()) / max(x.total(), 1) for x in items)
        assert i in left or share > 0.3
        assert i not in left or share < 0.6
    # secrets: nothing is left that the patterns find, and only texts with a span changed
    before, after = dict(kept), dict(rows_of(out["secrets"]))
    assert set(after) == left
    for i, t in after.items():
        assert not secrets.base_spans(t)
        assert t == before[i] or "[SECRET]" in t
    sizes = {r["doc_id"]: r["n_chars"] for r in out["secrets"].collect()}
    assert all(sizes[i] == len(t) for i, t in after.items() if t != before[i])
    # packing: every id of every text once
    pieces = {}
    for r in out["packing"].orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + bytes(r["ids"])
    assert pieces == {i: encoder_ids(t) for i, t in after.items()}


def test_stages_take_odd_rows(spark, tmp_path, docs, nothing):
    from pyspark.sql import functions as F

    path = str(tmp_path)
    spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, corpus()[5][1]), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    for start in (docs, nothing):
        now = start
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            now = written(stage(spark, now, path), f"odd-{name}")
            assert now.columns == docs.columns
        ids = [r["doc_id"] for r in now.collect() if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and 5 not in ids
        # of the two rows without id one has a text of its own; the other's (null) is that of row 32
        assert now.filter(F.col("doc_id").isNull()).count() == (0 if start is nothing else 1)
    assert corpus_pipeline.STAGES[0][1](spark, docs, path).columns == docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert np.unique([r["sequence_id"] for r in packed]).size > 0
    assert corpus_pipeline.run(spark, path).columns[0] == "doc_id"


def test_rows_with_null_or_repeated_ids_are_judged_row_by_row(spark, tmp_path):
    """Copies and leaks go whatever their id; a clean text stays, also beside another under one id."""
    texts = [t for _, t in corpus()]
    rows = [(1, texts[1]), (1, texts[2]), (2, texts[2]), (3, texts[3]), (None, texts[3]), (None, texts[4]), (None, texts[6]), (4, texts[7]),
            (1, texts[1]), (5, texts[8]), (5, texts[9]), (None, texts[10]), (None, texts[10])]
    docs = spark.createDataFrame([(i, t, "en", "s", 5, "x", None, 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, class_id string, _key string, _twice int")
    spark.createDataFrame([(0, texts[4]), (1, texts[9])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert once.columns == docs.columns
    want = [(1, texts[1]), (2, texts[2]), (3, texts[3]), (None, texts[4]), (None, texts[6]), (4, texts[7]), (5, texts[8]), (5, texts[9]), (None, texts[10])]
    assert sorted(rows_of(once), key=repr) == sorted(want, key=repr)
    clean = corpus_pipeline.drop_contaminated(spark, written(once, "test-once"), str(tmp_path))
    assert sorted(rows_of(clean), key=repr) == sorted([x for x in want if x[1] not in (texts[4], texts[9])], key=repr)


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= names
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"


def test_no_stage_leaves_texts_to_the_batches_of_the_caller(spark, tmp_path, docs):
    """Whoever runs a stage's result sends no rows to Python with it: that was done in short batches."""
    spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, corpus()[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in (corpus_pipeline.STAGES[i] for i in (0, 3, 4)):
        plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and "MapInArrow" not in plan and "Python" not in plan, name


def folder(spark):
    """Of each folder of Parquet in the shared folder: its columns and rows."""
    import os

    import pyarrow.dataset as ds

    from colscope.session import ensure_checkpoint_dir

    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    found = {x: ds.dataset(f"{top}/{x}", format="parquet") for x in os.listdir(top) if x.startswith("colscope-")}
    return {x: (d.schema.names, d.count_rows()) for x, d in found.items()}


def test_a_stage_writes_no_copy_of_what_the_caller_writes(spark, sf):
    """Texts that stay as they are do not come to lie in the shared folder once for every stage, nor ids twice."""
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        before = folder(spark)
        now = stage(spark, docs, sf)
        new = {x: v for x, v in folder(spark).items() if x not in before}
        kept = written(now, f"test-{name}")
        # near_duplicates keeps the texts that share a group, decontamination those with a seed
        n[name] = sum(rows for names, rows in new.values() if "text" in names or "ids" in names), kept.count(), docs.count()
        docs = kept
    assert n["quality"][0] == 0 and n["quality"][1] < first.count()
    assert n["near_duplicates"][0] < n["near_duplicates"][2] and n["decontamination"][0] < n["decontamination"][2]
    assert n["secrets"][0] == n["secrets"][1]
    assert 0 < n["packing"][0] <= n["packing"][1]


def test_run_lets_go_of_the_rows_between_stages(spark, sf):
    before = folder(spark)
    packed = corpus_pipeline.run(spark, sf)
    left = [x.split("-")[2] for x in folder(spark) if x not in before and x.startswith("colscope-stage-")]
    assert left == ["secrets"]
    assert packed.count() > 0


def test_keep_good_by_id_is_keep_good(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.quality_model(spark, sf)
    assert 0 < docs.count() - quality.keep_good(docs, model).count() < docs.count()
    assert sorted(map(tuple, quality.keep_good(docs, model, id_col="doc_id").collect())) == sorted(map(tuple, quality.keep_good(docs, model).collect()))
