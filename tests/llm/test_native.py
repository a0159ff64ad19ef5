"""op4 and op6 against plain Python, their plans without Python, and the registered list."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import imatch, queries, shards


def test_shards_hold_their_law(docs, rows):
    got = shards.shard(docs, shards=8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_match_the_mixture(spark):
    rows = [(i, str(i), "hot" if i % 3 == 0 else None if i % 10 == 1 else f"s{i % 7}") for i in range(3000)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).collect()
    source = {i: s for i, _, s in rows}
    counts = Counter((source[r["doc_id"]], r["shard"]) for r in got)
    for s in set(source.values()):
        n = [counts[s, k] for k in range(8)]
        assert max(n) - min(n) <= 2
    again = shards.shard(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5), shards=8).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_nothing(nothing):
    assert shards.shard(nothing).collect() == []


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[:len(t) - half] + texts[(i + 1) % len(texts)][:half])
    return out


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_fingerprints_follow_the_next_document(spark, rows, buckets):
    rows = sorted({i: t or "" for i, t in rows if i is not None}.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = imatch.fingerprints(docs, low=0.01, high=0.9, buckets=buckets).select(
        "*", imatch.fingerprint_text(F.col("signature")).alias("fp"), imatch.fingerprint_text(F.col("edited_signature")).alias("efp"),
        imatch.fingerprint_text(F.col("next_signature")).alias("nfp"),
        imatch.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == [i for i, _ in rows]
    assert [r["n_chars"] for r in out] == [len(t) for _, t in rows]
    assert [r["edited_sha256"] for r in out] == [hashlib.sha256(t.encode()).hexdigest() for t in edited([t for _, t in rows])]
    assert [r["nfp"] for r in out] == [r["fp"] for r in out[1:] + out[:1]]
    by_text = defaultdict(set)
    for (_, t), r in zip(rows, out):
        by_text[t].add(r["fp"])
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1) >= (r["fp"] == r["efp"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_hash_the_lexicon_terms_alone(spark):
    texts = ["rare1 mid common", "mid common rare2", "other common", "other common mid x", "common", "common y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = imatch.fingerprints(docs, low=0.3, high=0.6).select(
        "doc_id", imatch.fingerprint_text(F.col("signature")).alias("fp")).orderBy("doc_id").collect()
    fp = [r["fp"] for r in out]
    assert fp[0] == fp[1] != fp[2] != fp[3] and len(set(fp)) == 5     # in the band: "mid" (3 of 6) and "other" (2 of 6)


def test_fingerprint_edges(spark, docs, rows, nothing):
    assert imatch.fingerprints(nothing).collect() == []
    one = imatch.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert one[0]["next_signature"] == one[0]["signature"]
    assert imatch.fingerprints(docs).count() == len(rows)


@pytest.mark.parametrize("name", ["op4_imatch", "op6_shards", "op8_url_filter"])
def test_native_queries_have_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want.fetchall())


def test_likeness_tells_the_edited_text_from_the_next(spark, sf):
    rows = queries.op4_imatch(spark, sf).select("near_edited", "near_next").collect()
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert (a > b).mean() > 0.9 and a.mean() > b.mean() + 0.1
