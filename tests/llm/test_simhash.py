"""op11: fingerprints and components against brute force; the grid and the exact points."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colscope.llm import simhash


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id reachable over links at two bits or fewer; ``prints``: (id or None, fingerprint)."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        r = find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [least.get(find(i)) for i in range(len(prints))]


def test_every_row_against_brute_force(docs, rows, nothing):
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = [(i, f - (f >> 63 << 64), c) for (i, f), c in zip(prints, brute_components(prints))]
    assert got == sorted(want, key=repr)
    assert simhash.near_duplicates(nothing).collect() == []


def test_long_text_is_read_in_parts(monkeypatch):
    rng = random.Random(2)
    text = "  ".join("".join(rng.choice("abcdeÄß") for _ in range(rng.randint(1, 30))) for _ in range(500)) + "\n\x0b x\x1cy"
    want = brute_fingerprint(text)
    assert simhash.fingerprint(text.encode()) == want
    chunks = simhash._word_chunks
    monkeypatch.setattr(simhash, "_word_chunks", lambda t: chunks(t, 7))
    monkeypatch.setattr(simhash, "_STEP", 5)
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"a b") == brute_fingerprint("a b") and simhash.fingerprint(b" \n") == 0


def test_jvm_hash_is_the_same(spark):
    from pyspark.sql import functions as F
    from xxhash import xxh64_intdigest

    for text in ("", "a b c", "é" * 40):
        h = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
        assert h % (1 << 64) == xxh64_intdigest(text.encode(), seed=42)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=2), st.sampled_from([2, 4]))
def test_counts_never_differ_by_more_than_the_bits(x, flips, width):
    y = x
    for b in flips:
        y ^= 1 << b
    count = lambda v: [(v >> i & (1 << width) - 1).bit_count() for i in range(0, 64, width)]
    assert sum(abs(a - b) for a, b in zip(count(x), count(y))) <= (x ^ y).bit_count()


def _nodes(spark, prints):
    return spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "fp long").cache()


@pytest.mark.parametrize("width", [2, 4])
def test_cells_hold_the_segment_counts(spark, width):
    rng = random.Random(1)
    prints = [0, 2**64 - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(20))]
    got = {}
    for r in simhash.cells(_nodes(spark, prints), width).collect():
        got.setdefault(r["fp"] % (1 << 64), set()).add(r["cell"] % (1 << 64))
    for x in prints:
        count = [(x >> i & (1 << width) - 1).bit_count() for i in range(0, 64, width)]
        near = [count] + [count[:i] + [c + d] + count[i + 1:] for i, c in enumerate(count) for d in (-1, 1) if 0 <= c + d <= width]
        assert got[x] == {sum(c << width * i for i, c in enumerate(v)) for v in near}


@pytest.mark.parametrize("crowd", [32, 2])
@pytest.mark.parametrize("width", [2, 4])
def test_links_connect_what_two_bits_connect(spark, crowd, width):
    """Also where cells are crowded: chains, a dense ball around one fingerprint, and strangers."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ 1 << b for b in range(40)} | {centre ^ 3 << 2 * b ^ 1 << 63 for b in range(12)} | {rng.getrandbits(64) for _ in range(60)}
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        prints.add(chain)
        chain ^= 3 << b
    prints = sorted(prints)
    found = simhash.links(_nodes(spark, prints), width, crowd).collect()
    at = {f: i for i, f in enumerate(prints)}
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        a, b = at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]
        assert (prints[a] ^ prints[b]).bit_count() <= 2
        label[find(a)] = find(b)
    want = brute_components(list(enumerate(prints)))
    for i in range(len(prints)):
        for j in range(i):
            assert (find(i) == find(j)) == (want[i] == want[j])


def test_a_hot_key_is_joined_in_parts(spark):
    from pyspark.sql import functions as F

    from colscope.llm.tables import by_key, written

    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, 7).when(F.col("id") % 5 > 0, F.col("id") % 50).alias("k"))
    values = written(rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "test-values")
    got = by_key(rows, values, "k")
    assert got.columns == ["k", "id", "m"] or set(got.columns) == {"id", "k", "m"}
    want = rows.join(values.drop("n"), "k", "left").select("id", "k", "m")
    assert sorted(map(tuple, got.select("id", "k", "m").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
