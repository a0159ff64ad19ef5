"""op7 and op1 against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from llm_rows import words_of

from colscope.llm.blocks import Block
from colscope.llm.decontaminate import decontaminate, tile
from colscope.llm.neardup import bag_minhash, components, near_duplicates


def bag(text, k=5):
    w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    grams = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    return Counter(grams or [tuple(w) if w else ("", (text or ""))])


def classes(rows, limit=0.8):
    rows = [r for r in rows if r[0] is not None]
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if rows[i][0] == rows[j][0] or both >= limit * (bags[i].total() + bags[j].total() - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def test_classes_equal_brute_force(docs, rows):
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["class_id"] is None for r in got if r["doc_id"] is None)
    sizes = Counter(want[i] for i, _ in rows if i is not None)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got if r["doc_id"] is not None)


def test_chain_of_copies_is_one_class(spark):
    import random

    rng = random.Random(5)
    w = words_of(rng, 300)
    rows = []
    for i in range(30):         # neighbours are alike, the ends are not
        w = list(w)
        w[(i * 10) % 300] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows)


def test_no_rows(nothing):
    assert near_duplicates(nothing).collect() == []


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 2**44, 60).astype(np.uint64)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    a[:5], b[:5] = 40, 25
    rows = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = bag_minhash(rows, np.concatenate([ids[a > 0], ids[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 6)], "a long, b long")
    assert {r["id"]: r["label"] for r in components(links).collect()} == {
        **{i: 1 for i in range(1, 7)}, **{i: 7 for i in range(7, 10)}}


def brute_tiles(item, doc, k):
    """Greedy string tiling by looking at every pair of positions."""
    used_i, used_d, total = [False] * len(item), [False] * len(doc), 0
    k = min(k, len(item))
    while k:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and not used_i[i + n] and not used_d[j + n]):
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return total
        used_i[i:i + n] = [True] * n
        used_d[j:j + n] = [True] * n
        total += n
    return total


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        item = rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        doc = rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint64)
        k = int(rng.integers(2, 5))
        tiles = tile(item, doc, k)
        for i, j, n in tiles:
            assert (item[i:i + n] == doc[j:j + n]).all()
        marked = [x for i, _, n in tiles for x in range(i, i + n)]
        assert len(set(marked)) == len(marked)
        assert [n for _, _, n in tiles] == sorted((n for _, _, n in tiles), reverse=True)
        want = brute_tiles(item.tolist(), doc.tolist(), k) if len(item) else 0
        assert abs(sum(n for _, _, n in tiles) - want) <= 2 * k     # equal lengths may be chosen in another order


def test_leaks_are_found_and_clean_documents_left(spark, docs, rows):
    import random

    rng = random.Random(8)
    items = [" ".join(words_of(rng, 30)) for _ in range(8)] + ["tiny item", None, "", " ".join(words_of(rng, 40))]
    halves = items[3].split()
    planted = [(100, f"{rows[3][1]} {items[0]} {rows[4][1]}"), (101, " ".join(halves[15:] + ["between"] * 9 + halves[:15])),
               (102, items[5].upper()), (103, "prefix tiny item suffix"), (104, " ".join(items[6].split()[:10]))]
    more = spark.createDataFrame(planted + planted[:1], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate(docs.select("doc_id", "text").union(more), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(100, 0), (100, 0), (101, 3), (102, 5), (103, 8)]
    assert all(0.5 <= r["coverage"] <= 1 for r in got)
    assert {r["doc_id"]: r["tiles"] for r in got}[101] == 2


def test_empty_sides(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).collect() == []
    assert decontaminate(nothing, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def test_block_words_do_not_cross_texts():
    from colscope.llm.blocks import grams, words

    texts = ["ab", "c", "", "d e", "!"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t) for t in texts])
    w = words(Block(0, np.frombuffer(raw, np.uint8), off))
    assert w.counts.tolist() == [1, 1, 0, 2, 0]
    h, bounds = grams(w, 2)
    assert np.diff(bounds).tolist() == [1, 1, 0, 1, 0]
