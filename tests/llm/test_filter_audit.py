"""op13: the Gray-code walk and the whole audit against plain counting over every order."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colscope.llm import filter_audit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 50), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=32,
                unique_by=lambda c: c[0]))
def test_states_are_the_counts_of_all_subsets(cells):
    mask = np.array([c[0] for c in cells])
    counts = np.array([c[1:] for c in cells])
    states = filter_audit.survivors(mask, counts, 5)
    for s in range(32):
        assert states[s].tolist() == counts[(mask & s) == 0].sum(0).tolist()


def fails(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]


def brute(docs, labels):
    """Rows of the contract by applying every order to every document."""
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    rows = [(part or "", fails(t or "") + [i is not None and i > least[t or ""]], i in good, i in toxic) for i, t, part in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                name = "".join("ABCDE"[x] for x in order)
                out[part, name, step] = (len(left) - len(gone), len(gone), sum(r[1][f] for r in mine) - len(gone),
                                         sum(r[1] == [x == f for x in range(5)] for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] += len(gone)
                left = [r for r in left if not r[1][f]]
    return {(p, n, s): (*v, shapley[p, "ABCDE".index(n[s - 1])]) for (p, n, s), v in out.items()}


def test_audit_equals_plain_counting(spark, rows):
    odd = [(i, t, [None, "", "en", "de"][(i or 0) % 4]) for i, t in rows]
    odd += [(100, "Z" * 5 + "word " * 400, "de"), (101, "w1 w2 " * 150, "fr"), (102, "w1 w2 " * 150, "fr"), (103, "a" * 10 + "|", "fr"),
            (None, "w1 w2 " * 150, "fr"), (101, "w1 w2 " * 150, "fr"), (104, "CapsÉ \U0001f600 " * 300, "en"), (50, " ".join(map(str, range(300))), "en")]
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 0.5) for i, t, lang in odd], "doc_id long, text string, lang string, mask int, part string, n double")
    marks = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (101, 1, 1), (102, 1, 0), (None, 1, 1), (999, 1, 1), (50, 1, None), (30, None, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, digest string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute(odd, marks)
    assert len(got) == 4 * 600


def test_empty_tables(spark, nothing, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing, none).collect() == []
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in filter_audit.audit(docs, none).collect())
