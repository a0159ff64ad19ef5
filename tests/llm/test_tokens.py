"""op2 and op3: ids against the library, packing laws, code round trips."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colscope.llm import dac, packing
from colscope.llm.tables import shared_path
from colscope.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoder(tokenizer_path):
    return Encoder(tokenizer_path)


def plain(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "don't", "s", "é", "7", "!", "<|endoftext|>", "漢"]),
                         max_size=12).map("".join), max_size=6))
def test_parts_give_the_ids_of_whole_texts(tokenizer_path, texts):
    encoder = _shared(tokenizer_path)
    assert encoder(texts) == plain(encoder, texts)
    assert encoder(texts) == plain(encoder, texts)       # now with known parts


_ENC: dict = {}


def _shared(path):
    return _ENC.setdefault(path, Encoder(path))


def test_cache_bound_does_not_change_ids(encoder, monkeypatch):
    import colscope.llm.tokens as tokens

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(60)]
    want = plain(encoder, texts)
    monkeypatch.setattr(encoder, "cache_bytes", 20 * tokens.PART_BYTES)
    for i in range(0, 60, 5):
        assert encoder(texts[i:i + 5]) == want[i:i + 5]
    assert encoder(texts) == want


def test_new_words_are_encoded_many_to_a_text(tokenizer_path, monkeypatch):
    """The library gets texts of many new words, not a text for each, and nothing for words met before."""
    encoder = Encoder(tokenizer_path)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(3000)]
    texts = [" ".join(words[i:i + 100]) + "." for i in range(0, 3000, 100)]
    want = plain(encoder, texts)
    given, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda some: given.extend(some) or encode(some))
    assert encoder(texts) == want and len(given) < 100
    given.clear()
    assert encoder(texts[::-1]) == want[::-1] and not any(given)


def test_ids_that_cannot_be_told_apart_are_encoded_one_by_one(tokenizer_path):
    """Where the bytes of the ids do not say which word they belong to, each word is a text."""
    encoder = Encoder(tokenizer_path)
    texts = ["some words, and others", "words of  two\u2003spaces \u3000and é, "]
    want = plain(encoder, texts)
    encoder.size[:] = 1
    assert encoder(texts) == want


def test_parts_that_came_most_often_stay(tokenizer_path):
    import colscope.llm.tokens as tokens

    encoder = Encoder(tokenizer_path, 40 * (tokens.PART_BYTES + 8))
    rng = random.Random(3)
    for _ in range(6):
        encoder(["a often often often often"] + [" ".join("".join(rng.choice("abcde") for _ in range(9)) for _ in range(30))])
        assert encoder.held <= encoder.cache_bytes and len(encoder.parts) == len(encoder.n) == len(encoder.first) == len(encoder.met)
        assert encoder.n.sum() == len(encoder.ids) and " often" in encoder.parts


def test_an_idle_worker_holds_no_encoder(tokenizer_path, monkeypatch):
    import time

    import colscope.llm.tokens as tokens

    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.2)
    shared = tokens._Shared()
    want = shared(tokenizer_path, ["two words", "two more words"], None)
    assert len(shared.encoders) == 1 and shared(tokenizer_path, ["two words", "two more words"], 1 << 20) == want
    for _ in range(100):
        time.sleep(0.05)
        if not shared.encoders:
            break
    assert not shared.encoders and not shared.watched
    assert shared(tokenizer_path, ["two words", "two more words"], None) == want and shared.watched


def test_an_idle_worker_gives_the_memory_of_its_encoder_back(tokenizer_path, monkeypatch):
    import time

    import colscope.llm.tokens as tokens

    given = []
    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.2)
    shared = tokens._Shared()
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(len(shared.encoders)), raising=False)
    shared(tokenizer_path, ["two words"], None)
    for _ in range(100):
        time.sleep(0.05)
        if 0 in given:      # encoders of other tests may be let go meanwhile
            break
    assert 0 in given


def test_pack_places_every_id_once(docs, rows, encoder, tokenizer_path):
    got = packing.pack(docs, tokenizer_path, window=128, end_id=0).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= 128
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    end = np.array([0], "<u4").tobytes()
    want = defaultdict(list)
    for (i, _), ids in zip(rows, plain(encoder, [t or "" for _, t in rows])):
        want[i, len(ids) // 4 + 1].append(ids + end)
    for key, texts in want.items():
        parts = sorted(pieces[key])
        assert b"".join(p for _, p in parts) == b"".join(texts) or len(texts) > 1
        assert sum(len(p) for _, p in parts) == sum(map(len, texts))
    assert set(pieces) == set(want)
    short = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 128
        short += at < 128
    assert short <= 1


def test_solver_uses_only_what_there_is():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 5000):
        hist = np.bincount(rng.integers(1, 65, n), minlength=65)
        combos, repeat = packing.solve(hist, 64)
        used = np.zeros(65, int)
        for c, r in zip(combos, repeat):
            assert c.sum() == 64 and r > 0
            for length in c[c > 0]:
                used[length] += r
        assert (used <= hist).all()
        if n == 5000:
            assert (used * np.arange(65)).sum() > 0.8 * (hist[:64] * np.arange(64)).sum()


def test_layout_has_one_place_for_every_piece():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        hist = np.bincount(rng.integers(1, 65, n), minlength=65)
        runs = packing.layout(hist, 64).tolist()
        got = []
        for length in range(1, 65):
            for rank in range(hist[length]):
                _, first, at, step = [r for r in runs if r[0] == length and r[1] <= rank][-1]
                got.append((at + (rank - first) * step, length))
        got.sort()      # gapless
        assert [a for a, _ in got] == np.cumsum([0, *(x for _, x in got)])[:-1].tolist()


def test_places_come_in_pieces_of_a_batch(spark, monkeypatch):
    rows = [(p, n, 1 + (p + n) % 7, 3 * p) for p in range(20) for n in (5, 9, 64)]
    before = spark.createDataFrame(rows, "part long, length long, n long, before long").coalesce(1)
    runs = packing.layout(np.bincount([5] * 100 + [9] * 100 + [64] * 100, minlength=65), 64)
    whole = sorted(map(tuple, packing._places(before, runs).collect()))
    assert [len(x) for _, _, x in whole] == [n for *_, n, _ in sorted(rows)]
    _, first, at, step = next(r for r in runs.tolist() if r[0] == 64)
    assert all(x == [at + (3 * p + i - first) * step for i in range(len(x))] for p, n, x in whole if n == 64)
    monkeypatch.setattr(packing, "_PLACES_AT_ONCE", 8)
    assert sorted(map(tuple, packing._places(before, runs).collect())) == whole


def test_no_text_or_id_of_the_packed_pieces_goes_to_python(docs, tokenizer_path):
    plan = packing.pack(docs, tokenizer_path, window=64)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    assert "lambda" not in plan     # not generated code: the join's rows, which hold a task's places, would be copied


def test_no_exchange_of_the_layout_moves_ids(docs, tokenizer_path):
    plan = packing.pack(docs, tokenizer_path, window=64)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanges and "Bucketed: true" in plan and "ShuffledHashJoin" in plan
    at = next(i for i, line in enumerate(plan.split("\n")) if "ShuffledHashJoin" in line)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    lines = plan.split("\n")[at + 1:]
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "ids" in line)
    assert not any("Exchange" in line for line in lines[:scan])


def test_packing_an_empty_table(nothing, tokenizer_path):
    assert packing.pack(nothing, tokenizer_path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip_and_address(ids):
    levels = dac.encode(np.array(ids, np.uint32))
    assert dac.decode(levels).tolist() == ids
    for i in range(0, len(ids), 37):
        assert dac.access(levels, i) == ids[i]


def test_token_files(spark, docs, rows, encoder, tokenizer_path, monkeypatch):
    path = shared_path(spark, "test-dac")
    monkeypatch.setattr(dac, "SEGMENT", 2000)
    dac.write(docs, path, tokenizer_path, end_id=2, files=4)
    got = sorted(dac.read(spark, path).collect(), key=lambda r: r["start"])
    end = np.array([2], "<u4").tobytes()
    want = [(i, x + end) for (i, _), x in zip(rows, plain(encoder, [t or "" for _, t in rows]))]
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    assert sorted(zlib.crc32(bytes(r["ids"])) for r in got) == sorted(zlib.crc32(x) for _, x in want)
    flat = np.frombuffer(b"".join(bytes(r["ids"]) for r in got), "<u4")
    for position in (0, 1, len(flat) // 2, len(flat) - 1):
        assert dac.token_at(spark, path, position) == flat[position]
    assert dac.token_at(spark, path, len(flat)) is None


def test_token_files_of_an_empty_table(spark, nothing, tokenizer_path):
    path = shared_path(spark, "test-dac-empty")
    dac.write(nothing, path, tokenizer_path)
    assert dac.read(spark, path).collect() == []
