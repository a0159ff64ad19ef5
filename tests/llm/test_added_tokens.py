"""op2 and op3: texts that hold the literal of an added token, against an untouched library."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import DOCS

from colscope.llm import dac, packing
from colscope.llm.tables import shared_path
from colscope.llm.tokens import Encoder

TEXTS = ["see a<|endoftext|>b here", "see a b here", "<|endoftext|>", "x <|endoftext|> y, z", "a<|endoftext|><|endoftext|>", "<|endoftext", ""]


@pytest.fixture(scope="module")
def library_ids(tokenizer_path):
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(tokenizer_path)
    return lambda t: np.array(untouched.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


_ENC: dict = {}


def _shared(path):
    return _ENC.setdefault(path, Encoder(path))


def test_the_literal_of_an_added_token_has_its_id(tokenizer_path):
    assert np.frombuffer(_shared(tokenizer_path)(TEXTS[:1])[0], "<u4").tolist() == [3826, 257, 50256, 65, 994]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "　", "a", "don't", "7", "!", "<|endoftext|>", "<|", "|>", "漢"]), max_size=10).map("".join), max_size=6))
def test_ids_of_an_untouched_library(tokenizer_path, library_ids, texts):
    encoder = _shared(tokenizer_path)
    want = [library_ids(t) for t in texts]
    assert encoder(texts) == want
    assert encoder(texts) == want       # now with known parts


def test_pieces_and_files_of_an_untouched_library(spark, tokenizer_path, library_ids):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0.5, "b", 1) for i, t in enumerate(TEXTS)], DOCS)
    end = np.array([0], "<u4").tobytes()
    want = {i: library_ids(t) + end for i, t in enumerate(TEXTS)}
    pieces: dict = {}
    for r in sorted(packing.pack(docs, tokenizer_path, window=128, end_id=0).collect(), key=lambda r: r["start"]):
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + bytes(r["ids"])
    assert pieces == want
    path = shared_path(spark, "test-dac-added")
    dac.write(docs, path, tokenizer_path, end_id=0, files=2)
    got = sorted(dac.read(spark, path).collect(), key=lambda r: r["start"])
    assert {r["doc_id"]: zlib.crc32(bytes(r["ids"])) for r in got} == {i: zlib.crc32(x) for i, x in want.items()}
    assert [r["start"] for r in got] == [sum(len(want[i]) // 4 for i in range(n)) for n in range(len(TEXTS))]
