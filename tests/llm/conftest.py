"""Small tables for the operators of ``colscope.llm``."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import DOCS, corpus  # noqa: E402

def frame(spark, rows):
    """Rows with all columns of ``documents`` and some whose names operators use themselves."""
    return spark.createDataFrame(
        [(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 7 == 0 else f"src{(i or 0) % 3}",
          None if (i or 0) % 4 == 0 else len(t or ""), 0.5, "b", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def encoder_ids(tokenizer_path):
    """Ids of a whole text by the library alone, with the end id 0."""
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
