"""What a task of the corpus pipeline holds at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from colscope.llm import secrets
from colscope.llm.blocks import text_blocks
from colscope.llm.tables import BATCH_SETTINGS, short_batches, written


def test_a_scan_for_secrets_holds_little_beside_the_texts():
    """4 MB of texts: a scan's arrays of numbers per byte stay those of a short block (22 MB before)."""
    texts = pa.array(["plain words of a text, key = 0123456789abcdef0123 " * 40] * 2000)
    model = secrets.Model(np.zeros((secrets._N, secrets._N)))
    tracemalloc.start()
    try:
        found = sum(len(secrets.spans_of(b, model)) for b in text_blocks(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(texts)
    assert peak < 10 << 20


def test_written_reads_and_sends_few_rows_at_a_time(spark):
    """A task gets at most 500 rows at a time (2000 before); the session's settings come back."""
    before = {k: spark.conf.get(k) for k in BATCH_SETTINGS}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = written(spark.range(0, 3000, 1, 1).selectExpr("cast(id as string) as text"), "test-rows")
    sent = written(rows.mapInArrow(sizes, "n long"), "test-sizes")
    assert sent.agg({"n": "sum"}).first()[0] == 3000
    assert sent.agg({"n": "max"}).first()[0] <= 500
    assert {k: spark.conf.get(k) for k in BATCH_SETTINGS} == before
    with short_batches(spark, 7):
        assert {spark.conf.get(k) for k in BATCH_SETTINGS} == {"7"}
