"""One text at a time goes through the same rules as a log, for every text."""

from __future__ import annotations

import pytest
from test_examples_guard import TEXTS

from colscope.operators import guard


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_single_text_equals_log(spark, i):
    row = guard.audit(spark.createDataFrame([(TEXTS[i],)], "sql string")).first()
    v = guard.validate(spark, TEXTS[i])
    assert (v["is_valid"], v["error_type"], v["rule"]) == (row["is_valid"], row["error_type"], row["rule"])
