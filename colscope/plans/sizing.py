"""Broadcast only behind a size check.

A side is broadcast when its size stays under ``max_bytes`` (default 64 MiB): measured, texts
included, by a cheap action on a batch, or rows known on the driver times the width of columns
that have a fixed one. Above it the plain DataFrame is returned
and Spark shuffles both sides; AQE may still convert at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BYTES = 64 * 1024 * 1024


def fits(rows: int, max_rows: int, row_bytes: int = 64, max_bytes: int = DEFAULT_MAX_BYTES) -> bool:
    return rows <= max_rows and rows * row_bytes <= max_bytes


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int, row_bytes: int = 64,
                       max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Hint broadcast when ``rows`` (already known) passes :func:`fits`."""
    return F.broadcast(df) if fits(rows, max_rows, row_bytes, max_bytes) else df


def _width(df: DataFrame) -> Column:
    """Bytes of a row: its texts as long as they are, 16 for any other plain value and for every column."""
    width = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return width


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_MAX_BYTES) -> tuple[DataFrame, bool, int]:
    """Count and measure ``df`` in one pass (it must be cheap: a batch of questions, edits, rules) and
    hint broadcast only if its rows and its bytes fit. Returns (frame, hinted, rows)."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    ok = got["n"] <= max_rows and got["bytes"] <= max_bytes
    return (F.broadcast(df) if ok else df), ok, got["n"]


#: Session setting with which a caller asks for a partition count, e.g. for tables that
#: arrive as one unsplittable file each. Unset: the scan's own splits are kept.
PARTITIONS_CONF = "spark.colscope.inputPartitions"


def dealt(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt round-robin to the partition count that the caller gave (the argument
    or the session setting); without one ``df`` as it is. Nothing is measured or run."""
    if df.isStreaming:
        return df      # a stream keeps its source's parallelism
    want = partitions or df.sparkSession.conf.get(PARTITIONS_CONF, None)
    return df.repartition(int(want)) if want else df


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of ``df`` (file sizes and column widths). Nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
