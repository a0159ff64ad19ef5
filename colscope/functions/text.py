"""Column expressions shared by the operators. All JVM-side, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# seed literal that makes the second 64-bit hash independent of the first
_SEED2 = 0x5EED_C01D


def canonical_text(c: Column, dt: T.DataType) -> Column:
    """Sample-value text of one value (P7): strings as is, bytes as ``<bytes:N>``,
    nested values as their string cast, everything else cast to string."""
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(dt, T.BinaryType):
        return F.concat(F.lit("<bytes:"), F.octet_length(c).cast("string"), F.lit(">"))
    if isinstance(dt, T.MapType):
        return F.to_json(c)
    return c.cast("string")


def norm_key(c: Column, dt: T.DataType) -> Column:
    """Value normalised per family so that equal values of two columns compare equal
    (int and bigint are both widened to bigint)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("bigint")
    if isinstance(dt, T.MapType):
        return F.to_json(c)
    return c


def fingerprint(c: Column, dt: T.DataType) -> tuple[Column, Column]:
    """128-bit value fingerprint as two independent 64-bit xxhash values.

    Grouping on two longs instead of the raw value keeps the distinct-count and
    inclusion shuffles fixed-width whatever the column type (long texts, arrays).
    At 1e10 distinct values per column the chance of any collision is ~1e-19.
    Nulls give null.
    """
    v = norm_key(c, dt)
    h1 = F.when(c.isNotNull(), F.xxhash64(v))
    h2 = F.when(c.isNotNull(), F.xxhash64(F.lit(_SEED2), v))
    return h1, h2


def py_strip(c: Column) -> Column:
    """Trim all leading/trailing Unicode whitespace, like Python's ``str.strip``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truncate_text(c: Column, limit: int) -> Column:
    """Cell text: newlines become spaces, trimmed, cut to ``limit`` with ``...``."""
    t = py_strip(F.regexp_replace(c, "\n", " "))
    return F.when(F.char_length(t) <= limit, t).otherwise(
        F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def name_variants(name: Column) -> Column:
    """Keyword variants of an identifier, as a sorted distinct array.

    whole name, name without ``_``, ``_`` as space, the ``_`` parts, Hangul runs
    of 2+, Latin runs of 2+ in lower case; empty strings dropped.
    """
    parts = F.split(name, "_")
    hangul = F.regexp_extract_all(name, F.lit("([가-힣]{2,})"), 1)
    latin = F.transform(F.regexp_extract_all(name, F.lit("([a-zA-Z]{2,})"), 1), lambda w: F.lower(w))
    allv = F.concat(F.array(name, F.regexp_replace(name, "_", ""), F.regexp_replace(name, "_", " ")),
                    parts, hangul, latin)
    return F.array_sort(F.array_remove(F.array_distinct(allv), ""))


def strip_code_fence(text: Column) -> Column:
    """A2: trim; when the text opens with a code fence, drop its first and last line."""
    t = py_strip(text)
    lines = F.split(t, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(t.startswith("```"), F.when(F.size(lines) > 2, inner).otherwise(F.lit(""))).otherwise(t)
