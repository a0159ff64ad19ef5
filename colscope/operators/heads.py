"""The first rows of a table in an order over all its columns, without sorting its rows.

The n-th smallest value of the leading column comes from that column alone (a bounded heap per
task), and rows up to it are read with a filter that reaches the scan. Where that value is shared
by more rows than are wanted, the next column decides, among those rows only, and so on. So a
level reads one column, of fewer rows each time, and long texts are read only of rows that tie
in everything before them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_TEXT = 1000        # a longer value is not written into a filter


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(name: str, dt: T.DataType) -> str | None:
    """SQL for a value's exact text, or None where a value cannot be written as a literal."""
    c = _quoted(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return f"CAST({c} + CAST(0 AS {dt.simpleString()}) AS STRING)"      # -0.0 and 0.0 are one value
    if isinstance(dt, T.TimestampType):
        return f"CAST(unix_micros({c}) AS STRING)"
    if type(dt) is T.StringType:
        return c if dt == T.StringType() else None
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampNTZType, T.DecimalType)):
        return f"CAST({c} AS STRING)"
    return None


def _literal(value: str, dt: T.DataType) -> str:
    text = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dt, T.TimestampType):
        return f"timestamp_micros({int(value)})"
    return text if type(dt) is T.StringType else f"CAST({text} AS {dt.simpleString()})"


@dataclass
class _Search:
    """How far the head of one table is known."""

    need: int
    tied: list[str] = field(default_factory=list)       # equalities that the rows still to be told apart share
    found: list[str] = field(default_factory=list)      # filters of rows that are in for certain
    level: int = 0
    done: bool = False

    def close(self, *more: str) -> None:
        self.found.append(" AND ".join([*self.tied, *more]) or "true")
        self.done = True


def _step(s: _Search, name: str, dt: T.DataType, values: list[str | None]) -> None:
    """``values``: the first ``need + 1`` values of the column among the tied rows, nulls first."""
    c = _quoted(name)
    if len(values) <= s.need:
        return s.close()
    cut = values[s.need - 1]
    if cut is not None and len(cut) > LONG_TEXT:
        return s.close()        # the few rows that tie so far are sorted as they are
    is_cut = f"{c} IS NULL" if cut is None else f"{c} = {_literal(cut, dt)}"
    if values[s.need] != cut:
        return s.close(is_cut if cut is None else f"({c} IS NULL OR {c} <= {_literal(cut, dt)})")
    before = values[:s.need].index(cut)
    if before:
        s.found.append(" AND ".join([*s.tied, f"({c} IS NULL OR {c} < {_literal(cut, dt)})"]))
    s.need -= before
    s.tied.append(is_cut)


def head_filters(tables: Mapping[str, DataFrame], orders: Mapping[str, Sequence[str]], n: int) -> dict[str, str]:
    """For each table a filter (SQL text) that keeps its first ``n`` rows by ``orders`` (ascending,
    nulls first) and, beside them, at most rows that tie with the last one. A job per level
    serves all tables; at most n + 1 values of a table come to the driver."""
    search = {t: _Search(n) for t in tables}
    while any(not s.done for s in search.values()):
        parts, at = [], {}
        for t, s in search.items():
            if s.done:
                continue
            if s.level >= len(orders[t]):
                s.close()           # rows alike in all columns of the order
                continue
            name = orders[t][s.level]
            dt = tables[t].schema[name].dataType
            text = _text(name, dt)
            if text is None:
                s.close()
                continue
            at[t] = (name, dt)
            c = F.col(_quoted(name))
            if type(dt) is T.StringType:
                c, text = F.substring(c, 1, LONG_TEXT + 1), f"substring({text}, 1, {LONG_TEXT + 1})"
            rows = tables[t].where(" AND ".join(s.tied)) if s.tied else tables[t]
            parts.append(rows.orderBy(c.asc_nulls_first()).limit(s.need + 1)
                         .select(F.lit(t).alias("t"), F.expr(text).alias("v")))
        values: dict[str, list] = {t: [] for t in at}
        if parts:
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            for r in out.collect():
                values[r["t"]].append(r["v"])
        for t, (name, dt) in at.items():
            _step(search[t], name, dt, values[t])
            search[t].level += 1
    return {t: " OR ".join(f"({f})" for f in s.found) for t, s in search.items()}
