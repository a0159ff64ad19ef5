"""Embedding whitening on the components that FEAST finds.

1. *Moments* (one pass): rows, and per dimension the sum, least and largest of the integer
   coordinates x = floor(64 c) + 1000000. Sums are whole numbers, so exact in any order.
2. *Covariance* (one pass): products of the coordinates less the whole number nearest to their
   mean, added as longs where they fit (they do while rows times squared spread stays below
   2^62; else as doubles). What is left of the mean, at most a half, is taken off afterwards.
   A task sends d (d + 1) / 2 sums; the d x d matrix is all that the driver sees.
3. *Components*: ``feast.leading`` on that matrix.
4. *Check* (one pass): covariance of the whitened rows themselves, blocks centred before
   multiplying and merged by Chan's rule, against the identity.
5. *Result* (one pass): a row per vector and component.

Rows that are dropped: a null or empty vector, one with a null or non-finite entry, and one
whose length is not the table's most frequent length (of two as frequent, the larger): it has no
place in one covariance. Defined results: components whose eigenvalue is zero to rounding are left
out, so one row, or rows all alike, give no rows, as an empty table does; repeated rows count as
often as they occur; null ids are carried along; entries beyond 2^40 count as 2^40; ``deviation``
is null where it does not fit a long.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.feast import leading
from colscope.session import ship_package

SCALE, SHIFT = 64, 1_000_000
_ROWS = 4096
_FAR = float(1 << 40)


def coordinates(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a list column, and their integer coordinates."""
    length = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    flat = col.take(pa.array(rows)).flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(value).all(1) & ~null.reshape(-1, dim).any(1)
    x = np.floor(SCALE * np.clip(value[good], -_FAR, _FAR)).astype(np.int64) + SHIFT
    return rows[good], x


def _blocks(batches, dim: int):
    """``(ids, x)`` of at most ``_ROWS`` rows; ids is the batch's first column at those rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            rows, x = coordinates(part.column(part.num_columns - 1), dim)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), x


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors that could be used (0: there are none)."""
    top = (vectors.filter("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    return top[0]["d"] if top else 0


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, int]:
    """Rows, sums per dimension (exact), and the largest distance of a coordinate from the mean."""
    def run(batches):
        n, total = 0, np.zeros(dim, object)
        low, high = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for _, x in _blocks(batches, dim):
            n += len(x)
            total += x.sum(0).astype(object)
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            s = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), s, pa.array(low), pa.array(high)],
                                             ["d", "n", "s", "low", "high"])

    out = vectors.mapInArrow(run, "d long, n long, s decimal(38,0), low long, high long").groupBy("d").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(out.collect())
    if not rows:
        return 0, np.zeros(dim, object), 0
    n = rows[0]["n"]
    sums = [int(r["s"]) for r in rows]
    spread = max(max(r["high"] - s // n, s // n - r["low"]) for r, s in zip(rows, sums)) + 1
    return n, np.array(sums, object), int(spread)


def covariance(vectors: DataFrame, dim: int, n: int, sums: np.ndarray, spread: int) -> np.ndarray:
    """Covariance of all usable vectors, divisor ``n``."""
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    exact = n * spread * spread < 1 << 62
    whole = _ROWS * spread * spread < 1 << 53       # a block's products are exact as doubles
    upper = np.triu_indices(dim)

    def run(batches):
        total = np.zeros((dim, dim), np.int64 if exact else np.float64)
        some = False
        for _, x in _blocks(batches, dim):
            y = x - near
            some = True
            if exact and not whole:
                total += y.T @ y
            else:
                f = y.astype(np.float64)
                total += (f.T @ f).astype(total.dtype)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["cell", "s"])

    kind = "long" if exact else "double"
    rows = vectors.mapInArrow(run, f"cell long, s {kind}").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    v = np.zeros((dim, dim))
    for r in rows:
        v[upper[0][r["cell"]], upper[1][r["cell"]]] = r["s"] / n
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, near)], float)
    v = np.triu(v) - np.triu(np.outer(rest, rest))
    return v + np.triu(v, 1).T


def _centred(x: np.ndarray, n: int, sums: np.ndarray, fits: bool) -> np.ndarray:
    """n x - S, exact: longs where they fit, else Python's whole numbers."""
    return x * n - sums.astype(np.int64) if fits else x.astype(object) * n - sums


def identity_error(vectors: DataFrame, dim: int, project) -> float:
    """Largest entry of |covariance of the whitened rows - identity|. ``project`` maps integer
    coordinates to whitened rows."""
    def run(batches):
        n, mean, m2 = 0, 0.0, 0.0
        for _, x in _blocks(batches, dim):
            w = project(x)
            k, at = len(w), w.mean(0)
            c = w - at
            gap = at - mean
            m2 = m2 + c.T @ c + np.outer(gap, gap) * (n * k / (n + k))
            mean = mean + gap * (k / (n + k))
            n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(mean)]), pa.array([list(m2.ravel())])], ["n", "mean", "m2"])

    parts = vectors.mapInArrow(run, "n long, mean array<double>, m2 array<double>")
    # tasks' sums are added up as rows per cell; means beside them give Chan's correction
    cell = parts.select("n", "mean", F.posexplode("m2").alias("cell", "m2"))
    k = F.size("mean")
    a, b = F.get("mean", F.floor(F.col("cell") / k).cast("int")), F.get("mean", (F.col("cell") % k).cast("int"))
    rows = cell.select("cell", "n", "m2", k.alias("k"), a.alias("a"), b.alias("b")).groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("m2").alias("m2"), F.first("k").alias("k"),
        F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"),
        F.sum(F.col("n") * F.col("a") * F.col("b")).alias("ab")).collect()
    worst = 0.0
    for r in rows:
        value = (r["m2"] + r["ab"] - r["a"] * r["b"] / r["n"]) / r["n"]
        worst = max(worst, abs(value - (r["cell"] // r["k"] == r["cell"] % r["k"])))
    return worst


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` of every usable row
    and component (see the module text)."""
    spark = df.sparkSession
    ship_package(spark)
    vectors = _vectors(df, id_col, vector_col)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = dimension(vectors)
    n, sums, spread = moments(vectors.select("v"), dim) if dim else (0, None, 0)
    if not n:
        return spark.createDataFrame([], schema)
    v = covariance(vectors.select("v"), dim, n, sums, spread)
    e, q = leading(v, min(components, dim))
    found = len(e)
    if not found:
        return spark.createDataFrame([], schema)
    fits = n * spread < 1 << 62
    small = dim * (n * spread) ** 2 < 1 << 62
    turn = q / np.sqrt(e) / n
    explained = e / np.trace(v)

    def project(x):
        return _centred(x, n, sums, fits).astype(np.float64) @ turn

    error = identity_error(vectors.select("v"), dim, project)

    def run(batches):
        for ids, x in _blocks(batches, dim):
            y = _centred(x, n, sums, fits)
            if small:
                deviation = pa.array((y * y).sum(1))
            else:
                total = (y.astype(object) ** 2).sum(1)
                deviation = pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())
            row = pa.array(np.repeat(np.arange(len(x)), found))
            yield pa.RecordBatch.from_arrays([
                ids.take(row), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(row), n)), deviation.take(row), pa.array((y.astype(np.float64) @ turn).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(row), error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
