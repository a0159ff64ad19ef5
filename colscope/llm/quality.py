"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

    score(x) = sigmoid(b + <w, x> + 1/2 * sum_f ((x V)_f^2 - (x^2 V^2)_f))

The pairwise part uses the sum-of-squares identity, so a document is scored in
time linear in its features. ``fit`` trains on at most ``max_rows`` labelled rows
(half of them of either label, chosen by a hash of the id); their features are
computed in tasks and only these vectors reach the driver. Scoring is one pass
over the documents without a shuffle.

Defined results: a null or empty text has a feature vector like any other (no
words, zero statistics) and gets a score; null metadata is a bucket of its own;
without labelled rows every score is 0.5; with one label only, all rows get that
label's side of 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.blocks import Block, lean, text_blocks, words
from colscope.llm.tables import without_ids
from colscope.session import ship_package

WORD_DIMS = 4096
META_BUCKETS = 34
STATS = 16
MAX_TRAIN_ROWS = 4000


@dataclass
class Model:
    bias: float
    w: np.ndarray           # (dims,)
    v: np.ndarray           # (dims, rank)
    mean: np.ndarray        # of the structure statistics
    scale: np.ndarray


_KIND = np.zeros(256, np.int64)     # 1 lower, 2 upper, 3 digit, 4 white, 5 sentence mark, 6 other mark, 7 non-ASCII
for _c in range(256):
    ch = chr(_c)
    _KIND[_c] = (7 if _c >= 128 else 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit()
                 else 4 if ch.isspace() else 5 if ch in ".,;:?'\"()-" else 6)


def _share_of_repeats(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values / values, and the largest value's share (0 without values)."""
    total = np.bincount(rows, minlength=n).astype(float)
    key = (rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    uniq, cnt = np.unique(key, return_counts=True)
    r = (uniq >> np.uint64(44)).astype(np.int64)
    distinct = np.bincount(r, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, r, cnt)
    safe = np.maximum(total, 1)
    return distinct / safe, most / safe


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word weights (n x WORD_DIMS: log counts, unit length) and statistics (n x STATS)."""
    n, size = b.n, np.diff(b.offsets).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(b.offsets))
    kinds = np.bincount(row_of * 8 + _KIND[b.data], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    w = words(b)
    rows, count = w.rows(), w.counts.astype(float)
    x = np.bincount(rows * WORD_DIMS + (w.hash & np.uint64(WORD_DIMS - 1)).astype(np.int64),
                    minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    x = np.log1p(x, dtype=np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)
    same = np.zeros(len(rows), bool)
    if len(rows) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (rows[1:] == rows[:-1])
    distinct, most = _share_of_repeats(rows, w.hash, n)
    # a line is the bytes between line feeds; compared by first, last and number of words
    feed = np.concatenate([np.zeros(1, np.int64), np.cumsum(b.data == 10)])
    line_key = feed[w.start].astype(np.uint64) if len(rows) else np.zeros(0, np.uint64)
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = (line_key[1:] != line_key[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    line_hash = np.add.reduceat(w.hash, first) if len(first) else np.zeros(0, np.uint64)
    line_rows = rows[first]
    line_distinct, line_most = _share_of_repeats(line_rows, line_hash, n)
    lines = np.bincount(line_rows, minlength=n)
    length = (w.end - w.start).astype(float)
    mean_len = np.bincount(rows, weights=length, minlength=n) / np.maximum(count, 1)
    stats = np.column_stack([
        kinds[:, 1:8], np.log1p(count), mean_len, distinct, most, line_distinct, line_most,
        np.bincount(rows, weights=same, minlength=n) / np.maximum(count, 1),
        np.log1p(count / np.maximum(lines, 1)),
        (kinds[:, 5] + kinds[:, 6]) * size / np.maximum(count, 1),
    ])
    return x, stats.astype(np.float32)


def _meta(batch: pa.RecordBatch, cols: list[str], first: int, n: int) -> np.ndarray:
    """One-hot power-of-two buckets of each metadata column; the last one is for null."""
    out = np.zeros((n, META_BUCKETS * len(cols)), np.float32)
    for j, c in enumerate(cols):
        v = batch.column(batch.schema.get_field_index(c)).slice(first, n).cast(pa.float64(), safe=False)
        v = np.array([np.nan if x is None else x for x in v.to_pylist()], float)
        bucket = np.where(np.isnan(v), META_BUCKETS - 1,
                          np.clip(np.log2(np.maximum(np.nan_to_num(v), 0) + 1), 0, META_BUCKETS - 2)).astype(int)
        out[np.arange(n), META_BUCKETS * j + bucket] = 1
    return out


def _row_vectors(batches, text_col, meta_cols):
    for batch in batches:
        # 256 KB of text a block: its dense word matrix stays a few MB
        for b in text_blocks(batch.column(batch.schema.get_field_index(text_col)), 1 << 18):
            for lo in range(0, b.n, 256):
                hi = min(lo + 256, b.n)
                part = Block(b.first + lo, b.data[b.offsets[lo]:b.offsets[hi]], b.offsets[lo:hi + 1] - b.offsets[lo])
                x, stats = features(part)
                yield batch, part.first, part.n, x, stats, _meta(batch, meta_cols, part.first, part.n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
        metadata: tuple[str, ...] = ("n_chars",), max_rows: int = MAX_TRAIN_ROWS, rank: int = 8,
        epochs: int = 20, seed: int = 7) -> Model:
    """Train on ``docs`` with an entry (label 0 or 1) in ``labels``, at most ``max_rows`` entries.

    The entries are chosen from the narrow label table first, so the texts are never
    shuffled: each task keeps the chosen rows of its part of ``docs``."""
    ship_package(docs.sparkSession)
    meta = list(metadata)
    given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    ids = None
    for label in (0, 1):
        part = (given.filter(F.col("_y") == label).orderBy(F.xxhash64(F.lit(seed), F.col("_id").cast("string")), "_id")
                .limit(max_rows // 2))
        ids = part if ids is None else ids.unionByName(part)
    chosen = ids.distinct().collect()       # at most max_rows ids
    dims = WORD_DIMS + STATS + META_BUCKETS * len(meta)
    zero = Model(0.0, np.zeros(dims, np.float32), np.zeros((dims, rank), np.float32),
                 np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    if not chosen:
        return zero
    small = docs.sparkSession.createDataFrame([(r["_id"], r["_y"]) for r in chosen], given.schema)
    data = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(meta)])
    data = data.join(F.broadcast(small), "_id")     # max_rows ids: a bounded broadcast
    mcols = [f"_m{i}" for i in range(len(meta))]

    def vectors(batches):
        for batch, first, n, x, stats, m in _row_vectors(batches, "_text", mcols):
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("_id")).slice(first, n).cast(pa.string()),
                batch.column(batch.schema.get_field_index("_y")).slice(first, n),
                pa.array([a.tobytes() for a in at], pa.binary()),
                pa.array([x[i, a].astype(np.float16).tobytes() for i, a in enumerate(at)], pa.binary()),
                pa.array([s.tobytes() for s in stats], pa.binary()),
                pa.array([s.tobytes() for s in m], pa.binary())], ["id", "y", "at", "value", "stats", "meta"])

    got = data.mapInArrow(vectors, "id string, y int, at binary, value binary, stats binary, meta binary").collect()
    got.sort(key=lambda r: (r["id"], r["y"], bytes(r["at"])))
    got = got[:max_rows]
    if not got:
        return zero
    x = np.zeros((len(got), dims), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float16)
        x[i, WORD_DIMS:WORD_DIMS + STATS] = np.frombuffer(r["stats"], np.float32)
        x[i, WORD_DIMS + STATS:] = np.frombuffer(r["meta"], np.float32)
    y = np.array([r["y"] for r in got], np.float32)
    part = x[:, WORD_DIMS:WORD_DIMS + STATS]
    mean, scale = part.mean(0), np.maximum(part.std(0), 1e-3)
    x[:, WORD_DIMS:WORD_DIMS + STATS] = np.clip((part - mean) / scale, -6, 6) / 2
    return _descend(x, y, mean, scale, rank, epochs, seed)


def _forward(x, bias, w, v):
    xv = x @ v
    return bias + x @ w + 0.5 * ((xv * xv).sum(1) - ((x * x) @ (v * v)).sum(1)), xv


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x, y, mean, scale, rank, epochs, seed) -> Model:
    """Adam on the logistic loss with small L2 terms; rows weighted so that both labels count alike."""
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    p = [np.zeros(1, np.float32), np.zeros(dims, np.float32), rng.normal(0, 0.02, (dims, rank)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    ones = max(y.sum(), 1)
    weight = np.where(y == 1, n / (2 * ones), n / (2 * max(n - y.sum(), 1))).astype(np.float32)
    step, size = 0, 128
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, size):
            k = order[lo:lo + size]
            xb = x[k]
            z, xv = _forward(xb, p[0], p[1], p[2])
            g = ((_sigmoid(z) - y[k]) * weight[k] / len(k)).astype(np.float32)
            grad = [np.array([g.sum()], np.float32), xb.T @ g + 1e-4 * p[1],
                    xb.T @ (g[:, None] * xv) - ((xb * xb).T @ g)[:, None] * p[2] + 1e-3 * p[2]]
            step += 1
            for i in range(3):
                m[i] = 0.9 * m[i] + 0.1 * grad[i]
                s[i] = 0.999 * s[i] + 0.001 * grad[i] ** 2
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(p[0][0]), p[1], p[2], mean, scale)


def _scores(model: Model, x, stats, meta) -> np.ndarray:
    full = np.hstack([x, np.clip((stats - model.mean) / model.scale, -6, 6) / 2, meta]).astype(np.float32)
    return _sigmoid(_forward(full, model.bias, model.w, model.v)[0].astype(np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """``(id_col, score)`` for every row."""
    ship_package(docs.sparkSession)
    mcols = [f"_m{i}" for i in range(len(metadata))]
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"),
                       *[F.col(c).cast("double").alias(m) for c, m in zip(metadata, mcols)])
    shared = docs.sparkSession.sparkContext.broadcast(model)    # dims x (rank + 1) floats: a fixed size

    def run(batches):
        for batch, first, n, x, stats, m in _row_vectors(batches, "_text", mcols):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(_scores(shared.value, x, stats, m))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text",
              metadata: tuple[str, ...] = ("n_chars",), id_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``. With ``id_col`` (not null; rows
    that share it have one score) the ids of the others are written now and no text with them;
    what is left to run is a join without Python."""
    ship_package(docs.sparkSession)
    if id_col is not None:
        scored = score(docs, model, id_col, text_col, metadata)
        return without_ids(docs, scored.filter((F.col("score") < threshold) | F.isnan("score")), id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, first, n, x, stats, m in _row_vectors(batches, text_col, list(metadata)):
            keep = pa.array(_scores(shared.value, x, stats, m) >= threshold)
            yield batch.slice(first, n).filter(keep)

    return docs.mapInArrow(lean(run), docs.schema)
