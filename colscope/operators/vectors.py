"""V1/V2: term vectors and exact cosine top-k.

V1 (built in, no model): tokens -> bucket = md5 prefix mod B -> term
frequency -> unit length. A dense model's vectors plug in as an
``array<float>`` column instead (e.g. from the caller's pandas UDF).

V2 streams the items past blocks of questions:

* both sides are packed where they lie, a block of vectors per row (``mapInArrow``, no
  exchange): unit vectors as one matrix, or, for sparse ones, the stored terms - the
  questions' as posting lists (bucket -> question, weight);
* the question blocks are broadcast while Spark's size estimate of the questions is under a
  bound; beyond it they are dealt into parts of that size, and each partition of
  items is read once per part (a nested loop over blocks). The item vectors cross no exchange
  either way;
* ``mapInArrow`` scores a pair of blocks at a time, as a matrix product or by the posting
  lists of the terms that both hold, and keeps a running top-k per question; only a score that
  reaches its question's least kept one is looked at;
* a task gives one row per question, with its top-k as an array: what is shuffled goes by
  questions and partitions of items, not by pairs of blocks. A ``row_number`` window per question
  over these gives the global one (ties broken by item id).

Nothing passes through the driver, building the result runs no job, and no pair leaves a
task beyond its local top-k. What a task holds is bounded: a block of each side,
``chunk_cells`` scores and ``STATE_CELLS`` kept scores. More are let go and merged later; each
question's least kept score stays and is the bound for what follows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from colscope.plans.sizing import dealt, estimated_bytes
from colscope.session import ship_package

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
SCORE_DECIMALS = 12
CHUNK_CELLS = 2_000_000      # scores held at a time
STATE_CELLS = 4_000_000      # kept scores of a task
QUESTION_BYTES = 8 << 20     # of questions that a task meets, as estimated: some 25,000 vectors of 64 floats
MAX_PARTS = 1000             # of the questions; an estimate beyond that many says nothing


def tokens(text: F.Column) -> F.Column:
    """Lower-cased letter/digit runs of a text (array<string>, empties dropped)."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT), "")


def bucket_of(token: F.Column, buckets: int) -> F.Column:
    """Stable bucket of a token: first 8 hex digits of its md5, mod ``buckets``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def packed_terms(df: DataFrame, id_col: str, text_col: str, buckets: int = 4096) -> DataFrame:
    """V1: ``(id, idx array<int>, val array<double>)`` - one unit-length term-frequency vector
    per row, computed inside the row (no exchange). A text without a token keeps its row,
    with empty arrays: its cosine with anything is 0."""
    rows = dealt(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.sort_array(F.transform(
        F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")), lambda t: bucket_of(t, buckets))).alias("_b"))
    # runs of equal buckets in the sorted array: where they start, and how long they are
    rows = rows.select("id", "_b", F.expr(
        "filter(sequence(0, greatest(size(_b) - 1, 0)), i -> i < size(_b) AND (i = 0 OR _b[i] <> _b[greatest(i - 1, 0)]))").alias("_s"))
    rows = rows.select("id", F.expr("transform(_s, i -> _b[i])").alias("idx"), F.expr(
        "transform(_s, (i, j) -> CAST(coalesce(get(_s, j + 1), size(_b)) - i AS DOUBLE))").alias("_tf"))
    norm = F.sqrt(F.aggregate("_tf", F.lit(0.0), lambda s, x: s + x * x))
    # the norm as an array beside the counts: inside a lambda it would be taken anew for every term
    return rows.select("id", "idx", F.zip_with("_tf", F.array_repeat(norm, F.size("_tf")), lambda x, n: x / n).alias("val"))


def term_vectors(df: DataFrame, id_col: str, text_col: str, buckets: int = 4096) -> DataFrame:
    """V1 in long form: ``(id, bucket, weight)``, a row per stored term."""
    packed = packed_terms(df, id_col, text_col, buckets)
    return packed.select("id", F.explode(F.arrays_zip("idx", "val")).alias("_t")).select(
        "id", F.col("_t.idx").alias("bucket"), F.col("_t.val").alias("weight"))


def _topk_columns(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row-wise positions of the top-k by (score desc, id asc), as a (q, min(k, n)) matrix.
    ``ids`` gives each position's id, shape (n,) or (q, n); it is looked at only where exact
    ties stand at the cut."""
    q, n = scores.shape
    if n <= k:
        return np.tile(np.arange(n), (q, 1))
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, part, axis=1).min(axis=1)
    tied = np.flatnonzero(((scores >= least[:, None]).sum(axis=1) > k) & (least > -np.inf))
    if len(tied):
        some, cut = scores[tied], least[tied][:, None]
        keep = some > cut
        row, col = np.nonzero(some == cut)
        # all rows at once, by row and then id, nulls first
        order = pc.sort_indices(pa.table({"row": row, "id": pa.array((ids[tied][row, col] if ids.ndim == 2 else ids[col]).tolist())}),
                                [("row", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < (k - keep.sum(axis=1))[row]
        keep[row[first], col[first]] = True
        part[tied] = np.nonzero(keep)[1].reshape(-1, k)
    return part


def _ids(col: pa.Array) -> np.ndarray:
    if pa.types.is_integer(col.type) and not col.null_count:
        return col.to_numpy(zero_copy_only=False)
    out = np.empty(len(col), object)
    out[:] = col.to_pylist()
    return out


def _usable(rows: np.ndarray, owner: np.ndarray, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``rows`` have only non-null, finite entries, and the entries as doubles."""
    value = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(rows), bool)
    bad[owner[~np.isfinite(value)]] = True
    return ~bad, value


def _unit_rows(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(owner, value * value, n))
    norm[norm == 0] = 1.0
    return value / norm[owner]


def _packed(df: DataFrame, id_col: str, vec_cols: list[str], dim: int | None, block: int, side: str) -> DataFrame:
    """Blocks of at most ``block`` vectors of one width as single rows, packed where they lie (no
    exchange): ``{side}_block`` (a number of its own), ``{side}_w``, ``{side}_ids``, ``{side}_val`` (unit
    vectors, doubles) and, for sparse vectors, ``{side}_row`` and ``{side}_idx``: an entry per stored
    term, by row for items (side i) and by bucket, as posting lists, for questions (side q)."""
    kind = T.StructType([T.StructField(f"{side}_block", T.LongType()), T.StructField(f"{side}_w", T.IntegerType()),
                         T.StructField(f"{side}_ids", T.ArrayType(df.schema[id_col].dataType))]
                        + [T.StructField(f"{side}_{c}", T.BinaryType()) for c in ("val", "row", "idx")])

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            length = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
            for w in np.unique(length[length >= 0]) if dim is None else [dim]:
                here = np.flatnonzero(length == w if dim is None else length >= 0)
                # at most ``block`` vectors and about a million stored terms in a block
                terms = np.cumsum(np.maximum(length[here], 1))
                cut = np.unique(np.concatenate([np.arange(0, len(here), block), np.searchsorted(terms, np.arange(1, terms[-1] // 1_000_000 + 1) * 1_000_000)])
                                ) if len(here) else []
                for rows in np.split(here, cut[1:]) if len(here) else []:
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    owner = np.repeat(np.arange(len(rows)), length[rows])
                    good, value = _usable(rows, owner, part.column(part.num_columns - 1).flatten())
                    if not good.all():
                        part, keep = part.filter(pa.array(good)), good[owner]
                        value, owner = value[keep], (np.cumsum(good) - 1)[owner[keep]]
                    n = part.num_rows
                    value = _unit_rows(value, owner, n)
                    extra = [None, None]
                    if dim is not None:
                        bucket = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                        if side == "q":
                            order = np.argsort(bucket, kind="stable")
                            value, owner, bucket = value[order], owner[order], bucket[order]
                        extra = [owner.astype(np.int32).tobytes(), bucket.tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([int(w)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0)),
                         *[pa.array([x], pa.binary()) for x in (value.tobytes(), *extra)]], [f.name for f in kind.fields])
                    number += 1

    return df.select(id_col, *vec_cols).mapInArrow(run, kind)


def _dense_scores(x: np.ndarray, q: np.ndarray, cells: int):
    """(first item, scores of the questions against the items from there), in parts of at most ``cells`` cells."""
    step = max(1, cells // max(1, len(q)))
    for lo in range(0, len(x), step):
        yield lo, q @ x[lo:lo + step].T


def _sparse_scores(item: tuple, n: int, postings: tuple, n_q: int, dim: int, cells: int):
    """The same from posting lists: work and memory go by the terms that items and questions share."""
    row, idx, val = item
    q_row, q_idx, q_val = postings
    first = np.searchsorted(q_idx, np.arange(dim + 1))
    many = (first[1:] - first[:-1])[idx]                # questions that hold each of the items' terms
    per_item = np.bincount(row, many, n).astype(np.int64)
    done = np.concatenate([[0], np.cumsum(per_item)])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(done, done[lo] + cells, "right")) - 1
        hi = min(max(hi, lo + 1), lo + max(1, cells // max(1, n_q)), n)
        t = slice(ends[lo], ends[hi])
        m, total = many[t], int(done[hi] - done[lo])
        at = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[idx[t]], m)
        cell = q_row[at] * (hi - lo) + np.repeat(row[t] - lo, m)
        yield lo, np.bincount(cell, np.repeat(val[t], m) * q_val[at], n_q * (hi - lo)).reshape(n_q, hi - lo)
        lo = hi


class _Best:
    """Running top-k of one block of questions; places not filled yet have score -inf."""

    def __init__(self, question_ids: pa.Array, k: int):
        # a copy: a slice would hold the whole batch that it came in
        self.question_ids, self.k = question_ids.take(pa.array(np.arange(len(question_ids)))), k
        self.floor = np.full(len(question_ids), -np.inf)       # least of k scores, kept or let go
        self.score: np.ndarray | None = None
        self.ids: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return 0 if self.score is None else self.score.size

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in raw scores of the questions against the items ``ids``."""
        hit = scores >= (self.floor - 2 * 10.0 ** -SCORE_DECIMALS)[:, None]      # rounding may lift a score to the floor
        count = np.count_nonzero(hit, axis=1)
        many = np.flatnonzero(count > 4 * self.k)
        if len(many):
            rounded = np.round(scores[many], SCORE_DECIMALS)
            top = _topk_columns(rounded, ids, self.k)
            self._merge(many, np.take_along_axis(rounded, top, axis=1), ids[top])
            hit[many] = False
        row, col = np.divmod(np.flatnonzero(hit), scores.shape[1])
        value = np.round(scores[row, col], SCORE_DECIMALS)
        ok = value >= self.floor[row]
        row, col, value = row[ok], col[ok], value[ok]
        if not len(row):
            return
        rows, first, count = np.unique(row, return_index=True, return_counts=True)
        line, place = np.repeat(np.arange(len(rows)), count), np.arange(len(row)) - np.repeat(first, count)
        new = np.full((len(rows), count.max()), -np.inf)
        named = np.full(new.shape, ids[0], ids.dtype)
        new[line, place], named[line, place] = value, ids[col]
        self._merge(rows, new, named)

    def _merge(self, rows: np.ndarray, new: np.ndarray, named: np.ndarray) -> None:
        if self.score is None:
            self.score = np.full((len(self.floor), self.k), -np.inf)
            self.ids = np.full(self.score.shape, named.flat[0], named.dtype)
        if self.ids.dtype != named.dtype:
            self.ids, named = self.ids.astype(object), named.astype(object)
        both = np.concatenate([self.score[rows], new], axis=1)
        all_ids = np.concatenate([self.ids[rows], named], axis=1)
        keep = _topk_columns(both, all_ids, self.k)
        self.score[rows], self.ids[rows] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(all_ids, keep, axis=1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows].min(axis=1))

    def batches(self, id_type: pa.DataType):
        """A row per question with its kept (item id, score); they are let go, the floor stays."""
        if self.score is None:
            return
        filled = self.score > -np.inf
        ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
        top = pa.StructArray.from_arrays([pa.array(self.ids[filled].tolist(), id_type), pa.array(self.score[filled])], ["_iid", "score"])
        self.score = self.ids = None
        yield pa.RecordBatch.from_arrays([self.question_ids, pa.ListArray.from_arrays(pa.array(ends), top)], ["_qid", "_top"])


def cosine_topk(items: DataFrame, queries: DataFrame, k: int, *, item_id: str = "id", query_id: str = "query_id",
                item_vec: str = "vector", query_vec: str = "vector", sparse_dim: int | None = None,
                items_per_block: int = 5000, queries_per_block: int = 2500, chunk_cells: int = CHUNK_CELLS,
                broadcast_bytes: int = QUESTION_BYTES) -> DataFrame:
    """V2: exact cosine top-k of every query over all items.

    Dense: ``item_vec``/``query_vec`` are ``array<float|double>`` columns.
    Sparse (``sparse_dim`` set): both sides are ``(idx, val)`` arrays as from :func:`packed_terms`.
    Returns ``(query_id, item_id, score, rank)`` with rank 1..k by (score desc, item id asc);
    score is the raw cosine, rounded to 12 decimals so that exact copies tie. Nothing runs while
    the result is built. Rows whose vector is null or holds a null or non-finite entry have no
    score and are left out; dense vectors are compared with those of the same length only.
    """
    ship_package(items.sparkSession)
    width = sparse_dim
    i_cols, q_cols = ([item_vec], [query_vec]) if width is None else (["idx", "val"], ["idx", "val"])
    id_type = to_arrow_type(items.schema[item_id].dataType)
    if width is None:
        items = dealt(items)        # V1 has done so
    known = estimated_bytes(queries.select(query_id, *q_cols))
    ib = _packed(items, item_id, i_cols, width, items_per_block, "i")
    qb = _packed(queries, query_id, q_cols, width, queries_per_block, "q")
    # a batch of questions goes to every executor once. A larger set is dealt into parts of about
    # ``QUESTION_BYTES``, so that a task can keep the scores of its part, and each part meets the
    # partitions of items in turn. Where the estimate says nothing, Spark makes parts of about its
    # advisory size, measured while it runs. The items stay where they are read either way.
    parts = -(-known // QUESTION_BYTES)
    if known <= broadcast_bytes:
        qb = F.broadcast(qb)
    else:
        qb = qb.repartition(parts) if parts <= MAX_PARTS else qb.hint("rebalance")
    pairs = ib.crossJoin(qb)

    def run(batches):
        best: dict[int, _Best] = {}
        names: dict[int, np.ndarray] = {}       # ids of the latest blocks of items: one object per id, not one per pair
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for r in range(batch.num_rows):
                w = col["i_w"][r].as_py()
                if w != col["q_w"][r].as_py():
                    continue
                arr = lambda c, kind: np.frombuffer(col[c][r].as_buffer(), kind)
                block, number = col["i_block"][r].as_py(), col["q_block"][r].as_py()
                if block not in names:
                    if len(names) >= 16:
                        names.clear()
                    names[block] = _ids(col["i_ids"][r].values).copy()
                if number not in best:
                    best[number] = _Best(col["q_ids"][r].values, k)
                ids = names[block]
                n, n_q = len(ids), len(best[number].question_ids)
                if width is None:
                    parts = _dense_scores(arr("i_val", np.float64).reshape(n, w), arr("q_val", np.float64).reshape(n_q, w), chunk_cells)
                else:
                    parts = _sparse_scores((arr("i_row", np.int32), arr("i_idx", np.int32), arr("i_val", np.float64)), n,
                                           (arr("q_row", np.int32), arr("q_idx", np.int32), arr("q_val", np.float64)), n_q, w, chunk_cells)
                for lo, s in parts:
                    best[number].add(s, ids[lo:lo + s.shape[1]])
            if sum(b.cells for b in best.values()) > STATE_CELLS:      # let go; the window below merges
                for b in best.values():
                    yield from b.batches(id_type)
        for b in best.values():
            yield from b.batches(id_type)

    found = T.StructType([T.StructField("_iid", items.schema[item_id].dataType), T.StructField("score", T.DoubleType())])
    out = T.StructType([T.StructField("_qid", queries.schema[query_id].dataType), T.StructField("_top", T.ArrayType(found))])
    window = Window.partitionBy("_qid").orderBy(F.col("score").desc(), F.col("_iid").asc())
    # dealt by question first: the arrays are opened, and their rows sorted, once and by the window's tasks
    top = pairs.mapInArrow(run, out).repartition("_qid").select("_qid", F.explode("_top").alias("_t")).select("_qid", "_t._iid", "_t.score")
    return (top.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
            .select(F.col("_qid").alias(query_id), F.col("_iid").alias(item_id), "score", "rank"))


def with_embeddings(df: DataFrame, text_col: str, fn, out_col: str = "vector") -> DataFrame:
    """Dense V1 hook: ``fn`` maps a pandas Series of texts to a sequence of
    vectors (e.g. a sentence model's batch encode). Runs as an Arrow-batched
    pandas UDF on the executors; the model is the caller's."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in fn(texts)], index=texts.index)

    return df.withColumn(out_col, embed(F.col(text_col)))
