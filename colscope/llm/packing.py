"""Packing by non-negative least squares.

1. Every text becomes token ids plus an end id; ids are cut into whole windows and one
   remainder. The pieces are written once, each with its running number among its task's
   pieces of that length.
2. ``solve`` enumerates all combinations of one to three piece lengths that fill a window
   exactly, finds repeat counts x >= 0 with A x close to the histogram of lengths
   (accelerated projected gradient; A has a row per length), rounds them along the
   enumeration so that their sum is kept, and takes of each combination what the
   histogram still holds. All of it works on at most ``window`` histogram rows.
3. Pieces left over are packed greedily one after another, cut where a window is full,
   so only the last sequence has padding.

The layout says for each length which ranks begin at which token; a piece's rank is its running
number plus the pieces of that length in earlier tasks. The pieces are written bucketed by their
task, so what a task needs of the layout - one row - comes to them by a join that moves these
rows only: assigning sequences needs no shuffle of ids at any size, and a length that a third of
all pieces share is spread over all tasks. It is done by Spark's expressions: ids are written
once, and whoever runs the result sends none of them to Python.

Defined results: a null or empty text is one piece of the end id; null or repeated ids
are carried along (rows are packed one by one); an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.blocks import lean, text_blocks
from colscope.llm.tables import shared_path, short_batches, written
from colscope.llm.tokens import encode_ids
from colscope.session import ship_package

_PLACES_AT_ONCE = 1 << 17   # pieces, however many tasks share a length
ENCODE_BYTES = 2 << 20      # of text for one call of the tokenizer: the more, the more parts repeat in it


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, window: int, cache_bytes: int | None = None,
              block_bytes: int = ENCODE_BYTES) -> DataFrame:
    """(part, number, doc_id, start, length, doc_tokens, ids): ids as little-endian 32-bit bytes."""
    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for b in text_blocks(batch.column(1), block_bytes):
                encoded = [x + end for x in encode_ids(tokenizer, [b.text(i).decode() for i in range(b.n)], cache_bytes)]
                doc, start, length, total, ids, number = [], [], [], [], [], []
                for i, x in enumerate(encoded):
                    n = len(x) // 4
                    for s in range(0, n, window):
                        size = min(window, n - s)
                        doc.append(i + b.first)
                        start.append(s)
                        length.append(size)
                        total.append(n)
                        ids.append(x[4 * s:4 * (s + size)])
                        number.append(int(seen[size]))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(doc), part, np.int64)), pa.array(number, pa.int64()), batch.column(0).take(pa.array(doc, pa.int64())),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "number", "doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.mapInArrow(run if cache_bytes is None else lean(run), "part long, number long, doc_id long, start long, length long, doc_tokens long, ids binary")


def _by_task(pieces: DataFrame, batch_rows: int | None) -> DataFrame:
    """``pieces`` written once in the shared folder, bucketed by ``part``: a join on it reads them where
    they lie. The table's name is given back at once; the frame keeps the files."""
    spark = pieces.sparkSession
    name = f"colscope_pieces_{uuid.uuid4().hex}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    with short_batches(spark, batch_rows):
        pieces.write.bucketBy(n, "part").option("path", shared_path(spark, "pieces")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All rows (a <= b <= c) of lengths (0: unused) with a sum of ``window``."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    rows = []
    for a in np.concatenate([[0], lengths]):
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        ok = have[b] & have[c] & ((a == 0) | (b > 0))
        rows.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(rows)


def solve(hist: np.ndarray, window: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and their whole repeat counts for a histogram over lengths 0..window."""
    lengths = np.flatnonzero(hist[:window])
    lengths = lengths[lengths > 0]
    combos = combinations(lengths, window)
    combos = combos[combos[:, 2] < window]
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    target = hist.astype(float).copy()
    target[0] = target[window] = 0
    scale = max(target.max(), 1)
    target /= scale
    use = (combos > 0).astype(float)

    def times(x):       # A x
        return np.bincount(combos.reshape(-1), weights=(use * x[:, None]).reshape(-1), minlength=window + 1)

    def back(r):        # A^T r
        return (r[combos] * use).sum(1)

    v = np.ones(len(combos))
    for _ in range(12):     # largest eigenvalue of A^T A
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(times(y) - target) / (1.05 * norm), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    # rounding along the enumeration: neighbours share their fractions
    whole = np.diff(np.floor(np.cumsum(x * scale) + 0.5), prepend=0).astype(np.int64)
    left = hist.astype(np.int64).copy()
    for i in np.argsort(-whole, kind="stable"):
        if not whole[i]:
            break
        used = combos[i][combos[i] > 0]
        kinds, times_used = np.unique(used, return_counts=True)
        whole[i] = min(whole[i], (left[kinds] // times_used).min())
        left[kinds] -= whole[i] * times_used
    keep = whole > 0
    return combos[keep], whole[keep]


def layout(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows (length, first, at, step): the piece of a length with a rank from ``first`` to the next row's
    begins at token at + (rank - first) * step of all sequences one after another. At most three
    rows per combination and two per length. A left-over piece may run past its window."""
    combos, repeat = solve(hist, window)
    used = np.zeros(window + 1, np.int64)
    runs = []
    sequence = 0
    for combo, r in zip(combos.tolist(), repeat.tolist()):
        offset = 0
        for length in (x for x in combo if x):
            runs.append((length, int(used[length]), sequence * window + offset, window))
            used[length] += r
            offset += length
        sequence += r
    runs.append((window, 0, sequence * window, window))
    used[window] = hist[window]
    sequence += int(hist[window])
    rest = (hist - used) * np.arange(window + 1)
    token = sequence * window + np.cumsum(rest) - rest
    runs += [(n, int(used[n]), int(token[n]), n) for n in np.flatnonzero(rest).tolist()]
    return np.array(sorted(runs), np.int64)


def _places(before: DataFrame, runs: np.ndarray) -> DataFrame:
    """(part, length, places): where the pieces of a task and length begin, by their number.
    ``before``: (part, length, n, before)."""
    shared = before.sparkSession.sparkContext.broadcast(runs)       # its size is bounded by the window

    def run(batches):
        of, first, at, step = shared.value.T
        for batch in batches:
            group = np.cumsum(batch.column(2).to_numpy()) // _PLACES_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                some = batch.slice(lo, hi - lo)
                length, n, skip = (some.column(i).to_numpy() for i in (1, 2, 3))
                shift = max(int(first.max()), int((skip + n).max(initial=0))).bit_length() + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                row = np.repeat(np.arange(len(n)), n)
                rank = np.arange(ends[-1]) - ends[row] + skip[row]
                i = np.searchsorted((of << shift) + first, (length[row] << shift) + rank, "right") - 1
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(at[i] + (rank - first[i]) * step[i]))], ["part", "length", "places"])

    return before.select("part", "length", "n", "before").mapInArrow(lean(run), "part long, length long, places array<long>")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", cache_bytes: int | None = None, block_bytes: int = ENCODE_BYTES,
         batch_rows: int | None = None) -> DataFrame:
    """Pieces of all documents with their place: id_col, start, length, ids, doc_tokens, sequence_id,
    offset. Where memory is short: a worker keeps at most ``cache_bytes`` of parts of text it has
    encoded (``tokens``) and gives back what a task freed, encodes ``block_bytes`` of text at a time
    and gets ``batch_rows`` rows at a time (default: the session's)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = _by_task(pieces_of(docs, tokenizer, end_id, window, cache_bytes, block_bytes), batch_rows)
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():     # at most ``window`` rows
        hist[r["length"]] = r["n"]
    before = counts.select("part", "length", "n", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # a task's row has a number for each of its pieces; an array in a map is read in place, by generated code
    # (a lambda would copy the row for each piece)
    here = _places(before, layout(hist, window))
    here = written(here.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "places"))).alias("places")), "piece-places")
    place = F.element_at(F.element_at("places", F.col("length")), (F.col("number") + 1).cast("int"))
    placed = (pieces.join(here.hint("shuffle_hash"), "part").withColumn("place", place)
              .withColumn("over", F.expr(f"greatest(place % {window} + length - {window}, 0L)")))
    # what runs past its window is a piece of its own
    cut = placed.select("doc_id", "start", "length", "ids", "doc_tokens", "place", "over",
                        F.explode(F.expr("if(over > 0, array(0L, length - over), array(0L))")).alias("skip"))
    cut = cut.withColumn("size", F.expr("if(skip > 0, over, length - over)"))
    return cut.select(
        F.col("doc_id").alias(id_col), F.expr("start + skip").alias("start"), F.col("size").alias("length"),
        F.expr("if(over > 0, substring(ids, int(4 * skip + 1), int(4 * size)), ids)").alias("ids"), "doc_tokens",
        F.expr(f"(place + skip) div {window}").alias("sequence_id"), F.expr(f"(place + skip) % {window}").alias("offset"))
