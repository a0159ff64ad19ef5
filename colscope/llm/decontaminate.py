"""Benchmark decontamination by greedy string tiling.

1. *Seeds.* Every run of ``k`` words of a benchmark item is a seed (its rolling hash).
   A bit table of fixed size tells the document scan which of its own runs may be
   seeds; only documents with such runs go on, with the distinct seeds they hold.
2. *Join.* Those seeds join the seed table; pairs (document, item) whose shared seeds
   could not cover ``coverage`` of the item are dropped (k tokens per seed at most, so
   no pair that can pass is lost).
3. *Tile.* For each pair left: maximal common runs of still unmarked tokens are found by
   running Karp-Rabin (rolling hashes of k tokens, equal ones extended and compared),
   the longest is marked in both texts, and so on until no run of k tokens is left.
   Since each run is placed on its own, moved passages count as well.
4. An item is contaminated in a document if its marked tokens reach ``coverage``.

Result: one row per such pair: doc_id, item_id, matched (tokens), item_tokens, coverage,
tiles. Defined results: null texts count as empty; an item of fewer than ``k`` words is
one seed of all its words; an item without words never matches; repeated document rows
give repeated results, repeated items are one item; null ids are carried as they are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.blocks import Block, grams, lean, text_blocks, words
from colscope.llm.tables import written
from colscope.plans.sizing import DEFAULT_MAX_BYTES
from colscope.session import ship_package

SEED_WORDS = 5
COVERAGE = 0.5
TABLE_BITS = 26        # 8 MB


def _short_gram(w, i: int, size: int):
    """Hashes of all runs of ``size`` words of row i (items shorter than a seed)."""
    one = type(w)(w.hash[w.bounds[i]:w.bounds[i + 1]], None, None, np.array([0, w.bounds[i + 1] - w.bounds[i]]))
    return grams(one, size)[0]


def seed_table(items: DataFrame, k: int) -> DataFrame:
    """(item, pos, seed, size, tokens): ``size`` is k, or fewer for a shorter item."""
    def run(batches):
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                w = words(b)
                for i, n in enumerate(w.counts):
                    if not n:
                        continue
                    size = min(int(n), k)
                    h = _short_gram(w, i, size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(batch.column(0)[b.first + i].as_py(), len(h)), pa.int64()),
                        pa.array(np.arange(len(h))), pa.array(h.view(np.int64)),
                        pa.array(np.full(len(h), size, np.int32)), pa.array(np.full(len(h), n, np.int64))],
                        ["item", "pos", "seed", "size", "tokens"])

    return items.select("item", F.lower("item_text").alias("text")).mapInArrow(
        lean(run), "item long, pos long, seed long, size int, tokens long")


def _bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit per seed, by its low ``bits`` bits: 2**bits / 8 bytes whatever the benchmark's size."""
    slot = F.col("seed").bitwiseAND((1 << bits) - 1)
    rows = (seeds.groupBy(F.shiftright(slot, 5).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(31).cast("int"))).alias("bits"))
            .select("word", "bits").toLocalIterator())
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)       # bit i of the table is bit i % 8 of byte i / 8


def _seeded_docs(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, text, seeds) of documents that may hold a seed. ``sizes``: the seed lengths in use, 1 to k."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        mask = np.uint64(8 * len(table) - 1)
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                w = words(b)
                rows, found = [], []
                for size in sizes:
                    h, bounds = grams(w, size)
                    r = np.repeat(np.arange(b.n), np.diff(bounds))
                    slot = h & mask
                    hit = (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    hit &= (w.counts >= size)[r]
                    rows.append(r[hit])
                    found.append(h[hit])
                r, h = np.concatenate(rows), np.concatenate(found)
                if not len(r):
                    continue
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
                r, h = r[new], h[new]
                docs_hit, first = np.unique(r, return_index=True)
                at = pa.array(docs_hit + b.first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))],
                    ["doc_id", "text", "seeds"])

    return docs.mapInArrow(lean(run), "doc_id long, text string, seeds array<long>")


def tile(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token hash arrays: tiles (item start, doc start, length),
    longest first, ties by item then document position."""
    k = min(k, len(item))
    if not k or len(doc) < k:
        return []

    def runs(x):
        h = np.zeros(len(x) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + x[j:len(x) - k + 1 + j]
        return h

    hi, hd = runs(item), runs(doc)
    near = np.flatnonzero(np.isin(hd, hi))
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd[near], "left"), np.searchsorted(hi[order], hd[near], "right")
    n = up - lo
    d = np.repeat(near, n)
    a = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    ok = np.ones(len(d), bool)
    for j in range(k):
        ok &= item[a + j] == doc[d + j]
    a, d = a[ok], d[ok]
    # seeds one after another on a diagonal are one maximal match
    order = np.lexsort((a, d - a))
    a, d = a[order], d[order]
    if not len(a):
        return []
    new = np.concatenate([[True], (np.diff(a) != 1) | (np.diff(d - a) != 0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a))) + k - 1
    heap = [(-int(s), int(x), int(y)) for s, x, y in zip(size, a[first], d[first])]
    heapq.heapify(heap)
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles = []
    while heap:
        s, x, y = heapq.heappop(heap)
        s = -s
        free = ~(used_i[x:x + s] | used_d[y:y + s])
        if free.all():
            used_i[x:x + s] = used_d[y:y + s] = True
            tiles.append((x, y, s))
            continue
        # parts of the match that are still unmarked compete again by their own length
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for p, q in zip(edge[::2], edge[1::2]):
            if q - p >= k:
                heapq.heappush(heap, (-int(q - p), x + int(p), y + int(p)))
    return tiles


def _tiled(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            kept: list[tuple] = []
            for r in range(batch.num_rows):
                w = []
                for c in (3, 4):
                    raw = np.frombuffer((batch.column(c)[r].as_py() or "").encode(), np.uint8)
                    w.append(words(Block(0, raw, np.array([0, len(raw)]))).hash)
                t = tile(w[1], w[0], k)
                kept.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].as_py(),
                             sum(x[2] for x in t), len(w[1]), len(t)))
            if kept:
                cols = list(zip(*kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols], ["row", "doc_id", "item", "matched", "item_tokens", "tiles"])

    return pairs.select("row", "doc_id", "item", "text", "item_text").mapInArrow(
        lean(run), "row long, doc_id long, item long, matched long, item_tokens long, tiles long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = SEED_WORDS, coverage: float = COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """Pairs (document, item) whose tiles cover at least ``coverage`` of the item (module text)."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = written(seed_table(items, k), "seeds")
    n_seeds = seeds.count()
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect()) or [k]      # k values at most
    hits = _seeded_docs(docs.select("doc_id", F.lower("text").alias("text")), _bit_table(seeds, table_bits), sizes)
    hits = written(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    small = F.broadcast if n_seeds * 48 <= DEFAULT_MAX_BYTES else lambda x: x   # long, long, long, int, long of each seed
    shared = (hits.select("row", "doc_id", F.explode("seeds").alias("seed")).join(small(seeds), "seed")
              .groupBy("row", "doc_id", "item").agg(F.count("*").alias("shared"), F.max("size").alias("size"), F.max("tokens").alias("tokens"))
              .filter(F.col("shared") * F.col("size") >= coverage * F.col("tokens")))
    # an item's text is bounded by its seeds: n tokens make n - k + 1 of them
    pairs = (shared.join(hits.select("row", "text"), "row")
             .join(items.select("item", F.lower("item_text").alias("item_text")), "item"))
    tiled = _tiled(pairs, k).withColumn("coverage", F.col("matched") / F.col("item_tokens"))
    return (tiled.filter(F.col("coverage") >= coverage).join(items.select("item", "item_id"), "item")
            .select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "matched", "item_tokens", "coverage", "tiles"))
