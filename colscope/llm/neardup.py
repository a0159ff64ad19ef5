"""MinHash near-dedup by BagMinHash signatures over bags of word shingles.

1. *Signature.* A text's bag holds its runs of ``k`` words with their counts. Every
   distinct shingle has Poisson processes over its discretised weight axis, cut into
   the dyadic blocks (0,1], (1,2], (2,4], (4,8], ...: a block of length L emits points
   at rate L, each with a uniform place inside the block (the leaf of the hierarchy it
   falls into) and a uniform signature slot. A point counts if its place lies within
   the shingle's count; a slot keeps the earliest point. Two bags agree in a slot with
   probability equal to their weighted Jaccard similarity.
2. *Classes of equal bags* are folded first (one aggregate on a 128-bit digest), so
   groups of exact copies of any size are one node from there on.
3. *Bands.* Nodes that agree in all ``rows`` slots of one of ``bands`` bands share a group.
   In each group every node is compared with one pivot, the node that shares most: the
   multiset overlap sum(min) / sum(max) of the whole texts decides.
4. *The rest.* Two nodes x, y of a group that are still in different components, y not
   linked to the pivot p, can only be alike if what both have beyond p makes up for what
   they lack: |x & y| <= min(|x & p|, |y & p|) + |(x - p) & (y - p)|. So the nodes of a pivot
   are joined on the shingles they have beyond it, not on the group, and only pairs whose
   shared ones reach the missing overlap are compared, and pairs of extracts: nodes that lie in
   the pivot to four fifths or more may need none, and are compared with those of their size.
   No link between nodes that share a band is lost. A group of n copies, exact or near, costs
   about n comparisons; n extracts of one size of one long text that differ from it may still
   cost n squared.

Result: one row per input row: the id, ``class_id`` (the least id of its class) and
``class_size`` (rows of the class). Defined results: null text counts as empty; a text
without words is compared as a whole (its bag is one token made of the whole text), so
equal such texts share a class; a text of 1 to k-1 words has one shingle of all its
words; rows with one id are one document, whatever their texts; a row without id has a
null class; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.blocks import grams, lean, mix, seeded, text_blocks, words
from colscope.llm.tables import by_key, written
from colscope.session import ship_package

SHINGLE = 5
BANDS = 36
ROWS = 7
LIMIT = 0.8
_KEEP = np.uint64((1 << 44) - 1)
_SALTS = 16             # parts that rows of one key are dealt to


def bags(b, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 44-bit shingle hash and count of every distinct shingle, by row and hash."""
    h, bounds = grams(words(b), k)
    n = np.diff(bounds)
    rows = np.repeat(np.arange(b.n), n)
    empty = np.flatnonzero(n == 0)
    if len(empty):      # no word: the whole text is one token
        own = np.array([int.from_bytes(hashlib.blake2b(b.text(i), digest_size=8).digest(), "little") for i in empty], np.uint64)
        h, rows = np.concatenate([h, own]), np.concatenate([rows, empty])
    key = (rows.astype(np.uint64) << np.uint64(44)) | (h & _KEEP)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key & _KEEP, count


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def bag_minhash(rows: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m uint64) of the n bags given by (rows, h, count), every row having a shingle."""
    sig = np.full((n, m), np.inf)
    weight = np.bincount(rows, weights=count, minlength=n)
    todo = np.ones(n, bool)
    until = np.zeros(n)
    # one process per shingle and dyadic block that its count reaches into
    blocks = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    e = np.repeat(np.arange(len(h)), blocks)
    j = np.arange(len(e)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    e_row, low = rows[e], np.where(j == 0, 0, 2.0 ** (j - 1))
    rate = np.where(j == 0, 1.0, low)
    top = count[e]
    seed = mix(h[e] + mix(j.astype(np.uint64) + np.uint64(77)))
    horizon = (np.log(m) + 4.0) * m
    while todo.any():
        # all points up to the time horizon; a bag with a slot still empty gets a longer one
        until[todo] = horizon / weight[todo]
        live = np.flatnonzero(todo[e_row])
        t = np.zeros(len(live))
        i = 0
        while len(live):
            u = seeded(seed[live], i)
            t = t - np.log(_unit(u)) / rate[live]
            ok = t <= until[e_row[live]]
            live, t, u = live[ok], t[ok], u[ok]
            v = mix(u + np.uint64(0x5851F42D4C957F2D))
            place = low[live] + np.ceil(_unit(mix(v + np.uint64(3))) * rate[live])
            hit = place <= top[live]
            at = e_row[live[hit]] * m + (v[hit] % np.uint64(m)).astype(np.int64)
            np.minimum.at(sig.reshape(-1), at, t[hit])
            i += 1
        todo &= np.isinf(sig).any(1)
        horizon *= 2
    return sig.view(np.uint64)


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in text_blocks(batch.column(1), 1 << 18):
                r, h, c = bags(b, k)
                size = np.bincount(r, weights=c, minlength=b.n).astype(np.int64)
                sig = bag_minhash(r, h, c, b.n, bands * rows)
                code = np.zeros((b.n, bands), np.uint64)
                for i in range(rows):
                    code = mix(code + sig[:, i::rows])
                code = mix(code + mix(np.arange(bands, dtype=np.uint64)))
                # digest of the bag: two independent sums over its (shingle, count) pairs
                both = mix(h) + seeded(c.astype(np.uint64), 5)
                d = []
                for s in (11, 12):
                    x = seeded(both, s)
                    total = np.zeros(b.n, np.uint64)
                    np.add.at(total, r, x)
                    d.append(mix(total + size.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(b.first, b.n), pa.array(size), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, b.n * bands + 1, bands, dtype=np.int32)),
                                             pa.array(code.view(np.int64).reshape(-1)))],
                    ["doc_id", "size", "d1", "d2", "codes"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(
        lean(run), "doc_id long, size long, d1 long, d2 long, codes array<long>")


def _overlaps(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, sa, sb, overlap, beyond) of pairs that carry both texts: bag sizes, multiset
    overlap, and the shingles that b has more often than a, with how much more often."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                m, sides = part.num_rows, []
                for c in (2, 3):
                    keys, counts = [], []
                    for b in text_blocks(part.column(c), 1 << 18):
                        r, h, cnt = bags(b, k)
                        keys.append(((r + b.first).astype(np.uint64) << np.uint64(44)) | h)
                        counts.append(cnt)
                    sides.append((np.concatenate(keys), np.concatenate(counts)))
                (ka, ca), (kb, cb) = sides
                at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
                in_a = np.where(ka[at] == kb, ca[at], 0)
                row_a, row_b = (ka >> np.uint64(44)).astype(np.int64), (kb >> np.uint64(44)).astype(np.int64)
                total = lambda r, w: np.bincount(r, weights=w, minlength=m).astype(np.int64)
                more = cb > in_a
                ends = np.concatenate([[0], np.cumsum(np.bincount(row_b[more], minlength=m))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(total(row_a, ca)), pa.array(total(row_b, cb)),
                    pa.array(total(row_b, np.minimum(cb, in_a))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                        [pa.array((kb[more] & _KEEP).astype(np.int64)), pa.array((cb - in_a)[more])], ["e", "w"]))],
                    ["a", "b", "sa", "sb", "overlap", "beyond"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(
        lean(run), "a long, b long, sa long, sb long, overlap long, beyond array<struct<e:long,w:long>>")


def _compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) with their overlap. A pivot's text goes to many pairs: the join on it
    may be split by Spark's skew handling, and its other side is one row."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.lower("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.lower("text").alias("text_a")), "a"))
    return _overlaps(both, k)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(id, label)``: the least id that links (a, b) connect each id to. Every round
    takes the least label of the neighbours, then follows labels of labels."""
    both = written(links.select(F.col("a").alias("x"), F.col("b").alias("y"))
                   .union(links.select("b", "a")).distinct(), name)
    labels = both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("least")).select(
        "id", F.least("id", "least").alias("label"))
    labels = written(labels, name)
    while True:
        near = (both.join(labels.select(F.col("id").alias("y"), "label"), "y")
                .groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near")))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        # most rows of a large component point to one label: they are dealt over _SALTS parts; labels
        # that point to themselves need no hop
        hop = (step.filter("next < id").select(F.col("id").alias("next"), F.col("next").alias("hop"))
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
        new = written(step.join(hop, ["next", "salt"], "left")
                      .select("id", F.least("next", "hop").alias("label"), F.col("label").alias("before")), name)
        moved = new.filter(F.col("label") != F.col("before")).limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels


def _stars(groups: DataFrame) -> DataFrame:
    """(a, b, weight): the nodes of every group with the group's pivot a and the pivot's weight."""
    size = groups.groupBy("g").agg(F.count("*").alias("n"))
    weight = groups.join(size, "g").groupBy("node").agg(F.sum("n").alias("weight"))
    now = groups.join(weight, "node").select("g", "node", F.struct("weight", (-F.col("node")).alias("minus")).alias("rank"))
    pivot = now.groupBy("g").agg(F.max("rank").alias("top")).select(
        "g", (-F.col("top")["minus"]).alias("a"), F.col("top")["weight"].alias("weight"))
    return groups.join(pivot, "g").filter("node <> a").select("a", F.col("node").alias("b"), "weight").distinct()


def _still_possible(compared: DataFrame, stars: DataFrame, labels: DataFrame, need, limit: float) -> DataFrame:
    """Pairs (a, b) of nodes of one pivot that may be alike although it does not connect them
    (module text, 4). Two nodes with the same main pivot, the heaviest one they were compared
    with (or are), are looked at under that pivot only."""
    rank = F.struct("weight", (-F.col("a")).alias("minus"))
    main = (stars.select(F.col("b").alias("node"), rank.alias("r")).union(stars.select(F.col("a").alias("node"), rank.alias("r")))
            .groupBy("node").agg(F.max("r").alias("r")).select(F.col("node").alias("b"), (-F.col("r")["minus"]).alias("main")))
    nodes = (compared.join(main, "b").join(labels.withColumnRenamed("id", "b"), "b", "left")
             .withColumn("label", F.coalesce("label", "b")).withColumn("apart", F.col("overlap") < need(F.col("sa"), F.col("sb"))))
    open_ = nodes.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("apart").alias("any"),
                                  F.min("main").alias("m0"), F.max("main").alias("m1"))
    nodes = written(nodes.join(open_.filter("lo < hi and any and (m0 < m1 or m0 = a)").select("a"), "a"), "apart")
    side = lambda c: [F.col(n).alias(f"{m}{c}") for n, m in (("b", "n"), ("sb", "s"), ("overlap", "o"), ("label", "l"), ("main", "m"))]
    due = (F.col("lx") != F.col("ly")) & ((F.col("mx") != F.col("my")) | (F.col("mx") == F.col("a")))
    missing = need(F.col("sx"), F.col("sy")) - F.least("ox", "oy")
    # A node must share a weight of at least limit * size - overlap with any partner. Its most
    # frequent shingles may be left out while their weight stays below that: the rarest shingle
    # that two alike nodes share is then kept by both.
    have = nodes.select("a", "b", "sb", "overlap", "label", "main", "apart", F.explode("beyond").alias("p")).select("*", "p.e", "p.w").drop("p")
    held = have.groupBy("a", "e").agg(F.count("*").alias("f"), F.max("apart").alias("any")).filter("f > 1 and any").select("a", "e", "f")
    order = Window.partitionBy("a", "b").orderBy(F.desc("f"), "e")
    have = (have.join(held, ["a", "e"]).withColumn("cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("out", F.col("cum") < limit * F.col("sb") - F.col("overlap") - 1e-6))
    have = written(have.withColumn("left", F.coalesce(F.sum(F.when(F.col("out"), F.col("w"))).over(Window.partitionBy("a", "b")), F.lit(0)))
                   .filter("not out"), "kept")
    x = have.select("a", "e", F.col("w").alias("wx"), F.col("left").alias("dx"), *side("x"))
    y = have.filter("apart").select("a", "e", F.col("w").alias("wy"), F.col("left").alias("dy"), *side("y"))
    shared = (x.join(y, ["a", "e"]).filter(due).groupBy("a", "nx", "ny")
              .agg(F.sum(F.least("wx", "wy")).alias("both"), F.first(missing - F.col("dx") - F.col("dy")).alias("missing"))
              .filter("both >= missing"))
    # missing <= 0 asks that both nodes lie in the pivot to at least limit of their size (the sizes of
    # alike nodes differ by that factor at most): extracts of it that are smaller than what would
    # link them. Only those of neighbouring size classes are joined, dealt over _SALTS parts.
    size_class = lambda c: F.floor(F.log(F.col(c)) / float(-np.log(limit)) + 1e-9)
    extract = nodes.filter((F.col("sb") < F.col("sa")) & (F.col("overlap") >= limit * F.col("sb") - 1e-6))
    inner = (extract.select("a", *side("x"), size_class("sb").alias("class"))
             .withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    outer = (nodes.filter(F.col("apart") & (F.col("overlap") >= limit * F.col("sb") - 1e-6))
             .select("a", *side("y"), size_class("sb").alias("class"))
             .withColumn("salt", F.pmod(F.xxhash64("ny"), F.lit(_SALTS)).cast("int")))
    free = inner.join(outer, ["a", "class", "salt"]).filter(due & (missing <= 0))
    return (shared.select("nx", "ny").union(free.select("nx", "ny"))
            .select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    limit: float = LIMIT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of every row of ``docs`` (see the module text): id_col, class_id, class_size."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = written(_signatures(docs, k, bands, rows), "signatures")
    known = sig.filter(F.col("doc_id").isNotNull())
    reps = written(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "bags")
    node_of = written(by_key(known.select("doc_id", "d1", "d2"), reps, ["d1", "d2"]).select("doc_id", "node").distinct(), "nodes")
    own = node_of.filter(F.col("doc_id") == F.col("node")).select("doc_id")
    groups = (known.join(own, "doc_id", "left_semi")
              .select(F.explode("codes").alias("g"), F.col("doc_id").alias("node")).distinct())
    shared = groups.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    groups = written(groups.join(shared, "g"), "groups")
    texts = written(docs.join(groups.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    # nodes that are rows of one id with different texts are linked as they are
    links = (node_of.filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
             .join(own.withColumnRenamed("doc_id", "a"), "a", "left_semi"))
    need = lambda x, y: limit / (1 + limit) * (x + y) - 1e-6  # noqa: E731  overlap that makes sizes x, y alike
    alike = lambda pairs: pairs.filter(F.col("overlap") >= need(F.col("sa"), F.col("sb"))).select("a", "b")
    stars = written(_stars(groups), "stars")
    compared = written(_compared(stars.select("a", "b"), texts, k), "compared")
    links = written(links.union(alike(compared)).distinct(), "links")
    labels = components(links)
    rest = written(_still_possible(compared, stars, labels, need, limit), "rest")
    if rest.limit(1).count():
        labels = components(links.union(alike(_compared(rest, texts, k))))
    classes = (node_of.join(labels.withColumnRenamed("id", "node"), "node", "left")
               .select("doc_id", F.coalesce("label", "node").alias("class_id"))
               .groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    result = written(docs.select("doc_id").join(classes, "doc_id", "left"), "classes")
    sizes = written(result.filter("class_id is not null").groupBy("class_id").agg(F.count("*").alias("n"))
                    .withColumn("class_size", F.col("n")), "sizes")
    return by_key(result, sizes, "class_id").select(F.col("doc_id").alias(id_col), "class_id", "class_size")
