"""SimHash near-dedup by a segment-popcount embedding.

1. *Fingerprints.* Bit b of a text's 64-bit fingerprint is set if it is set in over half of
   the XXH64 values of the text's word shingles, repeats included. Equal fingerprints are one
   node from there on (an aggregate that is partial in every task), however many texts share one.
2. *Embedding.* A fingerprint is cut into segments of ``segment_bits`` bits and mapped to the
   vector of the segments' bit counts. One differing bit changes one count by at most one, so
   the Manhattan distance of two vectors is at most the Hamming distance of the fingerprints.
   All counts lie side by side in one 64-bit number.
3. *Grid range-join.* Two integer vectors at Manhattan distance r or less have a common point
   within r/2 of each: with r = 2, every node enters the unit cell of its vector and the cells
   one step away, and two nodes within 2 share a cell. Only cells with two nodes or more are kept.
4. *Verification.* Nodes that share a cell are compared exactly (bits of the XOR). A cell of more
   than ``crowd`` nodes is not listed pair by pair: its nodes enter, in the same way, the exact
   points at Hamming distance 1 or less. Nodes at one such point are all within 2 of each
   other, so each is linked with the least one there, and no link is lost: two nodes within 2
   have a common point. A node enters 65 cells and 65 points at most, whatever the data.
5. *Components* of the links: the least id that each node can reach.

Defined results: a null text counts as empty; a text without words has fingerprint zero and
is linked like any other; a text of fewer words than a shingle is one shingle; rows of one id
with different texts have their own rows, each with its text's component, and their ids count in
both; a row without id has a fingerprint and a component (null where no row with an id is in
it), and takes part in links; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.neardup import components
from colscope.llm.tables import by_key, small_or_shuffled, written
from colscope.session import ship_package

SHINGLE = 3
SEED = 42
LIMIT = 2
SEGMENT_BITS = 2
CROWD = 32
_STEP = 1 << 16         # shingles hashed and counted at a time


def _word_chunks(text: bytes, size: int = 1 << 20):
    """The words of a text, some at a time, so that a very long text never is a list of all its words."""
    lo = 0
    while lo < len(text):
        hi = min(lo + size, len(text))
        while hi < len(text) and not text[hi:hi + 1].isspace():
            hi += 1
        yield text[lo:hi].split()
        lo = hi


def _shingles(text: bytes, k: int):
    """Runs of ``k`` words joined by a space; one run of all words if there are fewer."""
    carry: list[bytes] = []
    some = False
    for words in _word_chunks(text):
        words = carry + words
        if len(words) >= k:
            some = True
            yield from map(b" ".join, zip(*(islice(words, i, None) for i in range(k))))
        carry = words[max(len(words) - k + 1, 0):]
    if not some and carry:
        yield b" ".join(carry)


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    hashes = map(partial(xxh64_intdigest, seed=seed), _shingles(text.lower(), k))
    ones, n = np.zeros(64, np.int64), 0
    while len(h := np.fromiter(islice(hashes, _STEP), "<u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` of every row: the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k, seed) for t in texts),
                             np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column, segment_bits: int = SEGMENT_BITS) -> Column:
    """Bit counts of all segments of 2 or 4 bits, each in its segment's place. Bit operations
    only: a sum that reaches the sign bit would be an overflow."""
    if segment_bits not in (2, 4):
        raise ValueError("segments have 2 or 4 bits")
    mask = lambda digit: F.lit(int(digit * 16, 16)).cast("long")
    a, b = fp.bitwiseAND(mask("5")), F.shiftrightunsigned(fp, 1).bitwiseAND(mask("5"))
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    if segment_bits == 2:
        return pairs
    return pairs.bitwiseAND(mask("3")) + F.shiftrightunsigned(pairs, 2).bitwiseAND(mask("3"))


def cells(nodes: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``(fp, cell)``: the cell of every node's vector and the cells one step away."""
    rows = nodes.select("fp", embedding(F.col("fp"), segment_bits).alias("v"),
                        F.explode(F.sequence(F.lit(0), F.lit(2 * (64 // segment_bits)))).alias("i"))
    rows = rows.withColumn("at", F.expr(f"CAST(({segment_bits} * ((i - 1) DIV 2)) AS INT)"))
    rows = rows.withColumn("count", F.expr(f"shiftrightunsigned(v, at) & {(1 << segment_bits) - 1}L"))
    return rows.select("fp", F.expr(f"""CASE
        WHEN i = 0 THEN v
        WHEN i % 2 = 1 AND count < {segment_bits} THEN v ^ shiftleft(count ^ (count + 1L), at)
        WHEN i % 2 = 0 AND count > 0 THEN v ^ shiftleft(count ^ (count - 1L), at) END""").alias("cell")).filter("cell is not null")


def points(nodes: DataFrame) -> DataFrame:
    """``(fp, point)``: every node with the 65 fingerprints at Hamming distance 1 or less."""
    rows = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    return rows.select("fp", F.expr("CASE WHEN i = 0 THEN fp ELSE fp ^ shiftleft(1L, i - 1) END").alias("point"))


def links(nodes: DataFrame, segment_bits: int = SEGMENT_BITS, crowd: int = CROWD) -> DataFrame:
    """``(a, b)``: links between different fingerprints (column ``fp``, distinct, already written).
    They connect exactly the fingerprints that differ in two bits or fewer, but of a crowded
    cell not every such pair is listed."""
    grid = cells(nodes, segment_bits)
    shared = written(grid.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    held = written(grid.join(small_or_shuffled(shared), "cell"), "held")
    few = held.filter(F.col("n") <= crowd)
    pairs = (few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")), "cell")
             .filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT).select("a", "b"))
    crowded = held.filter(F.col("n") > crowd).select("fp").distinct()
    # at most 65 nodes at a point
    stars = (points(crowded).groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter("size(all) > 1")
             .select("a", F.explode("all").alias("b")).filter("a < b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    seed: int = SEED, segment_bits: int = SEGMENT_BITS, crowd: int = CROWD) -> DataFrame:
    """``(id_col, fp, component_id)`` of every row of ``docs`` (see the module text)."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(docs, k, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    label = components(links(nodes, segment_bits, crowd), "simhash")
    # nodes without a link are their own component
    linked = written(nodes.join(label.withColumnRenamed("id", "fp"), "fp"), "linked")
    least = written(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    linked = written(by_key(linked.select("fp", "label"), least, "label").select("fp", "component_id"), "found")
    nodes = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return by_key(prints, written(nodes, "component-of"), "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")
