"""Token-id files in directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 has the first
chunk of every id, level j the chunk j of those ids that have one; each level has a bitmap
that says which of its ids go on in the next level, and a directory with the number of set
bits before every block of ``BLOCK`` bits. The id at position i is read from level 0 at i,
then at rank(i) of the next level while its bit is set: at most four steps, and no other
id is decoded.

*File format.* A Parquet file per range of document ids, in ascending order; its rows are
segments of at least ``SEGMENT`` ids (a document lies in one segment): ``part`` (number of
the range), ``first`` (ids before it in the part), ``tokens``, the documents' ids and id
counts, and ``levels``: chunk bytes, bitmap and directory. Spark's committer writes them,
so a lost executor leaves no half file and any file system that Spark knows will do.

Defined results: a null or empty text has the end id alone; rows are ordered by id (null
first), then by a hash of the text, then by place in the input, so repeated rows stay; an
empty table gives no segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.llm.blocks import text_blocks
from colscope.llm.tokens import encode_ids
from colscope.session import ship_package

CHUNK_BITS = 8
BLOCK = 512
SEGMENT = 1 << 20
_SCHEMA = ("part long, first long, tokens long, doc_ids array<long>, doc_tokens array<long>, "
           "levels array<struct<chunks:binary,more:binary,ranks:binary>>")


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of the array: chunk bytes, continuation bitmap (low bit first) and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> np.uint32(CHUNK_BITS) > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append({"chunks": (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(),
                       "more": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> np.uint32(CHUNK_BITS)
    return levels


def decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids (uint32)."""
    out = np.zeros(0, np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), bitorder="little")[:len(chunks)].astype(bool)
        chunks[more] |= out << np.uint32(CHUNK_BITS)
        out = chunks
    return out


def access(levels: list[dict[str, bytes]], i: int) -> int:
    """The id at position i, from one chunk per level."""
    value = 0
    for j, level in enumerate(levels):
        value |= level["chunks"][i] << (CHUNK_BITS * j)
        byte = level["more"][i >> 3]
        if not byte >> (i & 7) & 1:
            return value
        block = i // BLOCK
        start = block * BLOCK // 8
        ones = int.from_bytes(level["ranks"][4 * block:4 * block + 4], "little")
        ones += int.from_bytes(level["more"][start:i >> 3], "little").bit_count() + (byte & ((1 << (i & 7)) - 1)).bit_count()
        i = ones
    return value


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents, ascending by id, into segment files under ``path``."""
    spark = docs.sparkSession
    ship_package(spark)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "_tie", "_row"]
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
            .repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text"))

    def run(batches):
        part, first, held = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, sizes, ids = [], [], []

        def segment():
            flat = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_pylist([{
                "part": part, "first": first, "tokens": len(flat), "doc_ids": doc_ids, "doc_tokens": sizes,
                "levels": encode(flat)}], _ARROW)

        for batch in batches:
            for b in text_blocks(batch.column(1), 2 << 20):
                for i, x in enumerate(encode_ids(tokenizer, [b.text(i).decode() for i in range(b.n)])):
                    ids.append(x + end)
                    sizes.append(len(x) // 4 + 1)
                    doc_ids.append(batch.column(0)[b.first + i].as_py())
                    held += sizes[-1]
                    if held >= SEGMENT:
                        yield segment()
                        first, held = first + held, 0
                        doc_ids, sizes, ids = [], [], []
        if ids:
            yield segment()

    rows.mapInArrow(run, _SCHEMA).write.parquet(path)


_ARROW = pa.schema([
    ("part", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())),
    ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: ids of all documents before them."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    # one row per file range: a window over as many rows as files were written
    base = (files.groupBy("part").agg(F.sum("tokens").alias("n"))
            .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))
    return files.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id_col, start, n_tokens, ids (little-endian 32-bit bytes)."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                flat = decode(r["levels"]).astype("<u4").tobytes()
                size = np.array(r["doc_tokens"], np.int64)
                at = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(at + r["start"]), pa.array(size),
                    pa.array([flat[4 * a:4 * (a + n)] for a, n in zip(at.tolist(), size.tolist())], pa.binary())],
                    [id_col, "start", "n_tokens", "ids"])

    return segments(spark, path).select("doc_ids", "doc_tokens", "start", "levels").mapInArrow(
        run, f"`{id_col}` long, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a position of the whole corpus: reads one segment, decodes one id."""
    row = segments(spark, path).filter((F.col("start") <= position) & (F.col("start") + F.col("tokens") > position)).select(
        "start", "levels").first()
    return None if row is None else access([x.asDict() for x in row["levels"]], position - row["start"])
