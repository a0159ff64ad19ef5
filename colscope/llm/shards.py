"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are put in a seeded random order within their source; the row with rank r of n gets
the fractional rank (2 r + 1) / (2 n). Sorted by it, the sources alternate in the proportions
of the whole table, and cutting that order into equal runs gives every shard the same
mixture to within one row of each source. The law held is ``rows``.

No rank is taken over a whole source or the whole table at once: rows fall into cells by
their hash (or their fractional rank), a window ranks inside a cell, and the counts of the
cells before it give the offset. A source with a third of all rows has as many cells as any
other. The method uses no groups; equal texts may go to different shards.

Defined results: null text has size 1 and crc 0; null is a source of its own; rows with
equal hash are ordered by id (null first), size and crc, so repeated rows take neighbouring
ranks; ``grown_shard`` is null under this law; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.tables import small_or_shuffled, written

CELL_ROWS = 50_000


def _offsets(rows: DataFrame, cell: str, by: list[str]) -> DataFrame:
    """Rows in earlier cells (of the same ``by``) and in all cells, for each cell."""
    counts = rows.groupBy(*by, cell).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return counts.select(*by, cell, F.coalesce(F.sum("n").over(
        w.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"))
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    rows = written(rows.withColumn("h", F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")), "shard-rows")
    # cells: at least one per task, and at most about CELL_ROWS rows in each
    n = rows.count()
    cells = 1 << max(0, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // CELL_ROWS) - 1).bit_length()
    rows = rows.withColumn("cell", F.shiftright("h", 60 - (cells.bit_length() - 1)))
    offsets = small_or_shuffled(written(_offsets(rows, "cell", ["stratum"]), "shard-cells"), 96)
    order = Window.partitionBy("stratum", "cell").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = rows.join(offsets, ["stratum", "cell"]).select(
        "doc_id", "size", "text_crc32", "stratum",
        ((2 * (F.col("before") + F.row_number().over(order) - 1) + 1).cast("double") / (2 * F.col("total"))).alias("fraction"))
    ranked = ranked.withColumn("run", F.floor(F.col("fraction") * cells))
    ranked = written(ranked, "shard-ranks")
    # one row per run: a window over ``cells`` rows
    starts = small_or_shuffled(written(_offsets(ranked, "run", []), "shard-runs"))
    order = Window.partitionBy("run").orderBy("fraction", "stratum")
    place = ranked.join(starts, "run").withColumn("pos", F.col("before") + F.row_number().over(order) - 1)
    k = F.expr(f"pos * {shards} div total")
    return place.withColumn("shard", k).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"pos - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB. crc32 is not built in: bytes are folded over the table of the
#: polynomial 0xEDB88320, which the first common table computes.
ORACLE = """
WITH one AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
    xor(4294967295, list_reduce([4294967295] || list_transform(
      CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE regexp_extract_all(hex(encode(text)), '..') END,
      lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))::BIGINT AS text_crc32
  FROM documents, one),
h AS (
  SELECT *, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS h FROM r),
k AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank,
    count(*) OVER (PARTITION BY stratum) AS n FROM h),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n), stratum) - 1 AS pos, count(*) OVER () AS total FROM k)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 8 // total)::INT AS shard,
  pos - ((pos * 8 // total) * total + 7) // 8 AS slot, NULL::INT AS grown_shard
FROM p
"""
