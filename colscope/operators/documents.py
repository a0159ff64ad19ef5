"""Catalogue rows as search items with text documents.

Labels inside the documents are our own wording; the structure (which parts,
in which order, joined by `` | ``, optional parts left out) follows the
reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.text import name_variants

SEP = " | "


def table_documents(tables: DataFrame, columns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per table: name, business name, description, column list (position
    order), comment when present."""
    cols = (columns.groupBy("database", "table")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))),
                                          lambda s: s["column"]), ", ").alias("_cols")))
    doc = F.concat_ws(
        SEP,
        F.concat(F.lit("table: "), F.col("table")),
        F.concat(F.lit("business name: "), F.coalesce("business_name", F.lit(""))),
        F.concat(F.lit("description: "), F.coalesce("description", F.lit(""))),
        F.concat(F.lit("columns: "), F.coalesce("_cols", F.lit(""))),
        F.when(F.col("comment").isNotNull() & (F.col("comment") != ""), F.concat(F.lit("comment: "), F.col("comment"))),
    )
    return tables.join(cols, ["database", "table"], "left").select("database", "table", *keep, doc.alias("document"))


def column_documents(columns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """D3: per column: table, column, type, business name, description, name
    variants, keywords if any, first 5 samples if any."""
    kw = F.coalesce("keywords", F.array().cast("array<string>"))
    sv = F.coalesce("sample_values", F.array().cast("array<string>"))
    variants = name_variants(F.col("column"))
    doc = F.concat_ws(
        SEP,
        F.concat(F.lit("table: "), F.col("table")),
        F.concat(F.lit("column: "), F.col("column")),
        F.concat(F.lit("type: "), F.col("data_type")),
        F.concat(F.lit("business name: "), F.coalesce("business_name", F.lit(""))),
        F.concat(F.lit("description: "), F.coalesce("description", F.lit(""))),
        F.when(F.size(variants) > 0, F.concat(F.lit("name variants: "), F.array_join(variants, ", "))),
        F.when(F.size(kw) > 0, F.concat(F.lit("keywords: "), F.array_join(kw, ", "))),
        F.when(F.size(sv) > 0, F.concat(F.lit("samples: "), F.array_join(F.slice(sv, 1, 5), ", "))),
    )
    return columns.select("database", "table", "position", "column", *keep, doc.alias("document"))


def index_items(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """V3: search items of the catalogue: one per table (id ``db.table``) and one
    per column (id ``db.table.column``)."""
    t = (table_documents(tables, columns, ("business_name",))
         .select(F.concat_ws(".", "database", "table").alias("id"), F.lit("table").alias("type"),
                 "database", "table", F.lit(None).cast("string").alias("column"),
                 F.lit(None).cast("string").alias("data_type"),
                 F.coalesce("business_name", "table").alias("business_name"), "document",
                 F.lit(0).alias("position")))
    c = (column_documents(columns, ("data_type", "business_name"))
         .select(F.concat_ws(".", "database", "table", "column").alias("id"), F.lit("column").alias("type"),
                 "database", "table", "column", "data_type",
                 F.coalesce("business_name", "column").alias("business_name"), "document", "position"))
    return t.unionByName(c)
