"""Edit, report on and render the catalogue.

The catalogue is two DataFrames (``catalog_tables``, ``catalog_columns``);
every function here returns new DataFrames. Per-table text is assembled with
ordered ``collect_list`` of ``(position, line)`` structs, so each table's text
is built by one task from that table's own column rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.text import truncate_text

# output markers of the rendered text (our own wording)
UNKNOWN = "-"
EDIT_FIELDS = ["business_name", "description", "column_business_name", "column_description"]


def edit_catalog(tables: DataFrame, columns: DataFrame, edits: DataFrame
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4: apply a batch of edits.

    ``edits``: seq, database, table, business_name, description, column,
    column_business_name, column_description (null = keep). An edit with all
    four value fields null is refused; an edit of an absent table reports
    ``table_found=false``; an edit naming an absent column still succeeds for
    the table fields (``column_found=false``). Several edits of one field keep
    the value of the highest ``seq`` that sets it.
    Returns (tables, columns, report).
    """
    given = [F.coalesce(F.col(c) != "", F.lit(False)) for c in EDIT_FIELDS]
    any_given = given[0]
    for g in given[1:]:
        any_given = any_given | g
    # like the tool: a call whose four values are all null or empty is refused
    e = edits.withColumn("refused", ~any_given)
    live = e.where(~F.col("refused"))
    t_keys = tables.select("database", "table").withColumn("table_found", F.lit(True))
    c_keys = (columns.select("database", "table", F.col("column")).withColumn("column_found", F.lit(True)))
    report = (e.join(t_keys, ["database", "table"], "left")
              .join(c_keys, ["database", "table", "column"], "left")
              .select("seq", "database", "table", "column", "refused",
                      F.coalesce("table_found", F.lit(False)).alias("table_found"),
                      F.when(F.col("column").isNull(), F.lit(None).cast("boolean"))
                      .otherwise(F.coalesce("column_found", F.lit(False))).alias("column_found"))
              .withColumn("applied", ~F.col("refused") & F.col("table_found")))

    def last(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))

    t_new = live.groupBy("database", "table").agg(last("business_name").alias("_bn"),
                                                  last("description").alias("_desc"))
    out_tables = (tables.join(t_new, ["database", "table"], "left")
                  .withColumn("business_name", F.coalesce("_bn", "business_name"))
                  .withColumn("description", F.coalesce("_desc", "description"))
                  .drop("_bn", "_desc").select(*tables.columns))
    c_new = (live.where(F.col("column").isNotNull()).groupBy("database", "table", "column")
             .agg(last("column_business_name").alias("_bn"), last("column_description").alias("_desc")))
    out_columns = (columns.join(c_new, ["database", "table", "column"], "left")
                   .withColumn("business_name", F.coalesce("_bn", "business_name"))
                   .withColumn("description", F.coalesce("_desc", "description"))
                   .drop("_bn", "_desc").select(*columns.columns))
    return out_tables, out_columns, report


def _n_columns(columns: DataFrame) -> DataFrame:
    return columns.groupBy("database", "table").agg(F.count(F.lit(1)).alias("column_count"))


def overview(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table: business name, column count, row count text (0/null -> '-')."""
    return (tables.join(_n_columns(columns), ["database", "table"], "left")
            .select("database", "table",
                    F.coalesce("business_name", F.lit(UNKNOWN)).alias("business_name"),
                    F.coalesce("column_count", F.lit(0)).cast("bigint").alias("column_count"),
                    F.when(F.col("row_count") > 0, F.format_number("row_count", 0))
                    .otherwise(F.lit(UNKNOWN)).alias("row_count_text")))


def table_header(tables: DataFrame) -> DataFrame:
    """C7 header: business name, description and row count of each table."""
    return tables.select("database", "table", F.coalesce("business_name", F.lit(UNKNOWN)).alias("business_name"),
                         F.coalesce("description", F.lit("")).alias("description"), "row_count")


def table_detail(columns: DataFrame) -> DataFrame:
    """One row per column with flags, names, first 6 keywords and the first 5
    samples cut to 30 characters."""
    flags = F.concat_ws(", ", F.when(F.col("is_primary_key"), F.lit("PK")),
                        F.when(F.col("is_foreign_key"), F.lit("FK")))
    return columns.select(
        "database", "table", "position", "column", "data_type",
        flags.alias("flags"),
        F.coalesce("business_name", F.lit(UNKNOWN)).alias("business_name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 6), ", ")
        .alias("keywords_text"),
        F.array_join(F.transform(F.slice(F.coalesce("sample_values", F.array().cast("array<string>")), 1, 5),
                                 lambda v: truncate_text(v, 30)), ", ").alias("samples_text"),
    )


def _given(c: str) -> F.Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _column_line(full: bool) -> F.Column:
    """``name type; key; references t.c; required`` and, in full, ``means ...; values ...``."""
    facts = [F.concat_ws(" ", "column", "data_type"),
             F.when(F.col("is_primary_key"), F.lit("key")),
             F.when(F.col("is_foreign_key"), F.concat(F.lit("references "), F.col("foreign_key_ref"))),
             F.when(~F.col("nullable"), F.lit("required"))]
    if full:
        samples = F.slice(F.array_distinct(F.coalesce("sample_values", F.array().cast("array<string>"))), 1, 5)
        facts += [F.when(_given("business_name"), F.concat(F.lit("means "), F.col("business_name"))),
                  F.when(F.size(samples) > 0, F.concat(F.lit("values "), F.array_join(samples, " / ")))]
    return F.concat(F.lit("  "), F.concat_ws("; ", *facts))


def _ordered_lines(columns: DataFrame, line: F.Column) -> DataFrame:
    return (columns.groupBy("database", "table")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))),
                                          lambda s: s["l"]), "\n").alias("lines")))


def schema_text(tables: DataFrame, columns: DataFrame, variant: str = "full") -> DataFrame:
    """Per-table schema text. ``variant``: 'raw' (type, key, reference, required),
    'full' (+ business name, description, up to 5 distinct samples),
    'tables' (header only)."""
    t = tables.select("database", "table", "business_name", "description")
    head = F.concat(F.lit("TABLE "), F.col("table"))
    if variant in ("full", "tables"):
        head = F.concat_ws(": ", head, F.when(_given("business_name"), F.col("business_name")))
    if variant == "tables":
        return t.select("database", "table", head.alias("text"))
    if variant == "full":
        head = F.concat_ws("\n", head, F.when(_given("description"), F.col("description")))
    lines = _ordered_lines(columns, _column_line(variant == "full"))
    return (t.join(lines, ["database", "table"], "left")
            .select("database", "table",
                    F.concat(head, F.lit("\n"), F.coalesce("lines", F.lit(""))).alias("text")))


def schema_summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """C8 summary: a row per table with its label and, in position order, its columns, each
    followed by its label after ``=`` where it has one."""
    item = F.concat_ws("=", "column", F.when(_given("business_name"), F.col("business_name")))
    cols = (columns.groupBy("database", "table")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("l")))), lambda s: s["l"]).alias("cols")))
    return (tables.join(cols, ["database", "table"], "left")
            .select("database", "table", F.coalesce("business_name", F.lit(UNKNOWN)).alias("label"),
                    F.coalesce(F.size("cols"), F.lit(0)).cast("bigint").alias("column_count"),
                    F.array_join(F.coalesce("cols", F.array().cast("array<string>")), " | ").alias("columns")))


def database_text(per_table: DataFrame, text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """Join per-table texts of each database in table-name order (one row per database)."""
    return (per_table.groupBy("database")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", F.col(text_col).alias("x")))),
                                          lambda s: s["x"]), sep).alias(text_col)))


def status(tables: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Per database: table count, age of the newest catalogue ('today' under a
    day, else 'Nd ago'), number of stored examples."""
    age = F.floor((F.unix_seconds(F.current_timestamp()) - F.unix_seconds(F.max("generated_at"))) / 86400)
    out = tables.groupBy("database").agg(F.count(F.lit(1)).alias("table_count"), age.alias("age_days"))
    out = out.withColumn("age_text", F.when(F.col("age_days") < 1, F.lit("today"))
                         .otherwise(F.concat(F.col("age_days").cast("string"), F.lit("d ago"))))
    n_ex = examples.count() if examples is not None else 0
    return out.withColumn("example_count", F.lit(n_ex).cast("bigint"))
