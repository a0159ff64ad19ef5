"""A1-A3: the table work around model annotations.

The model call itself is outside: requests are rows, replies come back as a
DataFrame ``(database, table, column, reply)`` (``column`` null for a table
reply) - e.g. produced by the caller's ``mapInPandas`` over the requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.text import strip_code_fence

COLUMN_REPLY = "business_name string, description string, data_type_hint string, keywords array<string>"
TABLE_REPLY = "business_name string, description string, purpose string"


def column_requests(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A1 per column: what the profile knows of it, as one JSON object: the ``item`` (table and
    column), its ``values`` (type, examples, number of distinct ones: -1 if not known), its
    ``keys`` and the ``notes`` left by others (column, then table; empty if there is none)."""
    t = tables.select("database", "table", F.col("comment").alias("table_comment"))
    none = F.lit("")
    body = F.to_json(F.struct(
        F.concat_ws(".", "table", "column").alias("item"),
        F.struct(F.col("data_type").alias("type"), F.col("nullable").alias("optional"),
                 F.slice(F.coalesce("sample_values", F.array().cast("array<string>")), 1, 10).alias("examples"),
                 F.coalesce("unique_count", F.lit(-1)).alias("distinct")).alias("values"),
        F.struct(F.col("is_primary_key").alias("primary"), F.coalesce("foreign_key_ref", none).alias("references")).alias("keys"),
        F.array(F.coalesce("comment", none), F.coalesce("table_comment", none)).alias("notes")))
    return columns.join(t, ["database", "table"], "left").select("database", "table", "column", body.alias("request"))


def table_requests(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A1 per table: its facts and those of its columns, in position order, as one JSON object."""
    one = F.struct(F.col("position"), F.struct(
        F.col("column").alias("name"), F.col("data_type").alias("type"), F.col("is_primary_key").alias("key"),
        F.coalesce("foreign_key_ref", F.lit("")).alias("references")).alias("facts"))
    cols = columns.groupBy("database", "table").agg(F.array_sort(F.collect_list(one)).alias("_c"))
    body = F.to_json(F.struct(
        F.col("table"), F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("row_count", F.lit(0)).alias("rows"),
        F.coalesce(F.col("_c.facts"), F.array().cast("array<struct<name:string,type:string,key:boolean,references:string>>"))
        .alias("columns")))
    return tables.join(cols, ["database", "table"], "left").select("database", "table", body.alias("request"))


def parse_replies(replies: DataFrame, reply_col: str = "reply", schema: str = COLUMN_REPLY) -> DataFrame:
    """A2: trim, drop a code fence, parse JSON.

    ``state``: 'ok' (a JSON object), 'invalid' (not JSON: parsed as an empty
    object, so defaults apply), 'not_object' (JSON but not an object: the
    reference fails on it). Parsed fields are added as columns."""
    body = strip_code_fence(F.coalesce(F.col(reply_col), F.lit("")))
    v = F.try_parse_json(body)
    state = (F.when(v.isNull(), F.lit("invalid"))
             .when(F.schema_of_variant(v).startswith("OBJECT"), F.lit("ok"))
             .otherwise(F.lit("not_object")))
    parsed = F.when(state == "ok", F.from_json(body, schema))
    out = replies.withColumn("_body", body).withColumn("state", state).withColumn("_p", parsed)
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    return out.select(*replies.columns, "state", *[F.col("_p")[f].alias(f) for f in fields])


def _last_reply(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One reply per key: the last by ``seq`` if the replies carry one; among equals (or
    without ``seq``) the greatest by its fields."""
    rest = [c for c in parsed.columns if c not in keys]
    order = [c for c in ("seq",) if c in rest] + [c for c in rest if c != "seq"]
    last = parsed.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_l"))
    return last.select(*keys, "_l.*")


def merge_column_replies(columns: DataFrame, parsed: DataFrame) -> DataFrame:
    """A3 for columns: a reply that parsed (ok or invalid) sets business_name
    (default: the column name), description (default '') and keywords (default
    []); a failed reply ('not_object') or no reply leaves the column untouched."""
    r = (_last_reply(parsed.where(F.col("state") != "not_object"), ["database", "table", "column"])
         .select("database", "table", "column", F.lit(True).alias("_hit"),
                 F.col("business_name").alias("_bn"), F.col("description").alias("_desc"),
                 F.col("keywords").alias("_kw")))
    out = columns.join(r, ["database", "table", "column"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (out.withColumn("business_name", F.when(hit, F.coalesce("_bn", "column")).otherwise(F.col("business_name")))
            .withColumn("description", F.when(hit, F.coalesce("_desc", F.lit(""))).otherwise(F.col("description")))
            .withColumn("keywords", F.when(hit, F.coalesce("_kw", F.array().cast("array<string>")))
                        .otherwise(F.col("keywords")))
            .select(*columns.columns))


def merge_table_replies(tables: DataFrame, parsed: DataFrame, strict: bool = True) -> DataFrame:
    """A3 for tables: business_name (default: table name) and description
    (default ''). With ``strict`` a failed or missing table reply raises, as a
    failed table annotation aborts the run (one small action)."""
    r = (_last_reply(parsed.drop("column"), ["database", "table"]).select("database", "table", "state", F.col("business_name").alias("_bn"),
                       F.col("description").alias("_desc")))
    out = tables.join(r, ["database", "table"], "left")
    if strict:
        bad = out.where(F.col("state").isNull() | (F.col("state") == "not_object")).select("table").orderBy("table").limit(5).collect()
        if bad:
            raise ValueError(f"table annotation failed for: {[b['table'] for b in bad]}")
    hit = F.col("state").isNotNull() & (F.col("state") != "not_object")
    return (out.withColumn("business_name", F.when(hit, F.coalesce("_bn", "table")).otherwise(F.col("business_name")))
            .withColumn("description", F.when(hit, F.coalesce("_desc", F.lit(""))).otherwise(F.col("description")))
            .select(*tables.columns))


def call_model(requests: DataFrame, fn, request_col: str = "request", reply_col: str = "reply") -> DataFrame:
    """Model hook: ``fn`` maps a pandas Series of request texts to a Series of
    reply texts (one batched call per Arrow batch, on the executors). Keys are
    kept; the output feeds :func:`parse_replies`."""
    import pandas as pd

    keys = [c for c in requests.columns if c != request_col]
    schema = requests.select(*keys).schema.add(reply_col, "string")

    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            out[reply_col] = pd.Series(fn(pdf[request_col]), index=pdf.index).astype(object)
            yield out

    return requests.mapInPandas(run, schema)
