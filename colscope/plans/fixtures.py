"""Derived inputs built from the given tables (same expressions as the DuckDB
text in ``colscope.plans.oracle``). They stand in for what a live system
supplies: planted nulls, model replies, edits, vector items, question/SQL
pairs and a SQL log. Every one reads whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DB = "testdata"
VEC_DB = "vec"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# declared keys of the star schema (the files themselves declare none)
PRIMARY_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
                "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
FOREIGN_KEYS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
                ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
                ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
                ("lineitem", "l_suppkey", "supplier", "s_suppkey")]

# what a live system says of some of its tables
TABLE_COMMENTS = {"orders": "one row per order", "lineitem": "positions of orders", "documents": "texts, in 4 languages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read(spark, sf_dir, t) for t in TABLES}


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with planted nulls and one all-null column."""
    li = read(spark, sf_dir, "lineitem")
    return (li.withColumn("l_tax", F.expr("nullif(l_tax, 0.0)"))
            .withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'A')"))
            .withColumn("l_void", F.lit(None).cast("string")))


def profile_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = all_tables(spark, sf_dir)
    t["lineitem_nulls"] = lineitem_nulls(spark, sf_dir)
    return t


def part_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-reply texts keyed by part: plain, fenced, broken, missing keys, empty."""
    p = read(spark, sf_dir, "part")
    plain = F.concat(F.lit('{"business_name": "'), F.col("p_name"), F.lit('", "description": "part of '),
                     F.col("p_brand"), F.lit('", "keywords": ["'), F.col("p_type"), F.lit('", "'),
                     F.col("p_brand"), F.lit('"]}'))
    m = F.pmod(F.col("p_partkey"), F.lit(5))
    reply = (F.when(m == 0, plain)
             .when(m == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
             .when(m == 2, F.concat(F.lit('{"business_name": "'), F.col("p_name"), F.lit('", "description": ')))
             .when(m == 3, F.concat(F.lit('{"description": "size '), F.col("p_size").cast("string"), F.lit('"}')))
             .otherwise(F.lit("")))
    return p.select(F.col("p_partkey").alias("key"), reply.alias("reply"))


def column_replies(columns: DataFrame) -> DataFrame:
    """Model replies for catalogue columns, one of five shapes by position."""
    plain = F.concat(F.lit('{"business_name": "'), F.upper("column"), F.lit('", "description": "'),
                     F.col("column"), F.lit(" of "), F.col("table"), F.lit('", "keywords": ["'),
                     F.col("table"), F.lit('", "'), F.col("data_type"), F.lit('"]}'))
    m = F.pmod(F.col("position"), F.lit(5))
    reply = (F.when(m == 0, plain)
             .when(m == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
             .when(m == 2, F.lit('{"business_name": '))
             .when(m == 3, F.concat(F.lit('{"description": "values of '), F.col("column"), F.lit('"}')))
             .otherwise(F.lit("[1, 2]")))
    return columns.select("database", "table", "column", reply.alias("reply"))


def table_replies(tables: DataFrame) -> DataFrame:
    reply = F.concat(F.lit('{"business_name": "'), F.initcap("table"), F.lit('", "description": "rows of '),
                     F.col("table"), F.lit('"}'))
    return tables.select("database", "table", F.lit(None).cast("string").alias("column"), reply.alias("reply"))


def catalog_edits(spark: SparkSession, columns: DataFrame) -> DataFrame:
    """A batch of edits derived from the catalogue: every column of every table
    gets a description edit, tables with a 'key' column get a business name,
    plus edits of an absent table and an absent column and one empty edit."""
    per_col = columns.select(
        F.col("position").cast("bigint").alias("seq"), "database", "table",
        F.lit(None).cast("string").alias("business_name"), F.lit(None).cast("string").alias("description"),
        F.col("column"), F.lit(None).cast("string").alias("column_business_name"),
        F.concat(F.lit("edited "), F.col("column")).alias("column_description"))
    per_tab = (columns.where(F.col("column").contains("key")).select("database", "table").distinct()
               .select(F.lit(100).cast("bigint").alias("seq"), "database", "table",
                       F.concat(F.lit("Table "), F.col("table")).alias("business_name"),
                       F.lit(None).cast("string").alias("description"),
                       F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("column_business_name"),
                       F.lit(None).cast("string").alias("column_description")))
    odd = spark.createDataFrame(
        [(200, DB, "no_such_table", "x", None, None, None, None),
         (201, DB, "orders", None, "orders edited", "no_such_column", "y", None),
         (202, DB, "orders", None, None, None, None, None)],
        "seq bigint, database string, table string, business_name string, description string, column string, "
        "column_business_name string, column_description string")
    return per_col.unionByName(per_tab).unionByName(odd)


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items over ``embeddings``: per label a table ``t<label>`` whose
    item is the label's lowest vec_id; the other vectors are its columns."""
    e = read(spark, sf_dir, "embeddings")
    low = e.groupBy("label").agg(F.min("vec_id").alias("_low"))
    x = e.join(low, "label")
    is_t = F.col("vec_id") == F.col("_low")
    tname = F.concat(F.lit("t"), F.col("label").cast("string"))
    cname = F.concat(F.lit("c"), F.col("vec_id").cast("string"))
    return x.select(
        F.when(is_t, F.concat_ws(".", F.lit(VEC_DB), tname)).otherwise(F.concat_ws(".", F.lit(VEC_DB), tname, cname))
        .alias("id"),
        F.when(is_t, F.lit("table")).otherwise(F.lit("column")).alias("type"),
        F.lit(VEC_DB).alias("database"), tname.alias("table"),
        F.when(~is_t, cname).alias("column"),
        F.when(~is_t, F.lit("float")).alias("data_type"),
        F.when(is_t, F.concat(F.lit("label "), F.col("label").cast("string")))
        .otherwise(F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("business_name"),
        F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is also a question vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"),
                                                   F.col("embedding").alias("vector"))


def example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/SQL stand-ins: a user turn and the assistant turn right after it."""
    c = read(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").alias("u")
    a = c.where(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    m = F.pmod(F.col("u.turn"), F.lit(3))
    return j.select(
        F.concat(F.col("u.conv_id").cast("string"), F.lit("-"), F.col("u.turn").cast("string")).alias("log_id"),
        F.col("u.text").alias("question"), F.col("a.text").alias("sql"),
        F.when(m == 0, F.lit('["text", "role"]')).when(m == 1, F.lit("[broken")).alias("selected_columns"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("u.conv_id") * 60 + F.col("u.turn")).alias("added_at"))


def all_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the turn after it (any roles), as an example batch."""
    c = read(spark, sf_dir, "conversations")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select(
        F.concat(F.col("a.conv_id").cast("string"), F.lit("-"), F.col("a.turn").cast("string")).alias("log_id"),
        F.col("a.text").alias("question"), F.col("b.text").alias("sql"),
        F.lit(None).cast("string").alias("selected_columns"),
        F.timestamp_seconds(F.lit(1735689600) + F.col("a.conv_id") * 60 + F.col("a.turn")).alias("added_at"))


SHAPES = 26


def sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL log over ``orders``: one text per order, ``SHAPES`` shapes by order key."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    c = F.col("o_custkey").cast("string")
    m = F.pmod(F.col("o_orderkey"), F.lit(SHAPES))
    t = (F.when(m == 0, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), k))
         .when(m == 1, F.concat(F.lit("WITH t AS (SELECT o_custkey FROM orders WHERE o_orderkey = "), k,
                                F.lit(") SELECT * FROM t")))
         .when(m == 2, F.concat(F.lit("DROP TABLE orders_"), k))
         .when(m == 3, F.concat(F.lit("SELECT 1; DELETE FROM orders WHERE o_orderkey = "), k))
         .when(m == 4, F.concat(F.lit("SELECT * FROM orders WHERE o_custkey = "), c, F.lit(" --")))
         .when(m == 5, F.concat(F.lit("SELECT /* hint "), k, F.lit(" */ o_totalprice FROM orders")))
         .when(m == 6, F.lit(""))
         .when(m == 7, F.lit("   \n  "))
         .when(m == 8, F.concat(F.lit("SELECT 'grant "), k, F.lit("' AS note FROM orders")))
         .when(m == 9, F.concat(F.lit("select o_orderstatus, count(*) from orders where o_custkey = "), c,
                                F.lit(" group by o_orderstatus")))
         .when(m == 10, F.concat(F.lit("INSERT INTO orders_copy SELECT * FROM orders WHERE o_orderkey = "), k))
         .when(m == 11, F.concat(F.lit("SELECT "), k, F.lit("; SELECT "), c))
         .when(m == 12, F.concat(F.lit("UPDATE orders SET o_totalprice = 0 WHERE o_orderkey = "), k))
         .when(m == 13, F.concat(F.lit("SELECT * FROM orders WHERE o_orderpriority = '' OR '1'='1' AND o_custkey = "), c))
         .when(m == 14, F.concat(F.lit("SELECT o_orderkey FROM orders WHERE o_custkey = "), c,
                                 F.lit(" UNION SELECT NULL")))
         .when(m == 15, F.lit("SHOW TABLES"))
         .when(m == 16, F.concat(F.lit("SELECT 'a;b "), k, F.lit("' AS x FROM orders")))
         .when(m == 17, F.concat(F.lit("-- daily report "), k, F.lit("\nSELECT 1 AS one")))
         .when(m == 18, F.concat(F.lit("/* report\n"), k, F.lit(" */ SELECT o_orderkey FROM orders")))
         .when(m == 19, F.concat(F.lit("WITH t AS (SELECT 1 AS a)\n-- main part\nSELECT a + "), k, F.lit(" FROM t")))
         .when(m == 20, F.concat(F.lit('WITH t AS (SELECT 1 AS "a) DELETE '), k, F.lit('") SELECT * FROM t')))
         .when(m == 21, F.concat(F.lit("SELECT 'it''s -- no; comment' AS note, "), k, F.lit(" AS n")))
         .when(m == 22, F.concat(F.lit("SELECT o_orderkey FROM orders WHERE o_orderpriority = 'p "), k, F.lit("'")))
         .when(m == 23, F.concat(F.lit("SELECT * FROM orders WHERE o_custkey IN (7, 1"), c, F.lit(") AND o_orderpriority IN ('a', 'b"), k,
                                 F.lit("') LIMIT 2"), k))
         .when(m == 24, F.concat(F.lit("SELECT o_custkey, count(*) FROM orders WHERE o_custkey BETWEEN 3 AND 1"), c,
                                 F.lit(" AND o_orderstatus <> 'x"), k, F.lit("' GROUP BY o_custkey")))
         .otherwise(F.concat(F.lit("SELECT o_orderkey FROM orders WHERE no_such = 'p "), k, F.lit("'"))))
    return o.select(F.col("o_orderkey").alias("query_id"), t.alias("sql"))
