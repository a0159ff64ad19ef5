"""Frozen schemas of the catalogue, index and example stores."""

from pyspark.sql import types as T

CATALOG_TABLES = T.StructType([
    T.StructField("database", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("schema", T.StringType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("business_name", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("primary_keys", T.ArrayType(T.StringType()), True),
])

# column metadata as listed from a table's schema (P2); stats are joined on later
SCHEMA_COLUMNS = T.StructType([
    T.StructField("database", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
    T.StructField("default", T.StringType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("col_id", T.IntegerType(), False),
    T.StructField("family", T.StringType(), True),
])

CATALOG_COLUMNS = T.StructType([
    T.StructField("database", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
    T.StructField("default", T.StringType(), True),
    T.StructField("is_primary_key", T.BooleanType(), False),
    T.StructField("is_foreign_key", T.BooleanType(), False),
    T.StructField("foreign_key_ref", T.StringType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("sample_values", T.ArrayType(T.StringType()), True),
    T.StructField("null_ratio", T.DoubleType(), True),
    T.StructField("unique_count", T.LongType(), True),
    T.StructField("business_name", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("keywords", T.ArrayType(T.StringType()), True),
])

SEARCH_ITEMS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("database", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("column", T.StringType(), True),
    T.StructField("data_type", T.StringType(), True),
    T.StructField("business_name", T.StringType(), True),
    T.StructField("document", T.StringType(), True),
])

EXAMPLES = T.StructType([
    T.StructField("log_id", T.StringType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("sql", T.StringType(), True),
    T.StructField("selected_columns", T.StringType(), True),
    T.StructField("added_at", T.TimestampType(), True),
])

CATALOG_VERSION = "1.0"
