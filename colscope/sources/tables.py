"""Open a set of tables as DataFrames and list their columns.

A "database" is a named set of DataFrames: Parquet files in a folder, tables
of a Spark catalog, or JDBC tables read in parallel by a partition column.
Listing columns only reads schemas (no Spark job).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from colscope.schemas import SCHEMA_COLUMNS


def load_tables(spark: SparkSession, path: str, names: Iterable[str] | None = None,
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """Read every ``<name>.<fmt>`` under ``path`` (or the given names)."""
    if names is None:
        suffix = f".{fmt}"
        names = sorted(n[: -len(suffix)] for n in _listed(spark, path) if n.endswith(suffix))
    return {n: spark.read.format(fmt).load(f"{path.rstrip('/')}/{n}.{fmt}") for n in names}


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark can read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)]


def jdbc_range_options(column: str, lower, upper, num_partitions: int) -> dict[str, str]:
    """Options of a read in ``num_partitions`` ranges of a numeric, date or timestamp column. The
    bounds only place the ranges: rows outside them fall into the first or last one. No bounds
    (an empty table) or equal ones need no split."""
    if lower is None or upper is None or lower == upper:
        return {}
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(num_partitions)}


def jdbc_bounds_query(table: str, column: str) -> str:
    """The text by which the database itself finds a column's bounds (one row comes back, and an
    index on the column answers it without a scan)."""
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"


def jdbc_hash_predicates(column: str, num_partitions: int, hash_sql: str = "MOD(ABS({column}), {n})") -> list[str]:
    """Disjoint conditions that together cover all rows, for a key without useful ranges: a row
    belongs to the part of its hash, and rows without a key to part 0. ``hash_sql`` is the text of
    a hash below ``{n}`` in the database's own dialect (e.g. ``MOD(ABS(HASHTEXT({column})), {n})``)."""
    h = hash_sql.format(column=column, n=num_partitions)
    return [f"{h} = {i}" + (f" OR {column} IS NULL" if i == 0 else "") for i in range(num_partitions)]


def load_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                    lower=None, upper=None, num_partitions: int = 64, properties: Mapping[str, str] | None = None,
                    hash_sql: str | None = None) -> DataFrame:
    """One JDBC table. With a ``partition_column`` it is read in ``num_partitions`` tasks: by ranges,
    whose bounds are looked up in the database (``jdbc_bounds_query``) unless given, or, with
    ``hash_sql``, by hash conditions. Without one the read is a single task."""
    properties = dict(properties or {})
    if partition_column is not None and hash_sql is not None:
        return spark.read.jdbc(url, table, predicates=jdbc_hash_predicates(partition_column, num_partitions, hash_sql), properties=properties)
    reader = spark.read.format("jdbc").option("url", url).options(**properties)
    split = {}
    if partition_column is not None:
        if lower is None or upper is None:
            found = reader.option("query", jdbc_bounds_query(table, partition_column)).load().first()
            lower, upper = (found[0] if lower is None else lower), (found[1] if upper is None else upper)
            reader = spark.read.format("jdbc").option("url", url).options(**properties)
        split = jdbc_range_options(partition_column, lower, upper, num_partitions)
    return reader.option("dbtable", table).options(**split).load()


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def type_family(dt: T.DataType) -> str | None:
    """Value family used for key and inclusion tests; None = not key material."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DecimalType):
        return "decimal"
    return None


def table_columns_meta(database: str, tables: Mapping[str, DataFrame]) -> list[tuple]:
    """Column rows (driver-side metadata, one per column) in SCHEMA_COLUMNS order.

    ``col_id`` numbers the columns of all tables so that one shuffle can serve
    every table; tables are taken in name order.
    """
    rows = []
    col_id = 0
    for t in sorted(tables):
        for pos, f in enumerate(tables[t].schema.fields, start=1):
            md = f.metadata or {}
            rows.append((database, t, pos, f.name, f.dataType.simpleString(), bool(f.nullable),
                         md.get("default"), md.get("comment"), col_id, type_family(f.dataType)))
            col_id += 1
    return rows


def schema_columns(spark: SparkSession, database: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """P2 as a DataFrame: one row per column of every table."""
    return spark.createDataFrame(table_columns_meta(database, tables), SCHEMA_COLUMNS)


def catalog_tables(spark: SparkSession, database: str | None = None,
                   include_views: bool = False) -> dict[str, DataFrame]:
    """P1/P2 for tables registered in a Spark catalog: every table (and, when
    asked, view) of ``database`` (default: the current one) as a DataFrame."""
    out = {}
    for t in spark.catalog.listTables(database):
        if t.tableType == "VIEW" or t.isTemporary:
            if not include_views:
                continue
        name = f"{database}.{t.name}" if database and not t.isTemporary else t.name
        out[t.name] = spark.table(name)
    return out


def catalog_comments(spark: SparkSession, database: str | None = None) -> dict[str, str]:
    """Comments of the tables that a Spark catalog describes (name -> text), metadata only."""
    return {t.name: t.description for t in spark.catalog.listTables(database) if t.description}


def readable_tables(tables: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Split tables into those whose schema resolves and those that fail
    (name -> error text), so one broken table does not stop a profile run."""
    ok, bad = {}, {}
    for name, df in tables.items():
        try:
            _ = df.schema
            ok[name] = df
        except Exception as e:  # noqa: BLE001 - any reader error skips the table
            bad[name] = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
    return ok, bad
