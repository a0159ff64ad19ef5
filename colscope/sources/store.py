"""Stores of databases as versions with a commit marker.

A save writes all its parts (``tables`` and ``columns`` of a catalogue, the ``items`` of an
index) as Parquet under a fresh folder ``<root>/v-<uuid>`` and then, for each database in it, one
empty file ``<root>/_current/<database>/<number>-v-<uuid>``. The file's *name* is the pointer:
creating an empty file is one step on every file system, so a reader sees the old version or the
new one, all parts of it, and a save that fails at any point leaves the old one as it is. Since
nothing is overwritten, a frame that reads a store may be saved back to it. The version before
the current one is kept for jobs that still read it; older ones are deleted.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.schemas import CATALOG_VERSION
from colscope.session import ensure_checkpoint_dir

TABLE_COLS = ["database", "table", "schema", "row_count", "comment", "business_name", "description",
              "primary_keys"]
COLUMN_COLS = ["database", "table", "position", "column", "data_type", "nullable", "default",
               "is_primary_key", "is_foreign_key", "foreign_key_ref", "comment", "sample_values",
               "null_ratio", "unique_count", "business_name", "description", "keywords"]


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path as it wants it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _markers(spark: SparkSession, root: str, database: str) -> list[tuple[int, str]]:
    """(number, version) of the database's commits, the current one last."""
    names = _names(spark, f"{root}/_current/{quote(database, safe='')}")
    return sorted((int(n), v) for n, _, v in (x.partition("-") for x in names) if n.isdigit())


def publish(parts: Mapping[str, DataFrame], root: str, databases: Sequence[str] | None = None) -> str:
    """Write ``parts`` (frames with a column ``database``) as a new version and make it the current
    one of ``databases`` (default: those present in the first part). Returns its folder."""
    first = next(iter(parts.values()))
    spark = first.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{root.rstrip('/')}/{version}"
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    if databases is None:       # one short row per database
        have = spark.read.schema(first.schema).parquet(f"{folder}/{next(iter(parts))}")
        databases = sorted(r[0] for r in have.select("database").distinct().collect() if r[0] is not None)
    for d in databases:
        number = max((n for n, _ in _markers(spark, root, d)), default=0) + 1
        fs, marker = _files(spark, f"{root.rstrip('/')}/_current/{quote(d, safe='')}/{number:012d}-{version}")
        fs.create(marker, False).close()
    _clean(spark, root)
    return folder


def _clean(spark: SparkSession, root: str) -> None:
    """Delete markers older than each database's last two, and versions that no marker names,
    unless a save may still be writing them (they are younger than a day)."""
    keep = set()
    for d in _names(spark, f"{root}/_current"):
        marks = _markers(spark, root, unquote(d))
        keep |= {v for _, v in marks[-2:]}
        for number, version in marks[:-2]:
            fs, p = _files(spark, f"{root}/_current/{d}/{number:012d}-{version}")
            fs.delete(p, False)
    fs, p = _files(spark, root)
    now = time.time()
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("v-") and name not in keep and now - f.getModificationTime() / 1000 > 86_400:
            fs.delete(f.getPath(), True)


def current(spark: SparkSession, root: str, database: str) -> str | None:
    """Folder of the database's current version."""
    marks = _markers(spark, root, database)
    return f"{root.rstrip('/')}/{marks[-1][1]}" if marks else None


def databases(spark: SparkSession, root: str) -> list[str]:
    return sorted(unquote(n) for n in _names(spark, f"{root}/_current"))


def read_part(spark: SparkSession, root: str, part: str, database: str | None = None) -> DataFrame | None:
    """Rows of one part of the current version of one database or of all."""
    by_folder: dict[str, list[str]] = {}
    for d in [database] if database is not None else databases(spark, root):
        folder = current(spark, root, d)
        if folder is not None:
            by_folder.setdefault(folder, []).append(d)
    out = None
    for folder, names in sorted(by_folder.items()):
        df = spark.read.parquet(f"{folder}/{part}").where(F.col("database").isin(names))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def rebuild_index(items: DataFrame, path: str, database: str) -> int:
    """V3: the index of one database anew: its old items go, also if there are no new ones.
    Returns the number of items written."""
    publish({"items": items.where(F.col("database") == database)}, path, [database])
    return read_index(items.sparkSession, path, database).count()


def read_index(spark: SparkSession, path: str, database: str | None = None) -> DataFrame | None:
    """The current items of one database or of all; None if there never were any."""
    return read_part(spark, path, "items", database)


def write_versioned(df: DataFrame, root: str, name: str) -> str:
    """Write ``df`` under a fresh version folder and return its path (the caller keeps it)."""
    path = os.path.join(root, name, f"v-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read again: what follows neither computes it
    again nor depends on the executors that made it."""
    path = write_versioned(df, ensure_checkpoint_dir(df.sparkSession), f"colscope-{name}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_catalog(tables: DataFrame, columns: DataFrame, root: str) -> None:
    """Store the catalogue of the database(s) present in ``tables``: both parts, with one
    stamp, become visible together."""
    now = tables.sparkSession.sql("SELECT current_timestamp()").first()[0]
    stamp = [F.lit(CATALOG_VERSION).alias("version"), F.lit(now).alias("generated_at")]
    publish({"tables": tables.select(*TABLE_COLS, *stamp), "columns": columns.select(*COLUMN_COLS, *stamp)}, root)


def load_catalog(spark: SparkSession, root: str, database: str) -> tuple[DataFrame, DataFrame] | None:
    """``(tables, columns)`` of one database, or None when absent.

    Missing optional fields get their defaults; ``primary_keys`` is rebuilt from
    the column flags in position order."""
    t, c = (read_part(spark, root, part, database) for part in ("tables", "columns"))
    if t is None or c is None:
        return None
    c = (c.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
         .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))))
    pk = (c.where("is_primary_key").groupBy("database", "table")
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))),
                           lambda s: s["column"]).alias("pk")))
    t = (t.drop("primary_keys").join(pk, ["database", "table"], "left")
         .withColumn("primary_keys", F.coalesce("pk", F.array().cast("array<string>"))).drop("pk"))
    return t, c


def list_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """The stored database names."""
    return spark.createDataFrame([(d,) for d in databases(spark, root)], "database string")


def catalog_exists(spark: SparkSession, root: str, database: str) -> bool:
    return current(spark, root, database) is not None


def clear_store(spark: SparkSession, path: str, like: DataFrame) -> None:
    """Replace everything under ``path`` with an empty table of ``like``'s schema."""
    spark.createDataFrame([], like.schema).write.mode("overwrite").parquet(path)
