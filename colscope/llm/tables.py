"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.plans.sizing import DEFAULT_MAX_BYTES
from colscope.session import ensure_checkpoint_dir

BATCH_ROWS = 500        # about 1 MB of usual documents

BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/colscope-{name}-{uuid.uuid4().hex}"


@contextmanager
def short_batches(spark: SparkSession, rows: int | None = BATCH_ROWS) -> Iterator[None]:
    """While it lasts, at most ``rows`` rows (None: the session's number) are read from Parquet and go to
    a Python worker at a time: a batch of texts is held several times over, by the JVM and by the
    worker, for every running task."""
    if rows is None:
        yield
        return
    before = {k: spark.conf.get(k) for k in BATCH_SETTINGS}
    for k, n in before.items():
        spark.conf.set(k, str(min(rows, int(n)) if int(n) > 0 else rows))
    try:
        yield
    finally:
        for k, n in before.items():
            spark.conf.set(k, n)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder (at ``path``, if given) and read again: later
    steps neither compute it again nor depend on the executors that made it."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with short_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """The files of a frame written at ``path``, a ``shared_path``, that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_or_shuffled(ids: DataFrame, row_bytes: int = 48) -> DataFrame:
    """A frame of fixed-width columns (already written: the count is cheap), hinted for
    broadcast only while its rows fit the bound; above it both sides are shuffled."""
    return F.broadcast(ids) if ids.count() * row_bytes <= DEFAULT_MAX_BYTES else ids


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids``; rows without id stay. All columns of ``docs``."""
    gone = written(ids.select(id_col).distinct(), "gone")
    return docs.join(small_or_shuffled(gone), id_col, "left_anti").select(*docs.columns)


def by_key(rows: DataFrame, values: DataFrame, keys: str | list[str], count: str = "n") -> DataFrame:
    """``rows`` left-joined with ``values`` (one row per key, already written) on a key that a
    third of all rows may share; ``count`` of ``values`` says how many rows have the key. Keys
    with more rows than a thousand and than a millionth of all rows are broadcast, which are
    fewer than a million whatever the data; rows with another key are shuffled, rows without a
    key are not joined."""
    keys = [keys] if isinstance(keys, str) else keys
    most = max(1000, (values.agg(F.sum(count)).first()[0] or 0) // 1_000_000)
    hot = F.broadcast(values.filter(F.col(count) > most).drop(count))
    cold = values.filter(F.col(count) <= most).drop(count)
    extra = [f for f in values.schema.fields if f.name not in (*keys, count)]
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    known = rows.filter(~missing)
    found = known.join(hot, keys).unionByName(known.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left"))
    none = rows.filter(missing).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    return found.unionByName(none)
