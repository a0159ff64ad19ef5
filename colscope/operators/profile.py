"""Profile every column of a set of tables.

Work layout (what Spark runs):

* **stats pass** - one aggregate per table computes row count, non-null count,
  min/max (key families) and, in approximate mode, HLL distinct counts. No
  shuffle beyond the single-row final aggregate; Parquet footers answer
  ``count(*)``.
* **distinct pass** - every table is unpivoted to ``(col_id, h1, h2)``
  (128-bit value fingerprint) and all tables are unioned, so one exchange
  serves every column of every table. Partial aggregation runs map-side, so a
  hot value (one value in a third of the rows) is folded before the shuffle.
* **samples** - the first rows come by a filter found column by column
  (:mod:`colscope.operators.heads`); only the rows that pass it are sorted.
* **enum values** - a second scan of only the columns found to have at most
  ``enum_limit`` values; the partial aggregate keeps at most that many rows per
  task and column.
* **inclusion (FK) candidates and composite keys** -
  :mod:`colscope.operators.keys`: pruned on the stats and on value sketches that the same
  job leaves, then one semi-join on ``(key column, h1, h2)``.

Per-column results are metadata (one row per column); they are collected to
the driver between phases, never data rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.text import _SEED2 as SEED2
from colscope.functions.text import norm_key
from colscope.operators.heads import head_filters
from colscope.operators.keys import FAMILIES, SKETCH_SLOTS, composite_keys, inclusion_candidates, value_hash
from colscope.plans.sizing import broadcast_if_small, dealt
from colscope.schemas import SCHEMA_COLUMNS
from colscope.sources.store import kept
from colscope.sources.tables import readable_tables, table_columns_meta

APPROX_RSD = 0.02       # relative standard error of approximate distinct counts

STATS_SCHEMA = T.StructType([
    T.StructField("col_id", T.IntegerType(), False),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("non_null", T.LongType(), True),
    T.StructField("min_code", T.LongType(), True),
    T.StructField("max_code", T.LongType(), True),
    T.StructField("approx_distinct", T.LongType(), True),
])


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return False
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _norm_sql(name: str, dt: T.DataType) -> str:
    c = _q(name)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return f"CAST({c} AS BIGINT)"
    if isinstance(dt, T.MapType):
        return f"to_json({c})"
    return c


def fingerprint_sql(name: str, dt: T.DataType) -> tuple[str, str]:
    """Value identity as two longs, as SQL text (one JVM call per table instead
    of one per expression node).

    Integral, date and timestamp values are their own exact 64-bit identity
    (the value as a long, second part 0: no hashing, no collision); every
    other type gets a 128-bit fingerprint of two independent xxhash64 values.
    Equal values of one family give equal identities across columns."""
    c = _q(name)
    nn = f"{c} IS NOT NULL"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({c} AS BIGINT)", f"CASE WHEN {nn} THEN 0L END"
    if isinstance(dt, T.DateType):
        return f"CAST(unix_date({c}) AS BIGINT)", f"CASE WHEN {nn} THEN 0L END"
    if isinstance(dt, T.TimestampNTZType):
        return (f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})",
                f"CASE WHEN {nn} THEN 0L END")
    if isinstance(dt, T.TimestampType):
        return f"unix_micros({c})", f"CASE WHEN {nn} THEN 0L END"
    if isinstance(dt, T.DecimalType):
        # equal numbers of different scales are one value: hash the text without closing zeros
        v = f"regexp_replace(CAST({c} AS STRING), '([.][0-9]*?)0*$', '$1')" if dt.scale else f"concat(CAST({c} AS STRING), '.')"
    else:
        v = _norm_sql(name, dt)
    return (f"CASE WHEN {nn} THEN xxhash64({v}) END",
            f"CASE WHEN {nn} THEN xxhash64({SEED2}, {v}) END")


def canonical_text_sql(name: str, dt: T.DataType, qualifier: str = "") -> str:
    """SQL text of :func:`colscope.functions.text.canonical_text`."""
    c = qualifier + _q(name)
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(dt, T.BinaryType):
        return f"concat('<bytes:', CAST(octet_length({c}) AS STRING), '>')"
    if isinstance(dt, T.MapType):
        return f"to_json({c})"
    return f"CAST({c} AS STRING)"


def order_code_sql(name: str, fam: str | None, dt: T.DataType | None = None) -> str:
    """A bigint that never decreases as the value increases within its family:
    integral values as is, dates/timestamps as epoch units, strings as their
    first 7 UTF-8 bytes read big-endian. Used for min/max pruning only (ties
    between codes are allowed), it keeps every aggregate buffer fixed-width so
    Spark uses hash aggregation instead of sort aggregation."""
    c = _q(name)
    if fam == "timestamp" and isinstance(dt, T.TimestampNTZType):
        # wall-clock micros, independent of the session time zone (a zone's DST
        # gap would make a cast to TIMESTAMP non-monotone)
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"
    if fam == "integral":
        return f"CAST({c} AS BIGINT)"
    if fam == "date":
        return f"CAST(unix_date({c}) AS BIGINT)"
    if fam == "timestamp":
        return f"unix_micros(CAST({c} AS TIMESTAMP))"
    if fam == "decimal":
        # whole part, rounded down, held inside the range of a long
        return (f"CAST(least(greatest(floor({c}), CAST(-9223372036854775807 AS DECIMAL(38,0))), "
                f"CAST(9223372036854775807 AS DECIMAL(38,0))) AS BIGINT)")
    if fam == "string":
        return (f"CAST(conv(rpad(hex(substring(encode(substring({c}, 1, 7), 'UTF-8'), 1, 7)), 14, '0'), 16, 10) "
                f"AS BIGINT)")
    return "CAST(NULL AS BIGINT)"


def _meta_by_table(meta: Sequence[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for r in meta:
        out.setdefault(r[1], []).append(r)
    return out


def column_stats(tables: Mapping[str, DataFrame], meta: Sequence[tuple], approx: bool = False) -> DataFrame:
    """One aggregate per table: row count, non-null count, min/max, HLL distinct.

    Returns STATS_SCHEMA rows, one per column (lazy)."""
    parts = []
    for t, cols in _meta_by_table(meta).items():
        df = tables[t]
        aggs = [F.count(F.lit(1)).alias("__n")]
        structs = []
        for (_, _, pos, name, _, _, _, _, col_id, fam) in cols:
            dt = df.schema[name].dataType
            c = df[f"`{name}`"]
            aggs.append(F.count(c).alias(f"__nn{pos}"))
            mn = mx = F.lit(None)
            if fam is not None:
                code = F.expr(order_code_sql(name, fam, dt))
                aggs += [F.min(code).alias(f"__mn{pos}"), F.max(code).alias(f"__mx{pos}")]
                mn, mx = F.col(f"__mn{pos}"), F.col(f"__mx{pos}")
            apx = F.lit(None)
            if approx:
                aggs.append(F.approx_count_distinct(norm_key(c, dt), rsd=APPROX_RSD).alias(f"__apx{pos}"))
                apx = F.col(f"__apx{pos}")
            structs.append(F.struct(
                F.lit(col_id).alias("col_id"), F.col("__n").alias("row_count"),
                F.col(f"__nn{pos}").alias("non_null"),
                mn.cast("bigint").alias("min_code"), mx.cast("bigint").alias("max_code"),
                apx.cast("bigint").alias("approx_distinct")))
        if not structs:
            continue
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    return _union_all(parts)


def fingerprints(tables: Mapping[str, DataFrame], meta: Sequence[tuple],
                 col_ids: set[int] | None = None) -> DataFrame:
    """Long form ``(col_id, h1, h2)`` of every non-null value of the chosen columns
    of every table (no dedup, no shuffle)."""
    parts = []
    for t, cols in _meta_by_table(meta).items():
        df = tables[t]
        structs = []
        for (_, _, _, name, _, _, _, _, col_id, _) in cols:
            if col_ids is not None and col_id not in col_ids:
                continue
            h1, h2 = fingerprint_sql(name, df.schema[name].dataType)
            structs.append(f"named_struct('col_id', {col_id}, 'h1', {h1}, 'h2', {h2})")
        if structs:
            parts.append(long_form(df, structs).where(F.col("h1").isNotNull()))
    return _union_all(parts)


def distinct_counts(tables: Mapping[str, DataFrame], meta: Sequence[tuple]) -> DataFrame:
    """Exact distinct non-null count per column ``(col_id, distinct_count)``; one
    exchange for all tables, then a per-column count of the distinct groups."""
    fp = fingerprints(tables, meta)
    return (fp.groupBy("col_id", "h1", "h2").agg(F.lit(1).alias("_one"))
            .groupBy("col_id").agg(F.count(F.lit(1)).alias("distinct_count")))


def exact_column_sketches(tables: Mapping[str, DataFrame], meta: Sequence[tuple]) -> DataFrame:
    """Row count, nulls, exact distinct count, min/max order codes and a value sketch of every
    column of every table in ONE job: each table is unpivoted to
    ``(col_id, h1, h2, code)`` with nulls kept (their group counts the nulls),
    all tables are unioned into one scan stage, and two hash aggregations
    (map-side partial first) give
    ``(col_id, slot, freq, distinct_count, low, min_code, max_code)``: at most
    ``SKETCH_SLOTS`` slots of value hashes per column, each with the least hash in it
    (:mod:`colscope.operators.keys`), and a slot of nulls.
    """
    parts = []
    for t, cols in _meta_by_table(meta).items():
        df = tables[t]
        structs = []
        for (_, _, _, name, _, _, _, _, col_id, fam) in cols:
            h1, h2 = fingerprint_sql(name, df.schema[name].dataType)
            structs.append(f"named_struct('col_id', {col_id}, 'h1', {h1}, 'h2', {h2}, "
                           f"'code', {order_code_sql(name, fam, df.schema[name].dataType)})")
        if structs:
            parts.append(long_form(df, structs))
    groups = (_union_all(parts).groupBy("col_id", "h1", "h2")
              .agg(F.count(F.lit(1)).alias("freq"), F.min("code").alias("code")))
    slot = F.when(F.col("h1").isNotNull(), value_hash().bitwiseAND(SKETCH_SLOTS - 1))
    return groups.groupBy("col_id", slot.alias("slot")).agg(
        F.sum("freq").alias("freq"), F.count("h1").alias("distinct_count"), F.min(value_hash()).alias("low"),
        F.min("code").alias("min_code"), F.max("code").alias("max_code"))


def stats_of_sketches(sketches: DataFrame) -> DataFrame:
    """``(col_id, row_count, non_null, distinct_count, min_code, max_code)`` of every column."""
    return sketches.groupBy("col_id").agg(
        F.sum("freq").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("freq"))), F.lit(0)).alias("non_null"),
        F.sum("distinct_count").alias("distinct_count"),
        F.min("min_code").alias("min_code"), F.max("max_code").alias("max_code"))


def sample_values(tables: Mapping[str, DataFrame], meta: Sequence[tuple], limit: int = 10,
                  order_by: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(col_id, rank, value)``: per column the first ``limit`` distinct non-null
    canonical values, in row order of the first ``10*limit`` rows by the table's
    order (default: all orderable columns ascending, nulls first). The rows come by the
    filters of :mod:`colscope.operators.heads`: no table is sorted."""
    parts = []
    by_table = _meta_by_table(meta)
    orders = {t: list((order_by or {}).get(t) or [f.name for f in tables[t].schema.fields if _orderable(f.dataType)]) for t in by_table}
    first = head_filters({t: tables[t] for t in by_table if orders[t]}, orders, limit * 10)
    for t, cols in by_table.items():
        df = tables[t]
        keys = [F.col(_q(k)).asc_nulls_first() for k in orders[t]]
        # a few rows pass the filter: sorting them is cheap
        head = df.where(first[t]).orderBy(*keys).limit(limit * 10) if keys else df.limit(limit * 10)
        # at most 10*limit rows here: a single-partition window is fine
        w = Window.orderBy(*keys) if keys else Window.orderBy(F.monotonically_increasing_id())
        head = head.withColumn("__rn", F.row_number().over(w))
        structs = [f"named_struct('col_id', {col_id}, 'value', {canonical_text_sql(name, df.schema[name].dataType)})"
                   for (_, _, _, name, _, _, _, _, col_id, _) in cols]
        if structs:
            arr = "inline(array(" + ", ".join(structs) + "))"
            parts.append(head.selectExpr("__rn", arr).where(F.col("value").isNotNull()))
    if not parts:
        return None
    long = _union_all(parts)
    first = long.groupBy("col_id", "value").agg(F.min("__rn").alias("first_rn"))
    w = Window.partitionBy("col_id").orderBy("first_rn")
    return (first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("col_id", "rank", "value"))


def samples_as_arrays(samples_long: DataFrame) -> DataFrame:
    """``(col_id, sample_values array<string>)`` in rank order."""
    return samples_long.groupBy("col_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        .alias("sample_values"))


def enum_values(tables: Mapping[str, DataFrame], meta: Sequence[tuple], col_ids: set[int]) -> DataFrame:
    """``(col_id, value, frequency)`` for the given (low-cardinality) columns,
    reading only those columns."""
    parts = []
    for t, cols in _meta_by_table(meta).items():
        df = tables[t]
        structs = [f"named_struct('col_id', {col_id}, 'value', {canonical_text_sql(name, df.schema[name].dataType)})"
                   for (_, _, _, name, _, _, _, _, col_id, _) in cols if col_id in col_ids]
        if structs:
            parts.append(long_form(df, structs).where(F.col("value").isNotNull()))
    if not parts:
        return None
    return _union_all(parts).groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("frequency"))


def long_form(df: DataFrame, structs: list[Column] | list[str]) -> DataFrame:
    """Unpivot a list of same-typed struct expressions into rows of their fields.

    Built on ``DataFrame.unpivot`` (an Expand node, whole-stage codegen'd), which
    ran about twice as fast cold as ``inline(array(...))`` on lineitem."""
    base = dealt(df)
    if structs and isinstance(structs[0], str):
        wide = base.selectExpr(*[f"{s} AS __v{i}" for i, s in enumerate(structs)])
    else:
        wide = base.select(*[s.alias(f"__v{i}") for i, s in enumerate(structs)])
    return wide.unpivot([], [f"__v{i}" for i in range(len(structs))], "__k", "__v").select("__v.*")


def _union_all(parts: list[DataFrame]) -> DataFrame | None:
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Profile:
    """Result of :func:`profile_tables`. ``columns`` and ``tables`` follow the
    catalogue schemas; the rest are long-form DataFrames keyed by column."""

    database: str
    meta: DataFrame          # SCHEMA_COLUMNS
    stats: DataFrame         # per column: row_count, nulls, null_ratio, unique_count, ...
    samples: DataFrame | None  # (col_id, rank, value)
    enums: DataFrame | None    # (col_id, value, frequency)
    keys: DataFrame          # candidate keys (col_id ...)
    inclusions: DataFrame | None  # FK candidates
    columns: DataFrame       # catalog_columns
    tables: DataFrame        # catalog_tables
    inclusion_checks: DataFrame | None = None   # column pairs and whether sketches refuted them or all values were checked


def _unreadable(tables: Mapping[str, DataFrame]) -> dict[str, str]:
    """Tables that fail when all their columns are read (name -> error text); one job each."""
    bad = {}
    for name, df in tables.items():
        try:
            df.agg(*[F.count(df[f"`{c}`"]).alias(f"c{i}") for i, c in enumerate(df.columns)] or [F.count(F.lit(1)).alias("n")]).collect()
        except Exception as e:  # noqa: BLE001 - any read error counts
            bad[name] = (str(e).splitlines() or [type(e).__name__])[0][:300]
    return bad


def profile_tables(spark: SparkSession, tables: Mapping[str, DataFrame], database: str,
                   sample_limit: int = 10, enum_limit: int = 10, approx: bool = False,
                   order_by: Mapping[str, Sequence[str]] | None = None,
                   primary_keys: Mapping[str, Sequence[str]] | None = None,
                   foreign_keys: Sequence[tuple[str, str, str, str]] | None = None,
                   inclusions: bool = True, comments: Mapping[str, str] | None = None) -> Profile:
    """P10: profile all tables.

    Runs the stats pass (and the exact distinct pass unless ``approx``) and
    keeps their per-column results (one row per column) as a local DataFrame;
    samples, enum values and inclusion candidates stay lazy.
    Declared keys (``primary_keys``, ``foreign_keys`` as
    ``(table, column, ref_table, ref_column)``) set the catalogue flags; files
    declare none, so inferred candidates are reported separately. ``comments`` gives the tables'
    comments, e.g. :func:`colscope.sources.tables.catalog_comments`.
    """
    tables, failed = readable_tables(tables)
    for name, err in failed.items():      # a failing table is skipped, not fatal
        warnings.warn(f"profile: table {name} skipped: {err}", stacklevel=2)
    def stats_of(some: Mapping[str, DataFrame]) -> tuple[list[tuple], list, DataFrame | None]:
        rows = table_columns_meta(database, some)
        if not rows:
            return rows, [], None
        if approx:
            return rows, column_stats(some, rows, approx=True).collect(), None
        # at most SKETCH_SLOTS + 1 short rows a column, kept in the shared folder
        sketch = kept(exact_column_sketches(some, rows), "sketches")
        return rows, stats_of_sketches(sketch).collect(), sketch

    try:
        meta_rows, stats_rows, sketch = stats_of(tables)        # one job for all tables
    except (Py4JJavaError, CapturedException) as e:     # find the tables that cannot be read, go on with the rest
        if "OutOfMemory" in str(e) or "cancelled" in str(e):
            raise
        bad = _unreadable(tables)
        if not bad:
            raise
        for name, err in bad.items():
            warnings.warn(f"profile: table {name} skipped: {err}", stacklevel=2)
        tables = {t: df for t, df in tables.items() if t not in bad}
        meta_rows, stats_rows, sketch = stats_of(tables)
    meta_df = spark.createDataFrame(meta_rows, SCHEMA_COLUMNS)
    # empty tables give no group at all: their columns get zero counts
    seen = {r["col_id"] for r in stats_rows}
    stats_rows = [r.asDict() for r in stats_rows] + [
        {"col_id": m[8], "row_count": 0, "non_null": 0, "distinct_count": 0, "approx_distinct": 0,
         "min_code": None, "max_code": None} for m in meta_rows if m[8] not in seen]
    key = "approx_distinct" if approx else "distinct_count"
    nd: dict[int, int] = {r["col_id"]: r[key] for r in stats_rows}

    stat_list = []
    for r in stats_rows:
        n, nn = r["row_count"], r["non_null"]
        d = nd.get(r["col_id"], 0) or 0
        stat_list.append((r["col_id"], n, n - nn, nn, d if d > 0 else None,
                          bool(n > 0 and nn == n and d == n),
                          r["min_code"], r["max_code"]))
    stats_schema = T.StructType([
        T.StructField("col_id", T.IntegerType(), False),
        T.StructField("row_count", T.LongType(), True),
        T.StructField("nulls", T.LongType(), True),
        T.StructField("non_null", T.LongType(), True),
        T.StructField("unique_count", T.LongType(), True),
        T.StructField("is_candidate_key", T.BooleanType(), False),
        T.StructField("min_code", T.LongType(), True),
        T.StructField("max_code", T.LongType(), True),
    ])
    stats = spark.createDataFrame(stat_list, stats_schema).withColumn(
        "null_ratio", F.when(F.col("row_count") > 0,
                             F.round(F.col("nulls") / F.col("row_count"), 4)))

    samples = sample_values(tables, meta_rows, sample_limit, order_by) if meta_rows else None
    low_card = {c for c, d in nd.items() if d is not None and 0 < d <= enum_limit}
    enums = enum_values(tables, meta_rows, low_card) if low_card else None

    keys = stats.where("is_candidate_key").join(meta_df, "col_id")
    incl, checks = (inclusion_candidates(spark, lambda ids: fingerprints(tables, meta_rows, ids), meta_df, stats, sketch)
                    if inclusions else (None, None))

    columns = _catalog_columns(spark, meta_df, stats, samples, primary_keys, foreign_keys)
    tbl_rows = sorted({(r[0], r[1]) for r in meta_rows})
    row_count = {meta_rows_col[1]: None for meta_rows_col in meta_rows}
    by_id = {r[8]: r[1] for r in meta_rows}
    for r in stats_rows:
        row_count[by_id[r["col_id"]]] = r["row_count"]
    pk = primary_keys or {}
    catalog_tables = spark.createDataFrame(
        [(db, t, None, row_count.get(t), (comments or {}).get(t) or None, None, None, list(pk.get(t, []))) for db, t in tbl_rows],
        "database string, table string, schema string, row_count bigint, comment string, "
        "business_name string, description string, primary_keys array<string>")
    return Profile(database, meta_df, stats, samples, enums, keys, incl, columns, catalog_tables, checks)


def _catalog_columns(spark, meta_df, stats, samples, primary_keys, foreign_keys) -> DataFrame:
    pk_rows = [(t, c) for t, cs in (primary_keys or {}).items() for c in cs]
    fk_rows = [(t, c, f"{rt}.{rc}") for (t, c, rt, rc) in (foreign_keys or [])]
    pk = spark.createDataFrame(pk_rows, "table string, column string").withColumn("is_primary_key", F.lit(True))
    fk = spark.createDataFrame(fk_rows, "table string, column string, foreign_key_ref string")
    out = (meta_df.join(stats.select("col_id", "null_ratio", "unique_count"), "col_id", "left")
           .join(broadcast_if_small(pk, len(pk_rows), 1_000_000), ["table", "column"], "left")
           .join(broadcast_if_small(fk, len(fk_rows), 1_000_000), ["table", "column"], "left"))
    if samples is not None:
        out = out.join(samples_as_arrays(samples), "col_id", "left")
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("array<string>"))
    return out.select(
        "database", "table", "position", "column", "data_type", "nullable", "default",
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
        F.col("foreign_key_ref").isNotNull().alias("is_foreign_key"),
        "foreign_key_ref", "comment",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "null_ratio", "unique_count",
        F.lit(None).cast("string").alias("business_name"),
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("keywords"),
    )


def null_stats(tables: Mapping[str, DataFrame], meta: Sequence[tuple]) -> DataFrame:
    """P3/P5 alone: ``(col_id, row_count, nulls, null_ratio)`` from one single-row
    aggregate per table (``count(*)`` and ``count(c)``; no shuffle of values).
    The null ratio is rounded to 4 places and null for an empty table."""
    st = column_stats(tables, meta)
    return st.select("col_id", "row_count", (F.col("row_count") - F.col("non_null")).alias("nulls"),
                     F.when(F.col("row_count") > 0,
                            F.round((F.col("row_count") - F.col("non_null")) / F.col("row_count"), 4))
                     .alias("null_ratio"))


def composite_candidate_keys(spark: SparkSession, tables: Mapping[str, DataFrame], database: str, max_columns: int = 3,
                             **options) -> DataFrame:
    """Minimal keys of two or more columns, ``(table, columns)`` (:func:`keys.composite_keys`). Only
    columns of families that may be part of one are counted."""
    meta = [m for m in table_columns_meta(database, tables) if m[9] in options.get("families", FAMILIES)]
    got = {r["col_id"]: r for r in stats_of_sketches(exact_column_sketches(tables, meta)).collect()} if meta else {}
    columns = [(m[1], m[2], m[3], m[9], r["row_count"], r["non_null"], r["distinct_count"])
               for m in meta if (r := got.get(m[8])) is not None]
    return composite_keys(spark, tables, columns, long_form, max_columns, **options)
