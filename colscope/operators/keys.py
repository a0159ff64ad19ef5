"""Inclusion (foreign-key) candidates and composite keys.

*Inclusion.* Pairs of columns are cut down three times before a value is compared:

1. by the per-column figures (value family, distinct count, range of order codes), where
   columns meet by the binary blocks of their ranges, so that no join has a family alone as key;
2. by *sketches* that the stats job leaves behind: the values' hashes are dealt into
   ``SKETCH_SLOTS`` slots and the least hash of each slot is kept. If every value of A is one
   of B's, then no slot's least hash is smaller for A than for B, nor is a slot of B empty that A
   fills. A pair that breaks this is refuted - exactly: a true inclusion never is;
3. what is left reaches the full check, one semi-join on ``(key column, value)``.

*Composite keys* are found level by level over column sets. A set is not looked at if a
subset is a key already (its supersets are keys, but not minimal), or if the product of its
columns' distinct counts is below the row count. Of the others, one job counts the groups
of a hash sample of *values* (all rows of a sampled value are in, so two rows in one
group refute the set for certain), and only sets that pass it are counted over all values: first
by one 64-bit hash, and only the rows that share it, by both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.functions.text import _SEED2 as SEED2
from colscope.plans.sizing import broadcast_if_small
from colscope.sources.store import kept

SKETCH_SLOTS = 256
FAMILIES = ("integral", "date", "timestamp", "decimal")      # of columns that a composite key may have
INCLUSION = "fk_table string, fk_column string, key_table string, key_column string, fk_distinct bigint"


def value_hash() -> F.Column:
    """Hash of a value's identity ``(h1, h2)``: equal values of one family agree across columns."""
    return F.xxhash64("h1", "h2")


def refuted_pairs(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """``(fk_col_id, key_col_id)`` of the pairs that the sketches ``(col_id, slot, low)`` rule out. Nulls
    (rows without a slot) say nothing."""
    sketch = sketch.where("slot is not null")
    fk = sketch.select(F.col("col_id").alias("fk_col_id"), "slot", F.col("low").alias("fk_low"))
    key = sketch.select(F.col("col_id").alias("key_col_id"), "slot", F.col("low").alias("key_low"))
    return (pairs.select("fk_col_id", "key_col_id").join(fk, "fk_col_id").join(key, ["key_col_id", "slot"], "left")
            .where(F.col("key_low").isNull() | (F.col("fk_low") < F.col("key_low")))
            .select("fk_col_id", "key_col_id").distinct())


#: The smallest binary block ``(level, prefix)`` of the order codes that holds a column's whole range: the
#: codes that agree with its ends in all but the last ``level`` bits.
_LEVEL = ("CAST(CASE WHEN (min_code ^ max_code) < 0 THEN 64 WHEN min_code = max_code THEN 0 "
          "ELSE length(bin(min_code ^ max_code)) END AS INT)")
_PREFIX = "CASE WHEN level = 64 THEN 0L ELSE shiftright(min_code, level) END"


def column_pairs(meta: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs (A.x, B.y) that the per-column figures leave possible: B.y is a candidate key of A.x's
    value family, has at least as many distinct values, and its range covers A.x's.

    Columns meet by range, not by family alone: if B.y's range covers A.x's, then the block of
    B.y's range is A.x's or one of the at most 64 blocks around it, so A.x enters those."""
    m = (meta.select("col_id", "table", "column", "family").join(stats, "col_id")
         .where(F.col("family").isNotNull() & F.col("min_code").isNotNull()))
    m = m.withColumn("level", F.expr(_LEVEL)).withColumn("prefix", F.expr(_PREFIX))
    fk = m.where(F.col("unique_count") > 0).withColumn("level", F.explode(F.sequence(F.col("level"), F.lit(64))))
    fk = fk.withColumn("prefix", F.expr(_PREFIX)).alias("a")
    kk = m.where("is_candidate_key").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("family", "level", "prefix")]
    return (fk.join(kk, same[0] & same[1] & same[2] & (F.col("a.col_id") != F.col("b.col_id"))
                    & (F.col("a.unique_count") <= F.col("b.unique_count"))
                    & (F.col("a.min_code") >= F.col("b.min_code")) & (F.col("a.max_code") <= F.col("b.max_code")))
            .select(F.col("a.col_id").alias("fk_col_id"), F.col("b.col_id").alias("key_col_id"),
                    F.col("a.table").alias("fk_table"), F.col("a.column").alias("fk_column"),
                    F.col("b.table").alias("key_table"), F.col("b.column").alias("key_column"),
                    F.col("a.unique_count").alias("fk_distinct")))


def inclusion_candidates(spark: SparkSession, values, meta: DataFrame, stats: DataFrame, sketch: DataFrame | None = None,
                         max_broadcast_pairs: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Column A.x is an FK candidate of B.y when B.y is a candidate key of the same value
    family and every distinct value of A.x occurs in B.y.

    ``values(col_ids)`` gives the long form ``(col_id, h1, h2)`` of the named columns. Returns the
    candidates and, for every pair that the figures left possible, its ``state``: ``refuted`` (by
    the sketches) or ``checked`` (over all values)."""
    pairs = column_pairs(meta, stats)
    state = F.lit("checked")
    if sketch is not None:
        gone = refuted_pairs(pairs, sketch).withColumn("refuted", F.lit(True))
        pairs = pairs.join(gone, ["fk_col_id", "key_col_id"], "left")
        state = F.when(F.col("refuted"), "refuted").otherwise("checked")
    # a row per pair of columns, no data rows
    known = kept(pairs.select("fk_col_id", "key_col_id", "fk_table", "fk_column", "key_table", "key_column", "fk_distinct",
                              state.alias("state")), "column-pairs")
    report = known.drop("fk_col_id", "key_col_id", "fk_distinct")
    checked = known.where("state = 'checked'").drop("state")
    ids = checked.select(F.collect_set("fk_col_id").alias("f"), F.collect_set("key_col_id").alias("k"), F.count(F.lit(1)).alias("n")).first()
    if not ids["n"]:
        return spark.createDataFrame([], INCLUSION), report
    fk_vals = (values(set(ids["f"])).groupBy("col_id", "h1", "h2")
               .agg(F.lit(1).alias("_one")).withColumnRenamed("col_id", "fk_col_id"))
    key_vals = values(set(ids["k"])).select(F.col("col_id").alias("key_col_id"), "h1", "h2")
    small = broadcast_if_small(checked.select("fk_col_id", "key_col_id"), ids["n"], max_broadcast_pairs)
    expanded = fk_vals.join(small, "fk_col_id").select("fk_col_id", "key_col_id", "h1", "h2")
    matched = (expanded.join(key_vals, ["key_col_id", "h1", "h2"], "left_semi")
               .groupBy("fk_col_id", "key_col_id").agg(F.count(F.lit(1)).alias("matched")))
    found = (checked.join(matched, ["fk_col_id", "key_col_id"]).where(F.col("matched") == F.col("fk_distinct"))
             .select("fk_table", "fk_column", "key_table", "key_column", "fk_distinct"))
    return found, report


# ------------------------------------------------------------------ composite keys
def _group_rows(tables: Mapping[str, DataFrame], sets: Sequence[tuple[int, str, tuple[str, ...]]], one_in: int, long_form) -> DataFrame:
    """``(set_id, f1, f2)`` of every row of the sets' tables whose value hash f1 is one of ``one_in``."""
    parts = []
    for t in sorted({t for _, t, _ in sets}):
        structs = []
        for set_id, table, cols in sets:
            if table == t:
                names = ", ".join("`" + c.replace("`", "``") + "`" for c in cols)
                structs.append(f"named_struct('set_id', {set_id}, 'f1', xxhash64({names}), 'f2', xxhash64({SEED2}, {names}))")
        wide = tables[t].select(*sorted({c for _, table, cols in sets if table == t for c in cols}))
        parts.append(long_form(wide, structs).where(F.pmod("f1", F.lit(one_in)) == 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _set_ids(groups: DataFrame) -> set[int]:
    return {r[0] for r in groups.select("set_id").distinct().collect()}


def _not_unique(tables, sets, one_in: int, long_form, sets_per_job: int) -> set[int]:
    """Ids of the sets with two rows in one group; at most one number per set comes back."""
    bad: set[int] = set()
    for lo in range(0, len(sets), sets_per_job):
        some = sets[lo:lo + sets_per_job]
        if one_in > 1:
            groups = _group_rows(tables, some, one_in, long_form).groupBy("set_id", "f1", "f2").agg(F.count(F.lit(1)).alias("n"))
            bad |= _set_ids(groups.where("n > 1"))
            continue
        # Hardly any value comes twice here, as the sample has shown. Counting them where they are read
        # would hold, and spill, nearly every row: they are dealt as they are, by one hash, and sorted.
        same = Window.partitionBy("set_id", "f1").orderBy("f1")
        rows = _group_rows(tables, some, 1, long_form).select("set_id", "f1").repartition("set_id", "f1")
        twice = kept(rows.withColumn("n", F.row_number().over(same)).where("n = 2").select("set_id", "f1"), "shared-hashes")
        again = _set_ids(twice)
        if again:       # only the rows that share a hash are compared by both
            few = broadcast_if_small(twice, twice.count(), 1_000_000)
            rows = _group_rows(tables, [s for s in some if s[0] in again], 1, long_form).join(few, ["set_id", "f1"], "left_semi")
            bad |= _set_ids(rows.groupBy("set_id", "f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return bad


def composite_keys(spark: SparkSession, tables: Mapping[str, DataFrame], columns: Sequence[tuple], long_form,
                   max_columns: int = 3, families: Sequence[str] = FAMILIES,
                   sample_one_in: int = 64, sets_per_job: int = 256) -> DataFrame:
    """Minimal unique sets of two to ``max_columns`` columns: ``(table, columns array<string>)``.

    ``columns``: ``(table, position, column, family, row_count, non_null, distinct_count)`` of
    every column. Only columns of the given value families without a null take part, and no
    set that holds a column which is a key alone. Tables without rows have no key."""
    found: list[tuple[str, tuple[str, ...]]] = []
    usable: dict[str, list[tuple]] = {}
    for t, pos, name, family, rows, non_null, distinct in columns:
        # a constant column makes no set unique that is not unique without it
        if family in families and rows and non_null == rows and 1 < distinct < rows:
            usable.setdefault(t, []).append((pos, name, distinct, rows))
    for size in range(2, max_columns + 1):
        sets, names = [], {}
        for t, cols in sorted(usable.items()):
            for some in combinations(sorted(cols), size):
                if prod(c[2] for c in some) < some[0][3]:
                    continue
                chosen = tuple(c[1] for c in some)
                if any(k == t and set(v) <= set(chosen) for k, v in found):
                    continue
                names[len(sets)] = (t, chosen)
                sets.append((len(sets), t, chosen))
        for one_in in (sample_one_in, 1):
            bad = _not_unique(tables, sets, one_in, long_form, sets_per_job)
            sets = [s for s in sets if s[0] not in bad]
        found += [names[s[0]] for s in sets]
    return spark.createDataFrame([(t, list(cols)) for t, cols in found], "table string, columns array<string>")
