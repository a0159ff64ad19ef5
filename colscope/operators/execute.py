"""Dry run, guarded read-only execution with a bounded preview, and a
parts-versus-totals check.

``run_sql`` returns a lazy DataFrame: nothing is fetched; ``preview`` reads at
most ``max_rows`` rows (``limit``), and the row count is a separate aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import py_strip, truncate_text
from colscope.operators.guard import EXECUTION_ERROR, audit, validate
from colscope.plans.sizing import checked_broadcast
from colscope.session import ensure_checkpoint_dir

ERROR_LIMIT = 300
PREVIEW_ROWS = 20
CELL_LIMIT = 80
DRY_RUN_BATCH = 2000     # texts that the driver holds at a time


@dataclass
class Outcome:
    verdict: dict
    df: DataFrame | None = None
    error: str | None = None


def _cut(msg: str, limit: int = ERROR_LIMIT) -> str:
    t = str(msg).replace("\n", " ").strip()
    return t if len(t) <= limit else t[: limit - 3] + "..."


def dry_run(spark: SparkSession, sql: str) -> Outcome:
    """Validate, then parse and analyse without running (``spark.sql`` on a
    query is lazy but analysed eagerly; errors surface here)."""
    v = validate(spark, sql)
    return _analysed(spark, v) if v["is_valid"] else Outcome(v)


def _analysed(spark: SparkSession, v: dict) -> Outcome:
    try:
        df = spark.sql(v["sql"])
    except PySparkException as e:  # parse or analysis error
        return Outcome({**v, "is_valid": False, "error_type": EXECUTION_ERROR}, error=_cut(e))
    return Outcome(v, df)


# Texts in which a value may decide more than the forms below allow for: backslashes, variables,
# hints, options, named arguments, constants on the left of a comparison, comments within
# comments, columns named after values. They are dry-run one by one.
_ODD = (r"(?i)\\|[\u0001\u0002]|\$\{|/\*\+|/\*(?:(?!\*/)[\s\S])*/\*|\bWITH\s*\(|=>|->|"
        r"\bTRUE\b|\bFALSE\b|\bNULL\b|\bCURRENT_|\bLOCALTIME|USER\b|PIVOT\b")
_STRING = r"'[^']*+(?:''[^']*+)*+'"
_QUOTED = _STRING + r"""|"[^"]*+(?:""[^"]*+)*+"|`[^`]*+(?:``[^`]*+)*+`"""
_COMMENT = r"--[^\r\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/"
_INT = r"[1-9][0-9]{0,8}"
_END = r"(?=[\s);,]|$)"
# what a value may be compared with: a name, plain or in back quotes
_OPERATOR = r"([A-Za-z_]\w*+\s*+(?:<=|>=|<>|!=|==|[=<>])\s*+|(?<=`)\s*+(?:<=|>=|<>|!=|==|[=<>])\s*+)"


def _values(value: str) -> str:
    """Values of one kind that a name is compared with: one, a range, or a list. Two groups are
    kept: what stands before the value and, of a list, its closing bracket."""
    return (rf"{_OPERATOR}{value}{_END}|(\bBETWEEN\s++){value}\s++AND\s++{value}{_END}"
            rf"|(\bIN\s*+\(\s*+){value}(?:\s*+,\s*+{value})*+(?=\s*+\))")


# one row may be a limit that a correlated subquery needs; other counts are alike
_LIMIT = rf"(\b(?:LIMIT|OFFSET)\s++)(?:[2-9]|[1-9][0-9]{{1,8}}){_END}"
_COMPARED = r"([A-Za-z_]\w*+\s*+(?:<=|>=|<>|!=|==|[=<>])\s*+)" + _INT + _END
# in texts without BY: an int that is an item of a select list, also added to a column, or an
# int or string that is such an item with a name of its own
_ITEM = (r"(\bSELECT\s+(?:[A-Za-z_]\w*+\s*+\+\s*+)?)" + _INT + r"(?=\s*(?:;|$)|\s+(?:AS|FROM)\b)"
         r"|(\bSELECT\s+)" + _STRING + r"(?=\s+AS\b)|(,\s*+)" + _INT + r"(?=\s+AS\b)")
# a string where only a name may stand: never accepted, whatever it holds
_MISPLACED = r"(\bAS\s+)\"[^\"]*+(?:\"\"[^\"]*+)*+\""
# a quoted name that may be one the analyser makes up from an expression, as `(a = 5)`
_MADE_NAME = r"""`(?![A-Za-z_]\w*+`)[^`]*+`|"(?![A-Za-z_]\w*+")[^"]*+\""""


def _blanked(text: Column, mark: str, *patterns: str) -> Column:
    """``text`` with ``mark`` for what the patterns match beyond their groups, and after every quoted
    text, which is passed over as a whole."""
    pattern = "|".join([*patterns, f"({_QUOTED})"])
    groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    return F.regexp_replace(text, f"(?i){pattern}", "".join(f"${i}" for i in range(1, groups + 1)) + mark)


def _equal(text: Column, pattern: str) -> Column:
    """Lengths of all numbers that ``pattern`` finds and which of its matches are equal."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    length = lambda x: F.when(x.startswith("'"), "s").otherwise(F.length(x).cast("string"))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", length(x), F.array_position(found, x).cast("string"))), " ")


def _form(sql: Column, quoted_names: bool = False) -> Column:
    """A text's own form: the analyser accepts all texts of one form or none of them.

    Comments and the values that the analyser does not look at are blanked: ints and strings (each
    kind by a mark of its own) that a name is compared with, also as a range or a list of any
    length, and row limits. It does compare the expressions of a text (GROUP BY, ORDER BY) and
    derive decimal widths and names from numbers, so the form keeps, for texts with BY, which
    values are equal, and the length of every number that is left. A text that uses a made-up name
    keeps all its strings. ``quoted_names``: text in double quotes is a name."""
    misplaced = r"(\b\B)" if quoted_names else _MISPLACED
    text = F.regexp_replace(sql, f"({_QUOTED})|{_COMMENT}", "$1 ")
    by, made = text.rlike(r"(?i)\bBY\b"), text.rlike(_MADE_NAME)
    ints, strings = _values(_INT), _values(_STRING + "\u0001?")
    with_by = _blanked(_blanked(text, "\u0001", misplaced, ints, _LIMIT), "\u0002", strings)
    free = _blanked(_blanked(text, "\u0001", misplaced, ints, _LIMIT, _ITEM), "\u0002", strings)
    kept = F.when(by, _blanked(text, "\u0001", misplaced, _COMPARED)).otherwise(_blanked(text, "\u0001", misplaced, _COMPARED, _ITEM))
    form = (F.when(made, F.concat_ws("\n", kept, _equal(text, "[0-9]+")))
            .when(by, F.concat_ws("\n", with_by, _equal(text, f"{_STRING}|[0-9]+")))
            .otherwise(F.concat_ws("\n", free, _equal(free, "[0-9]+"))))
    return F.when(sql.rlike(_ODD), F.concat(F.lit("\u0001"), sql)).otherwise(form)


def dry_run_log(log: DataFrame, sql_col: str = "sql") -> DataFrame:
    """G5 for a whole SQL log: adds ``is_valid, error_type`` to every row.

    The rules (G4) are applied in Spark. Of the texts that they accept, one for each distinct
    form is analysed on the driver, ``DRY_RUN_BATCH`` at a time, and its state joined back."""
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    names = all(spark.conf.get(c) == "true" for c in ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers"))
    ruled = audit(log, sql_col).drop("rule", "statement_type").withColumn(
        "_form", F.when(F.col("is_valid"), _form(py_strip(F.col(sql_col)), names)))
    forms = ruled.filter("is_valid").groupBy(F.col("_form")).agg(F.min(py_strip(F.col(sql_col))).alias("sql"))
    schema, states, batch = "_form string, _ok boolean", [], []

    def keep() -> None:
        states.append(spark.createDataFrame(batch, schema).checkpoint())
        batch.clear()

    for r in forms.toLocalIterator():
        batch.append((r["_form"], _analysed(spark, {"is_valid": True, "sql": r["sql"]}).df is not None))
        if len(batch) == DRY_RUN_BATCH:
            keep()
    if batch or not states:
        keep()
    state = states[0]
    for s in states[1:]:
        state = state.union(s)
    refused = F.col("is_valid") & ~F.coalesce("_ok", F.lit(False))
    return (ruled.join(checked_broadcast(state, 50_000)[0], "_form", "left")
            .withColumn("error_type", F.when(refused, F.lit(EXECUTION_ERROR)).otherwise(F.col("error_type")))
            .withColumn("is_valid", F.col("is_valid") & ~refused).drop("_form", "_ok"))


def run_sql(spark: SparkSession, sql: str) -> Outcome:
    """Guarded execution. Only texts whose statements are all SELECT reach
    Spark, so no command can run; the result stays a lazy DataFrame."""
    return dry_run(spark, sql)


def preview(df: DataFrame, max_rows: int = PREVIEW_ROWS, width: int = CELL_LIMIT) -> DataFrame:
    """G6 preview: at most ``max_rows`` rows, every cell as text (newline ->
    space, trimmed, cut to ``width`` with '...'; null -> 'None')."""
    cells = [truncate_text(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")), width).alias(c)
             for c in df.columns]
    return df.limit(max_rows).select(*cells)


def result_note(df: DataFrame, max_rows: int = PREVIEW_ROWS) -> str:
    """Row count line and the 'N more' / empty notes (one count action)."""
    n = df.count()
    if n == 0:
        return "rows: 0\nno rows returned."
    more = f"\n... {n - max_rows} more rows not shown" if n > max_rows else ""
    return f"rows: {n}{more}"


def reconcile(df: DataFrame, keys: list[str], measure: str, tolerance: float | Decimal = 0) -> DataFrame:
    """Do the parts add up to the totals?

    The rows are summed once to the finest level, all coarser levels come from that (``rollup``),
    and every sum then counts twice: as the total of its own group and as a part of the group
    one level up. One aggregate on (level, leading keys) brings both together, so the detail rows
    are read once and nothing is joined. Null keys group together. Returns one row per parent:
    ``level, <keys>, total, parts_sum, diff, ok``."""
    n = len(keys)
    finest = df.groupBy(*keys).agg(F.sum(measure).alias("_sum"))
    sums = finest.rollup(*keys).agg(F.sum("_sum").alias("_sum"), (n - F.bit_count(F.grouping_id())).cast("int").alias("_level"))
    none = F.lit(None).cast(sums.schema["_sum"].dataType)

    def role(level: Column, total: Column, part: Column) -> Column:
        masked = [F.when(level > i, F.col(k)).alias(k) for i, k in enumerate(keys)]
        return F.struct(level.alias("level"), *masked, total.alias("_t"), part.alias("_p"))

    both = sums.select(F.explode(F.array(role(F.col("_level"), F.col("_sum"), none),
                                         role(F.col("_level") - 1, none, F.col("_sum")))).alias("_r")).select("_r.*")
    out = (both.where((F.col("level") >= 0) & (F.col("level") < n)).groupBy("level", *keys)
           .agg(F.sum("_t").alias("total"), F.sum("_p").alias("parts_sum")))
    diff = F.coalesce(F.col("total"), F.lit(0)) - F.coalesce(F.col("parts_sum"), F.lit(0))
    return out.withColumn("diff", diff).withColumn("ok", F.abs(F.col("diff")) <= F.lit(tolerance))


def reconcile_claims(df: DataFrame, keys: list[str], measure: str, claims: DataFrame,
                     tolerance: float | Decimal = 0) -> DataFrame:
    """G7 against stated figures: ``claims`` holds ``level`` (how many leading
    keys the figure is grouped by, 0 = grand total), those keys and a
    ``claimed`` value, e.g. the totals an answer reports. Each claim is
    compared with the sum of the detail rows of its group (null keys match
    null keys). Returns the claims with ``actual``, ``diff`` and ``ok``; a
    claim whose group has no rows gets a null ``actual`` and ``ok`` false."""
    gid = "_gid"
    n = len(keys)
    finest = df.groupBy(*keys).agg(F.sum(measure).alias("_sum"))
    r = (finest.rollup(*keys).agg(F.sum("_sum").alias("actual"), F.grouping_id().alias(gid))
         .withColumn("level", F.lit(n) - F.bit_count(F.col(gid)).cast("int")))
    # only prefix levels (first i keys grouped) are meaningful claims
    prefix_gids = [(1 << (n - i)) - 1 for i in range(n + 1)]
    r = r.where(F.col(gid).isin(*prefix_gids))
    # keys beyond a claim's level are rolled up (null) on the rollup side, so
    # the claim's are masked to null too; every key is then a null-safe
    # equi-join key and the join hash-partitions on all of them
    masked = claims.select("*", *[F.when(F.col("level") > i, F.col(k)).alias(f"_m{i}") for i, k in enumerate(keys)])
    c, a = masked.alias("c"), r.alias("a")
    cond = F.col("c.level") == F.col("a.level")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"c._m{i}").eqNullSafe(F.col(f"a.{k}"))
    out = c.join(a, cond, "left").select(*[F.col(f"c.{x}") for x in claims.columns], F.col("a.actual"))
    diff = F.col("claimed") - F.col("actual")
    return (out.withColumn("diff", diff)
            .withColumn("ok", F.coalesce(F.abs(diff) <= F.lit(tolerance), F.lit(False))))
