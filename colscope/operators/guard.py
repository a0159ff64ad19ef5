"""Rule checks of SQL text, as column expressions over a SQL-log
DataFrame (JVM regex, whole-stage codegen, no Python UDF). A single statement is
checked by the same expressions on one row.

Verdict order: empty -> injection -> dangerous -> statement type -> valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import py_strip
from colscope.plans.sizing import dealt

# ---- fixed values: the rule patterns, matched in this order, case-insensitive ----
INJECTION_PATTERNS = [
    r";\s*(DROP|DELETE|UPDATE|INSERT)",
    r"--\s*$",
    r"/\*.*\*/",
    r"'\s*OR\s+'1'\s*=\s*'1",
    r"UNION\s+SELECT\s+NULL",
    r"WAITFOR\s+DELAY",
    r"BENCHMARK\s*\(",
]
DANGEROUS_PATTERNS = [
    r"\bDROP\s+(TABLE|DATABASE|INDEX)\b",
    r"\bTRUNCATE\s+TABLE\b",
    r"\bALTER\s+TABLE\b",
    r"\bCREATE\s+(TABLE|DATABASE|INDEX)\b",
    r"\bGRANT\b",
    r"\bREVOKE\b",
]
READ_TYPES = ["SELECT"]
WRITE_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE"]
# ---- end of fixed values ----

SYNTAX_ERROR = "syntax_error"
INJECTION = "injection_detected"
DANGEROUS = "dangerous_operation"
EXECUTION_ERROR = "execution_error"

DML_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE"]


def jvm_pattern(p: str) -> str:
    """Same rule for Java regex: case-insensitive with Unicode classes, and '.'
    never crosses a newline (as in Python)."""
    return "(?iU)" + p.replace(".*", "[^\\n]*")


def first_hit(sql: Column, patterns: list[str]) -> Column:
    """0-based index of the first matching pattern, null if none."""
    expr = F.lit(None).cast("int")
    for i in reversed(range(len(patterns))):
        expr = F.when(sql.rlike(jvm_pattern(patterns[i])), F.lit(i)).otherwise(expr)
    return expr


# string literals (doubled or backslash-escaped quotes), quoted names, line and block comments
QUOTED_OR_COMMENT = (r"""(?s)'[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'|"[^"]*+"|`[^`]*+`|--[^\n]*+|/\*.*?\*/""")


def code_only(sql: Column) -> Column:
    """The text with literals, quoted names and comments blanked, so that what stands in them
    neither ends a statement nor gives it a type."""
    return F.regexp_replace(sql, QUOTED_OR_COMMENT, " ")


def statement_types(sql: Column) -> Column:
    """G3 (our rule), on the text outside literals and comments: split on ';', drop
    blank parts; each part's type is its first word (skipping '('), upper-cased; for
    WITH, the first DML word right after a closing parenthesis; no word -> UNKNOWN."""
    parts = F.filter(F.split(code_only(sql), ";"), lambda p: py_strip(p) != "")

    def one(p: Column) -> Column:
        w = F.upper(F.regexp_extract(p, r"^[\s(]*([A-Za-z_]+)", 1))
        after_cte = F.upper(F.regexp_extract(p, r"(?i)\)\s*(" + "|".join(DML_WORDS) + r")\b", 1))
        t = F.when(w == "WITH", F.when(after_cte != "", after_cte).otherwise(F.lit("UNKNOWN"))).otherwise(w)
        return F.when(t == "", F.lit("UNKNOWN")).otherwise(t)

    # a text without any statement, such as a lone literal or comment, is of no known type
    return F.when((F.size(parts) == 0) & (py_strip(sql) != ""), F.array(F.lit("UNKNOWN"))).otherwise(F.transform(parts, one))


def audit(log: DataFrame, sql_col: str = "sql", allow_write: bool = False) -> DataFrame:
    """G4 over a SQL log: adds ``is_valid, error_type, rule, statement_type``.

    ``rule`` is the matching pattern (or ``statement:<TYPE>`` / ``empty``).
    Each rule family is evaluated once into its own column (separate
    projections), then the verdict is read off those columns."""
    sql = F.coalesce(F.col(sql_col), F.lit(""))
    allowed = WRITE_TYPES if allow_write else READ_TYPES
    base = (dealt(log)
            .withColumn("_empty", py_strip(sql) == "")
            .withColumn("_inj", first_hit(sql, INJECTION_PATTERNS))
            .withColumn("_dang", first_hit(sql, DANGEROUS_PATTERNS))
            .withColumn("_types", statement_types(sql)))
    bad_type = F.filter(F.col("_types"), lambda t: ~t.isin(*allowed))
    inj, dang, empty = F.col("_inj"), F.col("_dang"), F.col("_empty")
    inj_txt = F.element_at(F.array(*[F.lit(p) for p in INJECTION_PATTERNS]), inj + 1)
    dang_txt = F.element_at(F.array(*[F.lit(p) for p in DANGEROUS_PATTERNS]), dang + 1)
    base = base.withColumn("_bad", F.try_element_at(bad_type, F.lit(1)))
    bad = F.col("_bad")
    error_type = (F.when(empty, F.lit(SYNTAX_ERROR)).when(inj.isNotNull(), F.lit(INJECTION))
                  .when(dang.isNotNull(), F.lit(DANGEROUS)).when(bad.isNotNull(), F.lit(DANGEROUS)))
    rule = (F.when(empty, F.lit("empty")).when(inj.isNotNull(), inj_txt).when(dang.isNotNull(), dang_txt)
            .when(bad.isNotNull(), F.concat(F.lit("statement:"), bad)))
    return (base.withColumn("error_type", error_type).withColumn("rule", rule)
            .withColumn("is_valid", F.col("error_type").isNull())
            .withColumn("statement_type", F.when(~empty, F.array_join("_types", ",")))
            .drop("_empty", "_inj", "_dang", "_types", "_bad"))


def summary(audited: DataFrame) -> DataFrame:
    """Counts per verdict and rule."""
    return (audited.groupBy("is_valid", "error_type", "rule")
            .agg(F.count(F.lit(1)).alias("n")))


def validate(spark: SparkSession, sql: str | None, allow_write: bool = False) -> dict:
    """G4 for one text: the same column rules on a frame of one row."""
    one = spark.createDataFrame([(sql or "",)], "sql string")
    r = audit(one, allow_write=allow_write).first()
    text = (sql or "").strip() if r["is_valid"] else sql or ""
    return {"is_valid": r["is_valid"], "error_type": r["error_type"], "rule": r["rule"], "sql": text}
