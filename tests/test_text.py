from pyspark.sql import functions as F

from colscope.functions.text import name_variants, py_strip, strip_code_fence, truncate_text


def test_name_variants_hangul_and_mixed(spark):
    df = spark.createDataFrame([("정상여부_YN_ab1",), ("order_total_amt",), ("x",)], "n string")
    out = {r["n"]: r["v"] for r in df.select("n", name_variants(F.col("n")).alias("v")).collect()}
    v = out["정상여부_YN_ab1"]
    assert "정상여부" in v and "yn" in v and "ab" in v and "YN" in v and "ab1" in v
    assert "정상여부YNab1" in v and "정상여부 YN ab1" in v
    assert v == sorted(set(v))
    assert set(out["order_total_amt"]) == {"order_total_amt", "ordertotalamt", "order total amt", "order",
                                           "total", "amt"}
    assert out["x"] == ["x"]


def test_fence_strip(spark):
    texts = ["```json\n{\"a\": 1}\n```", "  {\"a\": 1}  ", "```", "```json\n```", "", "plain\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strip_code_fence(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', "", "", "", "plain"]


def test_truncate_and_strip(spark):
    df = spark.createDataFrame([("a\nb  ",), ("x" * 100,), ("\t\n ",)], "t string")
    got = [r[0] for r in df.select(truncate_text(F.col("t"), 10)).collect()]
    assert got == ["a b", "x" * 7 + "...", ""]
    got2 = [r[0] for r in df.select(py_strip(F.col("t"))).collect()]
    assert got2[2] == ""
