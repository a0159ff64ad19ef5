"""Property checks: profile invariants hold on random frames."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)),
                          st.one_of(st.none(), st.sampled_from(["a", "b", "", "é"]))), min_size=0, max_size=40))
def test_profile_invariants(spark, rows):
    from colscope.operators.profile import profile_tables
    df = spark.createDataFrame(rows, "i int, s string")
    p = profile_tables(spark, {"t": df}, "db", sample_limit=3)
    n = len(rows)
    for r in p.columns.collect():
        vals = [x[r["position"] - 1] for x in rows]
        nn = [v for v in vals if v is not None]
        assert r["unique_count"] == (len(set(nn)) or None)
        assert (r["null_ratio"] is None) == (n == 0)
        if n:
            assert 0.0 <= r["null_ratio"] <= 1.0
            assert abs(r["null_ratio"] - round((n - len(nn)) / n, 4)) < 1e-12
        ordered = sorted(rows, key=lambda x: tuple((v is not None, v) for v in x))[:30]
        exp, seen = [], set()
        for x in ordered:
            v = x[r["position"] - 1]
            if v is not None and str(v) not in seen and len(exp) < 3:
                seen.add(str(v))
                exp.append(str(v))
        assert r["sample_values"] == exp
