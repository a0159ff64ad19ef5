"""Write PLANS.md: the formatted physical plans of the headline queries.

usage: python tools/explain_plans.py [sf_dir]
"""

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colscope.operators.profile import exact_column_sketches  # noqa: E402
from colscope.plans import fixtures as fx  # noqa: E402
from colscope.plans.registry import QUERIES  # noqa: E402
from colscope.session import local_session  # noqa: E402
from colscope.sources.tables import table_columns_meta  # noqa: E402

SHOW = {
    "profile stats pass (P3/P5/P6, all tables, one job)": None,
    "cosine_topk (V2 dense)": "cosine_topk",
    "score_fusion (V4-V6)": "score_fusion",
    "guard_summary (G1-G4)": "guard_summary",
    "inclusion_keys (P8)": "inclusion_keys",
    "pass_filter (G6 pass-through, pushdown)": "pass_filter",
}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{sf}` (local[8], AQE on; the final",
           "plan can change at run time).", ""]
    for title, name in SHOW.items():
        if name is None:
            t = fx.all_tables(spark, sf)
            df = exact_column_sketches(t, table_columns_meta("testdata", t))
        else:
            df = QUERIES[name](spark, sf)
        text = plan_text(df)
        lines = text.splitlines()
        if len(lines) > 120:
            lines = lines[:120] + ["... (cut)"]
        out += [f"## {title}", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
