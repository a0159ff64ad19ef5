"""Filter interaction audit by a Gray-code walk over all subsets of filters.

1. *Masks* (Spark). Every document gets a bit mask of the filters it fails. Filters A to D
   look at the text alone; E fails a document whose text also stands under a smaller id
   anywhere in the table: one aggregate on a digest of the text finds the least id of every
   text (map-side first, so a text that a third of all rows share leaves each task as one
   row), and a join on the id tells which documents are the first of their text.
2. *Cells.* Documents are counted by (part, mask): at most 32 cells a part, each with its
   documents, good ones and toxic ones.
3. *Walk* (one group of at most 32 rows per part). The subsets of the filters are visited in
   Gray-code order, so one filter is switched on or off at a time. Each cell keeps the number
   of its failing filters that are now active; a cell leaves the survivors when that counter
   leaves zero and joins them again when it is back. The survivors of all 32 subsets are stored.
4. *Steps.* What a filter removes at a step is the difference of two stored states; redundant,
   unique and Shapley figures are differences too. No document is looked at again for any of
   the 120 orders.

Defined results: a null text counts as empty; a null ``lang`` is the part ``""``, as an empty
one is; a row without id never fails E and has no labels; rows that repeat one id and text do
not fail E for each other; an id with several label rows is good (toxic) if one of them says
so; labels of unknown ids are ignored; an empty table has no parts, so no rows. Other columns
of either table are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.tables import written
from colscope.session import ship_package

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a non-null text, as booleans."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < 200,
            100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * capitals > 3 * F.length(text),
            text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: bit i of the mask is set for documents that fail the
    i-th filter of ``FILTERS``. At most 32 rows a part."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    mask = F.lit(0)
    for i, fails in enumerate(text_failures(F.col("text"))):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    # the texts end here: later steps move ids, masks and 16-byte digests; repeated rows are folded
    rows = (text.select("doc_id", "part", mask.alias("mask"), F.unhex(F.md5("text")).alias("digest"))
            .groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    rows = written(rows, "masks")
    known = rows.filter("doc_id is not null")
    first = (known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .groupBy("doc_id").agg(F.collect_list("digest").alias("first")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    last = 1 << FILTERS.index("E")
    known = (known.join(first, "doc_id", "left").join(marks, "doc_id", "left")
             .select("part", F.when(F.coalesce(F.array_contains("first", F.col("digest")), F.lit(False)), F.col("mask"))
                     .otherwise(F.col("mask") + last).alias("mask"), "n", "good", "toxic"))
    rest = rows.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return known.unionByName(rest).groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def survivors(mask: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Row s: the column sums of ``counts`` over cells without a filter of subset s in ``mask``.
    Subsets are visited in Gray-code order; each step switches one filter."""
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    active = np.zeros(len(mask), np.int64)      # per cell: its failing filters that are switched on
    running = counts.sum(0).astype(np.int64)
    subset = 0
    states[0] = running
    for i in range(1, 1 << filters):
        f = (i & -i).bit_length() - 1           # the bit in which code i differs from code i - 1
        has = (mask >> f) & 1 == 1
        if subset >> f & 1:
            active[has] -= 1
            running = running + counts[has & (active == 0)].sum(0)
        else:
            running = running - counts[has & (active == 0)].sum(0)
            active[has] += 1
        subset ^= 1 << f
        states[subset] = running
    return states


def steps(states: np.ndarray, filters: str = FILTERS) -> pd.DataFrame:
    """All orders' steps from the stored survivors (columns: documents, good, toxic)."""
    n = len(filters)
    everything = (1 << n) - 1
    kept = states[:, 0]
    fails = [int(kept[0] - kept[1 << f]) for f in range(n)]
    unique = [int(kept[everything & ~(1 << f)] - kept[everything]) for f in range(n)]
    # an order in which f comes right after the set s: |s|! ways before it, the rest after it
    shapley = [sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(kept[s] - kept[s | 1 << f])
                   for s in range(1 << n) if not s >> f & 1) for f in range(n)]
    rows = []
    for order in permutations(range(n)):
        name, before = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = states[before] - states[after]
            rows.append((name, step, int(kept[after]), int(gone[0]), fails[f] - int(gone[0]), unique[f],
                         int(gone[1]), int(gone[2]), shapley[f]))
            before = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Figures of every step of every order of the five filters, per part (``RESULT``)."""
    ship_package(docs.sparkSession)

    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        states = survivors(cells["mask"].to_numpy(np.int64), cells[["n", "good", "toxic"]].to_numpy(np.int64), len(FILTERS))
        out = steps(states)
        out.insert(0, "part", cells["part"].iloc[0])
        return out

    return mask_counts(docs, labels).groupBy("part").applyInPandas(walk, RESULT)


#: DuckDB text of the same rows: failure flags per document, then every order by plain counting.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part,
        len(ws) < 200 AS A,
        100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS C,
        regexp_matches(t, '[#$%&*|]') AS D,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E
      FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask,
        count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
c AS (SELECT i, chr(65 + i) AS name, 1 << i AS b FROM (SELECT unnest(range(5))::INT AS i)),
o AS (SELECT a.name || b.name || c3.name || d4.name || e5.name AS filter_order, [a.b, b.b, c3.b, d4.b, e5.b] AS bits
      FROM c a, c b, c c3, c d4, c e5 WHERE a.b + b.b + c3.b + d4.b + e5.b = 31
        AND len(list_distinct([a.i, b.i, c3.i, d4.i, e5.i])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit,
        coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
      FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
