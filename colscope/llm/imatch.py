"""Document fingerprints by I-Match (DataFrame functions only).

1. *Lexicon.* Terms are lower-cased runs of letters and digits, kept as 64-bit hashes. The
   lexicon holds the terms whose share of documents lies between ``low`` and ``high``, a band
   of inverse document frequencies. Every term in it is in at least ``low`` of all documents,
   so it has at most (mean distinct terms of a document) / ``low`` entries, whatever the
   corpus: that bounds its broadcast (the size is checked all the same).
2. *Fingerprint.* The distinct terms of a text that are in the lexicon are hashed as a whole
   and within randomised subsets of the lexicon (the exclusive or of the terms' hashes: what
   hashing them in sorted order gives, a value of the set alone, without the sort): at each of
   four rates (1/8 to 1/512) bits of the term pick one of up to 32 disjoint subsets, or none.
   A text of few terms is told by the large subsets, a long one by the small ones.
3. *Likeness* of two fingerprints: 1 if the whole hashes agree; otherwise the largest share,
   over the rates, of agreeing subsets among those that hold a term of either text (rates
   with fewer than ``LEAST`` such subsets are counted together).

Defined results: a text without lexicon terms has only the hash of the text itself, so equal
texts agree and others do not; null text counts as empty; documents are ordered by id (null
first), then by a hash of the text; the one document of a table is its own successor; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.tables import small_or_shuffled, written

LOW, HIGH = 1 / 2000, 1 / 4
RATES = ((3, 8), (5, 32), (7, 32), (9, 32))      # bits of the rate, subsets used
LEAST = 4


def distinct_terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term) of the band: in at least two documents, and in ``low`` to ``high`` of all."""
    n = texts.count()
    df = texts.select(F.explode(distinct_terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.filter((F.col("df") >= max(2, low * n)) & (F.col("df") <= high * n)).select("term")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, text) with ``bucket``, ``ghost`` and ``next_text``. Buckets are ranges of
    ids that start at ids of the table. The first row of each bucket is also a ghost at the
    end of the bucket before (of the first one: in the last), so the successor of a bucket's
    last row stands next to it; ghosts are to be dropped after use."""
    cuts = docs.agg(F.min("doc_id").alias("lo"), F.percentile_approx(
        "doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("cuts")).first()
    bounds = sorted({cuts["lo"], *cuts["cuts"]}) if cuts["lo"] is not None else []
    if not bounds:
        bucket, head = F.lit(0), F.lit(True)
    else:
        at = F.array(*[F.lit(x).cast("long") for x in bounds])
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when(
            (p + s <= len(bounds)) & (F.try_element_at(at, p + s) <= F.col("doc_id")), p + s).otherwise(p))
        bucket = F.coalesce(F.greatest(found - 1, F.lit(0)), F.lit(0))
        head = F.coalesce(F.array_contains(at, F.col("doc_id")), F.lit(True))
    rows = docs.withColumn("bucket", bucket).withColumn("tie", F.xxhash64("text"))
    last = max(len(bounds) - 1, 0)
    ghost = F.struct(F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("ghost"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    rows = rows.select("doc_id", "text", "tie", F.explode(F.when(head, F.array(own, ghost)).otherwise(F.array(own))).alias("b"))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "tie")
    return rows.select("doc_id", "text", "tie", "b.*").withColumn("next_text", F.lead("text").over(order))


def _memberships(term: Column) -> Column:
    """(rate, part) of a term: (0, 0) for the whole lexicon, and at each rate the part of the
    lexicon that bits of its own fall into. Of a rate's parts the first ``used`` are subsets."""
    out, shift = [F.struct(F.lit(0).alias("rate"), F.lit(0).cast("long").alias("part"), F.lit(1).alias("used"))], 0
    for rate, (bits, used) in enumerate(RATES, 1):
        part = F.shiftrightunsigned(term, shift).bitwiseAND((1 << bits) - 1)
        out.append(F.struct(F.lit(rate).alias("rate"), part.alias("part"), F.lit(used).alias("used")))
        shift += bits
    return F.array(*out)


def fingerprint_text(sig: Column) -> Column:
    """A signature as text: the whole hash, a colon, the subsets' marks in order."""
    return F.concat(F.lpad(F.lower(F.hex(sig["whole"])), 16, "0"), F.lit(":"),
                    F.array_join(F.transform(sig["marks"], lambda x: F.lower(F.hex(x))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two signatures, 0 to 1 (module text)."""
    alike, held = [], []
    for rate in range(1, len(RATES) + 1):
        x, y = (F.filter(s["marks"], lambda m: F.shiftright(m, 40) == rate) for s in (a, b))
        px, py = (F.transform(z, lambda m: F.shiftright(m, 32)) for z in (x, y))
        alike.append(F.size(F.array_intersect(x, y)))
        held.append(F.size(x) + F.size(y) - F.size(F.array_intersect(px, py)))
    total = lambda xs: sum(xs[1:], xs[0])
    shares = [F.when(h >= LEAST, s / h) for s, h in zip(alike, held)]
    pooled = F.when(total(held) > 0, total(alike) / total(held)).otherwise(F.lit(0.0))
    return F.when(a["whole"] == b["whole"], F.lit(1.0)).otherwise(F.coalesce(F.greatest(*shares), pooled))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH,
                 buckets: int | None = None) -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256 (of the text whose second half is the next
    document's start), signature, edited_signature, next_signature."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the lexicon's hashes, and 0 for the carrying rows below
    known = lexicon(docs, "text", low, high).union(spark.range(1).select(F.lit(0).cast("long"))).distinct()
    known = small_or_shuffled(written(known, "lexicon"), 24)
    rows = with_next(docs, buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (rows.withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"),
                                           F.coalesce(F.left("next_text", half), F.lit(""))))
            .withColumn("row", F.monotonically_increasing_id()))
    # One narrow row of numbers per distinct term of either text (side 0, 1), and a few that
    # carry the rest of the row (side 2, a value each). Terms beyond the lexicon end at the join.
    sha = F.sha2("edited", 256)
    rest = [F.col("ghost").cast("long"), F.col("doc_id"), F.col("tie"), F.col("n_chars"), F.xxhash64("edited"),
            *[F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]]
    side = lambda c, k: F.transform(distinct_terms(F.col(c)), lambda t: F.struct(
        F.lit(k).alias("side"), t.alias("term"), F.lit(0).alias("slot"), F.lit(None).cast("long").alias("value")))
    carry = F.array(*[F.struct(F.lit(2).alias("side"), F.lit(0).cast("long").alias("term"), F.lit(i).alias("slot"), v.alias("value"))
                      for i, v in enumerate(rest)])
    terms = rows.select("bucket", "row", F.explode(F.concat(carry, side("text", 0), side("edited", 1))).alias("t"))
    terms = terms.select("bucket", "row", "t.*").join(known, "term")
    # Hash of the set of terms in each subset: of distinct terms, in whatever order they come. The rows
    # of a bucket are still together, so neither aggregate needs an exchange.
    member = terms.select("bucket", "row", "side", "term", "slot", "value", F.explode(_memberships(F.col("term"))).alias("m"))
    member = member.select("bucket", "row", "side", F.col("m.rate").alias("rate"), F.when(F.col("side") == 2, F.col("slot")).otherwise(
        F.col("m.part")).alias("part"), F.when(F.col("side") == 2, F.col("value")).otherwise(F.xxhash64("term", "m.rate")).alias("hash"),
        F.col("m.used").alias("used")).filter("(side = 2 and rate = 0) or (side < 2 and part < used)")
    hashes = member.groupBy("bucket", "row", "side", "rate", "part").agg(F.bit_xor("hash").alias("hash"))
    mark = (F.shiftleft(F.col("rate").cast("long"), 40) + F.shiftleft(F.col("part").cast("long"), 32)
            + F.col("hash").bitwiseAND(0xFFFFFFFF))
    marks = lambda k: F.array_sort(F.collect_list(F.when((F.col("side") == k) & (F.col("rate") > 0), mark)))
    whole = lambda k: F.max(F.when((F.col("side") == k) & (F.col("rate") == 0), F.col("hash")))
    names = ["ghost", "doc_id", "tie", "n_chars", "edited_hash", "s0", "s1", "s2", "s3"]
    sets = hashes.groupBy("bucket", "row").agg(
        marks(0).alias("m0"), marks(1).alias("m1"), whole(0).alias("w0"), whole(1).alias("w1"),
        *[F.max(F.when((F.col("side") == 2) & (F.col("part") == i), F.col("hash"))).alias(n) for i, n in enumerate(names)])
    signed = sets.select(
        "bucket", "ghost", "doc_id", "tie", "n_chars",
        F.concat(*[F.lpad(F.lower(F.hex(f"s{i}")), 16, "0") for i in range(4)]).alias("edited_sha256"),
        F.struct(F.coalesce("w0", "tie").alias("whole"), F.col("m0").alias("marks")).alias("signature"),
        F.struct(F.coalesce("w1", "edited_hash").alias("whole"), F.col("m1").alias("marks")).alias("edited_signature"))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "tie")
    return (signed.withColumn("next_signature", F.lead("signature").over(order)).filter("ghost = 0")
            .select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "signature", "edited_signature", "next_signature"))
