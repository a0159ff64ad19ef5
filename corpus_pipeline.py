"""Corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame with the columns of ``documents`` (the last one: packed pieces). What it does in Python is
done in the stage, ``BATCH_ROWS`` texts at a time: the session's batches, were it left to the caller,
would not hold to that. A stage that drops rows writes their ids and leaves a join; texts are
written in the shared folder by the stage that changes them, token ids once, by packing.
Rows with a null text pass each stage as its operator defines; rows with a null or repeated id
are judged row by row, like the others; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm import decontaminate, neardup, packing, quality, queries, secrets
from colscope.llm.tables import BATCH_ROWS, remove, shared_path, small_or_shuffled, table, without_ids, written

TOKENIZER = "byte_bpe_50k.json"
#: What a worker may keep of the parts of text it has encoded: less than in op2, as the JVM beside it
#: has grown in the stages before.
PARTS_BYTES = 24 << 20
ENCODE_BYTES = 1 << 18      # of text for one call of the tokenizer, for the same reason


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name


def with_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of every row, and the key's column: its id where that is its alone, otherwise (a
    null or repeated id) a number of its own from 2^62 on, the hash of all its columns. Rows that
    are alike in every column share a key."""
    key, flag = _free(docs, "_key"), _free(docs, "_twice")
    twice = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(
        "doc_id", F.lit(True).alias(flag)), "repeated-ids")
    own = F.lit(1 << 62) + F.xxhash64(F.to_json(F.struct(*docs.columns))).bitwiseAND((1 << 60) - 1)
    if not twice.limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    flagged = docs.join(small_or_shuffled(twice.filter("doc_id is not null")), "doc_id", "left")
    return flagged.select(*docs.columns, F.when(F.col(flag) | F.col("doc_id").isNull(), own)
                          .otherwise(F.col("doc_id").cast("long")).alias(key)), key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (score of 0.5 or more)."""
    keyed, key = with_keys(docs)
    return quality.keep_good(keyed, queries.quality_model(spark, sf_dir), id_col=key).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, one document: the least id, or a row with a null or repeated
    id where the class has no other. Rows alike in every column are one."""
    keyed, key = with_keys(docs)
    classes = neardup.near_duplicates(keyed, id_col=key)
    left = without_ids(keyed, classes.filter(F.col(key) != F.col("class_id")), key)
    odd = left.filter(F.col(key) >= 1 << 62).dropDuplicates([key])
    return left.filter(F.col(key) < 1 << 62).unionByName(odd).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to half its words."""
    keyed, key = with_keys(docs)
    leaks = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return without_ids(keyed, leaks, key).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret replaced by a mark and ``n_chars`` of changed texts anew."""
    return written(secrets.redact(docs, queries.secret_model(docs)), "stage-secrets")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), window=1024, end_id=0,
                        cache_bytes=PARTS_BYTES, block_bytes=ENCODE_BYTES, batch_rows=BATCH_ROWS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


#: Stages that leave a join to run. What follows them reads its input many times.
DROPPING = ("quality", "near_duplicates", "decontamination")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``. The rows that a stage keeps are written for the next
    one and removed when the next one's own are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, run_stage in STAGES:
        docs, path = run_stage(spark, docs, sf_dir), None
        if name in DROPPING:
            path = shared_path(spark, f"stage-{name}")
            docs = written(docs, f"stage-{name}", path)
        if last:
            remove(spark, last)
        last = path
    return docs


QUERIES = {"pipeline": run}

#: Models, signatures and token ids are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None
ORACLE: dict[str, str] = {}
