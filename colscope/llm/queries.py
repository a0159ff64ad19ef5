"""Registered queries of the numbered operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from colscope.llm import (dac, decontaminate, filter_audit, imatch, language, neardup, packing, quality, secrets, shards, simhash,
                          urls, whitening)
from colscope.llm.tables import shared_path, table

TOKENIZER = "byte_bpe_50k.json"


def _id_remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict of every page's URL."""
    weights, bias = urls.fit(urls.LABELLED)
    return urls.judge(table(spark, sf_dir, "pages"), weights, bias).select("page_id", "host", "path", "rule", "verdict")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The model of op9, learned from labels whose id remainder modulo 3 is not 1."""
    labels = (table(spark, sf_dir, "labels").filter(_id_remainder(3) != 1)
              .select("doc_id", F.col("quality").alias("label")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality.fit(docs, labels)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(_id_remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item in runs of five words or more."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens; the digest columns come from the packed ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), window=1024, end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in directly addressable codes, written and read back."""
    path = shared_path(spark, "dac")
    dac.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return dac.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    rows = imatch.fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", imatch.fingerprint_text(F.col("signature")).alias("fingerprint"),
        imatch.fingerprint_text(F.col("edited_signature")).alias("edited_fingerprint"),
        imatch.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        imatch.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents whose id remainder modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_id_remainder(4) != 2))
    return language.predict(docs, model).select(
        "doc_id", F.coalesce(_id_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of the same mixture of sources."""
    return shards.shard(table(spark, sf_dir, "documents"), shards=8)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: bags of five-word shingles, similarity 0.8 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def secret_model(docs: DataFrame) -> secrets.Model:
    return secrets.fit(secrets.labelled_tokens(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every document; counts and the digest cover the fixed patterns' spans."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secret_model(docs))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document and the component of its links at two bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable embedding on the 32 leading components of all of them."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding", components=32)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of all 120 orders of the five filters, per language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_imatch": op4_imatch,
    "op5_language": op5_language,
    "op6_shards": op6_shards,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {"op6_shards": shards.ORACLE, "op8_url_filter": urls.oracle(),
                          "op13_filter_audit": filter_audit.ORACLE}
