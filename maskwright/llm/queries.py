"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import chat, decontam, fptree, langid, licenses, pieces, quality, resample, secrets, simhash, token_counts, toxicity, urls
from maskwright.llm.common import held_out, read_table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("toxic_spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(read_table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_tokens", "lossless", "token_ids")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    return chat.digest(chat.read_back(chat.format_conversations(rows.unionByName(extra))))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.campaign_urls(pages))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    said = langid.predict(docs, langid.train(docs))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.stored_ledger(read_table(spark, sf_dir, "documents"))
    base = F.expr(quality.RULES[0].fails) | F.expr(quality.RULES[1].fails)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits"]
    return rows.select("doc_id", *measures, F.lit(quality.CURRENT).alias("policy_version"), base.alias("base_failed"), quality.passes().alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, from one stored ledger."""
    rows = quality.stored_ledger(read_table(spark, sf_dir, "documents"))
    return reduce(DataFrame.unionByName, (quality.ablations(rows, version) for version in quality.POLICIES))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", token_counts.over_limit(F.col("n_tokens")).alias("over_limit"), "n_direct")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_simhash, op4_pieces, op5_chat, op6_urls, op7_decontamination, op8_language, op9_quality, op10_licenses, op11_search, op12_token_counts, op13_resample, quality_ablations)}
ORACLES = {
    "op5_chat": chat.oracle_sql(),
    "op6_urls": urls.ORACLE_SQL,
    "op7_decontamination": decontam.ORACLE_SQL,
    "op9_quality": quality.ORACLE_SQL,
    "op10_licenses": licenses.oracle_sql(),
    "op11_search": fptree.ORACLE_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
