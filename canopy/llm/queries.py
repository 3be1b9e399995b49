"""The queries op1 to op13: each applies its operator to its whole table and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, divergence, html, langid, lexical, linededup, ngram, packing, pii, sharding, simhash, toxicity
from .common import fold, materialize, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_on(docs.filter(fold("doc_id", 4) != 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove(read(spark, sf_dir, "documents"), min_sites=10).select("doc_id", "text", "n_lines", "n_removed")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_tokenizer(), capacity=2048)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), threshold=0.8, n=5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_on(docs, labels.filter(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_windows", "worst")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = ngram.vocabulary(docs.filter(fold("doc_id", 5) != 1))
    numbered = materialize(ngram.number(docs, words), "lm-numbers")
    model = ngram.grow(numbered.filter(fold("doc_id", 5) != 1), words, order=3, least=1)
    out = ngram.score_numbers(numbered, model)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), n=3, limit=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least_docs=30, smooth=5, most=50)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.place(read(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": linededup.ORACLE, "op6_benchmark_decontamination": decontamination.ORACLE, "op11_lexical_search": lexical.ORACLE,
        "op12_source_divergence": divergence.ORACLE, "op13_sharding": sharding.ORACLE,
    }
