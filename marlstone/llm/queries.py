"""The queries of the training-data operators, with production parameters over whole tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, lines, lm, mixing, oracles, rtree, simhash, spelling, suffix, tokens, toxicity, warc

from .common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2, blocks=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(_table(spark, sf_dir, "pages"), least_bytes=1000))
    return records.select(F.expr("try_cast(page_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), length=50, content=False)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tokens.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens.read_tokens(tokens.starts(index), ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("row.doc_id", "held_out", "lang_pred", "score")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), block=8, slots=1000, power=0.7)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.benchmark_matches(docs, _table(spark, sf_dir, "benchmark"), window=13)
    items = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), decontam.contaminated(20).alias("contaminated"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(_table(spark, sf_dir, "documents"), window=3)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_held_out(_table(spark, sf_dir, "documents").select("doc_id", "text"), order=2)
    return scored.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return rtree.hard_negatives(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, positives=5, negatives=3, low=50, high=95, label=label)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "held_out", "score", "predicted")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialise(spelling.corpus_words(_table(spark, sf_dir, "documents"), least=7, copies=2, drop_every=31), "words")
    return spelling.group_variants(words, ratio=10)


def queries() -> dict:
    operators = (op1_simhash, op2_warc, op3_suffix_dedup, op4_token_files, op5_language_id, op6_mix, op7_decontaminate, op8_line_dedup, op9_lm_score, op10_nearest, op11_hard_negatives, op12_toxicity, op13_spelling)
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
