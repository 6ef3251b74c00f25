"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuemill.llm import (
    alignment, decontaminate, lines, neardup, oracles, packing, ppm, pretokens, quality, repair, repeats, secrets, substrings, wavelet,
)
from venuemill.session import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeated_windows(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def references_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Language references from the documents that ``labels`` calls good and not toxic."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0")
    return quality.language_references(docs, good.select("doc_id"))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality_rules(docs, references_of(spark, docs, sf_dir))


def op3_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.find_contamination(documents(spark, sf_dir), benchmark)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = secrets.findings_of_paths(docs, secrets.scan_unseen(docs))
    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.KINDS[:3]))

    def spans(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *[count(k) for k in secrets.KINDS[:3]], F.sha2(spans(base), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
    )


def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op6_earlier_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_earlier_strings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_common_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(documents(spark, sf_dir))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pretokens.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    wavelet.write_shards(documents(spark, sf_dir), folder, vocabulary("word_bpe_49k.json"))
    return wavelet.read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = repair.repair_conversations(repair.damaged(rows))
    found = made.summary.withColumnRenamed("conv_id", "s")
    texts = repair.digests(made.messages).withColumnRenamed("conv_id", "t")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("s")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("t")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


QUERIES = {
    "op1_repeated_windows": (op1_repeated_windows, oracles.REPEATED_WINDOWS),
    "op2_quality_divergence": (op2_quality_divergence, None),
    "op3_benchmark_hits": (op3_benchmark_hits, oracles.BENCHMARK_HITS),
    "op4_secret_ledger": (op4_secret_ledger, None),
    "op5_packed_sequences": (op5_packed_sequences, None),
    "op6_earlier_strings": (op6_earlier_strings, None),
    "op7_ppm_scores": (op7_ppm_scores, None),
    "op8_common_lines": (op8_common_lines, oracles.COMMON_LINES),
    "op9_near_duplicates": (op9_near_duplicates, oracles.NEAR_DUPLICATES),
    "op10_token_counts": (op10_token_counts, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_wavelet_shards": (op12_wavelet_shards, None),
    "op13_conversation_repair": (op13_conversation_repair, None),
}
