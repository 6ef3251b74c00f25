"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept.  All but the last
return the columns of ``documents``; texts that a stage shortens get their new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuemill.llm import decontaminate, lines, neardup, packing, quality
from venuemill.llm.queries_llm import references_of, vocabulary
from venuemill.llm.store import stored


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of the struct ``rest``, with the text in column ``text`` where the old one was not null."""
    new = F.when(F.col("rest.text").isNotNull(), F.col(text))
    same = F.col("rest.text") == F.col(text)
    replaced = {"text": new, "n_chars": F.when(same | new.isNull(), F.col("rest.n_chars")).otherwise(F.length(new).cast("long"))}
    return docs.select(*[replaced.get(c, F.col(f"rest.`{c}`")).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null, empty and short texts among them.  Each repeated row is judged by itself; no rows give none."""
    return quality.rejected_rows_removed(docs, references_of(spark, docs, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least five documents stay in one of them.  A null text stays null; ids and other columns are as they were."""
    return _with_text(lines.remove_common_lines(docs, rest=True), docs.columns, "kept_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id.

    Rows that share an id stay or go together; rows without an id, and texts without words, stay."""
    return neardup.keep_one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; documents that are mostly such passages go whole.

    Null and empty texts stay as they are; each repeated row is treated alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.remove_contamination(docs, benchmark)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens; a null or empty text is one piece of the end id, repeated rows are packed each.

    Workers that served the stages before hold little else than their caches, so this one is small."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), cached=100_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokens, distances and components are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
