"""Pipeline stages ``(spark, docs, sf_dir) -> docs``; all but the last return the columns of ``documents``.

Each works on all rows it is given.  Rows with the same id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_encode
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.quality import quality_cascade
from tidemark.llm.shared import table, vocabulary_path
from tidemark.llm.suffix_dedup import numbered


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_cascade(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fuzzily equal lines one occurrence stays, and ``n_chars`` is counted anew.

    A document that lost lines and has no word left goes: all it said is said elsewhere.  One that had no words before stays.
    """
    out = dedup_lines(docs)
    changed = F.col("n_removed") > 0
    chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    left = out.where(~changed | F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    return left.withColumn("n_chars", chars).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id and text hash; rows without words all stay.

    Rows are told apart by id and text; a row without an id comes last.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = numbered(docs.select(order.alias("order"), "text", whole.alias("doc")), "order", "text")
    group = jaccard_components(rows, "row")
    first = group.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first")).distinct()
    kept = rows.join(first, rows["row"] == F.col("_first"), "left_semi")
    ids = rows.agg(F.count("*").alias("n"), F.countDistinct("row").alias("d")).first()
    return (kept if ids.n == ids.d else kept.dropDuplicates(["row"])).select("doc.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``: each document's token numbers, and a digest of what they decode to."""
    coded = bpe_encode(docs.select("doc_id", "text"), vocabulary_path(), decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
