"""A corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, tokens.

``STAGES`` are applied in order to the table documents. Each takes all that the one before has kept, and what it
returns is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkset.llm import bpe, decontaminate, line_dedup, quality_knn, simhash
from sparkset.llm.shared import keep, own_column, read_table, read_texts


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``quality_knn.THRESHOLD`` or more. Held-out labels are not learned from."""
    model = quality_knn.fit(docs, read_table(spark, sf_dir, "labels").where(~quality_knn.held_out()))
    score = own_column(docs, "score")
    return quality_knn.score(docs, model, score_col=score).where(F.col(score) >= quality_knn.THRESHOLD).drop(score)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; n_chars follows the text. A document that is all repeats becomes empty."""
    return line_dedup.dedup_lines(docs).select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, whatever their fingerprints; empty ones are a group."""
    return simhash.keep_first(docs, radius=None)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", tokens),
]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_texts(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
