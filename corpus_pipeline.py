"""Corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet and reads it again as the next stage's documents. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from leadline.llm.columns import free_name
from leadline.session import stage
from leadline.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold. The model learns from the documents given."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity_score")
    scored = model.score(docs, score_col=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more documents hold, but for one of them; none is left out."""
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    return with_length(line_dedup.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words all stay.

    It is the row of the smallest id, then text hash, then row number; a null id comes after all
    others. Rows are judged one by one, so rows that repeat an id are linked by their texts like
    any others, and so are rows with a null id. Row numbers are staged with the rows, as they may
    differ from one evaluation to the next.
    """
    number, key = free_name(docs, "row_number"), free_name(docs, "row_key")
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()))
    # No part is null, as a null id is never linked.
    none = F.col("doc_id").isNull()
    filled = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    keyed = rows.withColumn(key, F.struct(none.alias("none"), filled.alias("id"), F.xxhash64("text").alias("hash"), F.col(number).alias("number")))
    judged = near_dedup.near_duplicates(keyed, id_col=key)
    dropped = judged.where(~F.col("kept")).select(F.col("doc_id.number").alias(number))
    return rows.join(dropped, number, "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark text go."""
    return with_length(decontamination.clean(docs, read_table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is after the text changed."""
    if "n_chars" not in docs.columns:
        return docs
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

# A trained model and token ids cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
