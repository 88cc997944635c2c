"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of ``docs``, also columns this file knows nothing of.
A null text is rejected by the first stage; an empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.llm.decontaminate import contamination
from logvigil.llm.language import UNKNOWN, with_language
from logvigil.llm.line_dedup import dedup_lines
from logvigil.llm.near_dedup import near_duplicates
from logvigil.llm.packing import pack_documents
from logvigil.llm.stages import Stages, table

#: A text whose best language scores less is none of the languages learned.
LEAST_SCORE = 0.35
#: Pieces a task of the last stage keeps; they go with it, as the worker's memory is shared by all stages.
PIECES_HELD = 65_536


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned; null texts and texts without a letter go."""
    found = with_language(docs, docs.columns, name="_language")
    kept = (F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= LEAST_SCORE)
    return found.where(kept).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines they repeat from earlier documents; texts of nothing else go."""
    found = dedup_lines(docs, name="_dedup")
    left = (F.col("_dedup.n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s", "")) != "")
    return found.where(F.coalesce(left, F.lit(True))).select(*[
        F.when(F.col("_dedup.n_removed") > 0, F.length("text").cast(docs.schema[c].dataType))
        .otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at 80 % of five-word shingles: the smallest doc_id."""
    found = near_duplicates(docs, size=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item, as they are."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_gone")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    return docs.join(gone, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens or a power of two below."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), held=PIECES_HELD)


STAGES = [
    ("language", language), ("lines", lines), ("near copies", near_copies),
    ("decontamination", decontaminate), ("packing", pack),
]

#: A learned model, alignments, components and a tokenizer file: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    stages = Stages(spark)
    docs = table(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES:
        done = stages.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if held is not None:
            stages.drop(held)
        docs = held = done
    return docs
