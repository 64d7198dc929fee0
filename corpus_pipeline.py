"""A training corpus from ``documents``: quality rules, line dedup, near dedup, decontamination, token ids.

Part of the subpackage ``gapwright.llm``. Each stage gets what the one before it kept, written as
Parquet and read again. All but the last return the columns of their input, whatever their names.

Defined results: stages decide by row and text, so a null or repeated ``doc_id`` is no obstacle; an
empty table gives an empty table. Each stage's docstring says what it does with null, empty and
repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm import decontaminate, line_dedup, merge_dropout, near_dups, quality_rules
from gapwright.llm.skew import small
from gapwright.llm.storage import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, results: tuple[str, ...]) -> dict[str, str]:
    """Unused names for the columns that are named as results of an operator."""
    free = lambda c: c if c not in (*docs.columns, *results) else free(f"_{c}")
    return {c: free(f"_{c}") for c in docs.columns if c in results}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base test nor the learned list rejects.

    A null or empty text fails the base test and goes; repeated rows stay or go together.
    """
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    names = _aside(docs, ("stats", "base_failed", "kept"))
    judged = quality_rules.apply_rules(docs.withColumnsRenamed(names), rules).where("kept")
    return judged.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later repeated runs of lines, ``n_chars`` counted anew; one of which no word is left goes.

    A null or empty text stays as it is; rows equal in key and text are one document and all keep its runs.
    """
    names = _aside(docs, ("n_lines", "n_removed"))
    cut = line_dedup.dedup_lines(docs.withColumnsRenamed(names)).where((F.col("n_removed") == 0) | F.col("text").rlike(line_dedup.WORD))
    return cut.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(names.get(c, c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, 0.8), by doc_id; null ids come last.

    Equal rows are copies of each other; texts without a word are no copies and stay.
    """
    return near_dups.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none; equal texts stay or go together."""
    own = F.coalesce(F.xxhash64("text"), F.lit(0))
    found = decontaminate.find_leaks(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("th")).distinct()
    rows = docs.select(F.struct("*").alias("row"), own.alias("th"))
    return rows.join(small(stored(found, "leaking-texts")), "th", "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text. A null or empty text has none; repeated rows repeat theirs."""
    import public_tokenizers

    return merge_dropout.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", leaks), ("sentencepiece", tokens)]

#: quality rules and near dedup are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
