"""The corpus pipeline: language ID, near and exact dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of documents; the last returns the pieces of the packed sequences. Documents with a
null text or one without a letter go in the first stage, so an empty text only reaches later
stages when all of it repeats elsewhere; it is then packed as its end token. Rows that repeat
are copies, of which one stays. Texts of any length are worked on whole, ties go to the least
doc_id, and an empty table stays empty through all stages. Columns beside those of documents
stay as they are until packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import decontamination, language_id, near_dedup, packing, queries, suffix_dedup
from paneloom.llm.common import table, written

#: A text this far from all languages, as a share of the largest distance, is in none of them.
FARTHEST = 0.8
#: Repeated passages that go: 50 words are in 200 bytes or more but for the shortest words.
REPEAT_BYTES, REPEAT_WORDS = 200, 50


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def beside_other_columns(stage: Stage) -> Stage:
    """The stage with other columns than those of documents under names that no operator replaces."""

    @wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        found = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return found.withColumnsRenamed({new: old for old, new in aside.items()})

    return renamed


@beside_other_columns
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those far from every language that docs has."""
    profiles = language_id.learn_profiles(docs.select("text", "lang"))
    found = language_id.identify(docs, profiles)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("distance") <= FARTHEST)).select(*docs.columns)


@beside_other_columns
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near copies."""
    return near_dedup.kept_documents(docs)


@beside_other_columns
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of REPEAT_WORDS words or more made of strings of REPEAT_BYTES bytes that start elsewhere too.

    A character that a cut splits goes too. Documents stay, even if nothing is left of
    their text. n_chars follows the text.
    """
    found = suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES, min_words=REPEAT_WORDS, characters=True)
    changed = F.size("spans") > 0
    found = found.withColumn("text", F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


@beside_other_columns
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), window=13, share=0.05)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_file(), length=2048, end_id=1).drop("ids")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither sampling of near copies nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
