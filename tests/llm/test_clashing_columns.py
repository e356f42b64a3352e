"""Columns of callers that have the names which operators work with."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paneloom.llm import class_lm, decontamination, hard_negatives, language_id, mixing, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, queries, suffix_dedup, url_filters, warc

#: Names that operators give to columns within, and to what they add.
INNER = """
_id _id2 _key _k1 _k2 _raw _teaches _best _low _first own_lang own_source all_lang max_symbol_share symbol_share starts ends at prints is_hot places spans kept n_bytes base steps base_score score n_tokens n_known
n_words n_hit n_items item_ids contaminated class_id class_key is_first class_size n_copies n_links t c bands first_id best words hashes part key place copies taken more size rate source_size block label low high
is_query least v id digest turn pos d name prefix depth first parent piece host path rule verdict rank features held_out lang_pred distance print n count value start end length offset sequence_id ids
""".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "ab"[i % 2], "s", None) for i, t in enumerate([*texts, texts[0], texts[1] + " more", None, ""])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in INNER])


def untouched(found, replaced=()):
    """Columns are unique, and those of callers keep their values but for what is replaced."""
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    rows = found.collect()
    for c in set(INNER) & set(found.columns) - set(replaced):
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows), c
    return rows


def test_quality_rules(docs):
    added = {"n_words", "symbol_share", "max_symbol_share", "kept"}
    assert len(untouched(quality_rules.judged(docs), added)) == 16


def test_class_lm(docs):
    added = {"n_tokens", "n_known", "base_score", "score"}
    rows = untouched(class_lm.learned_and_scored(docs, F.col("doc_id") % 5 != 1, classes=3, head=50, core=5, groups=4), added)
    assert len(rows) == 16 and "base" in rows[0]
    assert len(untouched(class_lm.scored(docs, class_lm.learn(docs, classes=3, head=50, core=5, groups=4)), added)) == 16


def test_suffix_dedup(docs):
    rows = untouched(suffix_dedup.remove_repeats(docs, length=100), {"n_bytes", "spans", "kept"})
    assert sum(bool(r["spans"]) for r in rows) == 4


def test_near_dedup(docs):
    added = {"class_id", "class_key", "is_first", "class_size", "n_copies", "n_links"}
    rows = untouched(near_dedup.near_duplicates(docs), added)
    assert sum(not r["is_first"] for r in rows) == 2
    assert len(untouched(near_dedup.kept_documents(docs))) == 14


def test_decontamination(docs):
    items = docs.where("doc_id = 3").select(F.lit("x").alias("item_id"), "text")
    rows = untouched(decontamination.contamination(docs, items), {"n_words", "n_hit", "n_items", "item_ids", "contaminated"})
    assert [r["doc_id"] for r in rows if r["contaminated"]] == [3]


def test_other_operators_of_texts(docs, spark):
    profiles = language_id.learn_profiles(docs.select("text", "lang"))
    assert language_id.identify(docs, profiles).count() == 16
    assert packing.pack(docs, queries.tokenizer_file(), length=2048, end_id=1).select("doc_id").distinct().count() == 16
    assert mixing.mix(docs).count() == 16
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit("x").alias("score"))
    assert quality_classifier.scored(docs, labels, F.lit(True), cut=0.3).count() == 16


def test_other_tables(docs, spark):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html"), *[c for c in INNER if c != "digest"])
    assert warc.round_trip(pages.select("page_id", "url", "html"), min_bytes=0).count() == 16
    assert url_filters.judged(pages, queries.URL_RULES, trees=2).count() == 16
    talks = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", *[c for c in INNER if c != "turn"])
    assert prefix_trie.conversation_trie(talks).where("depth = 0").count() == 1
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), (F.col("doc_id") % 2).alias("label"), *[c for c in INNER if c != "label"])
    assert hard_negatives.hard_negatives(vectors, F.col("vec_id") % 5 == 0).count() > 0
