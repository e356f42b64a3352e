"""Registered corpus queries on the smallest tables: oracles, keys and the pipeline."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import SF, canonical, connection

from paneloom.llm import queries
from paneloom.llm.common import written

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert canonical(got) == canonical(connection().execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_for_each_row(spark, name):
    key, table = ("page_id", "pages") if name.startswith("op6") else ("doc_id", "documents")
    rows = QUERIES[name](spark, SF)
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = QUERIES["op3_language_id"](spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count()
    found = QUERIES["op4_quality_classifier"](spark, SF).where("held_out").join(labels, "doc_id")
    assert found.where("predicted = quality").count() >= 0.9 * found.count()
    found = QUERIES["op5_class_lm"](spark, SF).where("held_out").selectExpr("sum(score) > sum(base_score)").first()
    assert found[0]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = written(docs, name)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, copies, shared passages, benchmark items and columns with the operators' names."""
    import random

    import corpus_pipeline

    rng = random.Random(5)
    pools = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 7))) for _ in range(600)] for k, v in (("aa", "abcdeé"), ("bb", "lmnopß"))}

    def prose(lang, n):
        return " ".join(rng.choice(pools[lang]) for _ in range(n))

    copied, passage, item = prose("aa", 120), prose("bb", 60), prose("aa", 30)
    texts = {i: (prose(k, 100), k) for i, k in enumerate(["aa", "bb"] * 5)}
    texts |= {20: (None, "aa"), 21: ("", None), 22: ("12 ... 34", "bb"), 23: ("日本語" * 40, None)}
    texts |= {30: (copied, "aa"), 31: (copied, None), 32: (copied + " " + prose("aa", 3), "aa")}
    texts |= {40: (f"{prose('bb', 40)} {passage} {prose('bb', 40)}", "bb"), 41: (f"{prose('bb', 30)} é{passage} {prose('bb', 50)} \ufffd", "bb")}
    texts |= {50: (f"{prose('aa', 40)} {item} {prose('aa', 10)}", "aa"), 51: (f"{prose('aa', 70)} " * 300, "aa")}
    rows = [(i, t, k, None, None if t is None else len(t), "held", [i]) for i, (t, k) in texts.items()]
    rows += rows[:1] * 2
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "score string", "spans array<bigint>"]
    spark.createDataFrame(rows, ", ".join(names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.count() == len(kept[-1]) + (2 if name == "language_id" else 0)
        assert all(r["score"] == "held" and r["spans"] == [i] for i, r in kept[-1].items())
    assert set(kept[0]) == set(texts) - {20, 21, 22, 23}
    assert set(kept[1]) == set(kept[0]) - {31, 32}
    assert set(kept[2]) == set(kept[1]) and {i for i in kept[2] if kept[2][i]["text"] != texts[i][0]} == {40, 41, 51}
    assert all(passage not in kept[2][i]["text"] for i in (40, 41)) and kept[2][41]["text"].endswith("\ufffd")
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].values())
    assert set(kept[3]) == set(kept[2]) - {50}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(kept[3])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
