"""Quality classifier as a sparse ensemble of rules over text statistics (RuleFit).

Shallow trees are grown on labelled rows; every path from a root to a node is a rule, a
conjunction of comparisons. A lasso logistic regression gives most rules the weight 0. The
others become one Spark column expression, which scores any table of statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.common import least_hashed, slices, written

#: Labelled rows that rules and weights are fitted on at most: those of the least id hash.
SAMPLE = 20_000
STATISTICS = ["n_bytes", "n_words", "word_length", "upper_share", "digit_share", "symbol_share", "emphasis_share", "punct_share", "high_share", "line_share", "distinct_share", "top_share", "pair_share", "dup_line_share"]

#: Marks that prose hardly uses, and those that end emphatic sentences.
SYMBOLS, EMPHASIS = b"#$%&*+<=>@[\\]^_`{|}~", b"!?"


def statistics_of(raw: bytes) -> list[float]:
    """Statistics of a whole text; shares of bytes, words or lines. 0 where there are none."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    words = raw.split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    top = max(Counter(words).values(), default=0)
    pairs = max(len(words) - 1, 1)
    upper, digit = n[65:91].sum(), n[48:58].sum()
    letters = upper + n[97:123].sum()
    high = n[128:].sum()
    return [
        float(len(raw)),
        float(len(words)),
        sum(map(len, words)) / w,
        upper / size,
        digit / size,
        n[list(SYMBOLS)].sum() / size,
        n[list(EMPHASIS)].sum() / size,
        (n[33:127].sum() - letters - digit) / size,
        high / size,
        n[10] / size,
        len(set(words)) / w,
        top / w,
        len(set(zip(words, words[1:], strict=False))) / pairs,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs without text, with STATISTICS. A null text is empty."""
    names = [c for c in docs.columns if c != "text" and c not in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([statistics_of(raw or b"") for raw in batch.column(0).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.record_batch([*batch.columns[1:], *(pa.array(c) for c in rows.T)], names=[*names, *STATISTICS])

    schema = T.StructType([*docs.select(*names).schema.fields, *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])
    return docs.select(F.col("text").cast("binary").alias("text"), *names).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, at most?, threshold), all of which must hold."""

    parts: frozenset[tuple[str, bool, float]]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in sorted(self.parts):
            out = out & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
        return out.cast("double")


def rules_of(forest) -> list[Rule]:
    """Every path from a root to another node, once each."""
    found: dict[Rule, None] = {}

    def walk(node, parts: tuple) -> None:
        if parts:
            bounds: dict[tuple[str, bool], float] = {}
            for name, at_most, threshold in parts:
                old = bounds.get((name, at_most))
                bounds[name, at_most] = threshold if old is None else min(old, threshold) if at_most else max(old, threshold)
            found.setdefault(Rule(frozenset((n, a, t) for (n, a), t in bounds.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            name, threshold = STATISTICS[node.split().featureIndex()], node.split().threshold()
            walk(node.leftChild(), (*parts, (name, True, threshold)))
            walk(node.rightChild(), (*parts, (name, False, threshold)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


@dataclass
class Ensemble:
    """Rules with weights; score is the probability of label 1."""

    bias: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + F.lit(weight) * rule.column()
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, *, sample: int = SAMPLE, trees: int = 12, depth: int = 3, lasso: float = 2e-3, seed: int = 5) -> Ensemble:
    """Rules and weights from rows (doc_id, label 0 or 1, STATISTICS), at most sample of them.

    Rows of one label, or none, give an ensemble without rules.
    """
    known = rows.where("label in (0, 1)")
    some = least_hashed(known, sample, "doc_id", *STATISTICS).select(F.col("label").cast("double").alias("label"), *STATISTICS).cache()
    n, ones = some.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < ones < n:
        share = min(max((ones or 0) / (n or 1), 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(share / (1 - share))), {})
    features = VectorAssembler(inputCols=STATISTICS, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(features.transform(some))
    rules = rules_of(forest)
    fired = some.select("label", *[r.column().alias(f"r{i}") for i, r in enumerate(rules)])
    inputs = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules")
    model = LogisticRegression(labelCol="label", featuresCol="rules", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(inputs.transform(fired))
    some.unpersist()
    weights = model.coefficients.toArray()
    return Ensemble(float(model.intercept), {r: float(w) for r, w in zip(rules, weights, strict=True) if w})


def scored(docs: DataFrame, labels: DataFrame, teaches: Column, *, cut: float = 0.3, **options) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text).

    labels (doc_id, quality) of rows where teaches holds are learned from; a null or
    other label teaches nothing. Repeated rows are scored each, and alike; a null text as
    an empty one. Empty docs give an empty result; without labels of both kinds every
    score is the mean label, from 0.001 (also for no label) to 0.999. Of rows with one
    hash the sample takes those of least id and statistics. Other columns of docs,
    whatever their names, are neither read nor returned.
    """
    rows = written(with_statistics(docs.select("doc_id", "text")), "text-statistics")
    known = labels.select("doc_id", F.col("quality").alias("label"))
    ensemble = fit(rows.where(teaches).join(known, "doc_id"), **options)
    return rows.withColumn("score", ensemble.score()).withColumn("predicted", (F.col("score") >= cut).cast("int"))
