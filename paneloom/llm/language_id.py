"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of the most frequent character n-grams, most frequent first. A
document gets the language whose profile is nearest in out-of-place distance: the sum,
over the document's own profile, of how far each n-gram stands from its place in the
language's profile; an n-gram that is not there counts as the whole profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import fold, slices

#: What stands for everything that is not a letter; no letter has this code point.
GAP = 1
UNDETERMINED = "und"
#: Counted n-grams that a task holds before it adds them up, and sums before it passes them on.
HELD = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(0x110000)).astype(bool)


def ngram_codes(text: str | None, longest: int) -> np.ndarray:
    """Codes of all n-grams of 1 to longest (at most 3) letters, a word's ends included.

    21 bits hold a code point. Empty for a null text or one without a letter.
    """
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, points, GAP).astype(np.int64)
    codes = codes[letter | np.concatenate(([False], letter[:-1]))]
    codes = np.concatenate(([GAP], codes) if codes[-1] == GAP else ([GAP], codes, [GAP]))
    found = [codes[codes != GAP]]
    if longest > 1:
        found.append((codes[:-1] << 21) | codes[1:])
    if longest > 2:
        found.append(((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[codes[1:-1] != GAP])
    return np.concatenate(found)


def parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """text in parts of about most characters, cut at spaces, so that no n-gram is cut."""
    start = 0
    while len(text) - start > most:
        end = text.rfind(" ", start + 1, start + most)
        end = text.find(" ", start + most) if end < 0 else end
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and their counts."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and the sums of their counts."""
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def text_counts(text: str | None, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, however long, and their counts."""
    found = [counted(codes) for part in parts(text or "") if len(codes := ngram_codes(part, longest))]
    return summed([c for c, _ in found], [n for _, n in found])


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent of distinct codes, most frequent first; the smaller code wins a tie."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, *, size: int = 300, longest: int = 3) -> dict[str, list[int]]:
    """Profiles by language, counted over all rows of docs (text, lang).

    Each partition adds its counts before the shuffle. The driver gets size codes for
    each language. Rows with a null text or lang teach nothing; rows that repeat teach each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in total.items():
                yield pa.record_batch({"lang": [lang] * len(codes), "code": codes, "n": n})
            total.clear()

        def fold_in() -> None:
            for lang, (codes, n) in held.items():
                if lang in total:
                    codes, n = [total[lang][0], *codes], [total[lang][1], *n]
                total[lang] = summed(codes, n)
            held.clear()

        size = 0
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = text_counts(text, longest)
                if len(codes):
                    mine = held.setdefault(lang, ([], []))
                    mine[0].append(codes)
                    mine[1].append(n)
                size += len(codes)
                if size > HELD:
                    fold_in()
                    size = 0
                    if sum(len(codes) for codes, _ in total.values()) > HELD:
                        yield from told()
        fold_in()
        yield from told()

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, size: int = 300, longest: int = 3) -> DataFrame:
    """docs with lang_pred, score and distance.

    distance is the out-of-place distance to the nearest profile as a share of the
    largest possible one. score is 1 minus that profile's share of the distances to it
    and to the second; 1 where there is one language. The first language in order wins a
    tie. A null text, one without a letter and, where no profile was learned, any text
    get 'und', score 0 and distance 1. Columns named lang_pred, score or distance are
    replaced; others stay.
    """
    langs = sorted(profiles)
    codes = np.unique(np.concatenate([np.asarray(profiles[k], np.int64) for k in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(langs), len(codes)), size, np.int32)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def judge(text: str | None) -> tuple[str, float, float]:
        found, counts = text_counts(text, longest)
        if not len(found) or not langs:
            return UNDETERMINED, 0.0, 1.0
        own = ranked(found, counts, size)
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        there = (codes[at] == own) & (ranks[:, at] < size)
        far = np.where(there, np.abs(ranks[:, at] - np.arange(len(own))), size).sum(axis=1)
        first = int(far.argmin())
        others = np.delete(far, first)
        score = 1.0 if not len(others) else 0.5 if not others.min() else 1 - far[first] / (far[first] + others.min())
        return langs[first], float(score), float(far[first] / (size * len(own)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for batch in slices(batches):
            place = batch.schema.get_field_index("text") if place is None else place
            rows = [judge(text) for text in batch.column(place).to_pylist()]
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("lang_pred", "score", "distance")]
            yield pa.record_batch(
                [batch.column(i) for i in kept] + [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))],
                names=[batch.schema.names[i] for i in kept] + ["lang_pred", "score", "distance"],
            )

    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "distance")]
    schema = docs.select(*[f.name for f in fields]).schema.add("lang_pred", "string").add("score", "double").add("distance", "double")
    return docs.mapInArrow(predict, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: those outside fold 0."""
    return docs.where(fold() != 0)
