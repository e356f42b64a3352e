"""Quality rules whose thresholds follow the data, in DataFrame functions.

Each statistic of a text is compared with fences learned for its language and source from
mergeable KLL quantile sketches: the upper quartile plus reach times the quartile range,
which is at least a floor. The sketches of small groups give way to their language's,
merged from those of all its sources. Fences are joined to the statistics and rows beyond
one are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.arrays import grams
from paneloom.llm.common import SPACES, waiting, written

#: Statistic and the least quartile range that its fence counts with.
FLOORS = {"symbol_share": 0.02, "upper_share": 0.05, "dup_line_share": 0.005, "repeat_share": 0.08, "word_length": 1.0}


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper.

    A null text has no word. Words in windows of three are matched by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    columns = docs.columns
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_words": F.array_remove(F.split(text, SPACES), ""), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    df = grams(df, "_hashes", 3, "_grams").drop("_hashes")
    df = df.withColumn("_some", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    df = df.withColumn("_sorted", F.when(F.col("_some"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.lit(None)))
    df = df.drop("_grams", "_some")
    twice = F.transform(
        "_sorted",
        lambda x, j: F.when((x["g"] == F.get("_sorted", j - 1)["g"]) | (x["g"] == F.get("_sorted", j + 1)["g"]), x["i"]),
    )
    df = df.withColumn("_starts", F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop("_sorted")
    covered = F.transform("_starts", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("_starts", j + 1) - i, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long"))).select(
        *[c for c in columns if c not in NEW], *NEW
    )


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]


def base_failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def shares() -> dict[str, Column]:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("n_upper") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def judged(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, reach: float = 3.0, min_rows: int = 200, sketch_k: int = 1000) -> DataFrame:
    """Every column of docs but text, the statistics, base_failed, each fence and kept.

    Fences are learned from the rows that pass the base rules. A group (lang, source) of
    fewer than min_rows of them takes the fences of its lang; null is a lang and a source
    like others. A group whose lang has no such row has no fences, and base_failed alone
    decides. Ties with a fence are kept. Rows that repeat count and are judged each; an
    empty table gives no rows. Columns of the names that are added are replaced, others stay.
    """
    docs, named = waiting(docs, "doc_id", "text", "lang", "source")
    rows = written(statistics(docs).drop("text").withColumns(shares()).withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "statistics")
    names = list(FLOORS)
    sketches = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(n, sketch_k).alias(n) for n in names])
    merged = sketches.groupBy("lang").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(n, sketch_k).alias(n) for n in names])

    def fences(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
        def at(name: str, rank: float) -> Column:
            return F.kll_sketch_get_quantile_double(name, F.lit(rank))

        return df.select(
            *[F.col(k).alias(f"{prefix}{k}") for k in keys],
            *[(at(n, 0.75) + F.lit(reach) * F.greatest(at(n, 0.75) - at(n, 0.25), F.lit(FLOORS[n]))).alias(f"{prefix}{n}") for n in names],
        )

    own = fences(sketches.where(F.col("n") >= min_rows), "own_", "lang", "source")
    wide = fences(merged, "all_", "lang")
    df = rows.join(own, rows["lang"].eqNullSafe(own["own_lang"]) & rows["source"].eqNullSafe(own["own_source"]), "left")
    df = df.join(wide, df["lang"].eqNullSafe(wide["all_lang"]), "left")
    df = df.withColumns({f"max_{n}": F.coalesce(f"own_{n}", f"all_{n}") for n in names})
    beyond = F.lit(False)
    for n in names:
        beyond = beyond | F.coalesce(F.col(n) > F.col(f"max_{n}"), F.lit(False))
    return named(df.withColumn("kept", ~F.col("base_failed") & ~beyond).select(*rows.columns, *[f"max_{n}" for n in names], "kept"))
