"""Benchmark decontamination by winnowing, in DataFrame functions.

Every run of consecutive words keeps the least hash of its k-grams as its fingerprint. Two
equal runs have the same fingerprint, so the join of fingerprints finds each document and
item that share a run; the hit is then extended: of the document's runs with one of the
item's fingerprints, those that equal one of the item's runs are hits. Runs are compared by
64-bit hashes of all their words: they meet only where they have a fingerprint in common, so
a false hit needs two equal hashes in the few runs that do. Texts are cut into words once,
whatever the lengths of the items; of what comes of them, only hashes are shuffled until the last
join, which takes what columns the caller keeps to the documents with hits, or brings those to them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.arrays import several_grams, sliding_least
from paneloom.llm.common import waiting, written

#: What is between words once A-Z are lower-cased. As letters of either case part words alike, a text can be cut before.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_words(df: DataFrame) -> DataFrame:
    """words: of a null text none. Case stays."""
    return df.withColumn("words", F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), ""))


def with_hashes(df: DataFrame) -> DataFrame:
    """hashes of words, A-Z lower-cased."""

    def lowered(w: Column) -> Column:
        return F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(lowered(w))))


def with_fingerprints(df: DataFrame, size: int, prints: str, runs: str) -> DataFrame:
    """runs: a hash of each size words; prints: for each of them the least hash of its k-grams."""
    k = 8 if size >= 13 else (size + 1) // 2
    return sliding_least(several_grams(df, "hashes", {prints: k, runs: size}), prints, size - k + 1, prints)


def with_stretches(df: DataFrame, prints: str, runs: str, size: int, out: str) -> DataFrame:
    """out: (size, print, low, runs) of consecutive runs with one fingerprint; low is the place of the first, from 1."""
    n = F.size(prints)
    # Arrays that a lambda looks into are columns, else they are made anew for each element.
    df = df.withColumn("_low", F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & ((i == 1) | (F.get(prints, i - 1) != F.get(prints, i - 2)))))
    end = F.concat(F.slice("_low", F.lit(2), F.greatest(F.size("_low") - 1, F.lit(0))), F.array(n + 1))
    each = F.zip_with("_low", F.when(n > 0, end).otherwise(F.array().cast("array<int>")), lambda low, end: F.struct(F.lit(size).alias("size"), F.get(prints, low - 1).alias("print"), low.alias("low"), F.slice(runs, low, end - low).alias("runs")))
    return df.withColumn(out, each).drop("_low")


def with_spans(df: DataFrame, starts: str, size: str, out: str) -> DataFrame:
    """out: maximal covered places (start, end) of runs of size words at ascending starts."""
    n = F.size(starts)
    df = df.withColumn("_first", F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(starts, j) > F.get(starts, j - 1) + F.col(size))))
    last = F.concat(F.transform(F.slice("_first", F.lit(2), F.size("_first") - 1), lambda j: j - 1), F.array(n - 1))
    each = F.zip_with("_first", last, lambda a, b: F.struct(F.get(starts, a).cast("long").alias("start"), (F.get(starts, b) + F.col(size)).cast("long").alias("end")))
    return df.withColumn(out, each).drop("_first")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: float = 0.05) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids and contaminated.

    A window is window consecutive words of an item, or all words of an item that has
    fewer; a word of a document is hit inside any occurrence of a window. contaminated:
    some word is hit, and at least share (as an exact ratio) of all words are. Null texts
    have no words. Items that repeat an item_id count once, a null item_id as an empty
    string; repeated documents are judged each on its own. Without documents the result is
    empty, without items nothing is hit. Columns of these names are replaced, others stay.
    """
    docs, named = waiting(docs, "doc_id", "text")
    ratio = Fraction(share).limit_denominator(1_000_000)
    items = with_words(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"))
    items = items.select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("size")).where("size > 0")
    # There are window different lengths at most.
    lengths = sorted(r["size"] for r in items.select("size").distinct().collect())
    keyed = docs.withColumns({"_id": F.xxhash64("doc_id", "text"), "_id2": F.xxhash64("text", "doc_id", F.lit(7))})
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")).cast("long")
    counted = keyed.withColumn("n_words", n_words)
    if not lengths:
        counted = counted.withColumns({"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>")})
    else:
        of_items = None
        for size in lengths:
            some = with_fingerprints(with_hashes(items.where(F.col("size") == size)), size, "prints", "item_runs")
            some = some.select("item_id", "size", F.array_distinct("prints").alias("prints"), F.array_distinct("item_runs").alias("item_runs"))
            of_items = some if of_items is None else of_items.unionByName(some)
        of_items = written(of_items, "benchmark-runs")
        found = with_hashes(with_words(keyed.select("_id", "_id2", "text")).select("_id", "_id2", "words")).drop("words")
        for size in lengths:
            found = with_stretches(with_fingerprints(found, size, f"p{size}", f"r{size}"), f"p{size}", f"r{size}", size, f"s{size}").drop(f"p{size}", f"r{size}")
        every = F.concat(*[F.col(f"s{size}") for size in lengths])
        found = found.select("_id", "_id2", F.explode(every).alias("s")).select("_id", "_id2", "s.*")
        shared = found.join(of_items.select("item_id", "size", F.explode("prints").alias("print")), ["size", "print"]).join(of_items.select("item_id", "size", "item_runs"), ["item_id", "size"])
        equal = F.filter(F.transform("runs", lambda r, i: F.when(F.array_contains("item_runs", r), F.col("low") + i)), lambda i: i.isNotNull())
        shared = shared.select("_id", "_id2", "item_id", "size", equal.alias("starts")).where(F.size("starts") > 0)
        pairs = written(shared.groupBy("_id", "_id2", "item_id", "size").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("starts")), "hits")
        hits = with_spans(pairs, "starts", "size", "spans").select("_id", "_id2", "item_id", "spans")
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
            lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(s["end"], a["upto"]).alias("upto")),
            lambda a: a["n"],
        )
        by_doc = hits.groupBy("_id", "_id2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        by_doc = by_doc.select("_id", "_id2", covered.alias("n_hit"), "item_ids")
        counted = counted.join(by_doc, ["_id", "_id2"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return named(counted.select(
        *docs.columns,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * ratio.denominator >= F.col("n_words") * ratio.numerator)).alias("contaminated"),
    ))
