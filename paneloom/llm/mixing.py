"""Mixing sources to target weights by entropy balancing.

Of all document rates with the wanted words from each source, the mix takes those nearest to
one each (least relative entropy). Their dual has one multiplier for each source, and the
rate of a document is exp(multiplier x words), cut at the cap: a source with fewer words
wanted than it has gives up long documents first, one with more repeats them first. Newton
rounds find all multipliers at once from sums over cells (source, size, documents), to which
the corpus shrinks in the first shuffle. Rates are then rounded into whole copies, a cell
after the other from the longest, each making up for what the ones before it took too much
or too little; within a cell the documents of least hash get the copy more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import written

#: Parts of a cell by hash of the id, of which only one is told apart by document.
PARTS = 1024
#: A source's words under its rates may differ from its target by this share.
TOLERANCE = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sources_of(cells: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: its words, its target, and a bracket of its multiplier.

    Sources in order of their names, null last, weigh weights[0], weights[1], ..., over and
    over. They share so many times all words by weight, but none gets more than most times
    its own; what is over goes to the others by weight. That is a level: with sources in
    order of what they can hold for each weight, it is the largest of what is left for
    each weight once all before are full.
    """
    sizes = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    # One row for each source.
    place = F.row_number().over(Window.orderBy("key")) - 1
    rows = sizes.withColumn("weight", F.get(F.lit([float(w) for w in weights]), place % len(weights))).withColumn("room", most * F.col("source_size"))
    every = Window.orderBy(F.col("room") / F.col("weight"), "key")
    before = F.coalesce(F.sum("room").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (share * total - before) / F.sum("weight").over(every.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("room"), F.col("level") * F.col("weight"))
    rows = rows.withColumn("target", F.greatest(target, F.lit(0.0)))
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    # At these ends every rate is at the cap, one, or at most the ratio.
    upper = F.when(ratio > 1, math.log(most) / F.col("least")).otherwise(0.0)
    lower = F.when(ratio < 1, F.log(F.greatest(ratio, F.lit(1e-300))) / F.col("least")).otherwise(0.0)
    at = F.when(F.col("target") >= F.col("room"), upper).otherwise(0.0)
    return rows.select("key", "source_size", "target", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in (("lower", lower), ("upper", upper), ("at", at))])


def rate(multiplier: Column, size: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(multiplier * size, F.lit(50.0))))


def balanced(cells: DataFrame, sources: DataFrame, most: float, rounds: int = 100) -> DataFrame:
    """sources with at, the multipliers that solve the dual.

    A round sums words and their slope by source under the present multipliers and takes a
    Newton step on the logarithm of the words, whose curve is nearly straight; a step out
    of the bracket becomes its middle. Sources stay in files between rounds.
    """
    state = written(sources.withColumn("off", F.when(F.col("target") > 0, F.lit(1.0)).otherwise(0.0)), "multipliers")
    for _ in range(rounds):
        w = rate(F.col("at"), F.col("size"), most)
        words = F.col("n") * F.col("size") * w
        slope = F.when(w < most, words * F.col("size")).otherwise(0.0)
        sums = cells.join(state.select("key", "at"), "key").groupBy("key").agg(F.sum(words).alias("g"), F.sum(slope).alias("dg"))
        both = state.join(sums, "key")
        low, high = F.when(F.col("g") < F.col("target"), F.col("at")).otherwise(F.col("lower")), F.when(F.col("g") > F.col("target"), F.col("at")).otherwise(F.col("upper"))
        both = both.withColumns({"lower": low, "upper": high, "off": F.when(F.col("target") > 0, F.abs(F.try_divide("g", "target") - 1)).otherwise(0.0)})
        step = F.col("at") - F.try_divide(F.log(F.try_divide("g", "target")) * F.col("g"), F.col("dg"))
        inside = (step > F.col("lower")) & (step < F.col("upper"))  # null without a slope
        new = F.when(F.col("off") <= TOLERANCE, F.col("at")).when(inside, step).otherwise((F.col("lower") + F.col("upper")) / 2)
        # A bracket of neighbouring numbers can't be cut.
        both = both.withColumn("off", F.when(F.col("upper") - F.col("lower") <= 1e-15 * F.abs("upper"), 0.0).otherwise(F.col("off")))
        state = written(both.withColumn("at", new).select(*state.columns), "multipliers")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            return state
    raise ValueError(f"the dual has not settled in {rounds} rounds")


def copies(cells: DataFrame, most: float) -> DataFrame:
    """cells (key, size, n, rate) with taken, the whole copies of all documents of the cell.

    A source's cells pass a task in order of size, which holds one number. There is at most
    one for each number of words of a document.
    """

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, owed = None, 0.0
        for batch in batches:
            found = []
            for key, size, n, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != source:
                    source, owed = key, 0.0
                wanted = n * r + (owed / size if size else 0.0)
                found.append(min(max(math.floor(wanted + 0.5), 0), n * math.floor(most)))
                owed += (n * r - found[-1]) * size
            yield pa.record_batch([*batch.columns[:3], pa.array(found, pa.int64())], names=["key", "size", "n", "taken"])

    dealt = cells.select("key", "size", "n", "rate").repartition("key").sortWithinPartitions("key", F.desc("size"))
    return dealt.mapInArrow(rounded, "key string, size long, n long, taken long")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, size (words), source_size, target, rate, copies and taken (words).

    docs has text and source beside the id; other columns are not read. A null text has no
    words, so nothing is taken of it; null is a source of its own and comes last. A source
    without words has the target 0. Rows that repeat count as documents of their own; a
    null id is an id. Texts of any length are counted whole, and no document gets more
    than most copies. Ties have no order to matter, as documents of a source and size get
    their copies by the hash of the id: another run gives the same. An empty table gives
    none.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    part = F.pmod(F.xxhash64(id_column), F.lit(PARTS)).cast("int")
    sized = written(docs.select(F.col(id_column).alias("doc_id"), key.alias("key"), n_words(F.col("text")).alias("size"), part.alias("part")), "sizes")
    parts = written(sized.groupBy("key", "size", "part").agg(F.count("*").alias("n")), "cell-parts")
    cells = written(parts.groupBy("key", "size").agg(F.sum("n").alias("n")), "cells")
    sources = balanced(cells, sources_of(cells, weights, share, most), most)
    rated = cells.join(sources.select("key", "source_size", "target", "at"), "key").withColumn("rate", rate(F.col("at"), F.col("size"), most))
    rated = written(rated.join(copies(rated, most).select("key", "size", "taken"), ["key", "size"]), "rated-cells")
    each = F.floor(F.col("taken") / F.col("n"))
    of_part = rated.select("key", "size", "source_size", "target", "rate", each.alias("each"), (F.col("taken") - each * F.col("n")).alias("more"))
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shared = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(of_part, ["key", "size"])
    shared = shared.withColumn("more", F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("n"))).drop("n", "before")
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = sized.withColumn("place", place).join(shared, ["key", "size", "part"])
    found = found.withColumn("copies", F.col("each") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0))
    return found.select(F.col("doc_id").alias(id_column), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, found: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The mix itself: each row of docs as often as mix gives its id copies; ids must be unique and not null."""
    wanted = found.where("copies > 0").select(id_column, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
    return docs.join(wanted, id_column)
