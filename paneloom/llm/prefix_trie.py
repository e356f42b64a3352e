"""The trie of common beginnings of conversations, built by halving depths.

Sequences are cut at half their depth: what stands before the cut is one trie, what stands
after it one forest for each distinct beginning, and both are cut again, all of a height in
one job, until pieces have one turn. A cut beginning's name is a digest of the name of its
piece's root and of the turns between, which come from digests of 1, 2, 4, ... turns made
before. Then pieces of 2, 4, ... turns are put together again: the totals of a lower
forest's roots are added to their ancestors in the upper trie. So depth costs as many jobs
as its logarithm; all rows are turns or nodes, and no conversation or node is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import written

#: Ids whose decimals a task joins before they go to the digest of their node.
JOINED = 4096


def digest(*parts: Column) -> Column:
    """16 bytes of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, name, chars) of turns in order.

    Rows are dealt by ranges of the order, so that a conversation of any length is spread;
    places in a range are added to the counts of the ranges before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("name"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), "name"]
    dealt = written(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    return dealt.withColumn("place", place).join(counts, ["conv_id", "range"]).select("conv_id", (F.col("before") + F.col("place")).alias("pos"), "name", "chars")


def rebuilt(turns: DataFrame, first_of: Column, n_first: Column, most_first: int) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, d, name, chars) and their lengths (conv_id, length).

    A conversation is the first n_first turns of the conversation first_of (both by
    conv_id; n_first is at most most_first), then its own turns after its first n_first.
    """
    turns = written(turns, "ordered-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"base": first_of, "h": n_first.cast("long")})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long")))
    convs = written(convs.select("conv_id", "base", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "b"), "conv_id").where("pos > h").select("conv_id", (F.col("b") + F.col("pos") - F.col("h")).alias("d"), "name", "chars")
    heads = turns.where(F.col("pos") <= most_first).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "name", "chars")
    borrowed = convs.where("b > 0").select("conv_id", "base", "b").join(heads, "base").where("d <= b").select("conv_id", "d", "name", "chars")
    return own.unionByName(borrowed), convs.select("conv_id", "length")


def height_of(lengths: DataFrame) -> int:
    """The power of two that depths 0 to the longest sequence fit in."""
    most = lengths.agg(F.max("length")).first()[0] or 0
    return 1 << int(most).bit_length()


def named_prefixes(sequences: DataFrame, lengths: DataFrame, height: int) -> DataFrame:
    """(conv_id, d, prefix, chars): names of all beginnings, and the characters of their last turn.

    A height's cut names follow from the names at the multiples of the height and the
    digest of the turns up to the cut; halves of all pieces are named in one job.
    """
    pieces = [sequences.select("conv_id", (F.col("d") - 1).alias("at"), F.col("name").alias("piece"))]
    while 2 << len(pieces) <= height:  # the longest first half has height / 2 turns
        odd = F.col("at") % 2 == 1
        halves = pieces[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(~odd, F.col("piece"))).alias("l"), F.max(F.when(odd, F.col("piece"))).alias("r"))
        pieces.append(written(halves.where("l is not null and r is not null").select("conv_id", "at", digest(F.col("l"), F.col("r")).alias("piece")), "pieces"))
    known = [written(lengths.select("conv_id", F.lit(0).cast("long").alias("d"), digest(F.lit(b"")).alias("prefix")), "prefixes")]
    while height > 1:
        half = height // 2
        roots = known[0]
        for more in known[1:]:
            roots = roots.unionByName(more)
        cut = pieces[half.bit_length() - 1].where(F.col("at") % 2 == 0).select("conv_id", (F.shiftright("at", 1) * height).alias("d"), "piece")
        named = roots.join(cut, ["conv_id", "d"]).select("conv_id", (F.col("d") + half).alias("d"), digest(F.col("prefix"), F.col("piece")).alias("prefix"))
        known.append(written(named, "prefixes"))
        height = half
    found = known[0]
    for more in known[1:]:
        found = found.unionByName(more)
    return found.join(sequences.select("conv_id", "d", "chars"), ["conv_id", "d"], "left").select("conv_id", "d", "prefix", F.coalesce("chars", F.lit(0)).alias("chars"))


def grafted(nodes: DataFrame, prefixes: DataFrame, height: int, sums: list[str]) -> DataFrame:
    """(prefix, sums): each node's sums over its subtree.

    nodes has prefix, first (a sequence through the node), depth and the node's own values.
    For pieces of 2, 4, ... turns, what the roots of the lower forest have goes to their
    ancestors in the upper trie, which a sequence through the root names.
    """
    totals = nodes.select("prefix", *sums)
    half = 1
    while half < height:
        both = 2 * half
        piece = F.floor(F.col("depth") / both).alias("piece")
        cut = nodes.where(F.col("depth") % both == half).select("prefix", F.col("first").alias("conv_id"), piece).join(totals, "prefix").drop("prefix")
        above = prefixes.where(F.col("d") % both < half).select("conv_id", F.floor(F.col("d") / both).alias("piece"), "prefix")
        more = cut.join(above, ["conv_id", "piece"]).select("prefix", *sums)
        totals = written(totals.unionByName(more).groupBy("prefix").agg(*[F.sum(c).alias(c) for c in sums]), "totals")
        half = both
    return totals


def ends_digests(ends: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of ends (prefix, conv_id): SHA-256 of the decimal ids in order, joined by commas.

    Ids are joined by ranges of the order first, so that a node with very many of them
    sends few long rows to the task that holds its digest.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for prefix, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found and found[-1][0] == prefix and len(found[-1][2]) < JOINED:
                    found[-1][2].append(str(c))
                else:
                    found.append((prefix, c, [str(c)]))
            yield pa.record_batch([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([",".join(f[2]) for f in found], pa.string())], names=["prefix", "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, state = None, None
        for batch in batches:
            found = []
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p == prefix:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    found.append((prefix, state.hexdigest()))
                prefix, state = p, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["prefix", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([prefix], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["prefix", "ends_sha256"])

    parts = ends.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id").mapInArrow(joined, "prefix binary, conv_id long, ids string")
    return parts.repartition("prefix").sortWithinPartitions("prefix", "conv_id").select("prefix", "ids").mapInArrow(hashed, "prefix binary, ends_sha256 string")


def trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct beginning of sequences (conv_id, d from 1, name, chars); lengths (conv_id, length) has them all.

    conv_id is the node's smallest member, parent_conv_id its parent's (null for the root,
    of depth 0); n_convs counts members, n_children children, n_leaves childless nodes of
    its subtree, saved_tokens sums (n_convs - 1) x chars of the last turn over the subtree;
    ends_sha256 is of the members that end there. Without a conversation there is no root.
    """
    sequences, lengths = written(sequences, "sequences"), written(lengths, "lengths")
    height = height_of(lengths)
    prefixes = written(named_prefixes(sequences, lengths, height), "named-prefixes")
    nodes = written(prefixes.groupBy("prefix").agg(F.min("conv_id").alias("first"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "nodes")
    of_parent = prefixes.select(F.col("conv_id").alias("first"), (F.col("d") + 1).alias("depth"), F.col("prefix").alias("parent"))
    nodes = nodes.join(of_parent, ["first", "depth"], "left")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "prefix", "left").fillna(0, ["n_children"])
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}
    nodes = written(nodes.withColumns(own), "trie-nodes")
    totals = grafted(nodes, prefixes, height, list(own))
    ends = prefixes.join(lengths.select("conv_id", F.col("length").alias("d")), ["conv_id", "d"])
    parents = nodes.select(F.col("prefix").alias("parent"), F.col("first").alias("parent_conv_id"))
    found = nodes.drop(*own).join(totals, "prefix").join(parents, "parent", "left").join(ends_digests(ends), "prefix", "left")
    return found.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, *, block: int = 100, heads: int = 6) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), each rebuilt on the beginning of its block's first.

    Conversation c begins with the first h turns of conversation c - c % block, h being
    CRC-32 of its decimal id modulo heads, and goes on with its own after its first h. Turns
    are in order of turn, null first; turns of one place, which repeated rows are too, are
    ordered by the digest of role and text, both of which are empty where null. Rows without
    conv_id belong to no conversation. Texts of any length are digested whole; other columns
    are not read. An empty table gives no row.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % heads
    return trie(*rebuilt(ordered_turns(rows), c - c % block, h, heads - 1))
