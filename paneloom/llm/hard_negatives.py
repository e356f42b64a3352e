"""Hard negatives by an exact search of cover trees.

A tree over a bounded sample deals all rows to its leaves; the covering radii of its nodes,
level by level, are of all rows. Leaves are split by hash into blocks of bounded size, each
with a tree of its own over its rows. A query goes to the blocks whose bounds meet its
window and can beat what the sample has for it, and there descends best-first; what it
reaches is scored exactly. Rows and queries of a block meet by a shuffle: rows come first
and are held, queries pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm import cover_tree
from paneloom.llm.common import least_hashed, written

#: Rows of the sample that the upper tree is built of, and rows of a block, about.
SAMPLE, BLOCK = 2048, 8192
#: Queries that a task answers at once.
ASKED = 512
#: No window: the ends of longs.
FAR = 2**63 - 1


def whole_vectors(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v has floor(scale x component), as doubles."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


class Index:
    """The upper tree, the norm and width of all vectors, and the blocks of each leaf; a bounded object that tasks get."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float, width: int) -> None:
        self.norm, self.width = norm, width
        order = np.argsort(ids, kind="stable")
        self.points, self.ids, self.labels = points[order], ids[order], labels[order]
        self.root = cover_tree.grown(cover_tree.augmented(self.points, norm))
        self.leaves = cover_tree.leaves(self.root)
        self.paths: list[list[cover_tree.Node]] = [[] for _ in self.leaves]

        def walk(node: cover_tree.Node, path: list) -> None:
            path = [*path, node]
            if not node.children:
                self.paths[node.number] = path
            for child in node.children:
                walk(child, path)

        walk(self.root, [])
        self.first: list[int] = []
        self.blocks: list[int] = []

    def dealt(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's leaf, by the nearest child at each level, and its distances to the nodes on the way."""
        depth = max(len(p) for p in self.paths)
        leaf, away = np.zeros(len(points), int), np.zeros((len(points), depth))
        todo = [(self.root, np.arange(len(points)), 0)]
        while todo:
            node, at, level = todo.pop()
            away[at, level] = np.linalg.norm(points[at] - node.centre, axis=1)
            if not node.children:
                leaf[at] = node.number
                continue
            nearest = np.argmin([np.linalg.norm(points[at] - c.centre, axis=1) for c in node.children], axis=0)
            todo += [(c, at[nearest == i], level + 1) for i, c in enumerate(node.children) if (nearest == i).any()]
        return leaf, away

    def settled(self, found: list) -> None:
        """Takes rows (leaf, n, reach) of all points: radii of all levels, and the blocks of each leaf."""
        for path in self.paths:
            for node in path:
                node.reach = 0.0
        counts = [0] * len(self.leaves)
        for leaf, n, reach in found:
            counts[leaf] = n
            for node, r in zip(self.paths[leaf], reach, strict=False):
                node.reach = max(node.reach, r)
        self.blocks = [-(-n // BLOCK) for n in counts]
        self.first = [sum(self.blocks[:i]) for i in range(len(counts))]

    def asked(self, queries: np.ndarray, probes: cover_tree.Probes, k: int, *, same: bool) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, list[int]]]]:
        """The sample's k-th best of each probe, or what it had, and (probes, blocks) to look in."""
        best = cover_tree.search(self.root, self.norm, self.points, self.ids, self.labels, queries, probes, k, same=same)
        least = np.maximum(probes.least, best.score[:, -1])
        lengths = np.linalg.norm(queries, axis=1)

        def found() -> Iterator[tuple[np.ndarray, list[int]]]:
            todo = [(self.root, np.arange(len(probes.query)))]
            while todo:
                node, at = todo.pop()
                q = probes.query[at]
                low, high = cover_tree.bounds(node, queries[q], lengths[q], self.norm)
                at = at[(high >= np.maximum(probes.low[at], least[at])) & (low <= probes.high[at])]
                if not len(at):
                    continue
                todo += [(c, at) for c in node.children]
                if not node.children and self.blocks[node.number]:
                    first = self.first[node.number]
                    yield at, list(range(first, first + self.blocks[node.number]))

        return least, found()


def indexed(rows: DataFrame) -> tuple[Index | None, DataFrame]:
    """The index, fitted on at most SAMPLE rows, and all rows (vec_id, label, v) with their block."""
    largest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    if largest[0] is None:
        return None, rows.withColumn("block", F.lit(0))
    sample = least_hashed(rows, SAMPLE, "vec_id").toArrow()
    width = int(largest[1])
    index = Index(matrix(sample["v"].combine_chunks(), width), sample["vec_id"].to_numpy(), sample["label"].to_numpy(), float(largest[0]) ** 0.5, width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, away = index.dealt(cover_tree.augmented(matrix(batch.column(2), width), index.norm))
            yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int32()), pa.array(away.tolist(), pa.list_(pa.float64()))], names=["vec_id", "label", "v", "leaf", "away"])

    dealt = written(rows.select("vec_id", "label", "v").mapInArrow(deal, "vec_id long, label long, v array<double>, leaf int, away array<double>"), "dealt-vectors")
    depth = max(len(p) for p in index.paths)
    # One row for each leaf of the sample's tree.
    index.settled([(r[0], r[1], r[2:]) for r in dealt.groupBy("leaf").agg(F.count("*"), *[F.max(F.get("away", F.lit(i))) for i in range(depth)]).collect()])
    block = F.get(F.lit(index.first), F.col("leaf")) + F.pmod(F.xxhash64("vec_id"), F.get(F.lit(index.blocks), F.col("leaf")))
    return index, dealt.select("vec_id", "label", "v", block.cast("int").alias("block"))


PAIR = "block int, is_query int, id long, label long, low long, high long, least long, v array<double>"


def searched(index: Index, rows: DataFrame, queries: DataFrame, k: int, *, same: bool) -> DataFrame:
    """(id, low, high, score, vec_id): the first k rows of each query (id, label, v, low, high) within its window."""
    width, norm = index.width, index.norm

    def probes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, cover_tree.Probes]:
        """Distinct vectors and their probes; columns id, label, low, high, least, v."""
        label, low, high, least = (batch.column(i).to_numpy() for i in range(1, 5))
        distinct, place = np.unique(matrix(batch.column(5), width), axis=0, return_inverse=True)
        return distinct, cover_tree.Probes(place.reshape(-1), label, low, high, least)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ASKED):
                some = batch.slice(start, ASKED)
                least, found = index.asked(*probes_of(some), k, same=same)
                columns = [some.column(0), some.column(1), some.column(2), some.column(3), pa.array(least), some.column(5)]
                for at, blocks in found:
                    part = [c.take(pa.array(at)) for c in columns]
                    for block in blocks:
                        yield pa.record_batch([pa.array(np.full(len(at), block, np.int32)), pa.array(np.ones(len(at), np.int32)), *part], names=["block", "is_query", "id", "label", "low", "high", "least", "v"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tree = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1
            for start, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if start == end:
                    continue
                some = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, held, tree = blocks[start], [], None
                if not kinds[start]:
                    held.append((matrix(some.column(7), width), some.column(2).to_numpy(), some.column(3).to_numpy()))
                    continue
                if tree is None:
                    if not held:  # a block that the hash left empty
                        continue
                    points, ids, labels = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(ids, kind="stable")
                    points, ids, labels, held = points[order], ids[order], labels[order], []
                    tree = cover_tree.grown(cover_tree.augmented(points, norm))
                for at in range(0, some.num_rows, ASKED):
                    part = some.slice(at, ASKED).select(["id", "label", "low", "high", "least", "v"])
                    best = cover_tree.search(tree, norm, points, ids, labels, *probes_of(part), k, same=same)
                    row, place = np.nonzero(best.score != cover_tree.NONE)
                    taken = [part.column(c).take(pa.array(row)) for c in ("id", "low", "high")]
                    yield pa.record_batch([*taken, pa.array(best.score[row, place]), pa.array(best.id[row, place])], names=["id", "low", "high", "score", "vec_id"])

    sent = queries.select("id", "label", "low", "high", F.lit(-FAR).cast("long").alias("least"), "v").mapInArrow(send, PAIR)
    held = rows.select("block", F.lit(0).alias("is_query"), F.col("vec_id").alias("id"), "label", *[F.lit(0).cast("long").alias(c) for c in ("low", "high", "least")], "v")
    met = held.unionByName(sent).repartition("block").sortWithinPartitions("block", "is_query")
    found = met.mapInArrow(answer, "id long, low long, high long, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("id", "low", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, scale: float = 256.0, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has vec_id, embedding and a whole-number label; is_anchor is a condition on vec_id.
    Components become floor(scale x component), scores are exact inner products; higher ones
    come first, ties by the smaller vec_id. Positives are an anchor's first other rows of its
    label, negatives the first of other labels whose score is window[0] to window[1] percent
    of the positive's. Rows with a null vec_id, label or vector, or with a null or
    non-finite component, take no part. Rows that repeat whole count once; rows of one
    vec_id that differ are rows of their own, and an anchor's own id is never its positive.
    Shorter vectors end in zeros; components that no long holds, and scores, stop at its
    ends. Other columns are not read. An anchor without positives, or without negatives in
    a window, has no row; an empty table gives none.

    Of rows with equal vector and label, only the first positives + 1 ids (at least
    negatives) can be in a result: those before them have the same score and come first.
    Others are left out of the search, but not as anchors.
    """
    spark = rows.sparkSession
    every = written(whole_vectors(rows, scale).distinct(), "vectors")
    first = max(positives + 1, negatives)
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    index, held = indexed(written(every.withColumn("place", place).where(F.col("place") <= first).drop("place"), "candidates"))
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held = written(held, "blocks")
    anchors = every.where(is_anchor)
    queries = written(anchors.groupBy("label", "v").agg(F.min("vec_id").alias("id")), "queries")
    wide = queries.withColumns({"low": F.lit(-FAR).cast("long"), "high": F.lit(FAR).cast("long")})
    near = written(searched(index, held, wide, positives + 1, same=True).select("id", "score", F.col("vec_id").alias("positive_id")), "positives")
    # Of a score 100 a + b, so many percent are percent x a and so many hundredths of b; no product leaves a long.
    a, b = F.expr("score div 100"), F.col("score") % 100
    low, high = (a * w + end(b * w / 100).cast("long") for w, end in zip(window, (F.ceil, F.floor), strict=True))
    near = near.where("score >= 0").withColumns({"low": low, "high": high})
    narrow = near.where("low <= high").select("id", "low", "high").distinct().join(queries, "id")
    far = searched(index, held, narrow, negatives, same=False).select("id", "low", "high", "place", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
    members = anchors.select("label", "v", F.col("vec_id").alias("anchor_id")).join(queries, ["label", "v"]).select("id", "anchor_id")
    place = F.row_number().over(Window.partitionBy("id", "anchor_id").orderBy(F.desc("score"), "positive_id"))
    pairs = members.join(near, "id").where("positive_id <> anchor_id").withColumn("nth", place).where(F.col("nth") <= positives)
    return pairs.join(far, ["id", "low", "high"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
