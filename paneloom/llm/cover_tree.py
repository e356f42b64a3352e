"""A cover tree over points of one norm, and its best-first search by inner product.

Points get one more component, so that all have the largest norm; inner products with a
query, which gets a zero there, then depend on the angle alone. A node covers its points
within an angle of its centre, which bounds their inner products on both sides.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Points that are not split further.
LEAF = 128
#: A node of which so many children cover less than half is not split: its points are all far from each other.
FAN = 32
#: Products that a search holds at once.
HELD = 1 << 21


@dataclass
class Node:
    """centre is a point; members are those of a leaf. reach is the largest distance of a covered point."""

    centre: np.ndarray
    reach: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)
    number: int = -1


def augmented(points: np.ndarray, norm: float) -> np.ndarray:
    """Points with the component that makes each as long as norm."""
    return np.column_stack([points, np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", points, points), 0.0))])


def grown(points: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree of augmented points. Children's centres are over half their parent's reach apart and cover half of it."""
    root = Node(points[0], 0.0, np.arange(len(points)))
    todo = [root]
    while todo:
        node = todo.pop()
        own = points[node.members]
        away = np.linalg.norm(own - node.centre, axis=1)
        node.reach = float(away.max())
        if len(own) <= leaf or node.reach == 0.0:
            continue
        left, children, half = np.arange(len(own)), [], node.reach / 2
        centre = node.centre
        while len(left):
            near = np.linalg.norm(own[left] - centre, axis=1) <= half
            if near.any():
                children.append(Node(centre, 0.0, node.members[left[near]]))
            left = left[~near]
            if len(children) == FAN and 2 * len(left) > len(own):
                children = []
                break
            if len(left):
                centre = own[left[0]]
        if children:
            node.children, node.members = children, node.members[:0]
            todo += children
    return root


def leaves(root: Node) -> list[Node]:
    """Leaves from left to right, numbered."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.children:
            todo += reversed(node.children)
        else:
            node.number = len(found)
            found.append(node)
    return found


def bounds(node: Node, queries: np.ndarray, lengths: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that each query can have with a covered point, a bit wider for rounding."""
    scale = lengths * norm
    with np.errstate(invalid="ignore", divide="ignore"):
        at = np.arccos(np.clip(np.where(scale > 0, queries @ node.centre[:-1] / scale, 0.0), -1, 1))
    angle = 2 * np.arcsin(min(1.0, node.reach / (2 * norm))) if norm else 0.0
    slack = 0.5 + 1e-7 * scale
    return scale * np.cos(np.minimum(at + angle, np.pi)) - slack, scale * np.cos(np.maximum(at - angle, 0.0)) + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs; those that no long holds stop at its ends."""
    most = max(1.0, float(np.abs(a).max(initial=0.0))) * max(1.0, float(np.abs(b).max(initial=0.0))) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


@dataclass
class Probes:
    """What is searched: the query of each probe, its label, the ends of its window, and the least score that can count."""

    query: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray

    def take(self, at: np.ndarray) -> Probes:
        return Probes(self.query[at], self.label[at], self.low[at], self.high[at], self.least[at])


NONE = np.iinfo(np.int64).min


class Best:
    """The first k rows of each probe, by score and then the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.hstack([self.score[at], score]), np.hstack([self.id[at], ids])
        order = np.lexsort((ids, ~score), axis=1)[:, : self.score.shape[1]]  # ~ turns the order of longs without overflow
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def firsts(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row; of equal ones the first."""
    n = score.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(score), 1))
    if np.abs(np.where(score == NONE, 0, score)).max(initial=0) < 2**62 // n:
        key = np.where(score == NONE, NONE, score * n + (n - 1 - np.arange(n)))
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.argsort(~score, axis=1, kind="stable")[:, :k]


def search(root: Node, norm: float, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, probes: Probes, k: int, *, same: bool) -> Best:
    """The first k points of each probe within its window, of its label or, unless same, of any other.

    ids are in order. The node that can hold the best of any probe comes first; a node
    goes on only with the probes whose windows it meets and whose k-th best it can beat.
    """
    best = Best(len(probes.query), k)
    lengths = np.linalg.norm(queries, axis=1)

    def meets(node: Node, at: np.ndarray) -> tuple[np.ndarray, float]:
        q = probes.query[at]
        low, high = bounds(node, queries[q], lengths[q], norm)
        floor = np.maximum(np.maximum(probes.low[at], probes.least[at]), best.score[at, -1])
        good = (high >= floor) & (low <= probes.high[at])
        return at[good], float(np.minimum(high, probes.high[at])[good].max(initial=-np.inf))

    heap: list = []
    at, first = meets(root, np.arange(len(probes.query)))
    if len(at):
        heap.append((-first, 0, root, at))
    pushed = 0
    while heap:
        _, _, node, at = heapq.heappop(heap)
        at, _ = meets(node, at)
        if node.children:
            for child in node.children:
                some, first = meets(child, at)
                if len(some):
                    pushed += 1
                    heapq.heappush(heap, (-first, pushed, child, some))
            continue
        members = np.sort(node.members)
        step = max(1, HELD // max(1, len(members)))
        for start in range(0, len(at), step):
            some = at[start : start + step]
            asked, place = np.unique(probes.query[some], return_inverse=True)
            score = products(queries[asked], points[members])[place]
            good = ((labels[members][None] == probes.label[some][:, None]) == same) & (score >= np.maximum(probes.low[some], probes.least[some])[:, None]) & (score <= probes.high[some][:, None])
            score = np.where(good, score, NONE)
            found = firsts(score, k)
            taken = np.take_along_axis(score, found, 1)
            best.add(some, taken, np.where(taken == NONE, np.iinfo(np.int64).max, ids[members][found]))
    return best
