"""Mixing, the conversation trie and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.llm import cover_tree, hard_negatives, mixing, prefix_trie

DOCS = "doc_id long, text string, source string, key string, size string, target string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], DOCS)


def targets_by_rounds(sizes, weights, share, most):
    """Shares by weight, what is over a source's most handed to the others, until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while open_ := [s for s in names if s not in full]:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
    return full


def test_mix(spark):
    rng = random.Random(3)
    sources = ["a", "b", "é", "\U0001f600", None]
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), sources[min(i % 11, 4)]) for i in range(600)]
    rows += [(None, "w w", "a"), (900, None, "b"), (901, "", None), (902, " \t\n ", "a"), (903, "w " * 1_200, "b"), (904, " 　 w", "z0")]
    rows += [(1000 + i, "same size here", "é") for i in range(300)] + rows[:3]
    got = mixing.mix(documents(spark, rows), weights=(5, 2, 1), share=1.5, most=2.0).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len([w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    wanted = targets_by_rounds(sizes, (5, 2, 1), 1.5, 2.0)
    of = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        source = of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(wanted[source], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[source] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 5 for s in wanted), (taken, wanted)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7), weights=(5, 2, 1), share=1.5, most=2.0).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["copies"])
    assert [(r["doc_id"], r["copies"]) for r in sorted(got, key=key)] == [(r["doc_id"], r["copies"]) for r in sorted(again, key=key)]


def test_rates_are_those_of_least_entropy(spark):
    """Rates solve the constraint and are exp(one multiplier x words), cut at the cap."""
    rows = [(i, "w " * (1 + i % 40), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(documents(spark, rows), weights=(1, 3), share=1.2, most=2.0).collect()
    for s in "ab":
        own = [r for r in got if "ab"[r["doc_id"] % 2] == s]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-6)
        at = {round(math.log(r["rate"]) / r["size"], 9) for r in own if r["rate"] < 2}
        assert len(at) <= 1


def test_mix_of_little(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    got = mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}
    docs = documents(spark, [(1, "w w", "a"), (2, "w", "b")])
    found = mixing.mix(docs, weights=(1,), share=2.0)
    assert Counter(r["doc_id"] for r in mixing.mixed(docs, found).collect()) == {1: 2, 2: 2}


TURNS = "conv_id long, turn long, role string, text string, prefix string, d string"


def plain_trie(rows, block, heads):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16], (r, t)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = turns.get(c - int(math.fmod(c, block)), [])[:h] + own[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[: d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]) if n in children else 0, leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def tries(found):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in found.collect())


@pytest.mark.parametrize("longest", [0, 1, 2, 9, 70])
def test_trie(spark, longest):
    rng = random.Random(longest)
    rows = []
    for c in [*range(60), 100, 107, 230, 350, -5, -103]:
        n = rng.randint(0, longest) if c % 7 else longest
        rows += [(c, rng.choice([i, i, None]) if i < 2 else i, rng.choice(["user", "é", None]), rng.choice(["", None, "hé", "a" * 3000]) if rng.random() < 0.5 else "same") for i in range(n)]
    rows += rows[:4] + [(None, 1, "user", "lost")]
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "p", "q") for r in rows], TURNS))
    assert tries(got) == plain_trie(rows, 100, 6)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(7, i, "user", str(i % 50)) for i in range(1500)] + [(c, i, "user", "x" * i) for c in range(1000, 6000) for i in range(2)]
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "p", "q") for r in rows], TURNS))
    assert tries(got) == plain_trie(rows, 100, 6)


def test_empty_trie(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, block string, v string, id string"


def plain_negatives(rows, every):
    good = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, va, ka in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, k) for i, v, k in good)
        for s, p, _ in [x for x in scored if x[2] == ka and x[1] != a][:5]:
            negatives = [x for x in scored if x[2] != ka and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out |= {(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(negatives, 1)}
    return out


def negatives(spark, rows, every):
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % every == 0).collect()
    assert len(set(found)) == len(found)
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found}


@pytest.mark.parametrize("block", [8192, 20])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=5)).round(2 if i % 3 else 0).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(400 + i, [1.0, 1.0, 0.0, 0.0, 0.5], i % 2) for i in range(40)] + [(500 + i, [1.0, 0.75, 0.0, 0.0, 0.5], 2) for i in range(20)]
    rows += [(900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0], 1), (902, [math.nan] * 5, 1), (903, [math.inf] * 5, 0), (904, [1.0] * 5, None), (None, [1.0] * 5, 1), (910, [0.0] * 5, 1), (920, [1.0], 2), (930, [], 0), (940, [-1.0] * 5, 1)]
    rows += rows[:7] + [(3, [1.0] * 5, 1)]
    assert negatives(spark, rows, 10) == plain_negatives(rows, 10)


def test_large_components_and_little(spark):
    rows = [(0, [1e6, 1.0], 0), (1, [1e6, 3.0], 0), (2, [0.7e6, -5.0], 1), (3, [0.7e6, 5.0], 1), (4, [1e6, 1.0], 1), (5, [0.7e6, -6.0], 0)]
    assert negatives(spark, rows, 4) == plain_negatives(rows, 4) != set()
    assert negatives(spark, [(i, [1e30 * (i + 1)], i % 2) for i in range(5)], 2) == set()
    assert negatives(spark, [], 2) == set()
    assert negatives(spark, [(0, [1.0], 1)], 2) == set()


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(5, 3))[rng.integers(5, size=900)] + 0.05 * rng.normal(size=(900, 3)), np.ones((200, 3))])
    norm = float(np.linalg.norm(points, axis=1).max())
    root = cover_tree.grown(cover_tree.augmented(points, norm), leaf=10)
    found = cover_tree.leaves(root)
    assert sorted(np.concatenate([n.members for n in found])) == list(range(len(points))) and len(found) > 20
    queries = rng.normal(size=(7, 3))
    for n in found:
        low, high = cover_tree.bounds(n, queries, np.linalg.norm(queries, axis=1), norm)
        at = queries @ points[n.members].T
        assert (at >= low[:, None]).all() and (at <= high[:, None]).all()
