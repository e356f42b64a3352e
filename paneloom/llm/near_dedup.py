"""Near-duplicate classes by improved consistent weighted sampling (Ioffe).

A text is a weighted set of shingles of five words. A shingle's weight is its count times
the mean inverse document frequency of its words. Samples of two sets agree with the
probability of their weighted Jaccard similarity, so texts that agree in all samples of a
band are candidates, and each candidate link is decided by the exact weighted similarity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import slices, waiting, written
from paneloom.llm.graph import components

#: Document frequencies below this share of all documents count as this share. So at most
#: (mean distinct words of a document) / RARE words have a frequency of their own: the
#: bound on what is collected and sent to the tasks.
RARE = 1e-3
#: Shingles whose samples are drawn at a time; these arrays stay in a core's cache.
TOGETHER = 65_536
#: Members of a star's group in one task.
SALT = 2_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def document_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Documents that contain each word; only words in at least RARE of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches):
            for raw in batch.column(0).to_pylist():
                seen.update(set(words_of(raw)))
            if len(seen) > 250_000:
                yield pa.record_batch({"word": pa.array(seen.keys(), pa.binary()), "df": pa.array(seen.values(), pa.int64())})
                seen.clear()
        yield pa.record_batch({"word": pa.array(seen.keys(), pa.binary()), "df": pa.array(seen.values(), pa.int64())})

    total = docs.count()
    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, df long")
    rows = found.groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") >= RARE * total).collect()
    return {bytes(r["word"]): r["df"] for r in rows} | {b"": total}


class Weights:
    """Weights of shingles: 1 to 2 times their count, as the words are frequent or rare."""

    def __init__(self, frequencies: dict[bytes, int], size: int = 5):
        self.size = size
        total = max(frequencies.get(b"", 1), 1)
        found = sorted((xxhash.xxh3_64_intdigest(w), 1 - math.log(total / df) / math.log(RARE)) for w, df in frequencies.items() if w)
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.idf = np.array([min(max(v, 1.0), 2.0) for _, v in found], np.float32)

    def shingles(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes in ascending order, and weights.

        A text of fewer words than a shingle has one shingle of all; one without a word has none.
        """
        words = words_of(raw)
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.float32)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        idf = np.full(len(h), 2.0, np.float32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            idf = np.where(self.hashes[at] == h, self.idf[at], idf)
        size = min(self.size, len(h))
        n = len(h) - size + 1
        key, weight = np.zeros(n, np.uint64), np.zeros(n, np.float32)
        for i in range(size):
            key = (key ^ h[i : i + n]) * _STEP
            key ^= key >> np.uint64(29)
            weight += idf[i : i + n]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(starts, n))
        return key[starts], (weight[order][starts] / np.float32(size) * counts).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    common = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return common / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - common)


class Sampler:
    """Consistent weighted samples, each kept as a 64-bit hash of (shingle, step).

    Gamma(2, 1) variates come from tables of quantiles, looked up by bits of a hash of
    shingle and sample. Equal values go to the smaller shingle hash, so texts agree.
    """

    def __init__(self, bands: int = 16, rows: int = 4, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.seeds = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)
        gamma = np.sort(rng.gamma(2, 1, 1 << 20)).astype(np.float32)
        self.r = np.maximum(gamma[128::256], np.float32(1e-3))
        self.ln_c = np.log(gamma[8::16])

    def band_keys(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of band keys for each set; no set may be empty."""
        out = np.empty((len(sets), self.bands), np.uint64)
        at = 0
        while at < len(sets):
            end, n = at, 0
            while end < len(sets) and (end == at or n + len(sets[end][0]) <= TOGETHER):
                n += len(sets[end][0])
                end += 1
            out[at:end] = self._some(sets[at:end])
            at = end
        return out

    def _some(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        key = np.concatenate([k for k, _ in sets])
        ln_s = np.log(np.concatenate([w for _, w in sets]))
        sizes = np.array([len(k) for k, _ in sets])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sets)), sizes)
        samples = np.empty((len(sets), len(self.seeds)), np.uint64)
        x, bits = np.empty_like(key), np.empty(len(key), np.int64)
        unsigned, signed = bits.view(np.uint64), x.view(np.int64)
        for k, seed in enumerate(self.seeds):
            np.bitwise_xor(key, seed, out=x)
            x *= _MIX
            np.right_shift(x, np.uint64(32), out=unsigned)
            x ^= unsigned
            x *= _STEP
            np.right_shift(x, np.uint64(52), out=unsigned)
            r = self.r[bits]
            np.right_shift(signed, 36, out=bits)
            bits &= 0xFFFF
            ln_a = self.ln_c[bits]
            np.right_shift(signed, 20, out=bits)
            bits &= 0xFFFF
            beta = bits.astype(np.float32)
            beta *= np.float32(1 / 65536)
            t = ln_s / r
            t += beta
            np.floor(t, out=t)
            # ln a = ln c - r (t - beta + 1)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            ln_a += beta
            hit = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, starts), sizes))
            own = owner[hit]
            hit = hit[np.concatenate(([True], own[1:] != own[:-1]))]
            samples[:, k] = (key[hit] + t[hit].astype(np.int64).view(np.uint64)) * _MIX
        bands = np.zeros((len(sets), self.bands), np.uint64)
        samples = samples.reshape(len(sets), self.bands, self.rows)
        for i in range(self.rows):
            bands = (bands ^ samples[:, :, i]) * _STEP
            bands ^= bands >> np.uint64(31)
        return (bands + np.arange(self.bands, dtype=np.uint64)) * _MIX


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """pairs (star, t) with their similarity, those of at least threshold.

    Members go to their star's group. A group of many members is cut by salt, each part
    with the star's text.
    """
    salts = written(pairs.groupBy("star").agg((F.floor(F.count("*") / SALT) + 1).cast("long").alias("salts")), "salts")
    sized = pairs.join(salts, "star")
    members = sized.select("t", "star", F.expr("pmod(xxhash64(t), salts)").alias("salt"), F.lit(1).alias("role"))
    stars = salts.select(F.col("star").alias("t"), "star", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("role"))
    rows = members.unionByName(stars).join(texts, "t").select("star", "salt", "role", "t", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in slices(batches):
            found = []
            for star, salt, role, t, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if role == 0:
                    group, own = (star, salt), weights.shingles(raw)
                elif (star, salt) == group and (s := similarity(own, weights.shingles(raw))) >= threshold - 1e-9:
                    found.append((star, t, s))
            yield pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["a", "b", "similarity"])

    return rows.repartition("star", "salt").sortWithinPartitions("star", "salt", "role").mapInArrow(check, "a long, b long, similarity double")


def cross_tested(state: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links between different components c of the same home, from state (home, t, c).

    Members outside a home's largest component are tested against all its members, in
    tiles of at most about OUTSIDE by MEMBERS, so a home of any size is spread over tasks.
    A tile's texts are cut into shingles once and only links leave it.
    """
    sizes = state.groupBy("home", "c").agg(F.count("*").alias("n"))
    homes = sizes.groupBy("home").agg(F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("n_all")).where("n_all > main.n")
    tiles = homes.select("home", F.col("main.c").alias("main_c"), (F.floor((F.col("n_all") - F.col("main.n")) / OUTSIDE) + 1).alias("rows"), (F.floor(F.col("n_all") / MEMBERS) + 1).alias("columns"))
    tiles = written(tiles, "tiles")
    there = state.join(tiles, "home")
    own_row, own_column = F.expr("pmod(xxhash64(t), rows)"), F.expr("pmod(xxhash64(t, 1), columns)")
    outside = there.where("c <> main_c").select("home", own_row.alias("row"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("column"), F.lit(0).alias("role"), "t", "c")
    members = there.select("home", F.explode(F.expr("sequence(0L, rows - 1)")).alias("row"), own_column.alias("column"), F.lit(1).alias("role"), "t", "c")
    dealt = outside.unionByName(members).join(texts, "t").select("home", "row", "column", "role", "t", "c", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, some, tables = None, [], None
        for batch in slices(batches):
            found = []
            for home, row, column, role, t, c, raw in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (home, row, column) != tile:
                    tile, some, tables = (home, row, column), [], None
                if role == 0:
                    some.append((t, c, weights.shingles(raw)))
                elif some:
                    tables = [Table(x) for x in parts(some)] if tables is None else tables
                    own = weights.shingles(raw)
                    found += [(star, t, sim) for table in tables for star, sim in table.alike(t, c, own, threshold)]
            yield pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["a", "b", "similarity"])

    keys = ["home", "row", "column"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(check, "a long, b long, similarity double")


#: Texts outside the largest component, and members, in a tile.
OUTSIDE, MEMBERS = 512, 2_048
#: Entries of a table of weights.
ENTRIES = 2_000_000


def parts(some: list[tuple]) -> Iterator[list[tuple]]:
    """Lists of texts whose table of weights stays under ENTRIES, or of one text."""
    part, keys = [], 0
    for x in some:
        n = len(x[2][0])
        if part and (len(part) + 1) * (keys + n) > ENTRIES:
            yield part
            part, keys = [], 0
        part.append(x)
        keys += n
    yield part


class Table:
    """Weights of some texts (t, c, shingles) by shingle, to compare one text with all of them."""

    def __init__(self, some: list[tuple]):
        self.t, self.c = np.array([x[0] for x in some]), np.array([x[1] for x in some])
        self.keys = np.unique(np.concatenate([x[2][0] for x in some]))
        self.weights = np.zeros((len(self.keys), len(some)), np.float32)
        for i, (_, _, (keys, w)) in enumerate(some):
            self.weights[np.searchsorted(self.keys, keys), i] = w
        self.totals = self.weights.sum(0, dtype=np.float64)

    def alike(self, t: int, c: int, own: tuple[np.ndarray, np.ndarray], threshold: float) -> list[tuple[int, float]]:
        keys, w = own
        if not len(keys) or not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        both = self.keys[at] == keys
        common = np.minimum(self.weights[at[both]], w[both, None]).sum(0, dtype=np.float64)
        sims = common / (self.totals + float(w.sum(dtype=np.float64)) - common)
        hits = np.flatnonzero((sims >= threshold - 1e-9) & (self.c != c) & (self.t != t))
        return [(int(self.t[i]), float(sims[i])) for i in hits]


def links(buckets: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All links (a, b, similarity) that decide the classes of the buckets (bucket, t, its size n), and labels (t, c).

    Testing all pairs of a bucket would grow with its square. First each bucket's star is
    tested against its members: the text that meets most others, which of edited copies
    is mostly the one they were made from. Most buckets are one component then. Members of
    the others meet at their star, once however many buckets they share, and all pairs of
    different components are tested there. So no link that joins two components is
    missed, and no bucket is capped.
    """
    scores = buckets.groupBy("t").agg(F.sum("n").alias("score"))
    best = F.min(F.struct(-F.col("score"), "t")).alias("s")
    stars = written(buckets.join(scores, "t").groupBy("bucket").agg(best).select("bucket", F.col("s.t").alias("star")), "stars")
    pairs = written(buckets.join(stars, "bucket").where("t <> star").select("star", "t").distinct(), "pairs")
    found = written(verified(pairs, texts, weights, threshold), "links")
    labels = components(found)
    state = buckets.join(labels, "t", "left").join(stars, "bucket").where("t <> star").select("bucket", "star", "t", F.coalesce("c", "t").alias("c"))
    mixed = written(state.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    state = written(state.join(mixed, "bucket").select(F.col("star").alias("home"), "t", "c").distinct(), "open")
    more = written(cross_tested(state, texts, weights, threshold), "cross-links")
    if more.limit(1).count():
        found = found.union(more)
        labels = components(found)
    return found, labels


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, words: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """docs with class_id, class_key, is_first, class_size, n_copies and n_links.

    Texts of one class are connected by links of at least threshold; equal texts are one
    text with n_copies rows. class_id is the class's least doc_id (null if it has none),
    class_key a number that is unique to the class, is_first marks one text's rows with
    that doc_id. n_links counts tested links of the text to different texts; links inside
    a class that were not needed to find it are not counted. A null text and one without
    a word are alike to none, and each such row is first in a class of its own with a
    null class_key. Columns of these names are replaced; an empty table gives no rows.
    """
    docs, named = waiting(docs, "doc_id", "text")
    weights = Weights(document_frequencies(docs), words)
    sampler = Sampler(bands, rows)
    key = F.unhex(F.md5(F.col("text").cast("binary"))).alias("_key")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [weights.shingles(raw) for raw in batch.column(2).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s[0])]
            keys = sampler.band_keys([sets[i] for i in some]).view(np.int64) if some else np.empty((0, bands), np.int64)
            take = pa.array(some, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([r.tobytes() for r in keys], pa.binary())],
                names=["_key", "doc_id", "bands"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.where("text is not null").select(key, "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(sign, f"_key binary, doc_id {id_type}, bands binary")
    distinct = signed.groupBy("_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    known = written(distinct.withColumn("t", F.monotonically_increasing_id()), "signatures")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.record_batch({"bucket": keys, "t": np.repeat(batch.column(0).to_numpy(), bands)})

    entries = written(known.select("t", "bands").mapInArrow(dealt, "bucket long, t long"), "buckets")
    # Joins of a hot bucket with a table, not with a sum, can be split over tasks.
    shared = written(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    buckets = written(entries.join(shared, "bucket"), "shared-buckets")
    near = known.join(buckets.select("t").distinct(), "t").select("t", "_key", "first_id")
    source = docs.select(key, "doc_id", F.col("text").cast("binary").alias("text"))
    texts = source.join(near, (source["_key"] == near["_key"]) & source["doc_id"].eqNullSafe(near["first_id"])).select("t", "text")
    texts = written(texts.dropDuplicates(["t"]) if has_repeats(known, docs) else texts, "texts")
    found, labels = links(buckets, texts, weights, threshold)
    ends = found.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("n_links"))
    classed = (
        known.select("_key", "first_id", "n_copies", "t")
        .join(labels, "t", "left")
        .join(ends, "t", "left")
        .select("_key", "first_id", "n_copies", "t", F.coalesce("c", "t").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    classes = classed.groupBy("class_key").agg(F.sum("n_copies").alias("class_size"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "t")).alias("best"))
    members = (
        classed.join(classes, "class_key")
        .select("_key", "class_key", "class_size", "n_copies", "n_links", F.col("best.first_id").alias("class_id"), (F.col("best.t") == F.col("t")).alias("_best"))
    )
    joined = docs.withColumn("_key", key).join(members, "_key", "left")
    alone = F.col("class_key").isNull()
    return named(joined.select(
        *docs.columns,
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_key",
        (alone | (F.col("_best") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("is_first"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    ))


def has_repeats(known: DataFrame, docs: DataFrame) -> bool:
    """Whether some doc_id is there more than once, or null."""
    one = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    return one["n"] != one["ids"]


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with the columns of docs."""
    docs, named = waiting(docs, "doc_id", "text")
    found = near_duplicates(docs, **options).where("is_first")
    if has_repeats(None, docs):
        lone = found.where("class_key is null")
        found = lone.unionByName(found.where("class_key is not null").dropDuplicates(["class_key"]))
    return named(found.select(*docs.columns))
