"""Exact removal of repeated byte strings with column-wise suffix sorting.

One suffix array over all text would need as many rounds as the longest document has
bytes, each over the whole collection. Repeats of a fixed length do not need it: two equal
strings of length bytes choose the same anchor, the k-gram of the least hash in them, at
the same place. So the collection is cut at its anchors. An anchor's passage is the text of
all strings that chose it; passages that share the anchor's fingerprint meet in one task,
aligned at the anchor, and there the collection Burrows-Wheeler transform and the common
prefixes are built column by column: each round inserts one symbol of each passage, from
the right end to the left. A string is repeated exactly if a neighbour in suffix order has
a common prefix of length bytes with it.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.common import slices, waiting, written

GRAM = 32
#: Texts are worked on in pieces of at most so many bytes, several short ones at a time.
SEGMENT, TOGETHER = 1 << 22, 1 << 18
PLACE_BITS = 25
#: Distinct passages that are sorted at a time; a fingerprint's passages stay together.
COLLECTION = 8_000
#: Starts in a block of a passage with a very frequent fingerprint.
BLOCK = 64
#: Bytes that stand for a word where passages are counted in words.
CODE = 2

SPANS = "array<struct<start: long, end: long>>"

_PLACES = np.uint64((1 << PLACE_BITS) - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.array([not _SPACE.match(bytes([b])) for b in range(256)])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM consecutive bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size, base = 1, np.array([0xD6E8FEB86659FD93], np.uint64)
    while size < GRAM:
        h = h[:-size] * base + h[size:]
        size, base = 2 * size, base * base
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) of at least length bytes, in lists worked on at a time."""
    some, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[at : at + SEGMENT + length - 1]
            if len(piece) >= length:
                some.append((i, at, piece))
                size += len(piece)
            if size >= TOGETHER:
                yield some
                some, size = [], 0
    if some:
        yield some


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all texts: fingerprint, text, anchor's place, first and last start.

    Each start of a string of length bytes belongs to one anchor of its text.
    """
    found: list[tuple[np.ndarray, ...]] = []
    width = length - GRAM + 1
    for some in pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in some), np.uint8)
        hashes = gram_hashes(data)
        at = np.arange(len(hashes), dtype=np.uint64)
        # the least hash, and of equal ones the last
        least = sliding_min((hashes & ~_PLACES) | (_PLACES - at), width)
        chosen = (_PLACES - (least & _PLACES)).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in some])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(some)), sizes)[: len(chosen)]
        starts = np.arange(len(chosen))
        inside = starts + length <= ends[owner]
        new = np.empty(len(chosen), bool)
        new[0] = True
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(chosen)) - 1
        ok = inside[first]
        first, last = first[ok], last[ok]
        own = owner[first]
        shift = np.array([a for _, a, _ in some])[own] - (ends - sizes)[own]
        place = chosen[first]
        found.append((hashes[place].view(np.int64), np.array([i for i, _, _ in some])[own], place + shift, first + shift, last + shift))
    return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(5))


def repeated_starts(passages: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each (bytes, anchor's place in them): the starts of strings of length bytes that start in another passage too.

    Rows are passages, columns places before or after the anchor. order holds the
    passages in the order of their suffixes from the current column on, common the
    common prefix of each with the one before it, at most length. Symbol 0 stands
    outside a passage and equals nothing, as an end marker does.
    """
    m = len(passages)
    left = max(a for _, a in passages)
    right = max(len(p) - a for p, a in passages)
    columns = np.zeros((m, left + right), np.uint16)
    for i, (p, a) in enumerate(passages):
        columns[i, left - a : left - a + len(p)] = np.frombuffer(p, np.uint8)
    for i, (p, a) in enumerate(passages):
        columns[i, left - a : left - a + len(p)] += 1
    columns = np.ascontiguousarray(columns.T)
    order, common = np.arange(m), np.zeros(m + 1, np.int16)
    starts = left + right - length + 1
    marked = np.zeros((max(starts, 0), m), bool)
    for column in range(left + right - 1, -1, -1):
        transform = columns[column][order]  # the symbols before the sorted suffixes
        moved = np.argsort(transform, kind="stable")
        symbols = transform[moved]
        longer = np.zeros(m + 1, np.int16)
        k = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] != 0)) + 1
        if len(k):
            here, before = moved[k], moved[k - 1]
            shared = common[here]
            far = np.flatnonzero(here != before + 1)
            if len(far):
                between = np.empty(2 * len(far), np.int64)
                between[::2], between[1::2] = before[far] + 1, here[far] + 1
                shared[far] = np.minimum.reduceat(common, between)[::2]
            longer[k] = np.minimum(shared + 1, length)
        order, common = order[moved], longer
        if column < starts:
            full = common == length
            marked[column, order] = full[:-1] | full[1:]
    return [np.flatnonzero(marked[:, i]) - (left - a) for i, (_, a) in enumerate(passages)]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered places, as (first, end), of strings of length bytes at ascending starts."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length) + 1
    firsts, lasts = starts[np.append(0, gaps)], starts[np.append(gaps - 1, len(starts) - 1)]
    return list(zip(firsts.tolist(), (lasts + length).tolist(), strict=True))


def united(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Spans in order of their starts, those that meet as one."""
    merged: list[list[int]] = []
    for s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return merged


def whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span with both ends moved outward past the bytes of a UTF-8 character that they split."""
    while 0 < start < len(raw) and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def repeated_spans(keyed: DataFrame, length: int, hot: int) -> DataFrame:
    """_k1, _k2 and the starts and ends, ascending, of what repeats in the texts beside these keys.

    Spans of a text may meet or overlap. Texts without any are left out.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    if length > 1000:
        raise ValueError("length must be at most 1000: a place in a passage has ten bits")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, row, place, first, last = anchors(batch.column(2).to_pylist(), length)
            if len(prints):
                k1, k2 = (batch.column(k).to_numpy()[row] for k in (0, 1))
                yield pa.record_batch({"print": prints, "k1": k1, "k2": k2, "place": (place << 20) | ((place - first) << 10) | (place - last)})

    found = written(keyed.where(F.octet_length("text") >= length).select("_k1", "_k2", text.alias("text")).mapInArrow(find, "print long, k1 long, k2 long, place long"), "anchors")
    # As a table it joins the anchors of a very frequent fingerprint in parts.
    repeated = written(found.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")
    # As a table it leaves the shuffles of all anchors behind before texts move.
    placed = written(
        found.join(repeated.select("print", (F.col("n") > hot).alias("hot")), "print")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("print", "place", "hot")).alias("places"))
        .withColumns({"prints": F.col("places.print"), "at": F.col("places.place"), "is_hot": F.col("places.hot")})
        .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "prints", "at", "is_hot"),
        "placed-anchors",
    )
    # All columns, as the caller's join takes them: equal shuffles by equal keys move the texts once.
    beside = keyed.join(placed, ["_k1", "_k2"])
    beside = beside.select("_k1", "_k2", text.alias("text"), "prints", "at", "is_hot", *[c for c in keyed.columns if c not in ("_k1", "_k2", "text")])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal passages of a batch go out once, with all their places."""
        for batch in slices(batches, 1024):
            equal: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
            for k1, k2, raw, prints, at, is_hot in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for p, where, h in zip(prints, at, is_hot, strict=True):
                    place, before, after = where >> 20, (where >> 10) & 1023, where & 1023
                    first, last = place - before, place - after
                    if not h:
                        equal[p, before, raw[first : last + length]].append((k1, k2, first))
                        continue
                    for block in range(after // BLOCK, before // BLOCK + 1):
                        point = place - block * BLOCK
                        low, high = max(first, point - BLOCK + 1), min(last, point)
                        inner = hashlib.blake2b(raw[point : point - BLOCK + 1 + length], digest_size=8, salt=block.to_bytes(2, "little")).digest()
                        equal[int.from_bytes(inner, "little", signed=True), point - low, raw[low : high + length]].append((k1, k2, low))
            yield pa.record_batch(
                {
                    "digest": pa.array([hashlib.blake2b(k[2], digest_size=16, salt=k[0].to_bytes(8, "little", signed=True) + k[1].to_bytes(8, "little")).digest() for k in equal], pa.binary()),
                    "print": pa.array([k[0] for k in equal], pa.int64()),
                    "before": pa.array([k[1] for k in equal], pa.int64()),
                    "passage": pa.array([k[2] for k in equal], pa.binary()),
                    "owners": pa.array([np.array(v, np.int64).tobytes() for v in equal.values()], pa.binary()),
                }
            )

    # Cut twice from the moved texts, which takes less disk than a table of passages.
    out = beside.mapInArrow(passages, "digest binary, print long, before long, passage binary, owners binary")
    # Distinct passages are sorted without their owners, however many these are.
    distinct = out.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("print", "before", "passage")], (F.sum(F.octet_length("owners")) > 24).alias("copied"))
    crowded = None
    if repeated.where(F.col("n") > hot).limit(1).count():
        distinct = written(distinct, "distinct-passages")
        many = distinct.groupBy("print").count().where(F.col("count") > hot).select("print")
        if many.limit(1).count():
            crowded, distinct = out.join(many, "print", "left_semi"), distinct.join(many, "print", "left_anti")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans within each passage: all of one with several owners, else its strings that another has."""

        def told(several: list[tuple[bytes, int, bytes, bool]]) -> pa.RecordBatch:
            alone = repeated_starts([(p, a) for _, a, p, _ in several], length) if len(several) > 1 else [np.empty(0, np.int64)] * len(several)
            rows = [(d, start, end) for (d, _, p, copied), s in zip(several, alone, strict=True) for start, end in ([(0, len(p))] if copied else runs(s, length))]
            return pa.record_batch({"digest": pa.array([r[0] for r in rows], pa.binary()), "start": pa.array([r[1] for r in rows], pa.int64()), "end": pa.array([r[2] for r in rows], pa.int64())})

        several, mine, last = [], [], None
        for batch in batches:
            for p, *passage in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if p != last:
                    several += mine if len(mine) > 1 or mine and mine[0][3] else []
                    mine = []
                    if len(several) >= COLLECTION:
                        yield told(several)
                        several = []
                    last = p
                mine.append((passage[0], passage[1], passage[2], passage[3]))
        several += mine if len(mine) > 1 or mine and mine[0][3] else []
        yield told(several)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices([batch], 64):
                owners = few.column(0).to_pylist()
                rows = np.frombuffer(b"".join(owners), np.int64).reshape(-1, 3)
                each = [len(o) // 24 for o in owners]
                start, end = (np.repeat(few.column(k).to_numpy(), each) for k in (1, 2))
                yield pa.record_batch({"k1": rows[:, 0], "k2": rows[:, 1], "start": rows[:, 2] + start, "end": rows[:, 2] + end})

    sorted_ = distinct.select("print", "digest", "before", "passage", "copied").repartition("print").sortWithinPartitions("print").mapInArrow(sort, "digest binary, start long, end long")
    spans = out.select("digest", "owners").join(sorted_, "digest").select("owners", "start", "end").mapInArrow(owned, "k1 long, k2 long, start long, end long")
    if crowded is not None:

        def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for passage, owners in zip(batch.column(batch.schema.get_field_index("passage")).to_pylist(), batch.column(batch.schema.get_field_index("owners")).to_pylist(), strict=True):
                    for s in range(len(passage) - length + 1):
                        rows.append((hashlib.blake2b(passage[s : s + length], digest_size=16).digest(), s, owners))
                yield pa.record_batch(
                    {"string": pa.array([r[0] for r in rows], pa.binary()), "s": pa.array([r[1] for r in rows], pa.int64()), "owners": pa.array([r[2] for r in rows], pa.binary())}
                )

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owners = batch.column(1).to_pylist()
                rows = np.frombuffer(b"".join(owners), np.int64).reshape(-1, 3)
                start = rows[:, 2] + np.repeat(batch.column(0).to_numpy(), [len(o) // 24 for o in owners])
                yield pa.record_batch({"k1": rows[:, 0], "k2": rows[:, 1], "start": start, "end": start + length})

        one = crowded.mapInArrow(singly, "string binary, s long, owners binary")
        twice = one.groupBy("string").agg(F.sum(F.octet_length("owners")).alias("n")).where("n > 24").drop("n")
        spans = spans.unionByName(one.join(twice, "string").select("s", "owners").mapInArrow(alone, "k1 long, k2 long, start long, end long"))
    spans = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    return spans.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("found.start").alias("starts"), F.col("found.end").alias("ends"))


def between_words(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(text, bytes) in lists worked on at a time; long texts are cut at white space."""
    some, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at <= len(text):
            space = _SPACE.search(text, at + SEGMENT)
            end = space.start() if space else len(text)
            some.append((i, text[at:end]))
            at, size = end + 1, size + end - at
            if size >= TOGETHER:
                yield some
                some, size = [], 0
    if some:
        yield some


def word_codes(texts: list[bytes]) -> list[bytes]:
    """CODE bytes for each word of a text, by the word's hash; only a code's first byte is under 128."""
    coded: list[list[bytes]] = [[] for _ in texts]
    for some in between_words(texts):
        raw = b" ".join((b"", *(p for _, p in some), bytes(8)))
        inside = _IN_WORD[np.frombuffer(raw, np.uint8)[:-8]]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, sizes = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        h = sizes.astype(np.uint64)
        long = np.flatnonzero(sizes > 64)
        rest = np.flatnonzero(sizes <= 64)
        for k in range(0, 64, 8):  # eight bytes of all words that have them
            mixed = (h[rest] ^ (eight[first[rest] + k] & _MASKS[np.minimum(sizes[rest] - k, 8)])) * np.uint64(0x9E3779B97F4A7C15)
            h[rest] = mixed ^ (mixed >> np.uint64(32))
            rest = rest[sizes[rest] > k + 8]
            if not len(rest):
                break
        for w in long:
            h[w] = int.from_bytes(hashlib.blake2b(raw[first[w] : first[w] + sizes[w]], digest_size=8).digest(), "little")
        h *= np.uint64(0x94D049BB133111EB)
        codes = np.stack([(h >> np.uint64(57 - 7 * k)).astype(np.uint8) & 127 | (128 if k else 0) for k in range(CODE)], axis=1).tobytes()
        upto = CODE * np.searchsorted(first, np.cumsum([len(p) + 1 for _, p in some]))
        for (i, _), start, end in zip(some, (0, *upto[:-1]), upto, strict=True):
            coded[i].append(codes[start:end])
    return [b"".join(c) for c in coded]


def repeated_passages(keyed: DataFrame, over: int, hot: int) -> DataFrame:
    """_k1, _k2, n_passages and n_passage_words of the texts beside these keys; texts without passages are left out.

    A passage is a maximal run of words in strings of over + 1 words that start elsewhere
    too, whatever white space parts the words. Texts become strings of word codes, in which
    the same search finds them; words with one code, 7 * CODE bits of a hash, count as equal.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(word_codes(batch.column(2).to_pylist()), pa.binary())], names=["_k1", "_k2", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k1, k2, starts, ends = (batch.column(k).to_pylist() for k in range(4))
            # parts of codes at either end are not words
            words = [[e // CODE + -s // CODE for s, e in united(zip(*x, strict=True))] for x in zip(starts, ends, strict=True)]
            words = [[n for n in x if n > over] for x in words]
            yield pa.record_batch({"_k1": pa.array(k1, pa.int64()), "_k2": pa.array(k2, pa.int64()), "n_passages": pa.array([len(x) for x in words], pa.int64()), "n_passage_words": pa.array([sum(x) for x in words], pa.int64())})

    text = F.col("text").cast("binary")
    coded = keyed.where(F.octet_length("text") > 2 * over).select("_k1", "_k2", text.alias("text")).mapInArrow(encode, "_k1 long, _k2 long, text binary")
    found = repeated_spans(coded, CODE * (over + 1), hot).mapInArrow(count, "_k1 long, _k2 long, n_passages long, n_passage_words long")
    return written(found.where("n_passages > 0"), "word-passages")


def remove_repeats(docs: DataFrame, *, length: int = 400, hot: int = 100_000, min_words: int = 0, characters: bool = False, passages_over: int | None = None) -> DataFrame:
    """docs with n_bytes, spans (array of start, end) and kept (the remaining bytes).

    A byte goes if a string of length bytes that covers it starts anywhere else too, in
    the same text or another; overlaps count, and strings are judged on the input. A null
    text is empty. Rows that repeat, ids included, are texts of their own. Texts shorter
    than length keep all bytes. Columns named n_bytes, spans or kept are replaced.

    With min_words, maximal runs of fewer words, parts of words at either end included,
    stay. With characters, a character that a run's end splits goes with the run, so that
    what is left of UTF-8 text is UTF-8.

    With passages_over, n_passages and n_passage_words tell of passages of more words than
    that which repeat, however few bytes they have, see repeated_passages. They stay in kept.

    A fingerprint with more than hot anchors does not go to one task. Its passages are cut
    into blocks of BLOCK starts, which meet by a hash of what all strings of a block have
    in common, so that only strings nearly equal still meet. If more than hot of those do,
    each string goes by a 128-bit hash of its own, counted in part before the shuffle.
    """
    docs, named = waiting(docs, "doc_id", "text")
    names = docs.columns
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select("*", F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", "doc_id", F.lit(7)).alias("_k2"))
    counts = ["n_passages", "n_passage_words"] if passages_over is not None else []
    passages = repeated_passages(keyed, passages_over, hot) if counts else None
    spans = repeated_spans(keyed, length, hot)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(", ".join([f"n_bytes long, spans {SPANS}, kept binary", *(f"{c} long" for c in counts)])).fields])
    spans_arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws, all_spans, kept = batch.column(len(names)).to_pylist(), [], []
            for raw, starts, ends in zip(raws, *(batch.column(len(names) + k).to_pylist() for k in (1, 2)), strict=True):
                merged = united(zip(starts or (), ends or (), strict=True))
                if min_words:
                    merged = [m for m in merged if len(raw[m[0] : m[1]].split()) >= min_words]
                if characters:
                    merged = united(whole_characters(raw, s, e) for s, e in merged)
                edges = [0, *(x for pair in merged for x in pair), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                all_spans.append([{"start": s, "end": e} for s, e in merged])
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array([len(r) for r in raws], pa.int64()), pa.array(all_spans, spans_arrow), pa.array(kept, pa.binary())]
            columns += [batch.column(len(names) + 3 + i) for i in range(len(counts))]
            yield pa.record_batch(columns, names=[*names, "n_bytes", "spans", "kept", *counts])

    found = keyed.join(spans, ["_k1", "_k2"], "left")
    if counts:
        found = found.join(passages, ["_k1", "_k2"], "left")
    return named(found.select(*names, text.alias("_raw"), "starts", "ends", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).mapInArrow(merge, schema))
