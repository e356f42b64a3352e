"""Class-based bigram language model with classes from the exchange algorithm.

The probability of a token is that of its class after the class before it, times that of
the word within its class. Classes come from exchange clustering: words move to the class
where the likelihood of all class bigrams is largest. First the most frequent words and the
endings of all others are exchanged one at a time on a small table. Then the CORE most
frequent words and the endings move in parallel rounds over their counted neighbours, and
last every other word moves by its own neighbours over all training text. Tasks and driver
hold tables of fixed sizes only; the counts in them cover all training text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import slices, waiting, written

#: The end of a text as a word; no word is empty.
END = b""
#: Symbols: the end, CORE words, GROUPS word endings and one for all other words.
CORE, GROUPS = 20_000, 300
#: Words that are exchanged one at a time with the endings before the rounds.
FIRST = 500
#: Words whose counts every task holds; the counts of others are joined.
HEAD = 100_000
#: Distinct words, or numbers, that a task holds at a time.
HELD, PAIRS = 400_000, 4_000_000
#: Pairs of a word and a class beside it that a task holds before they are merged or told.
KEYS = 2_000_000
#: Rounds end when one adds less than this share of the first classes' likelihood.
GAIN = 0.01
#: What stands for the class of a word outside the head.
RARE = 255


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, then the end."""
    return [*(raw or b"").lower().split(), END]


def ending(word: bytes) -> bytes:
    """A word's last mark, if it is one, and the two bytes before it."""
    mark = word[-1:] if word[-1:] in (b".", b",", b"!", b"|", b"*", b"&", b"%", b"$", b"#") else b"-"
    return mark + word.rstrip(b".,!|*&%$#")[-2:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(seen.keys(), pa.binary()), "c": pa.array(seen.values(), pa.int64())})

        for batch in slices(batches):
            for raw in batch.column(0).to_pylist():
                seen.update(tokens(raw))
            if len(seen) > HELD:
                yield told()
                seen.clear()
        yield told()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols(dict):
    """Codes by word: the place of a head word, else -1 - the symbol of the word's ending."""

    def __init__(self, head: list[bytes], groups: list[bytes], core: int):
        super().__init__((w, i) for i, w in enumerate(head))
        self.head, self.core = head, core
        own = [w for w in head if w != END][:core]
        self.n_own = len(own)
        self.group = {g: 1 + len(own) + i for i, g in enumerate(groups)}
        self.other = 1 + len(own) + len(groups)
        self.size = self.other + 1
        self.own = {w: 1 + i for i, w in enumerate(own)} | {END: 0}
        #: The symbol of each head word.
        self.of_head = np.array([self.symbol(w) for w in head], np.int32)

    def __reduce__(self):
        return Symbols, (self.head, list(self.group), self.core)

    def symbol(self, word: bytes) -> int:
        own = self.own.get(word)
        return self.group.get(ending(word), self.other) if own is None else own

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD + HEAD:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.head))
        code = self[word] = -1 - self.symbol(word)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def small(self, first: int) -> tuple[np.ndarray, int]:
        """The symbol of each symbol when only the first words have their own, and how many there are."""
        words = [w for w in self.own if w != END]
        groups = 1 + min(first, self.n_own)
        of = [0, *(1 + i if i < first else groups + self.group.get(ending(w), self.other) - 1 - self.n_own for i, w in enumerate(words))]
        return np.array([*of, *range(groups, groups + self.size - 1 - self.n_own)], np.int64), groups + self.size - 1 - self.n_own


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    return float(f(table).sum() - f(table.sum(0)).sum() - f(table.sum(1)).sum())


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """A class for each symbol; symbol 0 keeps class 0 to itself.

    In each pass every symbol, most frequent first, leaves its class for the one where the
    sum of n log n over class bigrams, less that over class counts on either side, is
    largest. A pass without a move is the last.
    """
    size = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    order = order[order != 0]
    of = np.zeros(size, np.int64)
    of[order] = 1 + np.arange(len(order)) % max(classes - 1, 1)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    table = member.T @ bigrams @ member
    least = 1e-9 + 1e-11 * float(f(bigrams.sum()))  # over the rounding of the sums, so that passes end
    moved = 1
    while moved:
        moved = 0
        for w in order.tolist():
            old = of[w]
            member[w, old] = 0
            after, before, twice = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= twice
            rows, columns, same = table.sum(1) + before, table.sum(0) + after, np.diag(table)
            gain = (f(table + after) - f(table)).sum(1) - (f(same + after) - f(same))
            gain += (f(table + before[:, None]) - f(table)).sum(0) - (f(same + before) - f(same))
            gain += f(same + after + before + twice) - f(same)
            out, into = after.sum() + twice, before.sum() + twice
            gain -= f(rows + out) - f(rows) + f(columns + into) - f(columns)
            gain[0] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + least else old
            member[w, new] = 1
            of[w] = new
            table[new] += after
            table[:, new] += before
            table[new, new] += twice
            moved += new != old
    return of


def encoded(docs: DataFrame, names: list[str], symbols: Symbols) -> DataFrame:
    """The columns names of docs, a number for each row (_row), and the text as codes.

    _codes has a code of 4 bytes for each token: a head word's, or -1 - i for word i of
    _words, the text's words outside the head. _tf counts those and _symbols has the symbol
    of each in 4 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for raw in batch.column(0).to_pylist():
                words = tokens(raw)
                codes = symbols.codes(words)
                at = np.flatnonzero(codes < 0)
                own: dict[bytes, int] = {}
                places = np.fromiter((own.setdefault(words[i], len(own)) for i in at.tolist()), np.int64, len(at))
                of = np.zeros(len(own), "<i4")
                of[places] = -1 - codes[at]
                codes[at] = -1 - places
                rows.append((len(words), codes.astype("<i4").tobytes(), list(own), np.bincount(places, minlength=len(own)).astype(np.int32), of.tobytes()))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            yield pa.record_batch([*batch.columns[1:], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[*names, "n_tokens", "_codes", "_words", "_tf", "_symbols"])

    source = docs.select(F.col("text").cast("binary").alias("text"), *names)
    ddl = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in docs.select(*names).schema.fields)
    rows = source.mapInArrow(run, f"{ddl}n_tokens long, _codes binary, _words array<binary>, _tf array<int>, _symbols binary")
    return written(rows.withColumn("_row", F.monotonically_increasing_id()), "encoded")


@dataclass
class Batch:
    """The tokens of all rows of an Arrow batch one after another."""

    codes: np.ndarray
    #: The rows' first and last tokens.
    starts: np.ndarray
    ends: np.ndarray
    #: Tokens outside the head, and the place of each one's word among all words of the batch.
    rare: np.ndarray
    places: np.ndarray
    #: The symbols of those words.
    of_words: np.ndarray

    @staticmethod
    def of(codes: pa.Array, of_words: pa.Array) -> Batch:
        sizes, words = (pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) // 4 for c in (codes, of_words))
        flat, symbols = (np.frombuffer(b"".join(c.to_pylist()), "<i4").astype(np.int64) for c in (codes, of_words))
        ends = np.cumsum(sizes)
        rare = np.flatnonzero(flat < 0)
        base = np.repeat(np.cumsum(words) - words, sizes)
        return Batch(flat, ends - sizes, ends - 1, rare, base[rare] - 1 - flat[rare], symbols)

    def symbols(self, of_head: np.ndarray) -> np.ndarray:
        out = of_head[np.maximum(self.codes, 0)].astype(np.int64)
        out[self.rare] = self.of_words[self.places]
        return out

    def before(self, values: np.ndarray) -> np.ndarray:
        """The value of each token's neighbour; a text begins after an end, whose symbol and class are 0."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = 0
        return out


def neighbours(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """(symbol, slots, ns) of encoded rows: slot k counts symbol k after it, slot size + k before it.

    Pairs of symbols are counted within tasks first. A row has at most two slots for each symbol.
    """
    size, of_head = symbols.size, symbols.of_head

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            return pa.record_batch({"pair": pairs, "n": n.astype(np.int64)})

        for batch in batches:
            if batch.num_rows:
                some = Batch.of(batch.column(0), batch.column(1))
                found = some.symbols(of_head)
                held.append(some.before(found) * size + found)
            if sum(map(len, held)) > PAIRS:
                yield told()
                held = []
        yield told()

    pairs = rows.select("_codes", "_symbols").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    first, second = F.expr(f"cast(pair div {size} as int)"), F.expr(f"cast(pair % {size} as int)")
    sides = F.array(F.struct(first.alias("symbol"), second.alias("slot")), F.struct(second.alias("symbol"), (first + size).alias("slot")))
    each = pairs.select(F.explode(sides).alias("s"), "n").select("s.symbol", "s.slot", "n")
    return written(each.groupBy("symbol").agg(F.collect_list(F.struct("slot", "n")).alias("x")).select("symbol", F.col("x.slot").alias("slots"), F.col("x.n").alias("ns")), "neighbours")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a batch of neighbours, and for all their slots: row, slot and count."""
    slots = batch.column(1)
    sizes = pc.list_value_length(slots).to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), slots.flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()


def square(beside: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of each class after each, with of as the class of each symbol."""
    size = len(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes)
        for batch in batches:
            symbol, row, slot, n = _entries(batch)
            after = slot < size
            total += np.bincount(of[symbol[row[after]]] * classes + of[slot[after]], n[after], classes * classes)
        some = np.flatnonzero(total)
        yield pa.record_batch({"pair": some, "n": total[some].astype(np.int64)})

    return _square(beside.mapInArrow(count, "pair long, n long"), classes)


def _square(parts: DataFrame, classes: int) -> np.ndarray:
    found = parts.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(classes, classes)


class Moves:
    """The best class of words, all others where they are; small counts are looked up.

    Slot k of a word counts it after class k, slot classes + k before it. Class 0 takes no
    word, nor does an empty class, to which words of all kinds would go at once. Bigrams of
    a word with itself count as with its old class.
    """

    SMALL = 16

    def __init__(self, table: np.ndarray):
        self.table, self.classes = table, len(table)
        self.beside = np.concatenate((table, table.T))
        self.sums = (table.sum(0), table.sum(1))
        m = np.arange(self.SMALL)
        self.gains = f(self.beside[None] + m[:, None, None]) - f(self.beside)[None]
        self.costs = tuple(f(s[None] + m[:, None]) - f(s)[None] for s in self.sums)
        self.closed = (self.sums[0] + self.sums[1] == 0) | (np.arange(self.classes) == 0)

    def added(self, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self.gains[np.minimum(n, self.SMALL - 1), slot]
        big = np.flatnonzero(n >= self.SMALL)
        here = self.beside[slot[big]]
        out[big] = f(here + n[big, None]) - f(here)
        return out

    def best(self, word: np.ndarray, slot: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
        """New classes of words 0, 1, ... with the old ones; word, slot and n are entries in order of the word."""
        words = len(old)
        gain = self.added(slot, n)
        stay = self.beside[slot, old[word]]
        gain[np.arange(len(word)), old[word]] = f(stay) - f(np.maximum(stay - n, 0))
        total = np.zeros((words, self.classes))
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
        if len(word):
            total[word[starts]] = np.add.reduceat(gain, starts)
        place = np.arange(words)
        for side, sums, costs in ((slot < self.classes, self.sums[0], self.costs[0]), (slot >= self.classes, self.sums[1], self.costs[1])):
            size = np.bincount(word[side], n[side], words).astype(np.int64)
            cost = costs[np.minimum(size, self.SMALL - 1)]
            big = np.flatnonzero(size >= self.SMALL)
            cost[big] = f(sums + size[big, None]) - f(sums)
            cost[place, old] = f(sums[old]) - f(np.maximum(sums[old] - size, 0))
            total -= cost
        total[:, self.closed] = -np.inf
        total[place, old] = np.maximum(total[place, old], np.finfo(float).min)
        new = total.argmax(1)
        return np.where(total[place, new] > total[place, old] + 1e-9, new, old)


def moved(beside: DataFrame, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each symbol, all others where they are."""
    size, moves = len(of), Moves(table)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            symbol, row, slot, n = _entries(batch)
            slot = np.where(slot < size, of[np.minimum(slot, size - 1)] + moves.classes, of[np.maximum(slot - size, 0)])
            keys, at = np.unique(row * 2 * moves.classes + slot, return_inverse=True)
            word, slot = np.divmod(keys, 2 * moves.classes)
            new = moves.best(word, slot, np.bincount(at, n, len(keys)).astype(np.int64), of[symbol])
            yield pa.record_batch({"symbol": symbol, "class": new.astype(np.int32)})

    found = beside.mapInArrow(choose, "symbol int, class int").toArrow()
    out = of.copy()
    out[found.column("symbol").to_numpy()] = found.column("class").to_numpy()
    out[0] = 0
    return out


def exchanged(beside: DataFrame, symbols: Symbols, classes: int, gain: float, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A class for each symbol, the table of class bigrams, and its likelihood at first and after each round.

    In a round one half of the symbols moves, then the other, each by the table that the
    moves before it made: neighbours that change places at once would often both lose. A
    half that lowers the likelihood is not kept.
    """
    small, n_small = symbols.small(first)
    of = exchange(square(beside, small, n_small), min(classes, n_small))[small]
    table = square(beside, of, classes)
    steps = [likelihood(table)]
    least = gain * (steps[0] - likelihood(table.sum(keepdims=True)))
    half = (np.arange(symbols.size) * 0x9E3779B1 >> 16) & 1
    while len(steps) == 1 or steps[-1] - steps[-2] > least:
        last = steps[-1]
        for part in (0, 1):
            new = np.where(half == part, moved(beside, of, table), of)
            new_table = square(beside, new, classes)
            if likelihood(new_table) >= last:
                of, table, last = new, new_table, likelihood(new_table)
        steps.append(last)
    return of, table, steps


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of counts elements each."""
    ends = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def other_words(rows: DataFrame, symbols: Symbols, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, c, code, class) of all words of encoded rows without a symbol of their own, each in its best class; code is -1 outside the head."""
    moves, head, of_head, n_own = Moves(table), symbols.head, symbols.of_head, symbols.n_own
    wide = 2 * moves.classes

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(head, pa.binary())
        rare: dict[bytes, int] = {}
        rare_class = np.zeros(0, np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            """Held keys, each once; they come in sorted runs, which a stable sort merges."""
            keys, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[starts], np.add.reduceat(n[order], starts)

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal rare_class
            keys, n = merged()
            which, slot = np.divmod(keys, wide)
            starts = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            counts = np.diff(np.append(starts, len(keys)))
            ids = which[starts]
            old = np.append(of[of_head], rare_class[: len(rare)]).astype(np.int32)
            yield pa.record_batch({
                "word": pa.concat_arrays([names, pa.array(rare.keys(), pa.binary())]).take(pa.array(ids)), "code": np.where(ids < len(head), ids, -1).astype(np.int32), "old": old[ids],
                "slots": binaries(slot.astype(np.uint8), counts), "ns": binaries(n.astype("<i4"), counts),
            })
            rare.clear()
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            some = Batch.of(batch.column(0), batch.column(1))
            symbol = some.symbols(of_head)
            at = np.flatnonzero(symbol > n_own)
            if not len(at):
                continue
            cls = of[symbol]
            known = pc.dictionary_encode(batch.column(2).flatten())
            ids = np.fromiter((rare.setdefault(w, len(rare)) for w in known.dictionary.to_pylist()), np.int64, len(known.dictionary))[known.indices.to_numpy()]
            rare_class = np.append(rare_class, np.zeros(max(len(rare) - len(rare_class), 0), np.int32))
            rare_class[ids] = of[some.of_words]
            word = some.codes.copy()
            word[some.rare] = len(head) + ids[some.places]
            before, after = some.before(cls), np.append(cls[1:], 0) + moves.classes
            inside = np.ones(len(cls), bool)
            inside[some.ends] = False
            inside = inside[at]
            held.append(np.unique(np.concatenate((word[at] * wide + before[at], word[at][inside] * wide + after[at][inside])), return_counts=True))
            if sum(len(h[0]) for h in held) > KEYS:
                held[:] = [merged()]
                if len(held[0][0]) > KEYS // 2:
                    yield from told()
            if held and len(rare) > HELD:
                yield from told()
        if held:
            yield from told()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        carried: tuple | None = None

        def told(last: bool) -> Iterator[pa.RecordBatch]:
            """The words of held batches; but for the last time, the last word waits for more."""
            nonlocal carried, held
            words, code, old = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            sizes = np.concatenate([pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False) for b in held])
            slot, n = (np.frombuffer(b"".join(x for b in held for x in b.column(k).to_pylist()), kind).astype(np.int64) for k, kind in ((3, np.uint8), (4, "<i4")))
            held = []
            if carried:
                words, code, old = pa.concat_arrays([carried[0], words]), pa.concat_arrays([carried[1], code]), pa.concat_arrays([carried[2], old])
                sizes, slot, n = np.append(len(carried[3]), sizes), np.append(carried[3], slot), np.append(carried[4], n)
                carried = None
            same = pc.dictionary_encode(words).indices.to_numpy()
            starts = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            which = np.repeat(np.cumsum(np.append(False, same[1:] != same[:-1])), sizes)
            keys, at = np.unique(which * wide + slot, return_inverse=True)
            n = np.bincount(at, n, len(keys)).astype(np.int64)
            which, slot = np.divmod(keys, wide)
            if not last:
                own = which == len(starts) - 1
                carried = (words[starts[-1] : starts[-1] + 1], code[starts[-1] : starts[-1] + 1], old[starts[-1] : starts[-1] + 1], slot[own], n[own])
                which, slot, n, starts = which[~own], slot[~own], n[~own], starts[:-1]
            if len(starts):
                first = pa.array(starts)
                before = slot < moves.classes
                new = moves.best(which, slot, n, old.take(first).to_numpy().astype(np.int64))
                c = np.bincount(which[before], n[before], len(starts)).astype(np.int64)
                yield pa.record_batch({"word": words.take(first), "c": c, "code": code.take(first), "class": new.astype(np.int32)})

        rows_held = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows_held += batch.num_rows
            if rows_held > 20_000:
                yield from told(False)
                rows_held = 0
        if held:
            yield from told(True)
        elif carried:
            held = [pa.record_batch([carried[0], carried[1], carried[2], binaries(carried[3].astype(np.uint8), np.array([len(carried[3])])), binaries(carried[4].astype("<i4"), np.array([len(carried[4])]))], names=list("abcde"))]
            carried = None
            yield from told(True)

    found = rows.select("_codes", "_symbols", "_words").mapInArrow(profiles, "word binary, code int, old int, slots binary, ns binary")
    return written(found.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, c long, code int, class int"), "word-classes")


@dataclass
class Model:
    """Words with counts and classes, and the two tables of logarithms."""

    n: int
    v: int
    symbols: Symbols
    #: The classes of symbols; counts and classes of head words; words without a symbol of their own.
    of: np.ndarray
    head_counts: np.ndarray
    of_head: np.ndarray
    words: DataFrame
    transition: np.ndarray
    emission: np.ndarray
    #: The likelihood of the class bigrams at first, after each round and with all words in their classes.
    steps: list[float]

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        """Classes of a few words; one outside the training text has that of its ending."""
        found = {bytes(r["word"]): r["class"] for r in self.words.where(F.col("word").isin([bytearray(w) for w in words])).collect()}
        codes = self.symbols.codes(words)
        return np.array([self.of_head[c] if c >= 0 else found.get(w, self.of[-1 - c]) for w, c in zip(words, codes.tolist(), strict=True)])


def classed(rows: DataFrame, names: list[str], model: Model) -> DataFrame:
    """Encoded rows as classes: _classes has a byte for each token, RARE outside the head, and _places the place of each such one's word.

    _first has the class of each word's ending and _own place and class of each known word.
    n_known counts known tokens, base is the sum of log10(c + 0.5) over all tokens. Words
    outside the head are joined with their counts, each text's words added up before.
    """
    there = model.head_counts > 0
    of, of_head, log_head, unseen = model.of.astype(np.uint8), model.of_head.astype(np.uint8), np.log10(model.head_counts + 0.5), float(np.log10(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.frombuffer(codes, "<i4")
                rare = codes < 0
                head = codes[~rare]
                classes = np.full(len(codes), RARE, np.uint8)
                classes[~rare] = of_head[head]
                out.append((int(there[head].sum()), float(log_head[head].sum()), classes.tobytes(), (-1 - codes[rare]).astype("<i4").tobytes(), of[np.frombuffer(symbols, "<i4")].tobytes()))
            kinds = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([*batch.columns[2:], *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[*names, "_row", "n_tokens", "_n_head", "_head", "_classes", "_places", "_first"])

    ddl = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in rows.select(*names).schema.fields)
    short = rows.select("_codes", "_symbols", *names, "_row", "n_tokens").mapInArrow(run, f"{ddl}_row long, n_tokens long, _n_head long, _head double, _classes binary, _places binary, _first binary")
    each = rows.select("_row", F.posexplode(F.arrays_zip("_words", "_tf")).alias("i", "x")).select("_row", "i", F.col("x._words").alias("word"), F.col("x._tf").alias("tf"))
    known = model.words.where("code < 0").select("word", "c", "class")
    own = each.join(known, "word").groupBy("_row").agg(
        F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - unseen)).alias("_rare"), F.sum(F.col("tf").cast("long")).alias("_seen"), F.collect_list(F.col("i").cast("long") * 256 + F.col("class")).alias("_own"),
    )
    joined = short.join(own, "_row", "left")
    seen = F.coalesce("_seen", F.lit(0))
    base = F.col("_head") + F.octet_length("_places") / 4 * unseen + F.coalesce("_rare", F.lit(0.0))
    return written(joined.select(*names, "n_tokens", (F.col("_n_head") + seen).alias("n_known"), base.alias("base"), "_classes", "_places", "_first", "_own"), "classed")


def sequence(classes: bytes, places: bytes, first: bytes, own: list[int] | None) -> np.ndarray:
    """The classes of a text's tokens."""
    out = np.frombuffer(classes, np.uint8).astype(np.int64)
    rare = np.frombuffer(first, np.uint8).astype(np.int64)
    if own:
        known = np.asarray(own, np.int64)
        rare[known >> 8] = known & 255
    if len(rare):
        out[out == RARE] = rare[np.frombuffer(places, "<i4")]
    return out


PARTS = ["_classes", "_places", "_first", "_own"]


def class_bigrams(rows: DataFrame, classes: int) -> np.ndarray:
    """Counts of each class after each over classed rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = sequence(*row)
                total += np.bincount(np.append(0, found[:-1]) * classes + found, minlength=classes * classes)
        some = np.flatnonzero(total)
        yield pa.record_batch({"pair": some, "n": total[some]})

    return _square(rows.select(*PARTS).mapInArrow(count, "pair long, n long"), classes)


def counted(docs: DataFrame, head: int, core: int, groups: int) -> tuple[int, int, Symbols, np.ndarray]:
    """Tokens and distinct tokens of docs (text), the symbols and the counts of head words."""
    counts = written(word_counts(docs), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # A bound on the count first, so that the ordering task does not get head words of every partition.
    least, more = 0, 0
    for r in sorted(counts.groupBy(F.floor(F.log2("c")).alias("k")).count().collect(), key=lambda r: -r["k"]):
        if more >= head:
            break
        least, more = 2 ** r["k"], more + r["count"]
    best = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(head).toArrow()
    words, head_counts = best.column("word").to_pylist(), best.column("c").to_numpy().astype(np.float64)
    if END not in words:
        ends = counts.where(F.col("word") == F.lit(bytearray(END))).select("c").first()
        words, head_counts = [*words, END], np.append(head_counts, ends["c"] if ends else 0.0)
    own = set([w for w in words if w != END][:core])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = Counter()
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in own and word != END:
                    n_tokens[ending(word)] += c
        yield pa.record_batch({"ending": pa.array(n_tokens.keys(), pa.binary()), "n": pa.array(n_tokens.values(), pa.int64())})

    # An ending is one mark and at most two bytes.
    by_ending = counts.mapInArrow(grouped, "ending binary, n long").groupBy("ending").agg(F.sum("n").alias("n"))
    chosen = by_ending.orderBy(F.desc("n"), "ending").limit(groups).collect()
    return n, v, Symbols(words, [bytes(r["ending"]) for r in chosen], core), head_counts


def clustered(rows: DataFrame, n: int, v: int, symbols: Symbols, head_counts: np.ndarray, classes: int, gain: float) -> Model:
    """A model without its tables from encoded rows."""
    of, table, steps = exchanged(neighbours(rows, symbols), symbols, classes, gain)
    words = other_words(rows, symbols, of, table)
    of_head = np.append(of[symbols.of_head], 0)  # one more, so that it is never empty
    heads = words.where("code >= 0").select("code", "class").toArrow()
    of_head[heads.column("code").to_numpy()] = heads.column("class").to_numpy()
    return Model(n, v, symbols, of, head_counts, of_head, words, np.empty(0), np.empty(0), steps)


def with_tables(model: Model, rows: DataFrame, classes: int) -> Model:
    """The model with its tables from classed rows."""
    table = class_bigrams(rows, classes)
    model.steps.append(likelihood(table))
    types = np.bincount(model.of[: 1 + model.symbols.n_own], minlength=classes).astype(float)
    for r in model.words.groupBy("class").count().collect():
        types[r["class"]] += r["count"]
    total = table.sum(0)
    share = (total + 1) / (total.sum() + classes)
    model.transition = np.log10((table + share) / (table.sum(1, keepdims=True) + 1))
    model.emission = -np.log10(total + 0.5 * (types + 1))
    return model


def _checked(classes: int) -> None:
    if not 2 <= classes <= 127:
        raise ValueError("classes must be from 2 to 127: a slot has one byte")


def learn(docs: DataFrame, *, classes: int = 48, head: int = HEAD, core: int = CORE, groups: int = GROUPS, gain: float = GAIN) -> Model:
    """A model of all rows of docs (text); a null text is empty. Rounds end when one adds less than gain."""
    _checked(classes)
    n, v, symbols, head_counts = counted(docs, head, core, groups)
    rows = encoded(docs, [], symbols)
    model = clustered(rows, n, v, symbols, head_counts, classes, gain)
    return with_tables(model, classed(rows, [], model), classes)


def _scores(rows: DataFrame, names: list[str], model: Model) -> DataFrame:
    transition, emission = model.transition, model.emission
    log_all = float(np.log10(model.n + 0.5 * (model.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = sequence(*row)
                steps.append(float(transition[np.append(0, found[:-1]), found].sum() + emission[found].sum()))
            yield pa.record_batch([*batch.columns[4:], pa.array(steps, pa.float64())], names=[*names, "n_tokens", "n_known", "base", "steps"])

    ddl = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in rows.select(*names).schema.fields)
    done = rows.select(*PARTS, *names, "n_tokens", "n_known", "base").mapInArrow(run, f"{ddl}n_tokens long, n_known long, base double, steps double")
    return done.select(*names, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * log_all).alias("base_score"), (F.col("base") + F.col("steps")).alias("score"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score.

    base_score is the text's log10 probability by word counts, score that of the model. A
    null text is empty; rows that repeat are scored each. Columns of these names are
    replaced, others stay.
    """
    docs, named = waiting(docs, "text")
    names = [c for c in docs.columns if c != "text"]
    return named(_scores(classed(encoded(docs, names, model.symbols), names, model), names, model))


def learned_and_scored(docs: DataFrame, teaches: Column, *, classes: int = 48, head: int = HEAD, core: int = CORE, groups: int = GROUPS, gain: float = GAIN) -> DataFrame:
    """scored(docs, learn(docs.where(teaches))), with texts encoded and words joined once for both; a column _teaches is left out."""
    _checked(classes)
    flag = F.coalesce(teaches, F.lit(False)).alias("_teaches")
    docs, named = waiting(docs.select(flag, *[F.col(f"`{c}`") for c in docs.columns if c != "_teaches"]), "text", "_teaches")
    names = [c for c in docs.columns if c not in ("text", "_teaches")]
    n, v, symbols, head_counts = counted(docs.where("_teaches").select("text"), head, core, groups)
    both = [*names, "_teaches"]
    rows = encoded(docs, both, symbols)
    model = clustered(rows.where("_teaches"), n, v, symbols, head_counts, classes, gain)
    known = classed(rows, both, model)
    return named(_scores(known, names, with_tables(model, known.where("_teaches"), classes)))
