"""Concatenate-and-cut packing of tokenized documents into windows of fixed length."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import slices, written

#: Pieces of a text of letters: the tokenizer's own first cut, on bytes with A-Z lower-cased.
#: Bytes over 7F stand for letters here; texts in which they do not are cut at white space.
PIECES = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^\x00-\x20\x7fa-z0-9\x80-\xff]+")
#: ASCII without controls, and letters of the Latin blocks that have one code point each.
PLAIN = re.compile("[\t\n\r\x20-\x7eªµºÀ-ÖØ-öø-įı-ɏ]*")
#: Pieces that a worker remembers, and pieces that are encoded in one call.
MEMO, CALL = 600_000, 8_000


class Memo(dict):
    """Ids by piece; pieces that are not there are noted in new, once each."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> bytes:
        self.new.append(piece)
        self[piece] = b""
        return b""


class Encoder:
    """Token ids by piece, as little-endian unsigned 32-bit numbers.

    The tokenizer never joins across white space nor across its first cut, so a text's
    ids are those of its pieces. New pieces go to the tokenizer many at a time, with a
    space between; the mark of a word's last token shows where each ends. A text that holds
    the literal of one of the tokenizer's added tokens is encoded whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.as_loaded = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.literals = [t.content.lower().encode() for t in self.as_loaded.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.memo = Memo()

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def learn(self, cut: list[list[bytes]], plain: bool) -> None:
        pieces, self.memo.new = self.memo.new, []
        if len(self.memo) > MEMO:
            self.memo.clear()
            pieces = list(set().union(*cut))
        for at in range(0, len(pieces), CALL):
            some = pieces[at : at + CALL]
            if not plain:  # white space may cut none or several words, which would hide each other in a joined call
                found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
                self.memo.update((p, np.asarray(x.ids, "<u4").tobytes()) for p, x in zip(some, found, strict=True))
                continue
            found = np.frombuffer(self.ids(b" ".join(some).decode("utf-8", "replace")), "<u4")
            ends = 4 * (np.flatnonzero(self.last[found]) + 1)
            if len(ends) == len(some):
                raw, starts = found.tobytes(), [0, *ends.tolist()]
                self.memo.update(zip(some, [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)], strict=True))
            else:  # a piece in which the tokenizer sees several words, or none
                self.memo.update((p, self.ids(p.decode("utf-8", "replace"))) for p in some)

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        raws = [(text or "").encode("utf-8", "replace").lower() for text in texts]
        is_plain = [PLAIN.fullmatch(text or "") is not None for text in texts]
        out = [b""] * len(texts)
        whole = {i for i, raw in enumerate(raws) if any(t in raw for t in self.literals)}
        for i in whole:
            out[i] = np.asarray(self.as_loaded.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes() + end
        for plain in (True, False):
            at = [i for i, p in enumerate(is_plain) if p == plain and i not in whole]
            cut = [PIECES.findall(raws[i]) if plain else raws[i].split() for i in at]
            for pieces in cut:
                deque(map(self.memo.__getitem__, pieces), 0)  # the new ones go to self.memo.new
            if self.memo.new:
                self.learn(cut, plain)
            for i, pieces in zip(at, cut, strict=True):
                out[i] = b"".join([*map(self.memo.__getitem__, pieces), end])
        return out


_encoders: dict[str, Encoder] = {}


def token_bytes(texts: list[str | None], tokenizer: str, end_id: int) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer].encode(texts, np.asarray([end_id], "<u4").tobytes())


def tokenize(docs: DataFrame, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """One row for each row of docs: doc_id, ids, doc_tokens, part and at.

    at counts the tokens before the document in its partition, part. A null text is
    empty and has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = token_bytes(batch.column(1).to_pylist(), tokenizer, end_id)
            counts = np.asarray([len(x) // 4 for x in ids], np.int64)
            before = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "doc_tokens": counts, "part": np.full(len(ids), part, np.int64), "at": before})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, doc_tokens long, part long, at long")


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in windows of length tokens, one row for each piece.

    The tokens of all partitions, one after another, are cut every length tokens. The
    first pass tokenizes and writes ids with their place in the partition; the driver
    turns one total for each partition into offsets; the second pass cuts. A document
    that crosses a cut has a piece on each side. All windows but the last are full.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.
    Repeated rows are packed each on its own; an empty table gives no rows. Other columns
    of docs, whatever their names, are left out.
    """
    tokens = written(tokenize(docs, tokenizer, end_id=end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    base, so_far = {}, 0
    for row in totals:
        base[row["part"]] = so_far
        so_far += row["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            row_of: list[int] = []
            for i, (ids, n, part, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                first, start = base[part] + at, 0
                while start < n:
                    window, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append((start, size, zlib.crc32(piece), n, window, offset, piece))
                    row_of.append(i)
                    start += size
            columns = [batch.column(0).take(pa.array(row_of, pa.int64()))]
            columns += [pa.array([r[k] for r in rows], pa.binary() if k == 6 else pa.int64()) for k in range(7)]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids", "doc_tokens", "part", "at").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
