"""Packing of tokenised documents into sequences by vector best fit.

Every document becomes its token ids and an end id; documents longer than a sequence are cut into whole sequences and a
rest. A bin has three capacities - tokens, pieces and attention cost (the sum of squared lengths) - and a piece goes to
the open bin that, under every constraint, leaves the least weighted norm of what remains free; pieces come longest
first. Only piece lengths are packed: ids never leave the task that made them. Pieces are dealt evenly by a hash of
their key and packed on their own in runs of 50,000 or what is left of a partition, so a run costs a few unfilled bins at most; pieces of a whole
sequence are sequences already.

Defined cases: a null or empty text is the end id alone; a null doc_id packs like any other; repeated rows are packed
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, END = 4096, 1
#: White space that one of Python's split and the tokenizer's pattern treats differently from the other, or that is not ASCII.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -​    　﻿]")
_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The tokenizer, with its answers kept by white-space word: its pieces never span white space.

    Words of ASCII and Latin-1 letters, for which the tokenizer's rules (compose, lower case, split into
    contractions, letters, single digits and the rest) are plain, go to its BPE model piece by piece; all
    others through the whole tokenizer. Once full, the tables take no more entries.
    """

    _PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
    _SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level spelling: visible bytes stand for themselves, the others for code points from 256 on
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.spelling = [chr(b if b in visible else next(hidden)) for b in range(256)]

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            spelt = piece if piece.isascii() else "".join([self.spelling[b] for b in piece.encode()])
            got = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
            if len(self.pieces) < _WORDS:
                self.pieces[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if self._PLAIN(word) and not any(t in word for t in self.special):
            return b"".join([self._piece(p) for p in self._SPLIT(word.lower())])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if _ODD_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        words, known = text.split(), self.words
        new = {w for w in words if w not in known}
        if new:
            fresh = {w: self._word(w) for w in new}
            if len(known) < _WORDS:
                known.update(fresh)
            else:
                return np.frombuffer(b"".join([fresh[w] if w in fresh else known[w] for w in words]), "<u4")
        return np.frombuffer(b"".join([known[w] for w in words]), "<u4")


@cache
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([end], "<u4")).astype("<u4")
                for p, s in enumerate(range(0, len(ids), size)):
                    part = ids[s : s + size]
                    rows.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def vector_best_fit(
    lengths: np.ndarray, tokens: int = SEQUENCE, documents: int = SEQUENCE, cost: int = SEQUENCE * SEQUENCE,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, into the feasible bin of least weighted residual norm.

    Each residual is scaled by its capacity. A piece that alone exceeds the cost still gets a bin of its own.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = int(lengths.min()) if n else 0
    free = np.empty((3, max(16, n)), np.float64)  # residual tokens, documents, cost of the open bins
    names, used, made = np.empty(max(16, n), np.int64), 0, 0
    cap = np.array([tokens, documents, cost], np.float64)
    w = np.array(weights) / cap**2
    for i in order:
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) * size])
        rest = free[:, :used] - need[:, None]
        ok = (rest >= 0).all(axis=0)
        if ok.any():
            score = np.where(ok, w @ (rest * rest), np.inf)
            at = int(np.argmin(score))
            offsets[i] = tokens - free[0, at]
            free[:, at] -= need
        else:
            at = used
            free[:, at] = cap - need
            names[at], made, used = made, made + 1, used + 1
        bins[i] = names[at]
        if free[0, at] < least or free[1, at] < 1 or free[2, at] < 1:  # full: no later piece fits
            used -= 1
            free[:, at], names[at] = free[:, used], names[used]
    return bins, offsets


def pack(
    docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, end: int = END,
    max_documents: int | None = None, max_cost: int | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs(doc_id, text).

    max_documents and max_cost bound the pieces of a sequence and their summed squared lengths; unset, they never bind.
    """
    vocabulary = vocabulary or default_vocabulary()
    limits = (size, max_documents or size, max_cost or size * size)
    cut = pieces(docs, vocabulary, size, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        done = 0
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal done
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for b in whole.to_batches():
                bins, offsets = vector_best_fit(b.column(3).to_numpy(), *limits)
                ids = pa.array(base + done + bins)
                done += int(bins.max()) + 1 if len(bins) else 0
                yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(offsets)], [*b.schema.names, "sequence_id", "offset"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 50_000:
                yield from packed()
        if held:
            yield from packed()

    return (
        cut.repartition("doc_id", "piece", "ids_crc32")
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
