"""Removal of repeated byte strings by a depth-limited radix sort of all suffixes.

Suffixes are ordered only through `window` bytes and only as far as needed. They are not moved one by one: starts
whose windows share a long middle travel as one block (see _windows.blocks), so a pass groups blocks by their core
digit, drops groups of one, and settles a block whose whole hull occurs again: all its windows are repeated.
What is left (blocks at the edge of a repeat) is cut into finer blocks for the next, less significant pass, down to
single suffixes, whose groups of equal windows are exactly the repeats. Widths of the passes: 96, 8, 1 starts.

Digits are 64-bit fingerprints, two of them (121 bits) wherever equality counts. The texts are written once, where they
were read (common.placed): passes and the cut join them by row without moving a text. Counts are combined before each
shuffle and joined back, so a hot passage does not have to fit one task. The counts and the surviving blocks of each
pass, a small part of all, are written to the shared folder and deleted once used.

Defined cases: a null text counts as empty; texts shorter than the window lose nothing; a row of a repeated doc_id is
a document of its own; a null doc_id gets its row; other columns are ignored (remove_repeats keeps them); an empty
table gives an empty result. In remove_repeats, bytes of a character that was cut are dropped with it, and the first
occurrence is removed like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._windows import U, blocks
from .common import dealt, drop, in_place, placed, stash

WINDOW, WIDTHS = 200, (96, 8, 1)


def _parts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column, end to end, and their bounds (one more than texts)."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _ranges(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, starts, weight of every entry of a list column."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    flat = col.flatten()
    return (np.repeat(np.arange(len(col)), sizes), *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)))


def _rows(texts: DataFrame, todo: DataFrame | None, window: int, width: int) -> DataFrame:
    """The blocks of one pass over texts(rid, text): core, hull with the number of starts in its low 7 bits, row, start and weight."""
    whole = todo is None
    texts = texts.select("rid", "text") if whole else texts.join(todo, ["part", "rid"]).select("rid", "text", "todo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = _parts(b, "text")
            rid = _column(b, "rid")
            cut = np.zeros(len(data) + 1, bool)
            cut[bounds] = True
            if whole:
                weight = np.ones(len(data), np.int8)
            else:
                row, s, n, w = _ranges(b, "todo")
                s = s + bounds[row]
                cut[s] = cut[s + n] = True
                change = np.zeros(len(data) + 1, np.int8)
                np.add.at(change, s, w.astype(np.int8))
                np.add.at(change, s + n, -w.astype(np.int8))
                weight = np.cumsum(change, dtype=np.int8)[:-1]
            for first, count, core, hull in blocks(data, bounds[1:], weight, cut[:-1], window, width):
                doc = np.searchsorted(bounds, first, side="right") - 1
                hull = (hull & ~U(127)) | count.astype(U)
                start = (first - bounds[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(rid[doc]), pa.array(start), pa.array(weight[first].astype(np.int8))],
                    ["core", "hull", "rid", "s", "w"],
                )

    return texts.mapInArrow(run, "core long, hull long, rid long, s int, w byte")


def _range(w) -> Column:
    """The range of a block row."""
    return F.struct("s", F.col("hull").bitwiseAND(F.lit(127)).cast("int").alias("n"), w.cast("int").alias("w")).alias("r")


def repeated_ranges(texts: DataFrame, buckets: int, window: int = WINDOW, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(rid, ranges): starts of windows that also start elsewhere, for the rows of a placed texts(rid, part, text) that have any."""
    todo, settled = None, None
    for width in widths:
        rows = _rows(texts, todo if todo is None else dealt(todo, buckets), window, width)
        # counts are tables of their own: a join right above its aggregation could not be split where a key is hot
        again = stash(rows.groupBy("core").agg(F.sum("w").alias("c")).where("c > 1").select("core"))
        alive = stash(rows.join(again, "core"))
        drop(again)
        hulls = stash(alive.groupBy("core", "hull").agg(F.sum("w").alias("c"), F.min(F.struct("rid", "s")).alias("one")))
        twice = hulls.where("c > 1")
        done = stash(alive.join(twice.select("core", "hull"), ["core", "hull"], "left_semi").select("rid", _range(F.lit(1))))
        settled = done if settled is None else settled.unionByName(done)
        if width == widths[-1]:
            drop(alive, hulls)
            break
        single = hulls.where("c = 1")
        edge = twice.join(single.select("core").distinct(), "core", "left_semi")
        spots = single.unionByName(edge).select("hull", "one.rid", "one.s", "c")
        todo = stash(spots.select("rid", _range(F.least("c", F.lit(2)))).groupBy("rid").agg(F.collect_list("r").alias("todo")))
        drop(alive, hulls)
    return settled.groupBy("rid").agg(F.collect_list("r").alias("ranges"))


def _covered(docs: DataFrame, window: int, spec: str, make) -> DataFrame:
    """make(batch, kept bytes, removed, spans) in the place of each batch of docs, whose columns are c0, c1, ... there."""
    rows, buckets = placed(docs)
    text = F.coalesce(F.col(f"c{docs.columns.index('text')}"), F.lit("")).alias("text")
    others = [c for c, name in zip(rows.columns, docs.columns) if name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = _parts(b, "text")
            row, s, n, _ = _ranges(b, "ranges")
            lo = np.searchsorted(row, np.arange(b.num_rows + 1))
            kept, removed, spans = [], [], []
            for i in range(b.num_rows):
                text, own = data[bounds[i] : bounds[i + 1]], slice(lo[i], lo[i + 1])
                if lo[i] == lo[i + 1]:
                    kept.append(text.tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, s[own], 1)
                np.add.at(change, s[own] + n[own] - 1 + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept.append(text[~gone].tobytes())
                removed.append(len(text) - len(kept[-1]))
                spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]))
            yield make(b, kept, removed, spans)

    with in_place(docs.sparkSession):
        ranges = repeated_ranges(rows.select("rid", "part", text), buckets, window)
        joined = rows.select("rid", "part", text, *others).join(dealt(ranges, buckets), ["part", "rid"], "left")
        out = stash(joined.select("text", "ranges", *others).mapInArrow(run, spec))
    drop(rows)
    return out


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs(doc_id, text)."""

    def make(b: pa.RecordBatch, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.RecordBatch:
        size = [len(k) + r for k, r in zip(kept, removed, strict=True)]
        return pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("c0")), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    lean = docs.select(F.col("doc_id").cast("long"), "text")
    return _covered(lean, window, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with all repeated strings taken out of text, and n_chars to match where docs has it."""
    names = docs.columns

    def make(b: pa.RecordBatch, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.RecordBatch:
        texts = [k.decode("utf-8", "ignore") for k in kept]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        return pa.RecordBatch.from_arrays([new[c] if c in new else b.column(b.schema.get_field_index(f"c{i}")) for i, c in enumerate(names)], names)

    if "n_chars" in names:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return _covered(docs, window, docs.schema, make)
