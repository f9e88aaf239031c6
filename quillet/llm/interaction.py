"""How filters interact: what each removes under every order of applying them.

A document is a mask of the filters that it fails. A table of 2^n masks by n! orders, made once, holds the step at which
an order removes a mask (n: never). Tasks look their documents up in it, all orders at once, and count removals by
part, order, step and label with one bincount a batch; the arrays of the tasks are summed.

The five filters of `failures` read whole texts where they lie: what leaves the task is a mask and a digest. A copy is told
by SHA-256: the smallest doc_id of each digest is an aggregate combined before the shuffle, and it is joined by digest
and doc_id together, so a group of copies of any size is dealt over all tasks.

Defined cases: a null or empty text is empty (it fails A, and E if a smaller doc_id is empty too); a null lang is the part of
the empty string; a null doc_id is never a copy, names none, and has no label; rows that repeat a doc_id are documents each, none
a copy of the other by that id; of repeated labels one good or one toxic suffices; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 100, 80, 10
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_MARKS = re.compile(b"[#$%&*|]").search
_PARTS = 256  # parts of which a task holds sums at once


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """By mask and order: the step, from 0, whose filter is the first to fail; the number of filters where none does."""
    n = len(filters)
    bits = np.array([[filters.index(c) for c in order] for order in orders(filters)])
    fails = (np.arange(1 << n)[:, None, None] >> bits[None, :, :]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), n)


def own_failures(text: bytes, points: int) -> int:
    """Mask of the filters that a text fails by itself: A, B, C, D are bits 0 to 3."""
    words = text.split()  # bytes split at blanks, tabs, line and page breaks alone
    return (
        (len(words) < WORDS)
        | (100 * len(set(words)) < DISTINCT * len(words)) << 1
        | (100 * len(text.translate(None, _NOT_CAPITAL)) > CAPITALS * points) << 2
        | bool(_MARKS(text)) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of docs(doc_id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, digests = [], []
            points = pc.utf8_length(b.column(2)).to_pylist()
            for t, k in zip(b.column(2).cast(pa.binary()), points):
                raw = t.as_py()
                masks.append(own_failures(raw, k))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "own", "digest"])

    facts = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    facts = stash(facts.mapInArrow(run, "doc_id long, part string, own int, digest binary"))
    has_id = facts.where(F.col("doc_id").isNotNull())
    # both sides are tables, so that Spark can split whatever key is hot in the join
    first = stash(has_id.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))).withColumn("first", F.lit(True))
    told = has_id.join(first, ["digest", "doc_id"], "left")
    told = told.select("doc_id", "part", F.col("own").bitwiseOR(F.when(F.col("first").isNull(), 1 << 4).otherwise(0)).alias("mask"))
    return told.unionByName(facts.where(F.col("doc_id").isNull()).select("doc_id", "part", F.col("own").alias("mask")))


def interactions(masks: DataFrame, good: Column, toxic: Column, filters: str = FILTERS) -> DataFrame:
    """One row per part, filter_order and step of masks(part, mask): documents kept and removed, good and toxic ones among
    those removed, redundant and only failures of the step's filter, and its Shapley count."""
    table, names, n = first_failures(filters), orders(filters), len(filters)
    cells = len(names) * (n + 1)  # the last step of an order: never removed
    at = np.arange(len(names)) * (n + 1)
    base = table + at

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            sums = [x.ravel() for x in held.values()]
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["part", "sums"])
            held.clear()
            return batch

        for b in batches:
            parts = b.column(0).dictionary_encode()
            code, mask, label = parts.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k, part in enumerate(parts.dictionary.to_pylist()):
                own = code == k
                # alike documents as one, then all of their orders at once: by label (good, toxic) and cell, weighed
                alike, size = np.unique(mask[own] << 2 | label[own], return_counts=True)
                spot = (alike & 3)[:, None] * cells + base[alike >> 2]
                removed = np.bincount(spot.ravel(), np.repeat(size, len(names)), 4 * cells).astype(np.int64).reshape(4, cells)
                by_mask = np.bincount(alike >> 2, size, 1 << n).astype(np.int64)
                sums = np.concatenate([removed.ravel(), by_mask])
                held[part] = held[part] + sums if part in held else sums
                if len(held) >= _PARTS:
                    yield out()
        if held:
            yield out()

    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = masks.select("part", "mask", (flag(good) + 2 * flag(toxic)).alias("label"))
    partial = rows.mapInArrow(count, "part string, sums array<bigint>")
    sums = partial.select("part", F.posexplode("sums").alias("at", "x")).groupBy("part", "at").agg(F.sum("x").alias("x"))

    def report(key: tuple, t: pa.Table) -> pa.Table:
        x = np.zeros(4 * cells + (1 << n), np.int64)
        x[t["at"].to_numpy()] = t["x"].to_numpy()
        by, by_mask = x[: 4 * cells].reshape(4, len(names), n + 1), x[4 * cells :]
        gone, total = by.sum(axis=0)[:, :n], int(by_mask.sum())
        letter = np.array([[filters.index(c) for c in name] for name in names])
        fails = np.array([by_mask[(np.arange(1 << n) >> j) & 1 == 1].sum() for j in range(n)])
        alone = np.array([by_mask[1 << j] for j in range(n)])
        shapley = np.bincount(letter.ravel(), gone.ravel(), n).astype(np.int64)
        columns = {
            "kept": total - gone.cumsum(axis=1), "removed": gone, "redundant": fails[letter] - gone, "unique_fails": alone[letter],
            "good_lost": (by[1] + by[3])[:, :n], "toxic_lost": (by[2] + by[3])[:, :n], "shapley": shapley[letter],
        }
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(names) * n, pa.string()), "filter_order": pa.array(np.repeat(names, n).tolist()),
            "step": pa.array(np.tile(np.arange(1, n + 1), len(names)), pa.int32()), **{c: pa.array(v.ravel(), pa.int64()) for c, v in columns.items()},
        })

    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return sums.groupBy("part").applyInArrow(report, f"part string, filter_order string, step int, {counts}")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of the five filters over docs(doc_id, text, lang) with labels(doc_id, quality, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad")
    )
    masks, none = stash(failures(docs)), F.lit(None).cast("boolean")
    labelled = masks.where(F.col("doc_id").isNotNull()).join(stash(known), "doc_id", "left")
    rest = masks.where(F.col("doc_id").isNull()).withColumn("good", none).withColumn("bad", none)
    return interactions(labelled.unionByName(rest), F.col("good"), F.col("bad"))


def oracle() -> str:
    """The same as DuckDB SQL."""
    letters = ", ".join(f"('{c}', {i})" for i, c in enumerate(FILTERS))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
masks AS (
  SELECT doc_id, part,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM words),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
tally AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
f(c, bit) AS (VALUES {letters}),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(list_transform(bits[1:step - 1], lambda x: 1 << x)) AS earlier FROM orders, range(1, 6) s(step)),
parts AS (SELECT part, sum(n) AS total FROM tally GROUP BY part),
each AS (
  SELECT p.part, filter_order, step, bit, any_value(total) AS total,
    sum(CASE WHEN mask & (1 << bit) > 0 AND mask & coalesce(earlier, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & (1 << bit) > 0 AND mask & coalesce(earlier, 0)::INT > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = 1 << bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & (1 << bit) > 0 AND mask & coalesce(earlier, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & (1 << bit) > 0 AND mask & coalesce(earlier, 0)::INT = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM parts p JOIN tally t USING (part), steps GROUP BY p.part, filter_order, step, bit)
SELECT part, filter_order, step, (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
  removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM each"""
