"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `prefix` nearest pivots in order. The vectors are dealt into blocks; the inverted file of a
block posts, under each pivot, the vectors that have it in their prefix and the rank it has with them. A query reads the
lists of its own `ask` nearest pivots alone and adds up the distance of ranks (Spearman's footrule; a vector that a list
does not hold counts as rank `prefix`). The `share` of the block with the greatest length times the cosine that the
footrule may stand for (all ties of the last included; with equal lengths these are the least footrules) is ranked anew
by the exact measure, and the best of all blocks are merged. A share, not a number, of each block is reranked, so recall
does not fall as the table grows.

Blocks and parts of the queries meet in cells of at most `block` vectors and `block` queries, so a vector is copied
once for each `block` queries and a task is bounded. Pivots come from the `sample` rows of the smallest id hashes,
distinct and well apart, `pivots` at most: a bounded sample. Every row is indexed. Nearness is the inner product in
double precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or
candidates, nor do rows without id. Vectors are near to vectors of their own size alone; the commonest size has the
index, all rarer ones are searched exactly. Each of several rows with one id is a candidate and, if it is a query, asks
by itself, for all rows but itself; equal scores go to the smaller id; a query with fewer than `k` candidates gets them
all; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

PIVOTS, PREFIX, ASK, SHARE, BLOCK, SAMPLE = 256, 128, 64, 0.3, 32_768, 1024
_SMALL = 2048  # vectors below which a block is not cut for the sake of more tasks


def usable(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, v array<double>, d) of the rows that take part, d their size."""
    return vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")
    ).where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    ).withColumn("d", F.size("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.uint8)


def spread(rows: np.ndarray, most: int, near: float = 0.8) -> np.ndarray:
    """Up to `most` distinct rows, in order, first those whose cosine with all taken before is at most `near`:
    a vector that many rows share, exactly or nearly, is no more than one of them while others are left."""
    rows = np.array(list(dict.fromkeys(map(tuple, rows))), float)
    if not len(rows):
        return rows
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    taken: list[int] = []
    for i in range(len(rows)):
        if len(taken) < most and (not taken or (unit[taken] @ unit[i]).max() <= near):
            taken.append(i)
    rest = [i for i in range(len(rows)) if i not in set(taken)]
    return rows[(taken + rest)[:most]]


def _pivots(base: DataFrame, pivots: int, sample: int) -> np.ndarray:
    rows = base.orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(sample).collect()
    points = spread(np.array([r.v for r in rows], float), pivots)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


class Postings:
    """The inverted file of one block: under each pivot the places of the vectors that have it, and its ranks with them."""

    def __init__(self, near: np.ndarray, pivots: int) -> None:
        n, self.prefix = near.shape
        flat = near.reshape(-1)
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(pivots + 1))
        places, ranks = order // self.prefix, (order % self.prefix).astype(np.uint8)
        self.n, self.lists = n, [(places[a:b], ranks[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def footrule(self, asked: np.ndarray) -> np.ndarray:
        """The distance of every vector from a query's nearest pivots, in order; only their lists are read."""
        r = np.arange(len(asked))
        total = np.full(self.n, (self.prefix - r).sum(), np.int32)
        for rank, pivot in enumerate(asked):
            places, ranks = self.lists[pivot]
            gain = (np.abs(np.arange(self.prefix) - rank) - (self.prefix - rank)).astype(np.int32)
            total[places] += gain[ranks]
        return total


def _search(
    ids: np.ndarray, rids: np.ndarray, x: np.ndarray, near: np.ndarray | None, own: np.ndarray, q: np.ndarray,
    asked: np.ndarray | None, pivots: int, share: float, k: int,
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each query (own: its rid), the places of the best of one block and their scores; exactly, if there is no index."""
    n = len(ids)
    if near is not None:
        index, take = Postings(near, pivots), max(int(np.ceil(share * n)), min(n, k + 1))
        # the footrule of unrelated orders stands for a cosine of 0, none for 1
        ranks = np.minimum(np.arange(pivots), index.prefix)
        far = np.abs(np.arange(asked.shape[1])[:, None] - ranks).mean(axis=1).sum() or 1
        blur = 2 / pivots**0.5  # how far such a cosine may be off: a long vector just below 0 by it may be near
        length = np.linalg.norm(x, axis=1)
        length = np.round(length / length.max(), 6)  # equal but for rounding is equal
    places, scores = [], []
    for i in range(len(own)):
        if near is None:
            some = np.flatnonzero(rids != own[i])
        else:
            likely = length * (1 - index.footrule(asked[i]) / far + blur)
            some = np.flatnonzero(likely >= np.partition(likely, n - take)[n - take])
            some = some[rids[some] != own[i]]
        rough = x[some] @ q[i]
        if len(rough) > k:
            last = np.partition(rough, len(rough) - k)[len(rough) - k]
            some = some[rough >= last - 1e-9 * (1 + abs(last))]
        s = (x[some] * q[i]).sum(axis=1)  # the same sum for equal vectors, so ties are ties
        best = np.lexsort((ids[some], -s))[:k]
        places.append(some[best])
        scores.append(s[best])
    return places, scores


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, ask: int = ASK,
    share: float = SHARE, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds, over all rows but its own."""
    if pivots > 256 or prefix > 255:
        raise ValueError("pivots and ranks are single bytes: 256 pivots and a prefix of 255 at most")
    spark = vectors.sparkSession
    base = stash(usable(vectors).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = base.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return nothing
    common = common.d
    points = _pivots(base.where(F.col("d") == common), pivots, sample)
    prefix, ask = min(prefix, len(points)), min(ask, len(points))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(3).to_numpy()
            found = np.full(len(d), None, object)
            some = np.flatnonzero(d == common)
            if len(some):
                found[some] = [r.tobytes() for r in nearest_pivots(_matrix(b.column(2).take(pa.array(some))), points, max(prefix, ask))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, "near"])

    indexed = base.mapInArrow(near, "rid long, vec_id long, v array<double>, d int, asks boolean, near binary")
    sizes = {r.usual: r for r in base.groupBy((F.col("d") == common).alias("usual")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()}
    tasks = spark.sparkContext.defaultParallelism

    def cut(n: int) -> int:
        return max(1, -(-n // block), min(tasks, n // _SMALL))

    def of_size(number) -> Column:
        rare = number(sizes[False]) if False in sizes else 1
        return F.when(F.col("d") == common, number(sizes[True])).otherwise(rare)

    blocks, parts = of_size(lambda r: cut(r.n)), of_size(lambda r: max(1, -(-r.q // block)))
    spot = F.xxhash64("rid", F.lit(7))
    # every part of the stated queries meets every block of their size; both sides are bounded, so is a task
    left = indexed.select(
        "rid", "vec_id", "v", "near", "d", F.pmod(spot, blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    )
    right = indexed.where("asks").select(
        "rid", "vec_id", "v", "near", "d", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(spot, parts).cast("int").alias("part")
    )

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, rids, own = (t[c].to_numpy() for t, c in ((a, "vec_id"), (a, "rid"), (b, "rid")))
        order = [None, None]
        if a["d"][0].as_py() == common:
            order = [np.frombuffer(b"".join(t["near"].to_pylist()), np.uint8).reshape(t.num_rows, -1)[:, :m] for t, m in ((a, prefix), (b, ask))]
        places, scores = _search(ids, rids, _matrix(a["v"]), order[0], own, _matrix(b["v"]), order[1], len(points), share, k)
        found = [len(p) for p in places]
        return pa.table(
            [pa.array(np.repeat(own, found)), pa.array(np.repeat(b["vec_id"].to_numpy(), found)), pa.array(ids[np.concatenate(places)]), pa.array(np.concatenate(scores))],
            names=names,
        )

    cells = ["d", "block", "part"]
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(meet, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
