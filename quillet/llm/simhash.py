"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance through vantage-point shards.

Two fingerprints within `radius` (3) bits agree exactly on one of radius + 1 disjoint blocks of their bits, so
shards first hold fingerprints at block distance zero. Each such shard is cut into rings of Hamming distance to
a vantage point; by the triangle inequality a neighbour's ring distance differs by `radius` at most, so a
fingerprint that near to a ring's upper end also visits the next ring. Inside a ring small runs are compared
directly; larger ones through a vantage-point tree, pruned by the same bound. A shard yields a spanning forest of
its links, never all pairs of a group.

Defined cases: a null or empty text has fingerprint zero and links like any other; a null doc_id gets a row and
never names a component unless all ids of the component are null; repeated rows each get a row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stash

SHINGLE, SEED, RADIUS, RING = 3, 42, 3, 8
VANTAGE = 0x5BD1E995A17C3F29


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text: bit set if over half of the shingles' XXH64 have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(2)]
            signed = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed], ["doc_id", "text_key", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_key long, fp long"
    )


class _Forest:
    """Union-find over the points of one shard that keeps the links which merged something."""

    def __init__(self, n: int) -> None:
        self.parent, self.links = np.arange(n), []

    def _roots(self, points: np.ndarray) -> np.ndarray:
        """The roots of some points; their ways there become short."""
        root = self.parent[points]
        while ((up := self.parent[root]) != root).any():
            root = up
        self.parent[points] = root
        return root

    def add(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        """Links of near pairs of left and right, one for each pair of trees that meet; only the points at hand are looked at."""
        while True:
            a, b = self._roots(left), self._roots(right)
            near &= a[:, None] != b[None, :]
            hit = np.argwhere(near)
            if not len(hit):
                return
            _, one = np.unique(np.stack([a[hit[:, 0]], b[hit[:, 1]]], 1), axis=0, return_index=True)
            met: dict[int, int] = {}  # of the roots at hand, those that have one now
            for x, y, i, j in zip(*(v.tolist() for v in (a[hit[one, 0]], b[hit[one, 1]], left[hit[one, 0]], right[hit[one, 1]])), strict=True):
                while x in met:
                    x = met[x]
                while y in met:
                    y = met[y]
                if x != y:
                    x, y = min(x, y), max(x, y)
                    self.parent[y] = met[y] = x
                    self.links.append((i, j))


def forest(points: np.ndarray, radius: int = RADIUS, leaf: int = 128) -> list[tuple[int, int]]:
    """Links that span the graph of points at most `radius` bits apart, found through a vantage-point tree."""
    found, todo = _Forest(len(points)), [(np.arange(len(points)), np.arange(len(points)))]
    while todo:
        members, asking = todo.pop()
        if not len(members) or not len(asking):
            continue
        if len(members) <= leaf:
            for i in range(0, len(asking), 4096):
                q = asking[i : i + 4096]
                found.add(q, members, np.bitwise_count(points[q][:, None] ^ points[members][None, :]) <= radius)
            continue
        vantage = points[members[0]]
        d, to = np.bitwise_count(points[members] ^ vantage), np.bitwise_count(points[asking] ^ vantage)
        cut = int(np.median(d))
        inner, outer = members[d <= cut], members[d > cut]
        if not len(outer):
            cut -= 1
            inner, outer = members[d <= cut], members[d > cut]
        if not len(inner):  # all members at one distance: no ball divides them
            half = len(members) // 2
            todo += [(members[:half], asking), (members[half:], asking)]
            continue
        todo += [(inner, asking[to <= cut + radius]), (outer, asking[to.astype(int) > cut - radius])]
    return found.links


def _shard_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted)."""
    if not len(keys):
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    of = np.repeat(sizes, sizes) <= small
    left, right = [], []
    for gap in range(1, small):
        same = np.flatnonzero((keys[gap:] == keys[:-gap]) & of[:-gap])
        if not len(same):
            break
        near = same[np.bitwise_count(fps[same] ^ fps[same + gap]) <= radius]
        left.append(fps[near])
        right.append(fps[near + gap])
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        links = np.array(forest(fps[s : s + n], radius), np.int64).reshape(-1, 2)
        left.append(fps[s + links[:, 0]])
        right.append(fps[s + links[:, 1]])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that span all pairs of distinct fp at most `radius` bits apart."""
    blocks = radius + 1
    width = 64 // blocks
    fp = F.col("fp")
    distance = F.bit_count(fp.bitwiseXOR(F.lit(VANTAGE)))
    ring = F.floor(distance / RING)
    rings = F.when(distance % RING >= RING - radius, F.array(ring, ring + 1)).otherwise(F.array(ring))
    mask = (1 << width) - 1

    def piece(j: int):
        rest = F.shiftrightunsigned(fp, j * width)
        return rest if j == blocks - 1 else rest.bitwiseAND(F.lit(mask))

    keys = F.transform(
        rings,
        lambda r: F.array(
            *(F.struct(F.xxhash64(F.lit(j), piece(j), r).alias("k"), F.lit(j).alias("j")) for j in range(blocks))
        ),
    )
    rows = (
        fps.select("fp").distinct()
        .select("fp", F.explode(F.flatten(keys)).alias("s"))
        .select(F.col("s.k").alias("key"), "fp")
        .repartition("key")
        .sortWithinPartitions("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
            a, b = _shard_links(keys, points, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, points = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, points = np.concatenate([keys, k]), np.concatenate([points, f])
            if keys[0] == keys[-1]:
                continue
            done = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            yield out(keys[:done], points[:done])
            keys, points = keys[done:], points[done:]
        if len(keys):
            yield out(keys, points)

    return rows.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, component_id, first_key): one row per row of docs; first_key tells the texts of equal ids apart."""
    fps = stash(fingerprints(docs, shingle))
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = fps.groupBy("fp").agg(F.min(head).alias("head"))
    found = components(links(fps, radius))
    # tables of their own: a join right above an aggregation could not be split where one component is hot
    named = stash(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root")))
    heads = stash(named.groupBy("root").agg(F.min("head").alias("head")))
    per_fp = named.select("fp", "root").join(heads, "root").select("fp", "head")
    return fps.join(per_fp, "fp").select(
        "doc_id", "text_key", "fp", F.col("head.doc_id").alias("component_id"), F.col("head.text_key").alias("first_key")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    return groups(docs, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each near-duplicate group (the row of the smallest id, then text hash)."""
    first = (
        groups(docs, shingle, radius)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .distinct()
    )
    # two hashes name a row by id and text: the join and the choice of one row share their shuffle
    name = lambda i, t: (F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(1)).alias("k2"))
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of their own, whatever those of docs
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    keyed = rows.select("*", *name(at["doc_id"].cast("long"), F.xxhash64(F.coalesce(at["text"], F.lit("")))))
    first = first.select(*name(F.col("_id"), F.col("_key")))
    kept = keyed.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*rows.columns).toDF(*docs.columns)
