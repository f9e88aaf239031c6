import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillet.llm import simhash


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[a] = b
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), []).append(ids[i])
    return {i: min(m) for m in out.values() for i in m}


def test_fingerprint_matches_brute_force():
    for t in ["", None, "One", "one TWO", "É a b c d", "a\x0bb\x0cc d\x1ce", "x y z " * 40]:
        assert simhash.fingerprint(t) == brute_fp(t)


def test_forest_spans_all_links():
    rng = random.Random(1)
    points = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(500):
        p = rng.choice(points)
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    links = simhash.forest(np.array(points, np.uint64), leaf=8)
    assert all((points[a] ^ points[b]).bit_count() <= 3 for a, b in links)
    want = brute_components(list(range(len(points))), points)
    got = {i: i for i in range(len(points))}
    for _ in range(len(points)):
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert len(set(got.values())) == len(set(want.values()))
    assert got == want


def test_groups_over_a_table(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(99)) for _ in range(400)) for _ in range(8)]
    rows = []
    for k in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "one"), (203, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    for (i, _), fp in zip(rows, fps, strict=True):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == want[i]
    kept = {r.doc_id for r in simhash.keep_first(df).collect()}
    assert kept == set(want.values())


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 4
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.fingerprint != "0" * 16) == [(False, 1), (False, 1), (True, 1)]
    assert simhash.keep_first(df).count() == 2
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_internal_names_stay_the_callers(spark):
    rows = [(1, "a b c d", "x", 7, "k"), (2, "a b c d", "y", 8, "l"), (2, "a b c d", "y", 8, "l"), (3, None, "z", 9, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row_key string, _text_key long, k1 string")
    got = sorted(simhash.keep_first(df).collect())
    assert [tuple(r) for r in got] == [rows[0], rows[3]]


def test_trees_grow_with_the_points_they_meet():
    """Links of many points in linear time, and the same components as by every pair."""
    import time

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    points = np.unique(np.repeat(base, 40) ^ (np.uint64(1) << rng.integers(0, 60, 20_000).astype(np.uint64)))
    began = time.process_time()
    links = simhash.forest(points)
    assert time.process_time() - began < 10
    few = points[:600]
    near = np.bitwise_count(few[:, None] ^ few[None, :]) <= simhash.RADIUS
    root = np.arange(len(few))
    for _ in range(60):
        root = np.where(near, root[None, :], len(few)).min(axis=1)
    found = simhash.forest(few)
    own = np.arange(len(few))
    for i, j in found * 1:
        own[own == max(own[i], own[j])] = min(own[i], own[j])
    assert len(set(own.tolist())) == len(set(root.tolist())) and len(found) == len(few) - len(set(own.tolist())) and len(links) < len(points)


def test_hubs_are_joined_between_tables(spark):
    """No aggregation stands right below the joins of the components' rounds and of the names, so Spark may split them."""
    plan = simhash.groups(spark.createDataFrame([(i, f"a b c {i % 3}") for i in range(20)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
