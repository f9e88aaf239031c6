import numpy as np
from pyspark.sql import functions as F

from quillet.llm import neighbours


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order[: min(k, len(ids) - 1)]]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(m)] for q, m in got.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[100:400] = x[100]  # one vector that many rows share
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], block=1000)
    want = brute(np.arange(len(x)), x.astype(float))
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.95
    for q, m in got.items():
        assert len(m) == 20 and q not in {v for v, _ in m}
        assert m == sorted(m, key=lambda t: (-t[1], t[0]))
        assert np.allclose([s for _, s in m], [float((x[q].astype(float) * x[v]).sum()) for v, _ in m])
    assert [v for v, _ in got[100]] == [v for v, _ in want[100]]


def test_pivots_are_spread():
    rng = np.random.default_rng(7)
    x = np.r_[np.ones((50, 8)) + rng.normal(size=(50, 8)) * 1e-3, np.ones((5, 8)), rng.normal(size=(40, 8))]
    assert len(neighbours.spread(x, 10)) == 10
    close = (neighbours.spread(x, 10) @ np.ones(8) / 8**0.5) / np.linalg.norm(neighbours.spread(x, 10), axis=1) > 0.99
    assert close.sum() == 1
    assert len(neighbours.spread(x, 96)) == 91


def test_share_of_one_is_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], share=1.0, block=100)
    want = brute(np.arange(300), x.astype(float))
    assert {q: [v for v, _ in m] for q, m in got.items()} == {q: [v for v, _ in m] for q, m in want.items()}


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (1, [1.0, 1.0])]
    got = run(spark, rows)
    assert {q: [v for v, _ in m] for q, m in got.items()} == {0: [1, 1, 20], 20: [1, 1, 0]}  # every row but the query's own
    assert run(spark, rows[:0]) == {}
    assert run(spark, [(1, [1.0])]) == {}


def test_recall_with_unequal_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tenfold = np.where(np.arange(4000) % 100 == 7, 10.0, 1.0)
    for lengths in (rng.lognormal(sigma=0.5, size=4000), tenfold):
        y = (x * lengths[:, None]).astype(np.float32)
        got = run(spark, [(i, v.tolist()) for i, v in enumerate(y)])
        want = brute(np.arange(len(y)), y.astype(float))
        hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        print("recall", hit / (20 * len(want)))
        assert hit / (20 * len(want)) >= 0.95


def test_repeated_ids_and_other_sizes(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0, 1.0]), (20, [1.0, 2.0, 0.0]), (20, [0.5, 0.0]), (3, [4.0, 1.0])]
    got = run(spark, rows)
    assert got[0] == [(3, 4.0), (1, 3.0), (1, 2.0), (20, 0.5)]
    assert sorted(got[20]) == sorted([(2, 3.0), (3, 2.0), (1, 1.5), (1, 1.0), (0, 0.5)])  # two queries of one id


def test_lists_hold_what_the_footrule_needs():
    rng = np.random.default_rng(2)
    orders = np.array([rng.permutation(16) for _ in range(50)]).astype(np.uint8)
    index = neighbours.Postings(orders[:, :6], 16)
    assert sum(len(p) for p, _ in index.lists) == 50 * 6
    for q in orders[:5]:
        asked = q[:4]
        want = [sum(abs(r - (list(o[:6]).index(p) if p in o[:6] else 6)) for r, p in enumerate(asked)) for o in orders]
        assert index.footrule(asked).tolist() == want


def test_recall_over_the_tables(spark):
    for sf in ("0.01", "0.1"):
        table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding]
        ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
        want = brute(ids, x)
        got = {}
        for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hit = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
        print("recall", sf, hit / (20 * len(want)))
        assert hit / (20 * len(want)) >= 0.95
