import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quillet.llm import suffix


def brute(texts, w):
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60), prose(45), "x" * 300, "ab" * 400]
    rows = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s))))
            parts += [s[a:b] if rng.random() < 0.5 else s, prose(rng.randint(0, 20))]
        rows.append(rng.choice(["", " "]).join(parts))
    base = prose(300)
    for _ in range(15):
        c = list(base)
        for _ in range(rng.randint(0, 6)):
            c[rng.randrange(len(c))] = "Z"
        rows.append("".join(c))
    return rows + [rows[3], rows[3], "", "short", "y" * 199, "y" * 200, "q" * 201, None]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = texts(seed)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("core", F.lit("clash"))
        got = {r.doc_id: tuple(r)[1:] for r in suffix.repeats(df.repartition(3)).collect()}
        want = brute([(t or "").encode() for t in rows], 200)
        assert [got[i] for i in range(len(rows))] == want


def test_slabs_do_not_change_results(spark, monkeypatch):
    from quillet.llm import _windows

    rows = [(t or "") for t in texts(5)]
    data = __import__("numpy").frombuffer("".join(rows).encode(), "uint8")
    import numpy as np

    ends = np.cumsum([len(t.encode()) for t in rows])
    one, cut = np.ones(len(data), np.int8), np.zeros(len(data), bool)
    whole = {int(f): int(c) for s in _windows.blocks(data, ends, one, cut, 200, 1) for f, c in zip(s[0], s[2], strict=True)}
    monkeypatch.setattr(_windows, "SLAB", 777)
    parts = {int(f): int(c) for s in _windows.blocks(data, ends, one, cut, 200, 1) for f, c in zip(s[0], s[2], strict=True)}
    assert whole == parts


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "k" * 250), (1, "k" * 250), (None, None), (2, "é" * 150)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in suffix.repeats(df).collect())
    assert got == [(0, 0, 0, 0), (1, 250, 250, 1), (1, 250, 250, 1), (2, 300, 300, 1)]
    assert suffix.repeats(df.where("false")).count() == 0
    out = suffix.remove_repeats(df.withColumn("lang", F.lit("x")).withColumn("n_chars", F.lit(1).cast("long")))
    assert out.columns == ["doc_id", "text", "lang", "n_chars"] and out.where("n_chars > 0").count() == 0


def test_internal_names_stay_the_callers(spark):
    same = "abc def " * 40
    df = spark.createDataFrame([("w", "k", 5, 1, same), ("v", None, 6, 2, "z" + same)], "_whole string, _k1 string, rid long, doc_id long, text string")
    got = [tuple(r) for r in suffix.remove_repeats(df).orderBy("doc_id").collect()]
    assert got == [("w", "k", 5, 1, ""), ("v", None, 6, 2, "z")]
