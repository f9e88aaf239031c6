import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quillet.llm import toxicity


def corpus(n=600):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(["blorgh", "Vexfop", "kwazzel"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_fold():
    assert toxicity.fold("1d10t ѕtupid s.t.u.p.i.d tr@sh 100 a1 ＩＤＩＯＴ price$$$") == "idiot stupid stupid trash 100 a1 idiot price$$$"


def test_exceptions_and_longest_entry():
    m = toxicity.Model({"trash": 5.0, "tra": 1.0})
    a = m.automaton()
    assert m.evidence("the trash can is here", a)[1] == 0
    assert m.evidence("trash", a)[1] > m.evidence("train", a)[1] > 0
    assert m.evidence("", a) == m.evidence(None, a) == (0.0, 0.0)


def brute(model, text):
    """Every entry and phrase tried at every word of the text."""
    own = toxicity.words(text)
    line, at, total = " " + " ".join(own) + " ", 0, 0.0
    covered = set()
    for phrase in model.exceptions:
        for i in range(len(line)):
            if line.startswith(f" {phrase} ", i):
                covered.update(range(i, i + len(phrase) + 1))
    for w in own:
        fits = [e for e in model.weights if (w + " ").startswith(e)]
        if fits and at not in covered:
            total += model.weights[max(fits, key=len)]
        at += len(w) + 1
    return (math.log1p(100 * total / (len(own) + 10)), math.log1p(total)) if own else (0.0, 0.0)


def test_against_brute_force():
    m = toxicity.Model({"trash": 5.0, "tra": 1.0, "can ": 2.0, "idio": 3.0, "loser": 2.5}, ("trash can", "can of", "sore loser bracket"))
    a, rng = m.automaton(), random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice("trash can of idiot train canned tr4sh sore loser bracket the a".split()) for _ in range(rng.randint(0, 30)))
        assert m.evidence(text, a) == pytest.approx(brute(m, text))


def test_many_exceptions_take_linear_time():
    m = toxicity.Model({"trash": 5.0})
    began = time.perf_counter()
    assert m.evidence("trash can " * 100_000 + "trash", m.automaton())[1] == pytest.approx(math.log1p(5))
    assert time.perf_counter() - began < 5


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (None, "blorgh blorgh"), (9002, "bl0rgh vexf0p " * 5000), (9003, "fine " * 50000), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[9002].predicted == 1 and by[9003].predicted == by[9000].predicted == by[9001].predicted == 0
    assert not by[None].held_out
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, none)
    assert toxicity.score(df, model).first().predicted == 0
    assert toxicity.score(df.where("false"), model).count() == 0
