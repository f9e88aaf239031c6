import random

import numpy as np
from pyspark.sql import functions as F

from quillet.llm import quality


def corpus(n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        host = f"h{min(int(rng.expovariate(0.5)), 9)}"
        good = rng.random() < (0.2 if host == "h1" else 0.9)
        w = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(40, 90))]
        text = " ".join(w) if good else rng.choice([lambda: " | ".join(w), lambda: "!! ".join(w).upper(), lambda: " ".join([w[0]] * 40 + [w[1]] * 30)])()
        rows.append((i, text, host, f"p{i % 3}"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_every_row(spark):
    rows, labels = corpus()
    rows += [(5000, None, "h1", "p0"), (5001, "", None, None), (None, "a few plain words stand here", "rare", "x"), (5002, "word " * 40000, "h2", "p1"), (3, rows[3][1], "h3", "p0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, sub string").withColumn("evidence", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab)
    got = quality.score(df, model, F.col("source"), F.col("sub")).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = spark.createDataFrame([(i,) for i in truth], "i long").where(F.crc32(F.col("i").cast("string")) % 5 == 0).collect()
    held = {r.i for r in held}
    right = [r.keep == truth[r.doc_id] for r in got if r.doc_id in held]
    assert np.mean(right) > 0.95
    bad = [r.path_share for r in got if r.doc_id in truth and rows[r.doc_id][2] == "h1"]
    assert max(bad) < min(r.path_share for r in got if r.doc_id in truth and rows[r.doc_id][2] == "h0")


def test_shares_against_plain_arithmetic(spark):
    rows, labels = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, sub string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.score(df, model, F.col("source"), F.col("sub")).collect()}
    e = model.evidence(np.array([quality.shape(t) for _, t, _, _ in rows]))
    own = 1 / (1 + np.exp(-(e + model.base)))
    host, path = np.array([r[2] for r in rows]), np.array([f"{r[2]}/{r[3]}" for r in rows])

    def strength(keys, centre):
        spread, k = 0.0, 0
        for g in set(keys):
            m = own[keys == g]
            spread += len(m) * (m.mean() - centre[keys == g][0]) ** 2
            k += 1
        mean = own.mean()
        between = (spread - k * mean * (1 - mean)) / len(own)
        return min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6

    centre = (own.sum() + 0.5) / (len(own) + 1)
    kh = strength(host, np.full(len(own), centre))
    full = np.array([(kh * centre + own[host == h].sum()) / (kh + (host == h).sum()) for h in host])
    kp = strength(path, full)
    for i in range(len(rows)):
        h = (kh * centre + own[host == host[i]].sum() - own[i]) / (kh + (host == host[i]).sum() - 1)
        p = (kp * h + own[path == path[i]].sum() - own[i]) / (kp + (path == path[i]).sum() - 1)
        assert abs(got[i].host_share - h) < 1e-9 and abs(got[i].path_share - p) < 1e-9
        assert abs(got[i].score - 1 / (1 + np.exp(-(e[i] + np.log(p / (1 - p)))))) < 1e-9


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "h", "p")], "doc_id long, text string, source string, sub string")
    model = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(df, model, F.col("source"), F.col("sub")).first().evidence == 0
    assert quality.score(df.where("false"), model, F.col("source"), F.col("sub")).count() == 0
