import random
import re
from itertools import permutations

import duckdb

from quillet.llm import interaction, queries


def brute(docs, labels):
    """Every order applied to every document, one after another."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            c for c, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and ids[t] < i)) if x
        }

    parts = {}
    for i, t, lang in docs:
        parts.setdefault(lang or "", []).append((i, fails(i, t)))
    rows = []
    for part, own in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, c in enumerate(order, 1):
                out = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(out)
                found.append([part, order, step, len(left), len(out), sum(c in f for _, f in gone), sum(f == {c} for _, f in own), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)])
                gone += out
        rows += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(rows)


def result(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, df.collect()))


def test_first_failures():
    table = interaction.first_failures()
    assert table.shape == (32, 120)
    for k, order in enumerate(interaction.orders()):
        for mask in range(32):
            assert table[mask, k] == next((s for s, c in enumerate(order) if mask >> "ABCDE".index(c) & 1), 5)


def test_equals_brute_force_and_sql(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["LOUD", "a#b", "é", "日本", "x|y"]
    texts = [" ".join(rng.choice(words[: rng.choice((5, 150, 305))]) for _ in range(rng.choice((0, 5, 99, 100, 140)))) for _ in range(120)] + [None, "", " \t\n", "A" * 500, "\x1cx\x85y " * 60, "ÀÉ" * 20]
    docs = [(rng.choice((None, *range(400))), rng.choice(texts), rng.choice(("en", "de", None, "")), i) for i in range(900)]
    labels = [(rng.choice((None, *range(400))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = result(interaction.audit(frame, known))
    assert got == brute([d[:3] for d in docs], labels) and len(got) == 600 * 3
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", known.toPandas().astype("Int64"))
    assert sorted(con.execute(interaction.oracle()).fetchall()) == got


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(7, None, None)], docs.schema)
    assert result(interaction.audit(one, labels)) == brute([(7, None, None)], [])


def test_whole_table_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert sorted(con.execute(interaction.oracle()).fetchall()) == result(queries.op12_filter_interaction(spark, folder))
