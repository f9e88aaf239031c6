import random
import zlib

import duckdb
import pytest

from quillet.llm import layout, queries


def brute(docs, file_rows=500, reach=2):
    """Rows of (doc_id, text, source, lang), every row's query against every row and file."""
    key = lambda x: (x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0)
    values = [(s, g, -1 if t is None else len(t.encode()), None if i is None else zlib.crc32(str(i).encode()) % 365) for i, t, s, g in docs]
    columns = [sorted(map(key, c)) for c in zip(*values)]
    at = [[16 * sum(x < key(v) for x in c) // len(docs) for v, c in zip(row, columns)] for row in values]
    spell = [lambda s, g, n, d: "".join(f"{n:04b}"[k] + f"{s:04b}"[k] + f"{d:04b}"[k] + f"{g:04b}"[k] for k in range(4))][0]
    rows = sorted((int(spell(*c), 2), key(d[0]), c, d[0]) for c, d in zip(at, docs))
    files = [rows[k : k + file_rows] for k in range(0, len(rows), file_rows)]
    box = [[(min(r[2][k] for r in f), max(r[2][k] for r in f)) for k in range(4)] for f in files]
    out = []
    for p, (z, _, c, i) in enumerate(rows):
        low, high = [c[0], c[1], c[2] - reach, c[3] - reach], [c[0], c[1], c[2] + reach, c[3] + reach]
        touched = sum(all(b[k][0] <= high[k] and b[k][1] >= low[k] for k in range(4)) for b in box)
        matching = sum(any(all(low[k] <= r[2][k] <= high[k] for k in range(4)) for r in f) for f in files)
        out.append((i, z, p, p // file_rows, touched, matching, ",".join(f"{a},{b}" for a, b in box[p // file_rows])))
    return out


def result(df):
    assert df.columns == ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]
    return sorted(map(tuple, df.collect()), key=lambda r: r[2])


def frame(spark, docs, parts=3):
    rows = [(*d, 0, "x") for d in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, z int, file string").repartition(parts)


def some(seed, n, ids):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "日", "Z", *(f"s{i}" for i in range(rng.choice((1, 30))))]
    hot = rng.choice(sources)
    return [
        (i, rng.choice((None, "", "é" * rng.randrange(40), "x" * rng.randrange(200))), hot if rng.random() < 0.3 else rng.choice(sources), rng.choice(("en", "de", "fr", None)))
        for i in ids(rng, n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs = some(seed, 700, lambda rng, n: rng.sample(range(-50, 5000), n))
    assert result(layout.clustered(frame(spark, docs), 20 + 15 * seed)) == brute(docs, 20 + 15 * seed)


def test_repeated_rows_and_null_ids(spark):
    docs = some(4, 300, lambda rng, n: [rng.choice((None, *range(40))) for _ in range(n)])
    docs += docs[:50]
    assert result(layout.clustered(frame(spark, docs), 25)) == brute(docs, 25)


def test_one_value_empty_and_single(spark):
    same = [(5, "x", "a", "en")] * 90
    assert result(layout.clustered(frame(spark, same), 40)) == brute(same, 40)
    one = [(None, None, None, None)]
    assert result(layout.clustered(frame(spark, one))) == brute(one)
    assert layout.clustered(frame(spark, one).limit(0)).count() == 0


def test_whole_table_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(layout.oracle()).fetchall(), key=lambda r: r[2])
    assert result(queries.op13_clustered_layout(spark, folder)) == want
    docs = con.execute("SELECT doc_id, text, source, lang FROM documents").fetchall()
    assert want == brute(docs)


def test_nothing_that_grows_is_broadcast_or_in_one_task(spark):
    """Rows join on tables that Spark may split; the only windows over everything are over blocks of cells."""
    plan = layout.clustered(frame(spark, some(5, 300, lambda rng, n: range(n))), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2 and "CartesianProduct" not in plan and "SinglePartition" not in plan
