import base64
import hashlib

import zstandard
from pyspark.sql import functions as F

from quillet.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", "<p>Ünique</p>"), (4, "http://a/4", None),
    (5, "http://a/5", ""), (6, None, "x" * 700_000), (7, "http://a/7\r\nEvil: 1", "<p>same</p>"), (8, "u", "<p>twin</p>"), (8, "u", "<p>twin</p>"),
    (None, "n", "<p>same</p>"), (None, "m", "<p>alone</p>"), (9, "q", "a\r\n\r\nWARC/1.1\r\n\r\nb"),
]


def brute(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        own = groups[p]
        top = max((x for x in own if x is not None), default=None)
        first = len(own) == 1 or i == top
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    bundles = warc.write(df.repartition(3), frame=1000, bundle=300_000)
    # how many bundles there are is up to the partitions; each holds whole records within its size, but for one that is longer
    sizes = bundles.select("n_records", F.length("content")).collect()
    assert sum(n for n, _ in sizes) == len(PAGES)
    got = [tuple(r)[:5] for r in warc.read(bundles).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, brute(PAGES)))


def test_seek_and_plain_decompression(tmp_path):
    w = warc.Writer(frame=500)
    plain = []
    for i in range(50):
        name = warc.record_id(i, "u")
        data = warc.record(i, "u", f"<p>{i}</p>".encode() * (i + 1), None, True, name)
        w.add(name, data)
        plain.append(data)
    bundle = w.close()
    r = warc.Reader(bundle)
    assert len(r.at) > 10
    for i in (49, 0, 17):
        assert r.record_at(warc.record_id(i, "u")).payload == f"<p>{i}</p>".encode() * (i + 1)
    warc.export(bundle, str(tmp_path / "x.warc.zst"))
    with open(tmp_path / "x.warc.zst", "rb") as f:  # any decoder reads the archive and skips index and footer
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(plain)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df)).count() == 0


def test_hot_payload_spreads(spark):
    html = F.when(F.col("id") % 2 == 0, F.lit("hot" * 50)).otherwise(F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 256)))
    pages = spark.range(4000).repartition(8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    bundles = warc.write(pages)
    sizes = [r.n_records for r in bundles.collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500  # half of all rows share one payload
    assert warc.read(bundles).where("record_type = 'revisit' and refers_to = 3998").count() == 1999


def test_every_record_has_an_id_of_its_own(spark):
    """Equal rows in many tasks are records each, and an index finds every one of them."""
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")] * 40, "page_id long, url string, html string").repartition(4)
    rows = warc.read(warc.write(pages, bundle=300)).collect()
    assert len(rows) == 40 and len({r.record_id for r in rows}) == 40
