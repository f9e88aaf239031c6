"""Archives that are damaged, too large, or larger than they say."""

import io
import struct
import tarfile
import tracemalloc
import zipfile

import pytest

from quillet.operators import orders
from quillet.sources import archives
from quillet.sources.archives import Limits, members


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    return out.getvalue()


FILES = [("r/a.tex", b"x" * 100), ("r/b.bib", b""), ("r/c.png", bytes(range(256)))]


@pytest.mark.parametrize(("name", "data"), [("a.zip", zipped(FILES)), ("a.tar", tarred(FILES, "w")), ("a.tar.gz", tarred(FILES)), ("a.tgz", tarred(FILES))])
def test_members_and_every_way_to_cut_them_short(name, data):
    assert [(m[0], m[3], m[4]) for m in members(io.BytesIO(data), name, True)] == [(n, c, None) for n, c in FILES]
    assert [(m[0], m[1], m[3]) for m in members(io.BytesIO(data), name, False)] == [(n, len(c), None) for n, c in FILES]
    whole = [(n, c) for n, c in FILES]
    for k in range(0, len(data), 7):
        got = list(members(io.BytesIO(data[:k]), name, True))
        said = [m[4] for m in got if m[4]]
        assert [(m[0], m[3]) for m in got if not m[4]] == whole[: len(got) - len(said)] and (said or len(got) == len(FILES)) and len(said) <= 1


def test_guards():
    data = zipped(FILES)
    issue = lambda **k: [m[4] for m in members(io.BytesIO(data), "a.zip", True, Limits(**k))]
    assert issue(entries=2) == ["too many entries"] and issue(expanded=300) == ["too large"] and issue(packed=10) == ["archive too large"] and issue() == [None] * 3
    tar = tarred(FILES)
    issue = lambda **k: [m[4] for m in members(io.BytesIO(tar), "a.tgz", True, Limits(**k))]
    assert issue(entries=2)[-1] == "too many entries" and issue(expanded=300)[-1] == "too large" and issue(packed=10) == ["archive too large"]


def test_a_bomb_is_refused_in_constant_memory():
    bomb = zipped([("a.tex", b"\0" * (200 << 20))])
    small = tarred([("a.tex", b"\0" * (200 << 20))])
    # a zip that says less than it holds
    lie = bytearray(bomb)
    at = lie.rfind(b"PK\1\2")
    lie[at + 24 : at + 28] = struct.pack("<I", 1000)
    tracemalloc.start()
    for data, name, want in ((bomb, "a.zip", "too large"), (small, "a.tgz", "too large"), (bytes(lie), "a.zip", "not of its size")):
        tracemalloc.reset_peak()
        got = list(members(io.BytesIO(data), name, True, Limits(expanded=1 << 20)))
        assert got[-1][4].startswith(("damaged", want)) and all(m[3] is None for m in got)
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_source_by_members_and_by_folders(spark, tmp_path):
    spark.dataSource.register(archives.ArchiveSource)
    many = [(f"r/{i}.tex", bytes([i]) * 1000) for i in range(20)]
    (tmp_path / "a.zip").write_bytes(zipped(many))
    (tmp_path / "b.tgz").write_bytes(tarred(FILES))
    (tmp_path / "bad.zip").write_bytes(b"broken")
    (tmp_path / "no.txt").write_bytes(b"x")
    one = spark.read.format("archive").option("split", 3000).load(str(tmp_path / "a.zip"))
    assert one.rdd.getNumPartitions() == 7 and sorted((r.name, bytes(r.content)) for r in one.collect()) == sorted(many)
    every = spark.read.format("archive").load(f"file://{tmp_path}")
    got = {r.archive.rsplit("/", 1)[1]: r.n for r in every.where("issue IS NULL").groupBy("archive").count().withColumnRenamed("count", "n").collect()}
    assert got == {"a.zip": 20, "b.tgz": 3}
    report = {r.archive.rsplit("/", 1)[1]: (r.n, r.issue) for r in orders.archive_report(every).collect()}
    assert report == {"a.zip": (20, None), "b.tgz": (3, None), "bad.zip": (0, "damaged zip")}
    tight = spark.read.format("archive").option("expanded", 10_000).load(str(tmp_path / "a.zip"))
    assert [(r.name, r.issue) for r in tight.collect()] == [(None, "too large")]
