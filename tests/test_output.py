"""Tables, footnotes, figures, and documents written by tasks and read back."""

import random
import re
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillet.functions import images
from quillet.functions import latex as L
from quillet.operators import render
from quillet.plans import documents, papers
from quillet.sources import docx

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 20) + b"rest"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc4" + struct.pack(">H", 3) + b"x" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 30, 60) + b"....."


def places(tex):
    return [(c["row"], c["col"], c["row_span"], c["col_span"], c["align"], "".join(r["text"] for r in c["runs"])) for c in L.grid(tex)]


def test_grid_of_spans_in_both_directions():
    t = r"\begin{tabular}{lcr}\multirow{2}{*}{N} & \multicolumn{2}{c}{S} \\ & a & b \\ \multirow[t]{2}*{x} & \multicolumn{2}{r}{\multirow{2}{*}{m}}\\ & & \\ k & v & \\ & & \multirow{-2}{*}{w}\\ \multicolumn{9}{c}{G}\\ \multirow{9}{*}{z}\end{tabular}"
    assert places(t) == [
        (0, 0, 2, 1, "l", "N"), (0, 1, 1, 2, "c", "S"), (1, 1, 1, 1, "c", "a"), (1, 2, 1, 1, "r", "b"), (2, 0, 2, 1, "l", "x"), (2, 1, 2, 2, "r", "m"),
        (4, 0, 1, 1, "l", "k"), (4, 1, 1, 1, "c", "v"), (4, 2, 2, 1, "r", "w"), (5, 0, 1, 1, "l", ""), (5, 1, 1, 1, "c", ""), (6, 0, 1, 3, "c", "G"), (7, 0, 1, 1, "l", "z"), (7, 1, 1, 1, "c", ""), (7, 2, 1, 1, "r", ""),
    ]
    # a row that writes where a cell would go on ends it
    assert places(r"\begin{tabular}{ll}\multirow{3}{*}{A} & b\\ & c\\ X & d\end{tabular}")[:1] == [(0, 0, 2, 1, "l", "A")]
    assert L.grid("none") is None and L.grid(None) is None and places(r"\begin{tabular}{l}\end{tabular}") == []


def test_grids_cover_every_place_once():
    rng = random.Random(7)
    for _ in range(400):
        cols = rng.randrange(1, 5)
        cell = lambda: rng.choice(["", "x", r"\multirow{%d}{*}{m}" % rng.choice((2, 3, -2, 0, 9)), r"\multicolumn{%d}{c}{w}" % rng.randrange(1, 4), r"\multicolumn{2}{r}{\multirow{2}{*}{b}}", r"\multirow{2"])
        rows = [" & ".join(cell() for _ in range(rng.randrange(1, cols + 2))) for _ in range(rng.randrange(1, 6))]
        tex = r"\begin{tabular}{%s}%s\end{tabular}" % ("c" * cols, r"\\ ".join(r if r.strip() else "{}" for r in rows))
        seen = [(r, c) for x in L.grid(tex) for r in range(x["row"], x["row"] + x["row_span"]) for c in range(x["col"], x["col"] + x["col_span"])]
        assert sorted(seen) == [(r, c) for r in range(len(rows)) for c in range(cols)], tex


def test_image_headers():
    assert images.kind_and_size(PNG) == ("png", 40, 20) and images.kind_and_size(JPEG) == ("jpeg", 60, 30)
    assert images.kind_and_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == ("gif", 7, 9)
    for k in range(len(JPEG)):
        images.kind_and_size(JPEG[:k])
    assert images.kind_and_size(None) is None and images.kind_and_size(b"%PDF-1.4") is None


def test_footnotes():
    assert L.footnotes("a\\footnote{x {y}} b \\footnote[3]{z} \\footnotesize \\footnote{open") == ("a\x021\x03 b \x022\x03 \\footnotesize \\footnote{open", ["x {y}", "z"])
    assert L.footnotes("\\footnote{a\\footnote{b}}") == ("\x021\x03", ["a\\footnote{b}"]) and L.footnotes(None) == (None, [])


@pytest.fixture
def blocks(spark):
    """Two documents in one output, one of its own, with footnotes, a table and figures."""
    rows = [
        ("a", 1, "\\section{H\\footnote{one}}", "1.1节"), ("a", 2, "T <&> \\footnote{two} and\ttab\n\x0bbreak\\footnote{three}", ""), ("b", 1, "other\\footnote{four}", ""),
        ("b", 2, "\\begin{table}\\begin{tabular}{lc}\\multirow{2}{*}{A} & \\textbf{B}\\\\ & c\\\\ \\multicolumn{2}{c}{w}\\end{tabular}\\caption{Cap}\\end{table}", "表1-1"),
        ("b", 3, "\\begin{figure}\\begin{minipage}{1cm}\\includegraphics{p}\\caption{left}\\end{minipage}\\begin{minipage}{1cm}\\includegraphics{gone}\\end{minipage}\\end{figure}", "图1-1"),
        ("b", 4, "\\begin{figure}\\includegraphics[w]{q.jpg}\\includegraphics{p}\\caption{both}\\end{figure}", "图1-2"), ("c", 1, "alone\\footnote{five}", ""),
    ]
    plan = render.render_plan(spark.createDataFrame(rows, "doc_idx string, id int, text string, env_label string"), drawn=True)
    plan = plan.withColumn("document", F.when(F.col("doc_idx") == "c", "c/ü").otherwise("ab"))
    plan = render.with_notes(plan, ["document"], ["doc_idx", "id"])
    files = spark.createDataFrame([("b", "file:/x/b/p.png", PNG), ("b", "file:/x/b/q.jpg", JPEG), ("c", "file:/x/c/gone.png", PNG)], "folder string, path string, content binary")
    plan = render.with_panels(plan, files)
    return plan.withColumn("pos", F.when(F.col("doc_idx") == "b", 100).otherwise(0) + F.col("id"))


def test_documents_are_written_and_read_back(spark, blocks, tmp_path):
    refs = render.reference_blocks(spark.createDataFrame([(1, "A citation")], "id int, citation string"), F.lit("ab"), 1000)
    render.write_documents(blocks.unionByName(refs, True), str(tmp_path))
    files = sorted(p.relative_to(tmp_path).as_posix() for p in Path(tmp_path).rglob("*") if p.is_file())
    assert len(files) == 2 and all(re.fullmatch(r"part-\d{5}-[0-9a-f]{32}/(ab|c_2f__fc_)\.docx", f) for f in files)
    got = {d: [tuple(r)[2:] for r in sorted(rows, key=lambda r: r.pos)] for d in ("ab", "c/ü") if (rows := [r for r in spark.read.format("docx").load(str(tmp_path)).collect() if r.document == d])}
    assert got["c/ü"] == [("paragraph", 0, "alone", ["five"], 0)]
    assert got["ab"] == [
        ("heading1", 1, "1.1 H", ["one"], 0), ("paragraph", 0, "T <&>  and\ttab\nbreak", ["two", "three"], 0), ("paragraph", 0, "other", ["four"], 0), ("table", 0, "A\tB\n\tc\nw", [], 0),
        ("table", 0, "表1-1 Cap", [], 0), ("table", 0, "\t[图片: gone]\nleft\t", [], 1), ("figure", 0, "图1-1", [], 0), ("paragraph", 0, "", [], 1), ("paragraph", 0, "", [], 1), ("figure", 0, "图1-2 both", [], 0), ("reference", 0, "[1] A citation", [], 0),
    ]
    with zipfile.ZipFile(next(Path(tmp_path).rglob("ab.docx"))) as z:
        xml, notes, rels = (z.read(f"word/{n}").decode() for n in ("document.xml", "footnotes.xml", "_rels/document.xml.rels"))
        assert z.testzip() is None and [z.read(n) for n in sorted(z.namelist()) if "media" in n] == [PNG, JPEG, PNG]
    assert re.findall(r'footnoteReference w:id="(\d+)"', xml) == ["1", "2", "3", "4"] == re.findall(r'<w:footnote w:id="(\d+)"><', notes)
    assert re.findall(r'wp:extent cx="(\d+)" cy="(\d+)"', xml) == [(str(int(2.7 * 914400)), str(int(2.7 * 914400) // 2)), ("4572000", "2286000"), ("4572000", "2286000")]
    assert rels.count("relationships/image") == 3 and xml.count("<w:vMerge") == 2 and xml.count('<w:gridSpan w:val="2"/>') == 1


def test_a_task_that_fails_leaves_no_file(spark, blocks, tmp_path):
    bad = blocks.withColumn("body", F.when(F.col("document") == "ab", F.col("body")).otherwise(F.raise_error(F.lit("broken")).cast("string")))
    with pytest.raises(Exception, match="broken"):
        render.write_documents(bad, str(tmp_path))
    assert not list(Path(tmp_path).rglob("*"))
    render.write_documents(blocks.where("document = 'ab'"), str(tmp_path))
    render.write_documents(blocks.where("document <> 'ab'"), str(tmp_path))
    assert len(list(Path(tmp_path).rglob("*.docx"))) == 2
    render.write_documents(blocks.where("document = 'ab'"), str(tmp_path), "overwrite")
    assert [p.name for p in Path(tmp_path).rglob("*.docx")] == ["ab.docx"]


def test_unsorted_blocks_are_refused(spark, tmp_path):
    spark.dataSource.register(docx.DocxSource)
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "document string, pos int").coalesce(1)
    full = rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in render.StructType.fromDDL(docx.SCHEMA) if f.name not in rows.columns)).withColumn("level", F.lit(0))
    with pytest.raises(Exception, match="do not follow"):
        full.write.format("docx").mode("append").save(str(tmp_path))
    assert not list(Path(tmp_path).rglob("*"))


def test_empty_and_names():
    assert docx.file_name("a/b ü") == "a_2f_b_20__fc_.docx" and docx.file_name(None) == "_.docx"
