"""Queries with much work for each short row deal their rows to all cores, and work out each of a row's values once."""

import pytest
from pyspark.sql import functions as F

from quillet.operators import bibliography
from quillet.plans import catalog, papers

QUERIES = {**catalog.QUERIES, **papers.QUERIES}
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["citation_kinds", "table_grid", "bibitem_unmarked", "citation_format", "table_parse", "fragment_scalars"])
def test_one_file_is_the_work_of_many_tasks(spark, name):
    assert QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_fields_of_a_citation_are_made_once(spark):
    fields = F.map_from_arrays(F.array(F.lit("title"), F.lit("author")), F.array(F.lit("T"), F.lit("One, A and B. Two")))
    df = spark.range(1).select(bibliography.citation(F.lit("book"), fields).alias("c"))
    assert df._jdf.queryExecution().analyzed().toString().count("map_from_arrays") == 1
    assert df.head().c == "One A, B. Two. T[M]."


def test_editors_stand_for_authors_that_are_not_given(spark):
    rows = [("Ed, A and others", ""), ("Ed, A", "{}"), ("Ed, A", None), ("", "Au, B and C and D and E"), (None, "张三 and 李四 and 王五 and 赵六")]
    df = spark.createDataFrame(rows, "editor string, author string")
    fields = F.map_filter(F.create_map(*(x for n in df.columns for x in (F.lit(n), F.col(n)))), lambda k, v: v.isNotNull())
    said = [r.c for r in df.select(bibliography.citation(F.lit("book"), F.map_concat(fields, F.create_map(F.lit("title"), F.lit("T")))).alias("c")).collect()]
    assert said == ["Ed A, others. T[M].", "T[M].", "Ed A. T[M].", "Au B, C, D, et al. T[M].", "张三, 李四, 王五, 等. T[M]."]


def test_tables_are_parsed_once(spark):
    plan = papers.table_parse(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_images_are_chosen_where_their_names_are_dealt_to(spark):
    from quillet.sources import files

    images = spark.createDataFrame([("d", f"file:/in/d/{n}") for n in ("a.png", "a.pdf", "b.jpg", "b.jpg.png", "c", ".png", "e.jpeg")] + [("x", "file:/in/x/a.jpg")], "folder string, path string")
    wanted = spark.createDataFrame([("d", r) for r in ("a", "b", "b.jpg", "c", "", "e", "a.pdf", "none", "a", None)] + [("x", "a")], "doc string, rel string")
    found = files.image_of(wanted, images)
    got = sorted((r.doc, r.rel or "", (r.path or "").rpartition("/")[2]) for r in found.collect())
    assert got == sorted([("d", "", ".png"), ("d", "", ""), ("d", "a", "a.png"), ("d", "a", "a.png"), ("d", "a.pdf", "a.pdf"), ("d", "b", "b.jpg"), ("d", "b.jpg", "b.jpg"), ("d", "c", "c"), ("d", "e", "e.jpeg"), ("d", "none", ""), ("x", "a", "a.jpg")])
    plan = papers.image_lookup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # nothing of the files' size goes to every task


def test_documents_are_read_by_size(tmp_path):
    from quillet.sources.docx import DocxSource

    for k in range(6):
        (tmp_path / f"d{k}.docx").write_bytes(b"x" * (700_000 if k < 3 else 10))
    read = lambda **o: [len(p.value) for p in DocxSource({"path": str(tmp_path), **o}).reader(None).partitions()]
    assert read() == [1, 1, 4] and read(bytes_per_partition="1") == [1] * 6 and read(files_per_partition="2", bytes_per_partition="9000000") == [2, 2, 2]


def test_texts_are_given_back_in_pieces(spark):
    import pyarrow as pa

    from quillet.functions import latex

    texts = ["a" * 700_000, None, "b" * 700_000, "", "c", "d" * 2_000_000, "e"]
    got = [list(p.to_pylist()) for p in latex.text_udf(lambda x: x).func(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]))]
    assert [len(p) for p in got] == [3, 3, 1, 0] and sum(got, []) == texts


def test_ends_are_trimmed_without_reading_the_text(spark):
    from quillet.functions import text as T

    ends = ["", " \t\n\x0b\f\r", "\u3000", "\xa0 ", "\n\n", " 中"]
    rows = [(a + m + b,) for a in ends for m in ("", "x", "x \n y", "中 é") for b in ends] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select(T.stripped(F.col("t")).alias("a"), F.regexp_replace("t", r"^\s++|(?<!\s)\s++\z", "").alias("b"))
    assert all(r.a == r.b for r in df.collect())
    assert "regexp_replace" not in spark.range(1).select(T.stripped(F.lit("x")))._jdf.queryExecution().analyzed().toString()
