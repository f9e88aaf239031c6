"""All stages from source files to a render plan."""

import pytest
from pyspark.sql import functions as F

from quillet.plans import documents

MAIN = r"\title{A T}\author{x}\newcommand{\nm}{\textbf{Name}}\begin{document}\section{One}\label{s1}" + "\n\nText \\nm{} of \\cite{k1}, Section~\\ref{s2}.\n\n\\input{part}\n\\end{document}"


def test_stages(spark):
    files = spark.createDataFrame(
        [("1", "main.tex", MAIN), ("1", "part.tex", "\\section{Two}\\label{s2}\n\nMore \\cite{no}."), ("2", "x.tex", "no body \\input{gone}")], "folder string, name string, text string"
    )
    options = documents.Options.from_layers({"sort": "key"}, {"concurrency": 2}, {"start": None})
    paragraphs, titles, issues = documents.preprocess(files, options=options)
    paragraphs = paragraphs.cache()
    assert {(r.doc_idx, r.title) for r in titles.collect()} == {("1", "A T"), ("2", None)}
    assert {(r.level, r.stage) for r in issues.collect()} == {("ERROR", "chunk"), ("WARNING", "include")}
    assert tuple(documents.issue_counts(issues).first()) == (1, 1)
    entries = spark.createDataFrame([(0, "k1", "book", {"title": "B", "year": "2000"}), (1, "k2", "book", {"title": "b"})], "pos int, id string, entrytype string, fields map<string,string>")
    cites = documents.citations(entries, options)
    assert {(r.key, r.id) for r in cites.collect()} == {("k1", 1), ("k2", 1)}
    done = spark.createDataFrame([("1", 1, "kept")], "doc_idx string, id int, translation string")
    out = documents.translate(paragraphs, lambda: lambda system, user: user, done=done, options=options)
    final, refs, missing = documents.postprocess(out, cites, options=options)
    rows = {r.id: r for r in final.collect()}
    assert rows[1].translation == "kept" and rows[1].env_label == "1.1节"
    assert rows[2].text == "Text Name{} of \\textsuperscript{[1]}, Section1.2节." and rows[2].translation == rows[2].text
    assert {(r.chapter, r.key, r.env_label) for r in refs.collect()} == {("1", "s1", "1.1节"), ("1", "s2", "1.2节")}
    assert [(r.kind, r.key, r.n) for r in missing.collect()] == [("cite", "no", 1)]
    assert documents.plan(final).where("kind = 'heading1'").count() >= 1


def test_strict_and_unknown_options(spark):
    files = spark.createDataFrame([("2", "x.tex", "no body")], "folder string, name string, text string")
    with pytest.raises(ValueError):
        documents.Options.from_layers({"nope": 1})
    paragraphs, _, _ = documents.preprocess(files, options=documents.Options(strict=True))
    with pytest.raises(Exception, match="no document body"):
        paragraphs.select(F.max("id")).collect()
