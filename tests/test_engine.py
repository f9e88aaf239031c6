"""The document engine on small documents with known results."""

import io
import json
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillet.functions import fragments
from quillet.functions import latex as L
from quillet.functions import text as T
from quillet.functions.rules import Rules
from quillet.operators import bibliography, exchange, includes, orders, references, render, structure
from quillet.plans import documents
from quillet.sources import archives, bibtex, events, files
from quillet.streaming import jobs

TEX = r"""\documentclass{article}
\begin{document}
\maketitle
\begin{abstract}
We do. % remark
\end{abstract}
\section{Intro}
\label{sec:intro}

As \cite{a,b} shows in Section~\ref{sec:m} and \eqref{eq:1}.
text \begin{equation}
x = 1 \label{eq:1}

\end{equation} tail text

\newcommand{\foo}[1]{
  bar #1
}

\section{Method}\label{sec:m}
\subsection{Sub}

\begin{figure}
\includegraphics{x}
\caption{A figure}
\label{fig:x}
\end{figure}

\noindent

See Figure~\ref{fig:x} and \ref{gone}, \cite{zz}.
\end{document}
"""


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.createDataFrame([(0, 3, TEX), (1, 4, "no body")], "doc_idx int, chapter int, tex string")
    chunks = structure.chunk(docs).join(docs.select("doc_idx", "chapter"), "doc_idx")
    return structure.label(chunks).cache()


def test_chunks_and_labels(labelled):
    rows = labelled.orderBy("doc_idx", "id").collect()
    assert {r.doc_idx for r in rows} == {0}
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    got = {r.text.split("\n")[0][:24]: r.env_label for r in rows}
    assert got["\\begin{abstract}"] == "摘要"
    assert got["\\section{Intro}"] == "3.1节"
    assert got["\\begin{equation}"] == "式3-1"
    assert got["\\begin{figure}"] == "图3-1"
    assert got["\\subsection{Sub}"] == "3.2.1小节"
    assert got["See Figure~\\ref{fig:x} an"[:24]] == "3.2.1小节"
    eq = next(r.text for r in rows if r.text.startswith("\\begin{equation}"))
    assert eq.endswith("\\end{equation}") and "x = 1" in eq
    assert any(r.text == "tail text" for r in rows)
    assert not any("noindent" in r.text for r in rows)
    assert next(r.text for r in rows if r.text.startswith("\\section{Intro}")).endswith("\\label{sec:intro}")


def test_references(spark, labelled):
    refs = references.refmap(references.label_rows(labelled))
    cites = spark.createDataFrame([("a", 1), ("b", 2)], "key string, id int")
    out = references.replace_references(labelled, refs, cites).orderBy("id").collect()
    text = "\n".join(r.text for r in out)
    assert "As\\textsuperscript{[1,2]} shows in Section3.2节 and （式3-1）." in text or "As \\textsuperscript{[1,2]} shows in Section3.2节 and （式3-1）." in text
    assert "See Figure图3-1and [未找到],\\textsuperscript{[[未找到]]}." in text.replace(", \\text", ",\\text")
    used = references.cite_keys(labelled, ["doc_idx"])
    assert [(r.key, r.n) for r in references.missing(used, cites, ["doc_idx"]).collect()] == [("zz", 1)]


def test_strip_labels_and_clean(spark):
    df = spark.createDataFrame([("a\n\\label{x}\nb", "图 图7-5 和 表7-1 见 1.3节节 公式式1-1")], "t string, u string")
    r = df.select(T.strip_labels(F.col("t")).alias("t"), T.clean_cross_references(F.col("u")).alias("u")).first()
    assert r.t == "ab" and r.u == "图7-5和表7-1见 1.3节 公式1-1"


def test_comment_start(spark):
    df = spark.createDataFrame([("a % b",), ("a \\% b",), ("a \\\\% b",), ("none",)], "t string")
    assert [r.i for r in df.select(T.comment_start(F.col("t")).alias("i")).collect()] == [3, 0, 5, 0]


def test_macros():
    s = "\\newcommand{\\foo}[2][d]{<#1|#2>} \\foo{x} \\foo[y]{z} \\def\\b#1{(#1)}\\b9 % \\foo{no}\n\\newcommand*{\\s}{S}\\s"
    out = L.expand_macros(s)
    assert "<d|x> <y|z>" in out and "(9)" in out and "% \\foo{no}" in out and out.endswith("S")
    assert L.expand_macros("\\newcommand{\\r}{\\r}\\r").endswith("\\r")
    assert "\\begin{proof}" in L.expand_macros("\\newenvironment{pf}{\\proof}{\\endproof}\\begin{pf}x\\end{pf}")
    assert "\\operatorname{argmax}" in L.expand_macros("\\DeclareMathOperator*{\\am}{argmax}$\\am$")
    assert L.expand_macros(None) is None


def test_macros_of_any_depth():
    d = "\\newcommand{\\q}[1]{<#1>}"
    assert L.expansion(d + "\\q{" * 40 + "x" + "}" * 40) == (d + "<" * 40 + "x" + ">" * 40, 0)
    chain = "\\def\\ma{end}" + "".join(f"\\def\\m{b}{{\\m{a}}}" for a, b in zip("abcdefghijklmnopqrstuvwxy", "bcdefghijklmnopqrstuvwxyz"))
    assert L.expansion(chain + "\\mz") == (chain + "end", 0)
    for body in ("\\r", "\\r\\r", "x\\r y"):  # without end: the budget is spent, the rest stays and is counted
        out, left = L.expansion(f"\\def\\r{{{body}}} \\r")
        assert left > 0 and out.count("\\r") == left + 2 - (body == "\\r\\r") * -1 and len(out) < 3_000_000


def test_formatting_leaves_breaks_with_options():
    assert L.strip_formatting("a\\\\[2pt]\\textbf{b} \\[x\\]") == "a\nb \\[x\\]"


@pytest.mark.parametrize("text", ["\\textbf{a word " * 10_000, "\\begin{equation} x " * 10_000, "\\[ x " * 10_000, "\\textbf{" * 10_000 + "x" + "}" * 10_000, "a" + " " * 1_000_000 + "b", "$ x \\$ " * 10_001, "\\verb|a" * 10_001, "\\\\[ x" * 10_000])
def test_long_texts_are_formatted_in_linear_time(text):
    began = time.perf_counter()
    L.strip_formatting(text)
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("text", ["\\newenvironment{v}{a}{b}" + "\\begin{ x " * 10_000, "\\newcommand{\\q}[1]{<#1>}" + "\\q{ x " * 10_000, "\\newcommand{\\q}[2][d]{<#1>}" + "\\q[ x " * 10_000, "\\q" + " " * 1_000_000])
def test_long_texts_are_expanded_in_linear_time(text):
    began = time.perf_counter()
    L.expand_macros(text)
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_runs_of_blanks_are_read_once(spark, blank):
    """Every pattern over a text of a million blanks in a second or so."""
    df = spark.createDataFrame([("a" + blank * 1_000_000 + "b",)], "t string").cache()
    df.count()
    c = F.col("t")
    every = [
        T.strip_labels, T.clean_cross_references, T.strip_outer_space, T.strip_macro_definitions, T.strip_cjk_spaces, T.drop_preamble, T.collapse_blank_lines, T.break_sections, T.is_noncontent,
        T.strip_comments, fragments.clean_spaces, fragments.sanitize, fragments.strip_trailing_punctuation, fragments.clean_title, lambda t: F.size(T.label_keys(t)), lambda t: F.size(T.lost_tokens(t, t, Rules())),
        *(lambda t, p=p: F.regexp_count(t, F.lit(p)) for p in (T.CITE, T.REF, T.HYPERREF)),
    ]
    for i, f in enumerate(every):
        best = 9.0
        for _ in range(2):
            began = time.perf_counter()
            df.select(f(c).alias("x")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        assert best < 2, i


def test_many_lost_formulas(spark):
    df = spark.createDataFrame([(" ".join(f"$x_{i}$" for i in range(10_000)), "none $a$ " + " ".join(f"$x_{i}$" for i in range(5000)))], "a string, b string")
    began = time.perf_counter()
    got = df.select(T.lost_tokens(F.col("a"), F.col("b"), Rules()).alias("x")).first().x
    assert got == [f"$x_{i}$" for i in range(5000, 10_000)] and time.perf_counter() - began < 4


def test_formatting():
    s = "\\textbf{a \\emph{b}} {\\bf c} \\vspace*{1cm}$\\textbf{m}$ \\textcolor{red}{d}\\\\ \\begin{verbatim}\\textbf{k}\\end{verbatim} \\Large e"
    out = L.strip_formatting(s)
    assert "a b c" in out and "$\\textbf{m}$" in out and "d\n" in out and "\\begin{verbatim}\\textbf{k}\\end{verbatim}" in out and "vspace" not in out and "Large" not in out


def test_numbers_arguments_and_files(spark, tmp_path):
    want = {0: "零", 7: "七", 10: "十", 12: "十二", 110: "一百一十", 1010: "一千零一十", 10001: "一万零一", 20300: "二万零三百", 100000: "十万", 100010000: "一亿零一万", 1203000450: "十二亿零三百万零四百五十"}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert {r.n: r.x for r in df.select("n", T.chinese_numeral(F.col("n")).alias("x")).collect()} == want
    assert spark.range(1).select(T.chinese_numeral(F.lit(-3)).alias("x")).first().x == "-3"
    assert L.drop_arguments(" [o]{a{b}} {c}rest{d}", 2) == "rest{d}" and L.drop_arguments("[o]x{a}", 1) == "[o]x{a}" and L.drop_arguments("{a}{open", 2) == "{open"
    (tmp_path / "e.txt").write_text("# c\n\nexport A=1\nB = 'x=y' \nnone\nA=\"2\"\n")
    assert {r.key: r.value for r in files.env_files(spark, str(tmp_path / "e.txt")).collect()} == {"A": "2", "B": "x=y"}
    (tmp_path / "a.json").write_text('{"sort": "key", "start": 3}')
    (tmp_path / "b.json").write_text('{"start": 4}')
    (tmp_path / "c.json").write_text("[]")
    o = documents.Options.from_files(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), over={"strict": True})
    assert (o.sort, o.start, o.strict) == ("key", 4, True)
    with pytest.raises(ValueError):
        documents.Options.from_files(spark, str(tmp_path / "c.json"))


def test_title():
    assert L.title("% \\title{no}\n\\title[short]{A {B}\\\\ c}") == "A {B} c"
    assert L.title("none") is None and L.title(None) is None


def test_table(spark):
    t = "\\begin{table}\\caption{Cap {x}}\\begin{tabular}{l*{2}{c}p{2cm}}\\hline A & \\textbf{B} & $x^2$ & d \\\\ \\multicolumn{2}{c}{m} & \\alpha \\& b & e\\\\ \\multicolumn{4}{c}{group}\\\\ last\\\\\\end{tabular}\\end{table}"
    got = L.table(t)
    assert got["caption"] == "Cap {x}" and got["col_count"] == 4 and got["col_align"] == ["l", "c", "c", "l"]
    assert [r["type"] for r in got["rows"]] == ["header", "data", "group", "data"]
    assert got["rows"][0]["cells"][1][0]["bold"] and got["rows"][0]["cells"][2][1]["superscript"]
    assert got["rows"][1]["cells"][2][0]["text"] == "α & b"
    assert len(got["rows"][3]["cells"]) == 4
    df = spark.createDataFrame([(t,), ("none",), (None,)], "t string")
    rows = df.select(L.table_udf()(F.col("t")).alias("x")).collect()
    assert rows[0].x.caption == "Cap {x}" and rows[0].x.rows[0].cells[1][0].text == "B" and rows[1].x.rows is None


def test_bibliography(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "r.bib").write_text(
        '@string{j = "Journal of X"}\n@Article{k1, author = {Doe, Jane and Roe, R. and Poe, P. and Low, L.}, title = {A {T}itle}, journal = j # " Y", year = 2020, volume=3, number={4}, pages={1--9}, month = October, doi={10.1/x}}\n'
        "@comment{x}\n@book(k2, author={Li, 明}, title={B}, publisher={P}, address={Q}, year={2019})\n@misc{k3, title={a {t}itle}, howpublished={\\url{http://u.v}}}"
    )
    src = files.source_files(spark, str(tmp_path))
    entries = bibtex.entries(files.reference_files(src).select("path", "content")).withColumn("citation", bibliography.citation(F.col("entrytype"), F.col("fields")))
    got = {r.id: r.citation for r in entries.collect()}
    assert got["k1"] == "Doe Jane, Roe R., Poe P., et al. A Title[J]. Journal of X Y, 2020, 3(4): 1-9. DOI: 10.1/x."
    assert got["k2"] == "Li 明. B[M]. Q: P, 2019."
    assert got["k3"] == "a title[EB/OL]. Available: http://u.v."
    norm = F.lower(bibliography.field(F.col("fields"), "title"))
    kept = bibliography.dedup(entries.select("id", "pos", "citation", norm.alias("norm")), F.col("norm"), "pos", "id").withColumnRenamed("id", "key")
    numbered = bibliography.number(kept, bibliography.order_columns("file", "pos", "key", "pos"))
    look = {r.key: r.id for r in bibliography.lookup(numbered, "citation").collect()}
    assert look == {"k1": 1, "k3": 1, "k2": 2}
    assert bibliography.reference_list(bibliography.lookup(numbered, "citation")).count() == 2


def test_items(spark):
    body = "\\bibitem[A(2020)]{x} Ann, Bob.\n\\newblock A title.\n\\newblock \\emph{J. of Z}, 3(4):\\penalty0 1--9, 2020.\n\\newblock \\doi{10.1/q} \\bibitem{y} C. \\newblock T. \\newblock In Proc, 2001."
    df = spark.createDataFrame([("f", f"\\begin{{thebibliography}}{{9}}{body}\\end{{thebibliography}}")], "path string, content string")
    rows = bibliography.split_items(df, blocks=True).withColumn("p", bibliography.parse_item(F.col("body"))).orderBy("pos").collect()
    assert [r.key for r in rows] == ["x", "y"]
    p = rows[0].p
    assert (p.title, p.venue, p.volume, p.number, p.pages, p.year, p.doi, p.entrytype) == ("A title", "J. of Z", "3", "4", "1-9", "2020", "10.1/q", "article")
    assert rows[1].p.entrytype == "inproceedings"


def test_citations_of_items(spark):
    """What a .bbl or a thebibliography says comes out in full, in the order of files."""
    items = {
        "a.bbl": "\\bibitem{x} A. One and B. Two. On things in the world. Jour, 3(4):10--20, 1999.\\bibitem{y} Li, M., Roe, J. P. et al. A study of graphs in 1984, 2022.",
        "b.bbl": "\\bibitem{p} C. Poe.\n\\newblock Two.\n\\newblock In \\emph{Proc. of Z}, pages 563--587, 2001.",
    }
    fs = spark.createDataFrame([(k, k[2:], v.encode()) for k, v in items.items()], "path string, ext string, content binary")
    got = {r.key: (r.id, r.citation) for r in documents.citations(bibtex.gathered(fs)).collect()}
    assert got == {
        "x": (1, "A. One, B. Two. On things in the world[J]. Jour, 1999, 3(4): 10-20."), "y": (2, "Li M., Roe J. P., et al. A study of graphs in 1984[M]. 2022."),
        "p": (3, "C. Poe. Two[C]//Proc. of Z. 2001: 563-587."),
    }


def test_exchange(spark):
    rows = spark.createDataFrame(
        [(0, 1, "one \\cite{a}"), (0, 2, "\\begin{figure}\\includegraphics{x}\\caption{cap {y}}\\end{figure}"), (0, 3, "\\begin{equation}x\\end{equation}"), (1, 1, "two")], "doc_idx int, id int, text string"
    ).withColumn("tokens", T.estimate_tokens(F.col("text")))
    batched = exchange.greedy_batches(rows, ["doc_idx"], ["id"], "tokens", 1500).join(rows.drop("tokens"), ["doc_idx", "id"])
    terms = spark.createDataFrame([('{"0": {"one": "eins"}}',), ('[{"chapter": 1, "terms": {"two": "zwei"}}, {"x": 2}]',)], "value string")
    gl = exchange.glossary(terms)
    assert sorted(map(tuple, gl.collect())) == [(0, "one", "eins"), (1, "two", "zwei")]
    ready = exchange.with_terms(batched.withColumn("chapter", F.col("doc_idx")), gl)

    def make():
        def client(system, user):
            return user.upper().replace("\\CITE{A}", "")

        return client

    out = exchange.exchange(ready, make, "translate", concurrency=2)
    got = {(r.doc_idx, r.id): r.translation for r in out.collect()}
    assert got == {(0, 1): "ONE", (0, 2): "\\begin{figure}\\includegraphics{x}\\caption{CAP {Y}}\\end{figure}", (0, 3): "\\begin{equation}x\\end{equation}", (1, 1): "TWO"}
    checked = exchange.integrity(rows.join(out, ["doc_idx", "id"]), "text", "translation")
    assert [(r.doc_idx, r.id, r.syntax_error_tokens) for r in checked.where("syntax_error").collect()] == [(0, 1, ["\\cite{a}"])]
    assert exchange.still_to_do(rows, out, ["doc_idx", "id"]).count() == 0


def test_answers_and_retries():
    assert exchange.parse_answer("%%SEP_1%%\na\n%%SEP_2%%\nb", 2) == ["a", "b"]
    assert exchange.parse_answer("a\n\nb", 2) == ["a", "b"] and exchange.parse_answer("%%SEP_1%%\na", 3) == ["a", "", ""]
    calls = []

    def client(system, user):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 503")
        return "done"

    assert exchange.call(client, "", "", sleep=lambda s: None) == "done" and len(calls) == 3
    with pytest.raises(ValueError):
        exchange.call(lambda s, u: (_ for _ in ()).throw(ValueError("bad")), "", "", sleep=lambda s: None)


def test_rules():
    r = Rules().extend({"env_categories": {"figure": {"envs": ["myfig"]}, "box": {"prefix": "框", "envs": ["mybox"]}, "bad": 3}, "syntax_patterns": {"url": "\\\\url\\{[^}]+\\}", "broken": "("}, "chunk_block_envs": ["mybox"]})
    rows = {e: (c, p) for e, c, p, _ in r.env_rows}
    assert rows["myfig"] == ("figure", "图") and rows["mybox"] == ("box", "框") and rows["floatrow"][0] == "figure" and rows["codebox"][0] == "algorithm"
    assert "url" in r.syntax and "broken" not in r.syntax and "mybox" in r.block_envs and "mybox" not in Rules().block_envs


def test_includes(spark):
    rows = [("f", "main.tex", "a \\input{sub/x} b \\include{y} % \\input{z}"), ("f", "sub/x.tex", "X \\input{deep}"), ("f", "sub/deep.tex", "D"), ("f", "y.tex", "Y"), ("f", "z.tex", "Z"), ("g", "main.tex", "\\input{main}")]
    fs = spark.createDataFrame(rows, "folder string, name string, text string")
    edges = includes.include_edges(fs)
    order = includes.expand_order(fs.where("name = 'main.tex'"), edges)
    got = {(r.folder, r.name, r.cycle) for r in order.collect()}
    assert got == {("f", "main.tex", False), ("f", "sub/x.tex", False), ("f", "sub/deep.tex", False), ("f", "y.tex", False), ("g", "main.tex", False), ("g", "main.tex", True)}
    whole = {r.folder: r.text for r in includes.inlined(fs, edges, order).collect()}
    assert whole["f"].startswith("a X D b Y")
    assert {r.name for r in includes.leftovers(fs.where("folder = 'f'"), order).collect()} == {"z.tex"}
    edges.createOrReplaceTempView("e")
    fs.where("name = 'main.tex' AND folder = 'f'").createOrReplaceTempView("r")
    assert {r.name for r in spark.sql(includes.reachable_sql("e", "r")).collect()} == {"main.tex", "sub/x.tex", "sub/deep.tex", "y.tex"}


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "2").mkdir(parents=True)
    (tmp_path / "in" / "2" / "a.tex").write_bytes("\\title{é}\\author{x}\\begin{document}".encode("latin-1"))
    (tmp_path / "in" / "2" / "b.tex").write_text("much longer text without anything" * 5)
    src = files.source_files(spark, str(tmp_path / "in"))
    assert files.main_file(files.tex_files(src)).first().name == "a.tex"
    assert src.where("name = 'a.tex'").select(files.decoded(F.col("content")).alias("t")).first().t.startswith("\\title{é}")
    assert src.first().chapter == 2
    (tmp_path / "d.json").write_text(json.dumps({"documents": [{"tex": "t", "chapter": 1, "paragraphs": [{"id": 1, "text": "x"}, {"id": 2, "text": "y"}]}]}))
    docs = files.documents_json(spark, str(tmp_path / "d.json"))
    assert [(r.doc_idx, r.id, r.text) for r in docs.orderBy("id").collect()] == [(0, 1, "x"), (0, 2, "y")]
    files.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().paragraphs[1].text == "y"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("root/m.tex", "x")
        z.writestr("__MACOSX/j", "y")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        i = tarfile.TarInfo("../up.tex")
        i.size = 1
        t.addfile(i, io.BytesIO(b"z"))
    (tmp_path / "c.zip").write_bytes(b"broken")
    rows = archives.listing(spark.read.format("binaryFile").load(str(tmp_path)))
    report = {r.archive.rsplit("/", 1)[1]: r for r in orders.archive_report(rows).collect()}
    assert report["a.zip"].common_root == "root" and report["a.zip"].issue is None and report["b.tar.gz"].issue == "path escapes" and report["c.zip"].issue == "damaged zip"
    assert archives.safe_path("a/../b") == "b" and archives.safe_path("../b") is None and archives.safe_path("/b") is None
    spark.dataSource.register(archives.ArchiveSource)
    assert spark.read.format("archive").option("path", str(tmp_path / "a.zip")).load().where("name = 'root/m.tex'").first().content == b"x"


def test_events_and_stream(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    lines = ['{"type":"state","state":"queued","time":"2024-01-01T00:00:00Z"}', "", "{bad", '{"type":"state","state":"running","percent":40.0}', '{"state":"completed"}']
    (tmp_path / "ev" / "j1.ndjson").write_text("\n".join(lines) + "\n")
    got = events.load(spark, str(tmp_path / "ev"), after=1).orderBy("offset").collect()
    assert [(r.job_id, r.offset, r.state) for r in got] == [("j1", 3, "running"), ("j1", 4, "completed")]
    s = jobs.status(events.load(spark, str(tmp_path / "ev"))).first()
    assert (s.state, s.offset, s.n_events) == ("completed", 4, 3)
    assert jobs.merged_status(events.load(spark, str(tmp_path / "ev")), ("state", "percent")).first().percent == 40.0
    q = jobs.follow(events.stream(spark, str(tmp_path / "ev")), str(tmp_path / "cp"), str(tmp_path / "st"))
    q.awaitTermination(60)
    assert jobs.status_table(spark, str(tmp_path / "st")).first().state == "completed"


def test_queue(spark):
    req = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("r", 0)], "job_id string, time int")
    got = {r.job_id: r.admitted for r in jobs.admitted(req, spark.createDataFrame([("r",)], "job_id string"), 2).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_orders(spark):
    o = spark.createDataFrame([("o1", "u", "paid", "p", "m", 10000), ("o2", "u", "new", "p", "m", 10)], "id string, user_id string, status string, provider string, model string, estimated_chars int")
    r = spark.createDataFrame([("o1", "u", "p", "m", 10700), ("o2", "u", "p", "m", 10)], "order_id string, user_id string, provider string, model string, estimated_chars int")
    assert [x.id for x in orders.valid_orders(o, r).collect()] == ["o1"]
    p = spark.createDataFrame([("k", 1, None), ("k", 2, 1), ("k", 3, None), ("k", 4, 1), ("k", 5, 99)], "key string, pos int, wanted int")
    got = [(x.pos, x.chapter) for x in orders.assign_chapters(p, "key", "pos", "wanted").orderBy("pos").collect()]
    assert got == [(1, 2), (2, 1), (3, 3), (4, None), (5, None)]


def test_render(spark, labelled, tmp_path):
    plan = render.render_plan(labelled)
    kinds = {r.kind for r in plan.collect()}
    assert {"abstract", "heading1", "heading2", "equation", "figure", "paragraph"} <= kinds
    drawn = render.with_notes(render.render_plan(labelled, drawn=True), ["doc_idx"], ["id"]).selectExpr("string(doc_idx) AS document", "id AS pos", "*")
    render.write_documents(drawn, str(tmp_path))
    got = spark.read.format("docx").load(str(tmp_path)).orderBy("pos").collect()
    assert len(got) == plan.count() and got[1].text == "3.1 Intro" and got[1].level == 1


def test_answers_in_any_order():
    assert exchange.parse_answer("%%SEP_2%% y %%SEP_1%% x", 2) == ["x", "y"]
    assert exchange.parse_answer("%%SEP_1%%a%%SEP_1%%b%%SEP_2%%c", 2) == ["b", "c"]
    assert exchange.parse_answer("a\n\nb\n\nc", 2) == ["a", "b"] and exchange.parse_answer("", 2) == ["", ""]


def test_status_table_over_two_batches(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    for name, lines in (("j1", ['{"state":"running"}']), ("j2", ['{"state":"queued"}'])):
        (folder / f"{name}.ndjson").write_text("\n".join(lines) + "\n")
    table = lambda: {r.job_id: r.state for r in jobs.status_table(spark, str(tmp_path / "st")).collect()}
    follow = lambda: jobs.follow(events.stream(spark, str(folder)), str(tmp_path / "cp"), str(tmp_path / "st")).awaitTermination(90)
    follow()
    assert table() == {"j1": "running", "j2": "queued"}
    (folder / "j1_more.ndjson").write_text('{"state":"other"}\n')
    (folder / "j3.ndjson").write_text('{"state":"failed"}\n')
    follow()
    rows = jobs.status_table(spark, str(tmp_path / "st")).collect()
    assert len(rows) == len({r.job_id for r in rows}) == 4
    assert table()["j2"] == "queued" and table()["j3"] == "failed"
    # a crash before the pointer is moved leaves the table as it was, and no version stays that nothing points to
    (tmp_path / "st" / "data" / "version=crashed" / "bucket=1").mkdir(parents=True)
    assert len(table()) == 4
    assert {p.name for p in (tmp_path / "st" / "data").iterdir()} - {"version=crashed"} == {f"version={v}" for v in json.loads((tmp_path / "st" / "current.json").read_text()).values()}


def test_sums_before_and_batches_over_ranges(spark):
    rows = [(k, v) for k, v in zip(range(100), [3, 0, 5, 1] * 25, strict=True)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = {r.k: r.at for r in structure.sum_before(df, [F.col("k")], "v", "at").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows} and structure.sum_before(df.limit(0), [F.col("k")], "v", "at").count() == 0
    weights = [(i % 3, i, (i * 7919) % 90) for i in range(400)]
    want, state = {}, {}
    for key, i, w in weights:
        tot, b = state.get(key, (0, 0))
        tot, b = (w, b + 1) if tot > 0 and tot + w > 100 else (tot + w, b)
        state[key], want[i] = (tot, b), b
    batched = exchange.greedy_batches(spark.createDataFrame(weights, "key int, i int, w int"), ["key"], ["i"], "w", 100)
    assert {r.i: r.batch_no for r in batched.collect()} == want and batched.columns == ["key", "i", "w", "batch_no"]


def test_deep_includes_and_cycles(spark):
    edges = spark.createDataFrame([("f", f"n{i}", 0, f"n{i + 1}") for i in range(20)] + [("f", "n20", 0, "n3")], "folder string, src string, pos int, dst string")
    roots = spark.createDataFrame([("f", "n0")], "folder string, name string")
    got = includes.expand_order(roots, edges).collect()
    assert len(got) == 22 and [r.name for r in got if r.cycle] == ["n3"]
    with pytest.raises(ValueError):
        includes.expand_order(roots, edges, max_depth=5)


def test_includes_behind_comments(spark):
    rows = [("f", "main.tex", "a % \\input{z}\nb \\\\% \\input{z}\n\\input{x} 5\\% \\input{y}"), ("f", "x.tex", "X"), ("f", "y.tex", "Y"), ("f", "z.tex", "Z")]
    fs = spark.createDataFrame(rows, "folder string, name string, text string")
    edges = includes.include_edges(fs)
    order = includes.expand_order(fs.where("name = 'main.tex'"), edges)
    assert includes.inlined(fs, edges, order).first().text == "a % \\input{z}\nb \\\\% \\input{z}\nX 5\\% Y"


def test_long_texts_in_patterns(spark):
    from quillet.functions import fragments as G

    long = "word " * 40_000
    got = spark.createDataFrame([(long, "\\\\" * 20_000)], "t string, b string").select(
        T.comment_start(F.concat("t", "b", F.lit("%"))).alias("at"), G.caption(F.concat(F.lit("\\caption{a {b} "), "t", F.lit("}"))).alias("c"),
        T.comment_start(F.concat("b", F.lit("\\%"))).alias("none"),
    ).first()
    assert got.at == len(long) + 40_001 and got.none == 0 and got.c == "a {b} " + long.strip()
    rows = spark.createDataFrame([(1, 1, "\\section{" + long + "}", "1.1节")], "doc_idx int, id int, text string, env_label string")
    assert render.render_plan(rows).first().body == long.strip()


def test_headings_and_reports(spark):
    df = spark.createDataFrame([("\\section*{Related Work}\\label{sec:rw}",), ("Related Work",), ("\\section{Other}",), (None,)], "t string")
    got = exchange.cached_titles(df, F.col("t")).collect()
    assert {r.t: r.cached for r in got} == {"\\section*{Related Work}\\label{sec:rw}": "\\section*{相关工作}\\label{sec:rw}", "Related Work": None, "\\section{Other}": None, None: None}
    p = spark.createDataFrame([(1, True), (1, False), (2, False)], "doc_idx int, syntax_error boolean")
    assert tuple(documents.paragraph_totals(p).first()) == (2, 3, 1)
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert tuple(references.replace_summary(p, keys, keys.where("key = 'a'")).first()) == (2, 3, 2, 1)
    assert tuple(references.replace_summary(p.where("false"), keys, keys).first()) == (0, 0, 2, 2)
    i = spark.createDataFrame([("ERROR", "bib", "m"), ("ERROR", "chunk", "n")], "level string, stage string, message string")
    assert [tuple(r) for r in documents.demoted(i, "bib", "why").collect()] == [("WARNING", "bib", "m (why)"), ("ERROR", "chunk", "n")]


def test_fragments_by_their_parts(spark):
    from quillet.functions import fragments as G

    rows = [
        r"A \textbf{big \emph{old}} % note",
        r"\raisebox{-2pt}[1pt]{\includegraphics[width=1cm]{a.png}} Title\\of {Things}\label{x} 5\%",
        r"\section*[short]{Long {kept} one}",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.x for r in df.select(G.clean_title(F.col("t")).alias("x")).collect()] == ["A big old", r"Title of {Things}x 5\%", "Long {kept} one"]
    t = r"before \begin{proof}[of it] inside \end{proof} after"
    one = spark.createDataFrame([(t,)], "t string").select(
        G.environment(F.col("t"), "proof").alias("e"), G.around_environment(F.col("t"), "proof").alias("a"), G.around_environment(F.lit(r"x \begin{em} y"), "em").alias("o"),
        G.environment(F.col("t"), "em").alias("n"), G.caption(F.lit(r"\caption{a {b} c} \caption{d}")).alias("c"), G.caption(F.lit("none")).alias("z"),
        G.sanitize(F.lit("\\begin{tabular}{cc}a \\toprule b\\end{tabular} \\bf c \\begin{proof}[x]d\\end{proof}  \n\n\n\ne\\caption{f}")).alias("s"),
    ).first()
    assert tuple(one.e) == ("of it", "inside") and tuple(one.a) == ("before", "inside", "after") and tuple(one.o) == ("x", "y", "")
    assert tuple(one.n) == ("", t) and one.c == "a {b} c" and one.z == "" and one.s == "a  b c d\n\nef"


def test_bibliographies_of_all_kinds_gather(spark):
    bbl = rb"\begin{thebibliography}{9}\bibitem{k2} A. Author.\newblock A title.\newblock \emph{Journal}, 3(1):1--2, 2001.\end{thebibliography}"
    rows = [("a/x.bib", "bib", b"@article{k1, title={One}, year={2000}}"), ("a/x.bbl", "bbl", bbl), ("a/m.tex", "tex", b"text " + bbl.replace(b"k2", b"k3")), ("a/n.txt", "txt", b"@article{k9,}")]
    got = bibtex.gathered(spark.createDataFrame(rows, "path string, ext string, content binary")).orderBy("kind", "pos").collect()
    assert [(r.kind, r.key, r.fields["title"]) for r in got] == [(0, "k1", "One"), (1, "k2", "A title"), (2, "k3", "A title")]
    assert got[1].fields["year"] == "2001" and got[1].entrytype == "article"


def test_checkpoint_store(spark, tmp_path):
    from quillet.sources import checkpoints

    at = str(tmp_path / "done")
    assert checkpoints.load(spark, at).count() == 0
    checkpoints.save(spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "doc_idx int, id int, translation string"), at)
    checkpoints.save(spark.createDataFrame([(0, 2, "c")], "doc_idx int, id int, translation string"), at, run=1)
    assert sorted(map(tuple, checkpoints.load(spark, at).collect())) == [(0, 1, "a"), (0, 2, "c")]
    todo = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "doc_idx int, id int")
    assert [tuple(r) for r in exchange.still_to_do(todo, checkpoints.load(spark, at), ["doc_idx", "id"]).collect()] == [(0, 3)]
    checkpoints.remove(spark, at)
    assert checkpoints.load(spark, at).count() == 0


def test_reports(spark):
    m = spark.createDataFrame([(1, "z", 1), (1, "a", 3), (2, "b", 1)], "doc int, key string, n int")
    assert [(r.doc, r.report, r.total) for r in references.missing_report(m, ["doc"]).orderBy("doc").collect()] == [(1, "a (3), z (1)", 4), (2, "b (1)", 1)]
    c = spark.createDataFrame([(1, f"k{i}") for i in range(8)], "doc int, key string")
    r = references.first_collisions(c, ["doc"]).first()
    assert r.shown == ["k0", "k1", "k2", "k3", "k4"] and r.total == 8


def test_render_classes_by_label_then_text(spark):
    rows = [
        ("\\section{A}", "式1-1", "equation"), ("any words", "摘要", "abstract"), ("x", "算法1-1", "code"), ("x", "代码2-1", "code"),
        ("\\begin{table}\n\\begin{equation}a\\end{equation}\n\\end{table}", "表1-1", "equation"),
        ("\\begin{table}\\begin{tabular}{c}a\\end{tabular}\\end{table}", "表1-1", "table"),
        ("\\begin{Theorem*} a", "1.1节", "mathenv"), ("see \\begin{proof} b", "", "proof"), ("\\paragraph{P} c", None, "inline_heading"), ("\\begin{abstract} d", "", "abstract"), ("plain", None, "paragraph"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "text string, label string")
    assert [r.k for r in df.select(render.render_class(F.col("text"), F.col("label")).alias("k")).collect()] == [k for _, _, k in rows]
