"""Registered queries of what needs LaTeX or BibTeX sources, and the DuckDB SQL that checks each.

The sources are made from whole tables, with the whole texts of documents in them. Queries of `GRAMMAR` use operators
whose grammar is not regular, and so Arrow batches; all others stay in the JVM.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fragments, latex
from ..functions.rules import Rules
from ..operators import bibliography, exchange, includes, references, render, structure
from ..sources import bibtex, checkpoints, files
from ..sources.shared import folder
from ..streaming import jobs
from . import documents
from .catalog import _cites, _keyed, parts, plain_text, read

QUERIES = {}
ORACLE: dict[str, str] = {}
GRAMMAR: set[str] = set()


def query(sql: str, grammar: bool = False):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        if grammar:
            GRAMMAR.add(f.__name__)
        return f

    return add


def glue(*parts: Column | str) -> Column:
    """Columns and literal strings, joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def doc() -> Column:
    return F.col("doc_id")


def part() -> Column:
    return F.col("p_partkey")


# ---- LaTeX -----------------------------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, '\newcommand{\q}[2][z]{<#1-#2>}\def\w{W' || doc_id || '}\newenvironment{v}{\begin{quote}}{\end{quote}}<z-a> <b-W' || doc_id || '> \begin{quote}c\end{quote} % \q{n}'
  || chr(10) || replace(translate(text, '\{}', ''), '%', '\%') AS body FROM documents""", True)
def macro_expand(spark, sf_dir):
    """Macros and environments of a source expanded where they are used, definitions and comments kept."""
    t = glue(r"\newcommand{\q}[2][z]{<#1-#2>}\def\w{W", doc(), r"}\newenvironment{v}{\begin{quote}}{\end{quote}}\q{a} \q[b]{\w} \begin{v}c\end{v} % \q{n}" + "\n", plain_text())
    return read(spark, sf_dir, "documents").select("doc_id", latex.text_udf(latex.expand_macros)(t).alias("body"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('b ' || doc_id || ' $\textbf{m}  x$ x' || chr(10) || 'y g ' || translate(text, '\{}$%', ''), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')
  .replace('$\textbf{m} x$', '$\textbf{m}  x$') AS body FROM documents""", True)
def format_strip(spark, sf_dir):
    """wrappers, switches, spacing and forced breaks taken off outside formulas."""
    t = glue(r"\textbf{b \emph{", doc(), r"}} $\textbf{m}  x$ \vspace{1em}\noindent x\\y {g} ", F.translate("text", "\\{}$%", ""))
    return read(spark, sf_dir, "documents").select("doc_id", latex.text_udf(latex.strip_formatting)(t).alias("body"))


@query("SELECT doc_id, 'A ' || chr(92) || 'textbf{B} C' || doc_id AS title FROM documents", True)
def title_extract(spark, sf_dir):
    """The title command outside comments, breaks as blanks."""
    t = glue("\\documentclass{a} % \\title{no}\n\\title[s]{A \\textbf{B} \\\\ C", doc(), "\n}\\begin{document}", plain_text())
    return read(spark, sf_dir, "documents").select("doc_id", latex.text_udf(latex.title)(t).alias("title"))


@query(r"""
SELECT p_partkey, 'C \textbf{n} ' || p_partkey AS caption, 'l|c' AS align, i AS row, ['header', 'data', 'group'][i + 1] AS type,
  CASE i WHEN 0 THEN 'A|B*x' WHEN 1 THEN p_name || '|' || p_size || '≤' ELSE 'G' END AS cells FROM part, (VALUES (0), (1), (2)) v(i)""", True)
def table_parse(spark, sf_dir):
    """The rows of a table, their kinds, and their cells as runs of one style (* behind bold ones)."""
    t = glue(r"\begin{table}\caption{C \textbf{n} ", part(), r"}\begin{tabular}{|l|c|}\hline A & \textbf{B}x \\ \midrule ", F.col("p_name"), " & $", F.col("p_size"), r"\leq$\\[2pt] \multicolumn{2}{c}{G}\\ \bottomrule\end{tabular}\end{table}")
    df = parts(spark, sf_dir).select("p_partkey", latex.table_udf()(t).alias("t")).select("p_partkey", "t.caption", F.array_join("t.col_align", "|").alias("align"), F.posexplode_outer("t.rows").alias("row", "r")).where("row IS NOT NULL")  # an inner one asks for rows first, which parses each table twice
    run = lambda r: F.concat(r["text"], F.when(r["bold"], "*").otherwise(""))
    return df.select("p_partkey", "caption", "align", "row", "r.type", F.array_join(F.transform("r.cells", lambda c: F.array_join(F.transform(c, run), "")), "|").alias("cells"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'claims' WHEN 1 THEN 'figure' ELSE 'text' END AS category,
  CASE p_size % 3 WHEN 0 THEN '定理' || (p_size % 7) || '-' || n WHEN 1 THEN '图' || (p_size % 7) || '-' || n ELSE (p_size % 7) || '.0节' END AS env_label
FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS n FROM part)""")
def rules_extension(spark, sf_dir):
    """A category and an environment of a configuration, in labels."""
    rules = Rules().extend({"env_categories": {"claims": {"prefix": "定理", "envs": ["thm", " "]}, "figure": {"envs": ["plot"]}, "none": {"envs": ["x"]}, "bad": 3}})
    body = F.when(F.col("p_size") % 3 == 0, "\\begin{thm}x").when(F.col("p_size") % 3 == 1, "\\begin{plot}x").otherwise("\\begin{x}x")
    df = read(spark, sf_dir, "part").select(F.concat_ws("/", "p_size", "p_brand").alias("doc_idx"), (F.col("p_size") % 7).alias("chapter"), part().alias("id"), body.alias("text"))
    return structure.label(df, rules).select(F.col("id").alias("p_partkey"), "category", "env_label")


@query(r"""
SELECT p_partkey, ['heading1', 'equation', 'figure', '', 'paragraph'][p_size % 5 + 1] AS kind, CASE p_size % 5 WHEN 0 THEN 1 ELSE 0 END AS level,
  CASE p_size % 5 WHEN 0 THEN '1.2' WHEN 1 THEN '式1-1' WHEN 2 THEN '图1-2' ELSE '' END AS prefix,
  CASE p_size % 5 WHEN 0 THEN '标题 {x} ' || p_name WHEN 1 THEN '\begin{equation}' || p_size || '\end{equation}' WHEN 2 THEN 'C ' || p_name ELSE '见图1-2，' || p_name END AS body
FROM part WHERE p_size % 5 <> 3""")
def render_rows(spark, sf_dir):
    """What to draw of each paragraph; rows that lost markup are left out."""
    k = F.col("p_size") % 5
    text = F.when(k == 0, "\\section{H}").when(k == 1, glue("\\begin{equation}", F.col("p_size"), "\\end{equation}")).when(k == 2, glue("\\begin{figure}\\caption{C ", F.col("p_name"), "}\\end{figure}")).otherwise("plain")
    done = F.when(k == 0, glue("\\section{ 标题 {x} ", F.col("p_name"), "}")).when(k == 4, glue("见图 图1-2 ，", F.col("p_name"))).otherwise("")
    label = F.when(k == 1, "式1-1").when(k == 2, "图1-2").otherwise("1.2节")
    df = parts(spark, sf_dir).select(F.lit(1).alias("doc_idx"), part().alias("id"), text.alias("text"), done.alias("translation"), label.alias("env_label"), (k == 3).alias("syntax_error"))
    return render.render_plan(df).select(F.col("id").alias("p_partkey"), "kind", "level", "prefix", "body")


@query(r"""
WITH p AS (SELECT p_partkey, p_name, p_size, 1 + p_size % 3 AS h FROM part),
c AS (
  SELECT p_partkey, 0 AS row, 0 AS col, 2 AS row_span, 1 AS col_span, 'l' AS align, p_name AS said FROM p
  UNION ALL SELECT p_partkey, 0, 1, 1, 2, 'c', 'S' || p_size FROM p UNION ALL SELECT p_partkey, 1, 1, 1, 1, 'c', 'a' FROM p UNION ALL SELECT p_partkey, 1, 2, 1, 1, 'r', 'b' FROM p
  UNION ALL SELECT p_partkey, 2, 0, h, 1, 'l', 'x' FROM p UNION ALL SELECT p_partkey, 2 + i, 1, 1, 1, 'c', 'v' || i FROM p, range(3) r(i)
  UNION ALL SELECT p_partkey, 2 + i, 0, 1, 1, 'l', 'y' || i FROM p, range(3) r(i) WHERE i >= h UNION ALL SELECT p_partkey, 2, 2, 3, 1, 'r', 'w' || p_partkey FROM p)
SELECT p_partkey, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(row_span AS INTEGER) AS row_span, CAST(col_span AS INTEGER) AS col_span, align, said FROM c""", True)
def table_grid(spark, sf_dir):
    """The cells of a table in the plan, with the rows and columns that they span: named above, counted up to, cut short."""
    line = lambda i: F.concat(F.when(F.col("p_size") % 3 < i, f"y{i}").otherwise(""), F.lit(f" & v{i} & "))
    t = glue(
        "\\begin{table}\\begin{tabular}{lcr}\\multirow{2}{*}{", F.col("p_name"), "} & \\multicolumn{2}{c}{S", F.col("p_size"), "} \\\\ & a & b \\\\ \\multirow{3}{*}{x} & v0 & \\\\ ",
        line(1), "\\\\ ", line(2), "\\multirow[t]{-3}{*}{w", part(), "}\\end{tabular}\\end{table}",
    )
    rows = parts(spark, sf_dir).select(F.lit(1).alias("doc_idx"), part().alias("id"), t.alias("text"), F.lit("表1-1").alias("env_label"))
    cells = render.render_plan(rows, drawn=True).select(F.col("id").alias("p_partkey"), F.explode("grid").alias("c"))
    return cells.select("p_partkey", "c.row", "c.col", "c.row_span", "c.col_span", "c.align", F.array_join(F.transform("c.runs", lambda r: r["text"]), "").alias("said"))


@query(r"""
WITH d AS (SELECT doc_id, source, lang, trim(translate(text, '\{}', '')) AS c, doc_id % 3 AS k FROM documents),
n AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, source, 'b' || c || CASE WHEN k > 0 THEN chr(2) || '1' || chr(3) ELSE '' END || CASE WHEN k > 1 THEN ' and' || chr(2) || '2' || chr(3) ELSE '' END AS body,
  CASE k WHEN 0 THEN '' WHEN 1 THEN (before + 1)::BIGINT || ':one {x} ' || doc_id ELSE (before + 1)::BIGINT || ':one {x} ' || doc_id || ';' || (before + 2)::BIGINT || ':two' END AS notes FROM n""", True)
def footnote_ids(spark, sf_dir):
    """Footnotes of the documents of an output taken out of their texts, with ids that the output has once."""
    k = doc() % 3
    body = F.concat(F.lit("b"), F.trim(F.translate("text", "\\{}", "")), F.when(k > 0, glue("\\footnote{one {x} ", doc(), "}")).otherwise(""), F.when(k > 1, " and\\footnote[7]{ two }").otherwise(""))
    plan = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", body.alias("body"))
    notes = F.transform("notes", lambda n: F.concat(n["id"].cast("string"), F.lit(":"), n["body"]))
    return render.with_notes(plan, ["source"], ["lang", "doc_id"]).select("doc_id", "source", "body", F.array_join(notes, ";").alias("notes"))


@query(r"""
WITH p AS (SELECT p_brand, p_partkey, p_size % 3 AS k FROM part)
SELECT p_partkey, 0 AS panel, 'f' || p_partkey AS name, k > 0 AS shown, CASE WHEN k = 2 THEN '' ELSE 'left ' || p_partkey END AS caption, CASE WHEN k = 2 THEN 5.0::DOUBLE ELSE 2.7::DOUBLE END AS width FROM p
UNION ALL SELECT p_partkey, 1, CASE WHEN k = 2 THEN 'h.png' ELSE 'none' END, true, '', CASE WHEN k = 2 THEN 5.0::DOUBLE ELSE 2.7::DOUBLE END FROM p""")
def figure_panels(spark, sf_dir):
    """The panels of figures with the first of their images that is there; figures without panels by image."""
    p, k, brand = read(spark, sf_dir, "part"), F.col("p_size") % 3, F.col("p_brand")
    side = lambda inside, cap: glue("\\begin{minipage}{1cm}", inside, *cap, "\\end{minipage}")
    first = glue("\\includegraphics[w]{f", part(), "}")
    text = F.when(k == 2, F.concat(first, F.lit("\\includegraphics{h.png}"))).otherwise(
        F.concat(side(first, ("\\caption{left ", part(), "}")), side("\\includegraphics{none}\\includegraphics{h}", ()))
    )
    rows = p.select(brand.alias("doc_idx"), part().alias("id"), glue("\\begin{figure}", text, "\\end{figure}").alias("text"), F.lit("图1-1").alias("env_label"))
    image = lambda name: glue("file:/in/", brand, "/", name).alias("path")
    have = p.where(k > 0).select(brand.alias("folder"), image(glue("f", part(), ".jpg"))).unionByName(p.select(brand.alias("folder"), image("h.png")).distinct())
    body = F.when(F.col("kind") == "figure", F.col("source"))
    plan = render.render_plan(rows).join(rows.select("doc_idx", "id", F.col("text").alias("source")), ["doc_idx", "id"]).withColumn("source", body)
    shown = render.with_panels(plan, have.withColumn("content", F.encode("path", "UTF-8")))
    return shown.select(F.col("id").alias("p_partkey"), F.posexplode("panels").alias("panel", "x")).select("p_partkey", "panel", "x.name", F.col("x.image").isNotNull().alias("shown"), "x.caption", "x.width")


@query(r"""
SELECT source || '/' || lang AS document, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1)::INTEGER AS pos, 'n' || doc_id AS note,
  '图' || doc_id || ' ' || regexp_replace(trim(translate(text, '\{}', '')), '\r\n?', chr(10), 'g') AS said FROM documents""", True)
def docx_store(spark, sf_dir):
    """Documents written as .docx files by the tasks, one file for each source and language, and read back."""
    body = F.concat(F.trim(F.translate("text", "\\{}", "")), glue("\\footnote{n", doc(), "}"))
    plan = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("document"), doc().cast("int").alias("pos"), F.lit("paragraph").alias("kind"), glue("图", doc()).alias("prefix"), body.alias("body"))
    path = f"{folder(spark)}/docx-{uuid.uuid4().hex}"
    render.write_documents(render.with_notes(plan, ["document"], ["pos"]), path)
    return spark.read.format("docx").load(path).select("document", "pos", F.col("text").alias("said"), F.get("notes", 0).alias("note"))


# ---- bibliographies --------------------------------------------------------------------------------------------------

_KINDS = ("Article", "InProceedings", "Book", "PhdThesis", "TechReport", "Misc")


@query("""
WITH f AS (SELECT p_partkey, p_partkey % 6 AS k, p_name AS t, CAST(1950 + p_size AS VARCHAR) AS y, CAST(p_size AS VARCHAR) AS v, CAST(p_partkey % 9 AS VARCHAR) AS n,
  'A One, B Two, C Three, et al. ' AS lead, ' Available: http://x.y/' || p_partkey || '.' AS u FROM part)
SELECT p_partkey, CASE k
  WHEN 0 THEN lead || t || '[J]. Jour, ' || y || ', ' || v || '(' || n || '): 1-9.'
  WHEN 1 THEN lead || t || '[C]//Proc. City: Org, ' || y || ': 1-9.' || u
  WHEN 2 THEN lead || t || '[M]. City: Pub, ' || y || '. 2.' || u
  WHEN 3 THEN 'A One, B Two, C Three, D Four. ' || t || '[D]. City: Uni, ' || y || '. T.' || u
  WHEN 4 THEN lead || t || '[R]. City: Inst, ' || y || '. T. No.' || n || '.' || u
  ELSE lead || t || '[EB/OL]. ' || y || '. N & M.' || u END AS citation FROM f""")
def citation_kinds(spark, sf_dir):
    """Citations of all types of entries, with more authors than are shown."""
    given = {
        "author": F.lit("A One and B, Two and {C}  Three and D Four"), "title": F.col("p_name"), "year": (F.col("p_size") + 1950).cast("string"), "journal": F.lit("\\emph{Jour}"), "volume": F.col("p_size").cast("string"),
        "number": (part() % 9).cast("string"), "pages": F.lit("1--9"), "booktitle": F.lit("Proc"), "address": F.lit("City"), "organization": F.lit("Org"), "publisher": F.lit("Pub"), "edition": F.lit("2"),
        "school": F.lit("Uni"), "type": F.lit("T"), "institution": F.lit("Inst"), "howpublished": glue("\\url{http://x.y/", part(), "}"), "note": F.lit("N \\& M"),
    }
    fields = F.map_from_arrays(F.array(*map(F.lit, given)), F.array(*given.values()))
    return parts(spark, sf_dir).select("p_partkey", bibliography.citation(F.get(F.array(*map(F.lit, _KINDS)), (part() % 6).cast("int")), fields).alias("citation"))


def _bib() -> Column:
    """Two entries with strings, concatenation, nested groups, a comment, a month and parentheses."""
    return glue(
        '@string{j = "Jour"}\n@comment{x}\n@Article{k', part(), ", Author={A and {B} C}, title = \"T ", F.col("p_name"), "\", journal = j # \" of \" # {X}, month = jan, year = ", F.col("p_size") + 1950,
        "}\njunk @book(b", part(), ", title={Two\n  lines}, year=2000)",
    )


@query("""
SELECT p_partkey, 0 AS pos, 'article' AS entrytype, 'k' || p_partkey AS id, 'author=A and {B} C;journal=Jour of X;month=jan;title=T ' || p_name || ';year=' || (p_size + 1950) AS fields FROM part
UNION ALL SELECT p_partkey, 1, 'book', 'b' || p_partkey, 'title=Two lines;year=2000' FROM part""", True)
def bibtex_read(spark, sf_dir):
    """Entries of BibTeX sources with their fields."""
    e = bibtex.entries(parts(spark, sf_dir).select(part().cast("string").alias("path"), F.encode(_bib(), "UTF-8").alias("content")))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select(F.col("path").cast("long").alias("p_partkey"), "pos", "entrytype", "id", F.array_join(pairs, ";").alias("fields"))


_ITEM = "\\bibitem[a]{r"


@query("""
WITH i AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'bib' WHEN 1 THEN 'bbl' ELSE 'tex' END AS ext, p_name, p_size FROM part)
SELECT p_partkey, 0 AS kind, 0 AS pos, 'k' || p_partkey AS key, 'article' AS entrytype, 'T ' || p_name AS title, CAST(p_size + 1950 AS VARCHAR) AS year,
  'A, B C. T ' || p_name || '[J]. Jour of X, ' || (p_size + 1950) || '.' AS citation FROM i WHERE ext = 'bib'
UNION ALL SELECT p_partkey, 0, 1, 'b' || p_partkey, 'book', 'Two lines', '2000', 'Two lines[M]. 2000.' FROM i WHERE ext = 'bib'
UNION ALL SELECT p_partkey, CASE ext WHEN 'bbl' THEN 1 ELSE 2 END, 0, 'r' || p_partkey, 'article', 'On ' || p_name, '1999', 'A. One. On ' || p_name || '[J]. Jour, 1999, 3(4): 10-20.' FROM i WHERE ext <> 'bib'
UNION ALL SELECT p_partkey, CASE ext WHEN 'bbl' THEN 1 ELSE 2 END, 1, 's', 'inproceedings', 'Two', '2001', 'B. Two[C]//Proc. 2001.' FROM i WHERE ext <> 'bib'""", True)
def bibliography_union(spark, sf_dir):
    """Entries of bib and bbl files and of the bibliographies in tex files, as one table."""
    items = glue(_ITEM, part(), "}\nA. One, {\\natexlab{x}}.\n\\newblock On ", F.col("p_name"), ".\n\\newblock \\emph{Jour}, 3(4):10--20, 1999.\n\\bibitem{s} B.\n\\newblock Two.\n\\newblock In \\emph{Proc}, 2001.\n")
    k = part() % 3
    text = F.when(k == 0, _bib()).when(k == 1, items).otherwise(glue("\\bibitem{out} side\n\\begin{thebibliography}{9}\n", items, "\\end{thebibliography}"))
    ext = F.when(k == 0, "bib").when(k == 1, "bbl").otherwise("tex")
    g = bibtex.gathered(parts(spark, sf_dir).select(part().cast("string").alias("path"), ext.alias("ext"), F.encode(text, "UTF-8").alias("content")))
    return g.select(F.col("path").cast("long").alias("p_partkey"), "kind", "pos", "key", "entrytype", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"), bibliography.citation(F.col("entrytype"), F.col("fields")).alias("citation"))


@query("""
SELECT p_partkey, 'A. One and B. Two' AS authors, p_name AS title, 'Journal of ' || p_type AS venue, CAST(p_size AS VARCHAR) AS volume, '4' AS number, '10-' || (p_size + 10) AS pages, '1999' AS year,
  CASE p_partkey % 2 WHEN 0 THEN '10.1234/x' || p_partkey ELSE '' END AS doi, CASE p_partkey % 2 WHEN 0 THEN '' ELSE 'https://x.y/z' END AS url FROM part""")
def bibitem_parse(spark, sf_dir):
    """the fields of an item of a bibliography text."""
    body = glue(
        "A. One and B. Two.\n\\newblock {", F.col("p_name"), "}.\n\\newblock \\emph{Journal of ", F.col("p_type"), "}, ", F.col("p_size"), " (4): pp. 10--", F.col("p_size") + 10, ", 1999.\n\\newblock ",
        F.when(part() % 2 == 0, glue("\\doi{10.1234/x", part(), "}")).otherwise("see https://x.y/z)."),
    )
    return parts(spark, sf_dir).select("p_partkey", bibliography.parse_item(body).alias("i")).select("p_partkey", *(f"i.{c}" for c in ("authors", "title", "venue", "volume", "number", "pages", "year", "doi", "url")))


@query("""
SELECT p_partkey, ['One A., B. Two', 'A. One, B.-C. Two', 'Ann Lee, Bob Ray, C. Poe, et al'][p_partkey % 3 + 1] || '. On the ' || p_name || ' of things' || CASE WHEN p_partkey % 2 = 0 THEN '[J]. Jour of Odd, 1999, ' || p_size || '(4): 10-' || (p_size + 10) || '.' ELSE '[C]//Proceedings of X' || '. 2001.' END AS citation FROM part""", True)
def bibitem_unmarked(spark, sf_dir):
    """citations of items whose authors, titles and venues are told apart by what they look like."""
    names = F.get(F.array(F.lit("One, A. and B. Two."), F.lit("A. One, and B.-C. Two."), F.lit("Ann Lee, Bob Ray, C. Poe, et al.")), (part() % 3).cast("int"))
    venue = F.when(part() % 2 == 0, glue("Jour of Odd, ", F.col("p_size"), " (4): pp. 10--", F.col("p_size") + 10, ", 1999.")).otherwise("In Proceedings of X, 2001.")
    item = glue("\\bibitem{k", part(), "} ", names, " On the ", F.col("p_name"), " of things. ", venue)
    files = parts(spark, sf_dir).select(part().cast("string").alias("path"), F.lit("bbl").alias("ext"), F.encode(item, "UTF-8").alias("content"))
    return bibtex.gathered(files).select(F.col("path").cast("long").alias("p_partkey"), bibliography.citation(F.col("entrytype"), F.col("fields")).alias("citation"))


@query("SELECT p_partkey AS id, p_name AS citation FROM part")
def reference_entries(spark, sf_dir):
    """Entries each under its own key, and one citation for each number."""
    own = bibliography.alone(read(spark, sf_dir, "part").select(part().alias("id"), F.col("p_name").alias("citation"), glue("p", part()).alias("key")), "key")
    return bibliography.reference_list(bibliography.lookup(own.drop("key"), "citation"))


# ---- references and reports ------------------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT o_custkey AS doc, o_orderkey AS k FROM orders UNION ALL SELECT o_custkey, o_custkey FROM orders UNION ALL SELECT o_custkey, o_orderkey % 33 FROM orders),
m AS (SELECT doc, 'p' || k AS key, count(*) AS n FROM u WHERE k NOT IN (SELECT p_partkey FROM part) GROUP BY ALL)
SELECT doc, string_agg(key || ' (' || n || ')', ', ' ORDER BY key) AS report, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY doc""")
def missing_keys_report(spark, sf_dir):
    """The unknown keys of each document in order, as one line."""
    o, p = _cites(spark, sf_dir)
    owner = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"))
    used = references.cite_keys(o.join(owner, "o_orderkey"), ["o_orderkey", "doc"])
    return references.missing_report(references.missing(used, p, ["doc"]), ["doc"])


@query("""
WITH c AS (SELECT chapter, key FROM (SELECT user_id % 10 AS chapter, regexp_extract(props, '([0-9]+)', 1) AS key, event_type || '-' || (event_id % 50) AS env_label,
    lag(event_type || '-' || (event_id % 50)) OVER (PARTITION BY user_id % 10, regexp_extract(props, '([0-9]+)', 1) ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> env_label),
k AS (SELECT chapter, key, row_number() OVER (PARTITION BY chapter ORDER BY key) AS i FROM c GROUP BY chapter, key)
SELECT CAST(chapter AS VARCHAR) AS chapter, string_agg(CASE WHEN i <= 5 THEN key END, ',' ORDER BY key) AS shown, CAST(count(*) AS INTEGER) AS total FROM k GROUP BY chapter""")
def collision_report(spark, sf_dir):
    """The first five keys of each chapter that are given again."""
    c = references.collisions(_keyed(spark, sf_dir), ["chapter", "key"], "env_label", ["ts", "event_id"])
    return references.first_collisions(c, ["chapter"]).select("chapter", F.array_join("shown", ",").alias("shown"), "total")


@query("""
SELECT (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM documents) AS paragraphs, (SELECT count(*) FROM part) AS citation_keys, (SELECT count(*) FROM supplier) AS reference_keys""")
def replace_summary(spark, sf_dir):
    """Counts of a whole run."""
    return references.replace_summary(read(spark, sf_dir, "documents").select(F.col("source").alias("doc_idx")), read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier"))


@query("""
SELECT CAST(sum(CASE WHEN event_type = 'error' AND user_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN event_type = 'view' OR event_type = 'error' AND user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM events""")
def issue_levels(spark, sf_dir):
    """Errors and warnings, after the errors of one stage have become warnings."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("INFO")
    i = read(spark, sf_dir, "events").select(level.alias("level"), (F.col("user_id") % 3).cast("string").alias("stage"), F.col("props").alias("message"))
    return documents.issue_counts(documents.demoted(i, "0", "optional"))


# ---- exchange and stores ---------------------------------------------------------------------------------------------


def _client():
    return lambda system, user: user.replace("e", "3")


@query(r"""
WITH d AS (SELECT doc_id, translate(text, '\{}', '') AS c FROM documents), r AS (SELECT doc_id, c, regexp_replace(replace(c, 'e', '3'), '^\s+|\s+$', '', 'g') AS t FROM d)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '\begin{figure}see\caption{' || t || '}\end{figure}' WHEN 1 THEN '\begin{equation}see\end{equation}' ELSE t END AS translation FROM r""", True)
def exchange_batches(spark, sf_dir):
    """Batches sent, answers taken apart and put back; captions of floats alone, no formulas."""
    t, k = F.translate("text", "\\{}", ""), doc() % 3
    text = F.when(k == 0, glue("\\begin{figure}see\\caption{", t, "}\\end{figure}")).when(k == 1, "\\begin{equation}see\\end{equation}").otherwise(t)
    rows = read(spark, sf_dir, "documents").select(F.floor(doc() / 20).cast("int").alias("doc_idx"), doc().cast("int").alias("id"), text.alias("text"))
    weights = rows.select("doc_idx", "id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("tokens"))
    batches = exchange.greedy_batches(weights, ["doc_idx"], ["id"], "tokens", 1500).select("doc_idx", "id", "batch_no")
    sent = rows.join(batches, ["doc_idx", "id"]).withColumn("terms", F.create_map().cast("map<string,string>"))
    return exchange.exchange(sent, _client).select(F.col("id").cast("long").alias("doc_id"), "translation")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || lang WHEN doc_id % 2 = 0 THEN 'old ' || lang ELSE '' END AS translation FROM documents""")
def checkpoint_store(spark, sf_dir):
    """What two runs saved, the later first, with all rows."""
    rows = read(spark, sf_dir, "documents").select(F.lit(0).alias("doc_idx"), doc().cast("int").alias("id"), "lang")
    path = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    for run, (own, word) in enumerate((("id % 2 = 0", "old "), ("id % 3 = 0", "new "))):
        checkpoints.save(rows.where(own).withColumn("translation", glue(word, F.col("lang"))), path, run)
    done = exchange.restore(rows.select("doc_idx", "id"), checkpoints.load(spark, path), ["doc_idx", "id"], "translation")
    return done.select(F.col("id").cast("long").alias("doc_id"), "translation")


@query("""
SELECT doc_id, text AS body, CASE WHEN doc_id % 2 = 0 OR regexp_matches(text, '^[\\x00-\\x7f]*$') THEN text END AS strict FROM documents""")
def decode_texts(spark, sf_dir):
    """UTF-8, else Latin-1, or nothing where only UTF-8 will do."""
    content = F.when(doc() % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return read(spark, sf_dir, "documents").select("doc_id", files.decoded(content).alias("body"), files.decoded(content, True).alias("strict"))


# ---- files -----------------------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT p_brand AS folder, p_partkey || '.tex' AS name, CASE p_partkey % 5 WHEN 0 THEN 0 ELSE 1 END AS a, CASE p_partkey % 5 WHEN 1 THEN 0 WHEN 0 THEN 0 ELSE 1 END AS b, p_size FROM part WHERE p_partkey % 7 <> 6)
SELECT folder, arg_min(name, (a, b, -p_size, name)) AS name FROM f GROUP BY folder""")
def main_file(spark, sf_dir):
    """The main file of each folder."""
    k = part() % 5
    body = F.when(k == 0, "\\title{a} \\author \\begin{document}").when(k == 1, "\\begin{document}                 ").otherwise("\\titlepage \\author               ")
    text = F.concat(F.rpad(body, 40, "."), F.repeat(F.lit("x"), F.col("p_size")))
    tex = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("folder"), glue(part(), ".tex").alias("name"), F.lit("tex").alias("ext"), F.when(part() % 7 == 6, 2).otherwise(1).alias("depth"), F.encode(text, "UTF-8").alias("content")
    )
    return files.main_file(files.tex_files(tex)).select("folder", "name")


@query("""
SELECT p_brand AS doc, 'f' || p_partkey AS rel, CASE p_partkey % 3 WHEN 0 THEN 'file:/in/' || p_brand || '/f' || p_partkey || '.png' WHEN 1 THEN 'file:/in/' || p_brand || '/f' || p_partkey || '.pdf' END AS path FROM part""")
def image_lookup(spark, sf_dir):
    """The file of an image that is named without a suffix, by order of suffixes."""
    p = read(spark, sf_dir, "part").where(part() % 3 < 2)
    path = lambda suffix: glue("file:/in/", F.col("p_brand"), "/f", part(), suffix).alias("path")
    found = p.select(F.col("p_brand").alias("folder"), path(".pdf")).unionByName(p.where(part() % 3 == 0).select(F.col("p_brand").alias("folder"), path(".png")))
    return files.image_of(read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), glue("f", part()).alias("rel")), found)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    own = {
        "main.tex": glue("A", k, " \\input{a} % \\input{z}\nB \\include{sub/b.tex}\\input{none} 5\\% \\import{sub/}{d}"), "a.tex": glue("a", k, " \\input{c}"), "sub/b.tex": glue("b \\input{d} ", F.col("s_name")),
        "sub/d.tex": F.lit("near"), "d.tex": F.lit("far"), "c.tex": F.lit("c \\input{a}"), "z.tex": F.lit("z"),
    }
    return s.select(k.cast("string").alias("folder"), F.explode(F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*own.values()))).alias("name", "text"))


@query(r"""
SELECT s_suppkey, 'A' || s_suppkey || ' a' || s_suppkey || ' c \input{a} % \input{z}' || chr(10) || 'B b near ' || s_name || '\input{none} 5\% near' AS text FROM supplier""")
def include_inline(spark, sf_dir):
    """Every main file with its includes in place; comments, cycles and what is missing stay as they are."""
    fs = _sources(spark, sf_dir)
    edges = includes.include_edges(fs)
    return includes.inlined(fs, edges, includes.expand_order(fs.where("name = 'main.tex'"), edges)).select(F.col("folder").cast("long").alias("s_suppkey"), "text")


@query("SELECT s_suppkey, unnest(['d.tex', 'z.tex']) AS name FROM supplier")
def include_leftovers(spark, sf_dir):
    """Files that no main file reaches."""
    fs = _sources(spark, sf_dir)
    order = includes.expand_order(fs.where("name = 'main.tex'"), includes.include_edges(fs))
    return includes.leftovers(fs, order).select(F.col("folder").cast("long").alias("s_suppkey"), "name")


# ---- rows and settings -----------------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
r AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS pos FROM supplier)
SELECT k, CAST(pos AS INTEGER) AS pos, c_custkey, s_suppkey FROM l FULL JOIN r USING (k, pos)""")
def positional_zip(spark, sf_dir):
    """Rows of two tables side by side by their places."""
    left = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    right = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", (-F.col("s_suppkey")).alias("down"))
    return structure.zip_rows(left, right, ["k"], "c_custkey", "down").select("k", "pos", "c_custkey", "s_suppkey")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a=1;b=' || p_size || ';c=3' ELSE 'a=1;b=2' END AS merged FROM part""")
def settings_merge(spark, sf_dir):
    """One layer of settings over another."""
    base, over = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.col("p_size").cast("string"), F.lit("c"), F.lit("3"))
    m = fragments.merged(base, F.when(F.col("p_size") % 2 == 0, over))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def queue_cancelled(spark, sf_dir):
    """Requests without those that were cancelled."""
    gone = read(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return jobs.not_cancelled(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")
