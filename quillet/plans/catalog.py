"""The registered queries of the document engine over the supplied tables, and the DuckDB SQL that checks each.

Each query applies the operators of this library to a whole table. Where a table has no LaTeX, the text is made of its
integer columns by one expression that both engines build alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fragments
from ..functions import text as T
from ..functions.rules import Rules
from ..operators import bibliography, exchange, lifecycle, orders, references, render, structure
from ..sources import events as events_source
from ..sources import files
from ..sources.shared import folder
from ..streaming import jobs
from . import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all cores by keys: of short rows a task reads millions, which is too many where each is much work."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "part"), "p_partkey")


# ---- structure -------------------------------------------------------------------------------------------------------

@query("""
WITH s AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sec FROM conversations),
u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, sec ORDER BY turn) AS sub FROM s)
SELECT conv_id, turn, CAST(sec AS BIGINT) AS section_no, CAST(sub AS BIGINT) AS sub_no,
  coalesce(last_value(CASE role WHEN 'system' THEN CAST(sec AS VARCHAR) WHEN 'user' THEN sec || '.' || sub END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '0') AS heading
FROM u""")
def heading_carry_forward(spark, sf_dir):
    """Sections, subsections since the last section, and the inherited heading."""
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return structure.carry_forward(df, ["conv_id"], ["turn"], F.col("role") == "system", F.col("role") == "user").drop("role")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seq FROM events)
SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'figure' WHEN 'view' THEN 'table' WHEN 'error' THEN 'code' ELSE 'text' END AS category,
  CASE event_type WHEN 'click' THEN '图' || (user_id % 9) || '-' || seq WHEN 'view' THEN '表' || (user_id % 9) || '-' || seq WHEN 'error' THEN '代码' || (user_id % 9) || '-' || seq
    ELSE (user_id % 9) || '.0节' END AS env_label FROM e""")
def env_sequence(spark, sf_dir):
    """Environments told apart and numbered by category in a document."""
    kind = F.col("event_type")
    body = F.when(kind == "click", "\\begin{figure}\\end{figure}").when(kind == "view", "  \\begin{table*}[t] x").when(kind == "error", "\\begin{lstlisting}\nx").otherwise("words \\begin{figure}")
    df = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_idx"), (F.col("user_id") % 9).alias("chapter"), F.col("event_id").alias("id"), body.alias("text"))
    return structure.label(df).select(F.col("id").alias("event_id"), F.col("doc_idx").alias("user_id"), "category", "env_label")


@query("""
WITH x AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS d FROM events),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM x),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM s)
SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grp FROM m""")
def env_depth_merge(spark, sf_dir):
    """Rows belong together while the running depth is above zero."""
    depth = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    df = structure.merge_open(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", depth)
    return df.select("event_id", "user_id", F.col("grp").cast("long").alias("grp"))


@query("""
WITH g AS (SELECT *, sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations)
SELECT conv_id, CAST(grp AS BIGINT) AS grp, min(turn) AS turn, string_agg(role || ':' || length(text), chr(10) ORDER BY turn) AS body FROM g GROUP BY conv_id, grp""")
def leading_label_merge(spark, sf_dir):
    """Leading labels go with what is before them."""
    df = read(spark, sf_dir, "conversations").withColumn("body", F.concat("role", F.lit(":"), F.length("text").cast("string")))
    df = structure.attach_leading(df, ["conv_id"], "turn", F.col("role") == "system")
    return structure.join_groups(df, ["conv_id"], "turn", "body", "\n").select("conv_id", F.col("grp").cast("long").alias("grp"), "turn", "body")


_PAPER = r"""
WITH d AS (SELECT doc_id, replace(translate(text, '\{}', ''), '%', '\%') AS c FROM documents),
a AS (SELECT doc_id, string_split_regex(regexp_replace(c, '[ \t]+(\n|$)', '\1', 'g'), '\n\s*\n') AS a FROM d),
p AS (
  SELECT doc_id, 0 AS k, 0 AS pos, '\section{S' || doc_id || '}' AS body FROM d
  UNION ALL SELECT doc_id, 1, generate_subscripts(a, 1), regexp_replace(unnest(a), '^\s+|\s+$', '', 'g') FROM a
  UNION ALL SELECT doc_id, 2, 0, '\begin{equation} x_' || doc_id || chr(10) || chr(10) || '= 1 \end{equation}' || chr(10) || '\label{e' || doc_id || '}' FROM d
  UNION ALL SELECT doc_id, 3, 0, 'after ' || doc_id FROM d
  UNION ALL SELECT doc_id, 4, 0, '\subsection{T}' FROM d
  UNION ALL SELECT doc_id, 5, 0, 'tail ' || doc_id FROM d
  UNION ALL SELECT doc_id, 6, 0, '\begin{figure}' || chr(10) || '\caption{C}' || chr(10) || '\end{figure}' FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, pos) AS id FROM p WHERE body <> '')"""


def plain_text(text: str = "text") -> Column:
    """Whole texts without backslashes and braces, percent signs escaped: prose as a LaTeX source holds it."""
    return F.replace(F.translate(text, "\\{}", ""), F.lit("%"), F.lit("\\%"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a paper: its whole text in a section, then an equation with a blank line in it, a label, a comment,
    a subsection, layout and macro lines that say nothing, and a figure."""
    i = F.col("doc_id").cast("string")
    parts = (
        "\\documentclass{article}\nnot shown\n\\begin{document}\n\\maketitle\n\\section{S", i, "}\n", plain_text(), "\n\\begin{equation} x_", i, "\n\n= 1 \\end{equation}\n\n\\label{e", i, "}\nafter ", i,
        " % a comment\n\n\\subsection{T}\ntail ", i, "\n\n\\smallskip\n\\newcommand{\\q}{0}\n\n\\begin{figure}\n\\caption{C}\n\\end{figure}\n\\end{document}\nnot shown",
    )
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("tex"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.label(structure.chunk(_papers(spark, sf_dir)).withColumn("chapter", F.col("doc_idx") % 9 + 1))


@query(_PAPER + " SELECT doc_id, id, body FROM n")
def paragraph_chunk(spark, sf_dir):
    """The paragraphs of every document as a paper, numbered."""
    return structure.chunk(_papers(spark, sf_dir)).select(F.col("doc_idx").alias("doc_id"), F.col("id").cast("long").alias("id"), F.col("text").alias("body"))


@query(_PAPER + r"""
SELECT doc_id, id, CASE k WHEN 0 THEN 'section' WHEN 2 THEN 'math' WHEN 4 THEN 'subsection' WHEN 6 THEN 'figure' ELSE 'text' END AS category,
  CASE WHEN k = 2 THEN '式' || c || '-1' WHEN k = 6 THEN '图' || c || '-1' WHEN k < 4 THEN c || '.1节' ELSE c || '.1.1小节' END AS env_label
FROM (SELECT *, CAST(doc_id % 9 + 1 AS VARCHAR) AS c FROM n)""")
def paragraph_label(spark, sf_dir):
    """Category and label of every paragraph."""
    return _labelled(spark, sf_dir).select(F.col("doc_idx").alias("doc_id"), F.col("id").cast("long").alias("id"), "category", "env_label")


@query(_PAPER + r"""
SELECT CASE k WHEN 0 THEN 'section' WHEN 2 THEN 'math' WHEN 4 THEN 'subsection' WHEN 6 THEN 'figure' ELSE 'text' END AS category, count(*) AS n FROM n GROUP BY 1""")
def category_counts(spark, sf_dir):
    """Paragraphs of each category."""
    return structure.label_summary(_labelled(spark, sf_dir))


@query(r"""
SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN trim(text, ' ' || chr(10) || chr(9)) = '' ELSE true END AS silent,
  translate(text, '\{}', '') AS body, length(regexp_replace(text, '[%\\]', '_', 'g')) + CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS at FROM documents""")
def noncontent_text(spark, sf_dir):
    """Texts that only lay out, definitions of macros taken out, the place of the first comment."""
    r, t = F.col("doc_id") % 4, F.translate("text", "\\{}", "")
    layout = F.when(r == 0, "\\vspace{1em} \\noindent\n\\label{a}").when(r == 1, "\\begin{center}[t]\\end{center}").when(r == 2, F.concat(F.lit("\\noindent "), "text")).otherwise("\\bibliography{a}")
    defined = F.concat(F.lit("\\newcommand{\\a}[1]{\n{ b }\n}\n"), t, F.lit("\n\\def\\x{1}"))
    k = F.col("doc_id") % 3
    line = F.concat(F.translate("text", "%\\\n", "___"), F.when(k == 0, "\\%a%b").when(k == 1, "\\\\%b").otherwise("%c"))
    return read(spark, sf_dir, "documents").select("doc_id", T.is_noncontent(layout).alias("silent"), T.strip_macro_definitions(defined).alias("body"), T.comment_start(line).cast("long").alias("at"))


# ---- labels and references -------------------------------------------------------------------------------------------

_TEX = "concat('text ', translate(text, '\\{}', ''), doc_id, ' \\label{k', doc_id % 97, '} and \\tag{t', doc_id % 13, '}', chr(10), '\\hypertarget{h', doc_id % 7, '}{shown} end')"


def _tex(df: DataFrame) -> DataFrame:
    s = lambda x: F.lit(x)
    m = lambda n: (F.col("doc_id") % n).cast("string")
    t = F.concat(s("text "), F.translate("text", "\\{}", ""), F.col("doc_id").cast("string"), s(" \\label{k"), m(97), s("} and \\tag{t"), m(13), s("}\n\\hypertarget{h"), m(7), s("}{shown} end"))
    return df.withColumn("t", t)


@query(f"""
WITH d AS (SELECT doc_id, {_TEX} AS t FROM documents),
k AS (
  SELECT doc_id, 'label' AS category, 0 AS cat_rank, unnest(regexp_extract_all(t, '\\\\label(?:\\[[^\\]]*\\])?\\{{([^}}]+)\\}}', 1)) AS key FROM d
  UNION ALL SELECT doc_id, 'hypertarget', 2, unnest(regexp_extract_all(t, '\\\\hypertarget\\{{([^}}]+)\\}}', 1)) FROM d
  UNION ALL SELECT doc_id, 'tag', 3, unnest(regexp_extract_all(t, '\\\\tag\\*?\\{{([^}}]+)\\}}', 1)) FROM d)
SELECT doc_id, category, cat_rank, key FROM k""")
def label_extract(spark, sf_dir):
    """keys of all label-like commands by category."""
    df = _tex(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.explode(T.label_keys(F.col("t"))).alias("k")).select("doc_id", "k.category", "k.cat_rank", "k.key")


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TEX},
  '\\n?[ \\t]*\\\\hypertarget\\{{[^}}]+\\}}\\{{([^}}]*)\\}}[ \\t]*\\n?', '\\1', 'g'), '\\n?[ \\t]*\\\\label(?:\\[[^\\]]*\\])?\\{{[^}}]+\\}}[ \\t]*\\n?', '', 'g'),
  '\\n?[ \\t]*\\\\tag\\*?\\{{[^}}]+\\}}[ \\t]*\\n?', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM documents""")
def label_strip(spark, sf_dir):
    """text without label commands; anchors leave their text."""
    return _tex(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.strip_labels(F.col("t")).alias("body"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 10).cast("string").alias("chapter"), F.regexp_extract("props", "([0-9]+)", 1).alias("key"),
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string")).alias("env_label"),
    )


@query("""
SELECT CAST(user_id % 10 AS VARCHAR) AS chapter, regexp_extract(props, '([0-9]+)', 1) AS key,
  arg_max(event_type || '-' || (event_id % 50), (ts, event_id)) AS env_label FROM events GROUP BY ALL""")
def refmap_last_wins(spark, sf_dir):
    """The last label of each key of a chapter."""
    return references.last_wins(_keyed(spark, sf_dir), ["chapter", "key"], "env_label", ["ts", "event_id"])


@query("""
SELECT event_id, chapter, key, previous, env_label FROM (
  SELECT event_id, CAST(user_id % 10 AS VARCHAR) AS chapter, regexp_extract(props, '([0-9]+)', 1) AS key, event_type || '-' || (event_id % 50) AS env_label,
    lag(event_type || '-' || (event_id % 50)) OVER (PARTITION BY user_id % 10, regexp_extract(props, '([0-9]+)', 1) ORDER BY ts, event_id) AS previous FROM events)
WHERE previous <> env_label""")
def label_collisions(spark, sf_dir):
    """A key that is given again with another label."""
    return references.collisions(_keyed(spark, sf_dir), ["chapter", "key"], "env_label", ["ts", "event_id"]).select("event_id", "chapter", "key", "previous", "env_label")


@query("""
WITH own AS (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS chapter, CAST(s_suppkey % 60 AS VARCHAR) AS key, max(s_name) AS env_label FROM supplier GROUP BY ALL),
any_ AS (SELECT key, arg_min(env_label, chapter) AS env_label FROM own GROUP BY key)
SELECT c_custkey, chapter, key, coalesce(o.env_label, a.env_label, '[?]') AS env_label, coalesce(o.env_label, a.env_label) IS NOT NULL AS found
FROM (SELECT c_custkey, CAST(c_nationkey % 5 AS VARCHAR) AS chapter, CAST(c_custkey % 120 AS VARCHAR) AS key FROM customer)
LEFT JOIN own o USING (chapter, key) LEFT JOIN any_ a USING (key)""")
def ref_two_tier(spark, sf_dir):
    """A label in the own chapter, else in the chapter that sorts first, else a placeholder."""
    s = read(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).cast("string").alias("chapter"), (F.col("s_suppkey") % 60).cast("string").alias("key")).agg(F.max("s_name").alias("env_label"))
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("string").alias("chapter"), (F.col("c_custkey") % 120).cast("string").alias("key"))
    return references.two_tier(c, s, "key", "chapter", "env_label", "[?]").select("c_custkey", "chapter", "key", "env_label", "found")


def _cites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all orders and customers against all parts; those beyond the last part do not exist."""
    s = lambda c: F.col(c).cast("string")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("see~\\cite{p"), s("o_orderkey"), F.lit(", p"), s("o_custkey"), F.lit("} and \\citep[a]{p"), (F.col("o_orderkey") % 33).cast("string"), F.lit("}")).alias("text")
    )
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), s("p_partkey")).alias("key"), (F.col("p_partkey") + 1).alias("id"))
    return o, p


@query("""
WITH p AS (SELECT p_partkey AS k, CAST(p_partkey + 1 AS VARCHAR) AS id FROM part)
SELECT o_orderkey, '\\textsuperscript{[' || coalesce(a.id, '[?]') || ',' || coalesce(b.id, '[?]') || ']}' || '|' || '\\textsuperscript{[' || coalesce(c.id, '[?]') || ']}' AS cites
FROM orders LEFT JOIN p a ON a.k = o_orderkey LEFT JOIN p b ON b.k = o_custkey LEFT JOIN p c ON c.k = o_orderkey % 33""")
def cite_resolve(spark, sf_dir):
    """Citation commands to numbers over the whole table of parts."""
    o, p = _cites(spark, sf_dir)
    return references.resolve_citations(o, p, ["o_orderkey"], "[?]").select("o_orderkey", F.array_join("cites", "|").alias("cites"))


@query("""
WITH u AS (SELECT o_orderkey % 4 AS doc, o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey % 4, o_custkey FROM orders UNION ALL SELECT o_orderkey % 4, o_orderkey % 33 FROM orders)
SELECT doc, 'p' || k AS key, count(*) AS n FROM u WHERE k NOT IN (SELECT p_partkey FROM part) GROUP BY ALL""")
def missing_keys(spark, sf_dir):
    """Unknown keys over the whole table of parts."""
    o, p = _cites(spark, sf_dir)
    used = references.cite_keys(o.withColumn("doc", F.col("o_orderkey") % 4), ["o_orderkey", "doc"])
    return references.missing(used, p, ["doc"])


@query(r"""
WITH own AS (SELECT s_nationkey % 5 AS chapter, 'k' || (s_suppkey % 60) AS key, '图' || (s_nationkey % 5) || '-' || max(s_suppkey) AS env_label FROM supplier GROUP BY s_nationkey % 5, s_suppkey % 60),
any_ AS (SELECT key, arg_min(env_label, chapter) AS env_label FROM own GROUP BY key),
r AS (SELECT chapter, key, coalesce(o.env_label, a.env_label) AS found FROM (SELECT DISTINCT c_nationkey % 5 AS chapter, 'k' || (c_custkey % 120) AS key FROM customer) LEFT JOIN own o USING (chapter, key) LEFT JOIN any_ a USING (key)),
c AS (SELECT c_custkey, c_nationkey % 5 AS chapter, 'k' || (c_custkey % 120) AS key, c_name FROM customer),
x AS (SELECT c.*, r.found, p_partkey + 1 AS id FROM c JOIN r USING (chapter, key) LEFT JOIN part ON p_partkey = c_custkey * 2)
SELECT c_custkey, c_name || CASE WHEN found IS NULL THEN ' 见图 [未找到] 。' ELSE ' 见' || found || '。' END || ' 由\textsuperscript{[' || coalesce(CAST(id AS VARCHAR), '[未找到]') || ',[未找到]]},'
  || CASE WHEN found IS NULL THEN ' [未找到]、[未找到]; [未找到]!' ELSE found || '、[未找到];' || found || '!' END AS body FROM x""")
def reference_rewrite(spark, sf_dir):
    """Reference, hyperlink and citation commands in place, doubled prefixes and blanks tidied."""
    n = lambda c: F.col(c).cast("string")
    key = F.concat(F.lit("k"), (F.col("c_custkey") % 120).cast("string"))
    text = F.concat(
        "c_name", F.lit(" 见图 \\ref{"), key, F.lit("} 。 由~\\cite{p"), (F.col("c_custkey") * 2).cast("string"), F.lit(", q}, \\eqref{"), key, F.lit(" , none}; \\hyperref[ "), key, F.lit("]{here}!")
    )
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_idx"), (F.col("c_nationkey") % 5).alias("chapter"), F.lit(1).alias("id"), text.alias("text"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("string").alias("chapter"), F.concat(F.lit("k"), (F.col("s_suppkey") % 60).cast("string")).alias("key"), "s_suppkey")
    refs = s.groupBy("chapter", "key").agg(F.concat(F.lit("图"), "chapter", F.lit("-"), F.max("s_suppkey").cast("string")).alias("env_label"))
    cites = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), n("p_partkey")).alias("key"), (F.col("p_partkey") + 1).alias("id"))
    return references.replace_references(rows, refs, cites).select(F.col("doc_idx").alias("c_custkey"), F.col("text").alias("body"))


# ---- bibliography ----------------------------------------------------------------------------------------------------

@query("""
SELECT lower(trim(text)) AS norm, min(doc_id) AS doc_id, list_aggregate(list_sort(list(DISTINCT doc_id)), 'string_agg', ',') AS aliases FROM documents GROUP BY 1""")
def dedup_aliases(spark, sf_dir):
    """The first of equal normalised titles, with the keys of all."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("text")).alias("norm"))
    d = bibliography.dedup(df, F.col("norm"), "doc_id", "doc_id")
    return d.select("norm", "doc_id", F.array_join("aliases", ",").alias("aliases"))


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 7 = 0 THEN -1 ELSE 1900 + p_size END DESC, p_name, p_partkey) + 100 AS id FROM part""")
def citation_numbering(spark, sf_dir):
    """Global citation numbers, newest first, unknown years last; numbered by sorted ranges."""
    df = read(spark, sf_dir, "part").withColumn("year", F.when(F.col("p_size") % 7 == 0, "n.d.").otherwise((F.col("p_size") + 1900).cast("string")))
    order = bibliography.order_columns("year", "year", "p_name", "p_partkey")
    return structure.number_by_range(df, order, "id", 101).select("p_partkey", "id")


@query("""
SELECT p_partkey, coalesce(p_brand || '. ', '') || p_name || '[J]. Journal of ' || p_type || ', ' || (1950 + p_size) || ', ' || p_size || '(' || (p_partkey % 9) || '): 1-' || p_size || '.'
  || CASE WHEN p_partkey % 2 = 0 THEN ' DOI: 10.1/' || p_partkey || '.' ELSE '' END AS citation FROM part""")
def citation_format(spark, sf_dir):
    """A formatted citation from fields."""
    s = lambda c: c.cast("string")
    p = parts(spark, sf_dir)
    entries = F.map_from_arrays(
        F.array(*(F.lit(k) for k in ("author", "title", "journal", "year", "volume", "number", "pages", "doi"))),
        F.array(
            F.concat(F.lit("{"), F.col("p_brand"), F.lit("}")), F.col("p_name"), F.concat(F.lit("Journal  of "), F.col("p_type")), s(F.col("p_size") + 1950), s(F.col("p_size")), s(F.col("p_partkey") % 9),
            F.concat(F.lit("1--"), s(F.col("p_size"))), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("10.1/"), s(F.col("p_partkey")))),
        ),
    )
    return p.select("p_partkey", bibliography.citation(F.lit("Article"), entries).alias("citation"))


@query("""
WITH e AS (SELECT p_partkey AS id, p_name AS citation, unnest([p_name, p_brand]) AS key FROM part)
SELECT key, CAST(max(id) AS BIGINT) AS id, arg_max(citation, id) AS citation FROM e GROUP BY key""")
def citation_lookup(spark, sf_dir):
    """Every alias to its number; of several entries the later wins."""
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("citation"), F.array("p_name", "p_brand").alias("aliases"))
    return bibliography.lookup(df, "citation")


@query(r"""
WITH d AS (SELECT doc_id, 'x \bibitem[a]{r' || doc_id || '} Body ' || (doc_id % 5) || ' \bibitem{s' || doc_id || '} Next ' || translate(text, '\{}', '') AS t FROM documents)
SELECT doc_id, i - 1 AS pos, keys[i] AS key, trim(bodies[i + 1]) AS body FROM (
  SELECT doc_id, regexp_extract_all(t, '\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}', 1) AS keys, string_split_regex(t, '\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}') AS bodies, unnest([1, 2]) AS i FROM d)""")
def bibitem_split(spark, sf_dir):
    """Items of a bibliography text; each body runs to the next item."""
    s = F.col("doc_id").cast("string")
    t = F.concat(F.lit("x \\bibitem[a]{r"), s, F.lit("} Body "), (F.col("doc_id") % 5).cast("string"), F.lit(" \\bibitem{s"), s, F.lit("} Next "), F.translate("text", "\\{}", ""))
    items = bibliography.split_items(read(spark, sf_dir, "documents").select(s.alias("path"), t.alias("content")))
    return items.select(F.col("path").cast("long").alias("doc_id"), "pos", "key", "body")


# ---- exchange --------------------------------------------------------------------------------------------------------

@query("""
WITH RECURSIVE o AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (
  SELECT source, doc_id, w, rn, w AS tot, 0 AS b FROM o WHERE rn = 1
  UNION ALL SELECT o.source, o.doc_id, o.w, o.rn, CASE WHEN r.tot + o.w > 1500 THEN o.w ELSE r.tot + o.w END, CASE WHEN r.tot + o.w > 1500 THEN r.b + 1 ELSE r.b END
  FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
SELECT source, doc_id, CAST(w AS BIGINT) AS tokens, b AS batch_no FROM r""")
def greedy_batches(spark, sf_dir):
    """Token-bounded batches in order."""
    df = read(spark, sf_dir, "documents").select("source", "doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))
    return exchange.greedy_batches(df, ["source"], ["doc_id"], "tokens", 1500)


@query("""
SELECT d.doc_id, coalesce(t.translation, '') AS translation FROM documents d
LEFT JOIN (SELECT doc_id, 'done ' || quality AS translation FROM labels) t USING (doc_id)""")
def resume_restore(spark, sf_dir):
    """All rows with what a checkpoint has for them."""
    done = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("done "), F.col("quality").cast("string")).alias("translation"))
    return exchange.restore(read(spark, sf_dir, "documents").select("doc_id"), done, ["doc_id"], "translation")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    """Rows that a checkpoint does not have."""
    return exchange.still_to_do(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])


@query(r"""
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN '\section' || CASE p_partkey % 3 WHEN 0 THEN '*' ELSE '' END || '{' || CASE p_name WHEN 'red widget' THEN '甲' WHEN 'small ring' THEN '乙' END
  || '}' || CASE p_partkey % 3 WHEN 0 THEN ' \label{s' || p_partkey || '}' ELSE '' END END AS cached FROM part""")
def cache_shortcircuit(spark, sf_dir):
    """Headings with a standing translation, command and label as they were; other texts have none."""
    rules = Rules(titles={"red widget": "甲", "small ring": "乙"})
    k, title = F.col("p_partkey") % 3, F.initcap("p_name")
    text = F.when(k == 0, F.concat(F.lit(" \\section*{ "), title, F.lit("} \\label{s"), F.col("p_partkey").cast("string"), F.lit("}\n"))).when(k == 1, F.concat(F.lit("\\section{"), title, F.lit("}"))).otherwise(title)
    return exchange.cached_titles(read(spark, sf_dir, "part"), text, rules).select("p_partkey", "cached")


@query("""
WITH t AS (SELECT n_regionkey AS chapter, string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name) AS terms FROM nation GROUP BY 1)
SELECT doc_id, coalesce(terms, '') AS terms FROM (SELECT doc_id, doc_id % 7 AS chapter FROM documents) LEFT JOIN t USING (chapter)""")
def glossary_join(spark, sf_dir):
    """The terms of a row's chapter."""
    terms = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("chapter"), F.col("n_name").alias("term"), F.col("n_nationkey").cast("string").alias("translation"))
    df = exchange.with_terms(read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).cast("int").alias("chapter")), terms)
    return df.select("doc_id", F.array_join(F.transform(F.map_entries("terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("terms"))


@query(r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '\ref{a' || doc_id || '}' WHEN 1 THEN '' ELSE '\cite{b c};\ref{a' || doc_id || '};\label{c}' END AS lost, doc_id % 3 <> 1 AS syntax_error FROM documents""")
def syntax_integrity(spark, sf_dir):
    """Markup that a transformation lost; the width of blanks does not count."""
    s = F.col("doc_id").cast("string")
    x = F.concat(F.lit("\\ref{a"), s, F.lit("} \\cite{b c} \\label{c} \\label{c} "), "text")
    y = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\\cite{b \n c} \\label{c} "), "text")).when(F.col("doc_id") % 3 == 1, x).otherwise(F.col("text"))
    df = exchange.integrity(read(spark, sf_dir, "documents").select("doc_id", x.alias("x"), y.alias("y")), "x", "y")
    return df.select("doc_id", F.array_join("syntax_error_tokens", ";").alias("lost"), "syntax_error")


@query(r"""
SELECT doc_id, regexp_replace('a \% b ' || doc_id || ' % cut' || chr(10) || '% all' || chr(10) || 'kept ' || text, '(^|[^\\])%[^' || chr(10) || ']*', '\1', 'g') AS body FROM documents""")
def comment_strip(spark, sf_dir):
    """Lines cut at the first percent sign without a backslash."""
    t = F.concat(F.lit("a \\% b "), F.col("doc_id").cast("string"), F.lit(" % cut\n% all\nkept "), "text")
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_comments(t).alias("body"))


# ---- orders and jobs -------------------------------------------------------------------------------------------------

_CATALOG = [("a", "small", 1.7, 1.08, 2.0, 8.0, 2.2, 2.0), ("a", "large", 1.7, 1.15, 4.0, 16.0, 2.0, 3.0), ("b", "small", 1.75, 1.08, 4.0, 21.0, 1.8, 3.0)]


@query(f"""
WITH c(provider, model, cpt, ratio, ip, op, markup, least) AS (VALUES {", ".join(f"('{r[0]}', '{r[1]}', {', '.join(f'{x}::DOUBLE' for x in r[2:])})" for r in _CATALOG)}),
q AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS provider, CASE doc_id % 3 WHEN 0 THEN 'large' ELSE 'small' END AS model, length(text) * 1000 AS chars FROM documents),
t AS (SELECT *, greatest(1, CAST(floor(chars / cpt + 0.9999) AS BIGINT)) AS i, greatest(1, CAST(floor(chars * ratio / cpt + 0.9999) AS BIGINT)) AS o FROM q JOIN c USING (provider, model))
SELECT doc_id, i AS estimated_input_tokens, o AS estimated_output_tokens, round(i / 1000000.0::DOUBLE * ip + o / 1000000.0::DOUBLE * op, 6) AS raw_cost,
  round(greatest(least, (i / 1000000.0::DOUBLE * ip + o / 1000000.0::DOUBLE * op) * markup), 2) AS amount FROM t""")
def quote_pricing(spark, sf_dir):
    """Tokens and price from a catalog."""
    catalog = spark.createDataFrame(_CATALOG, "provider string, model string, chars_per_token double, default_output_ratio double, input_price_per_mtok double, output_price_per_mtok double, markup_multiplier double, minimum_price double")
    r = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("provider"), F.when(F.col("doc_id") % 3 == 0, "large").otherwise("small").alias("model"), (F.length("text") * 1000).alias("estimated_chars")
    )
    return orders.quote(r, catalog).select("doc_id", "estimated_input_tokens", "estimated_output_tokens", "raw_cost", "amount")


@query("""
SELECT source, CAST(round(sum(CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN round(n_chars * 0.45::DOUBLE) ELSE 0 END) * 0.92::DOUBLE) AS BIGINT) AS estimated_chars FROM documents GROUP BY source""")
def estimate_chars(spark, sf_dir):
    """The size that a set of files is priced by."""
    ext = F.element_at(F.array(F.lit("tex"), F.lit("bib"), F.lit("png")), (F.col("doc_id") % 3 + 1).cast("int"))
    return orders.estimated_chars(read(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("size"), ext.alias("ext")), ["source"])


@query("""
SELECT o_orderkey, abs(o_totalprice - o_totalprice * (1 + (o_orderkey % 5 - 2) * 0.05)) <= greatest(800, floor(o_totalprice * 0.08::DOUBLE)) AS ok FROM orders""")
def paid_guard(spark, sf_dir):
    """Whether an estimate is near enough to what was paid for."""
    new = F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5 - 2) * F.lit(0.05))
    return read(spark, sf_dir, "orders").select("o_orderkey", orders.still_paid(F.col("o_totalprice"), new).alias("ok"))


@query("SELECT o_orderkey AS job_id, c_custkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey")
def job_owner_join(spark, sf_dir):
    """The owner of each job."""
    j = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("order_id"))
    return orders.owners(j, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id")))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_jobs_top50(spark, sf_dir):
    """The 50 latest."""
    return orders.recent(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query("""
SELECT id, version, state FROM (
  SELECT o_orderkey AS id, 0 AS version, o_orderstatus AS state FROM orders
  UNION ALL SELECT o_orderkey, 1, 'X' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 10000000, 1, 'N' FROM orders WHERE o_orderkey % 1000 = 0)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def order_upsert(spark, sf_dir):
    """A table after changes."""
    o = read(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("version"), F.col("o_orderstatus").alias("state"))
    changed = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.lit("X").alias("state"))
    new = o.where("o_orderkey % 1000 = 0").select((F.col("o_orderkey") + 10000000).alias("id"), F.lit(1).alias("version"), F.lit("N").alias("state"))
    return orders.upsert(base, changed.unionByName(new), ["id"], "version")


@query("""
SELECT user_id, arg_max(event_type, event_id) AS state, arg_max(value, event_id) AS percent, max(event_id) AS "offset", count(*) AS n_events FROM events GROUP BY user_id""")
def job_status_latest(spark, sf_dir):
    """The latest event of each job."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("offset"), F.col("event_type").alias("state"), F.col("value").alias("percent"))
    return jobs.status(e, "user_id", "offset", ("state", "percent"))


@query("SELECT event_id, event_type FROM events WHERE event_id >= 1500")
def event_tail(spark, sf_dir):
    """A log from an offset on."""
    return jobs.tail(read(spark, sf_dir, "events").select("event_id", "event_type"), 1500, "event_id")


@query("""
SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status FROM events""")
def order_status_map(spark, sf_dir):
    """The status of an order by its job's state."""
    state = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("user_id", "event_id", orders.order_status(state).alias("status"))


@query("""
WITH b AS (SELECT source, doc_id % 8 AS batch, count(*) AS size FROM documents GROUP BY ALL)
SELECT source, batch, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (PARTITION BY source ORDER BY batch) AS BIGINT) AS done, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS total FROM b""")
def progress_running(spark, sf_dir):
    """Rows done and in all after each batch."""
    b = read(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 8).alias("batch")).agg(F.count(F.lit(1)).alias("size"))
    return jobs.progress(b, ["source"], ["batch"], "size")


# ---- summaries, guards, tables ---------------------------------------------------------------------------------------

@query("""
SELECT lang, count(DISTINCT doc_id // 10) AS documents, count(*) AS paragraphs, CAST(sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM documents GROUP BY lang""")
def summary_counts(spark, sf_dir):
    """Documents, paragraphs, and paragraphs that lost markup."""
    df = read(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 10).alias("doc_idx"), (F.col("n_chars") > 2000).alias("syntax_error"))
    return documents.paragraph_totals(df, ("lang",))


@query("""
WITH e AS (SELECT CAST(page_id % 40 AS VARCHAR) AS archive, 'root' || (page_id % 2 * (page_id % 40 % 3)) || '/f' || page_id || CASE page_id % 9 WHEN 0 THEN '.tex' ELSE '.png' END AS name, length(html) AS size FROM pages)
SELECT archive, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, bool_or(name LIKE '%.tex') AS has_tex,
  CASE WHEN count(DISTINCT split_part(name, '/', 1)) = 1 THEN min(split_part(name, '/', 1)) END AS common_root,
  CASE WHEN count(*) > 60 THEN 'too many entries' WHEN sum(size) > 40000 THEN 'too large' WHEN NOT bool_or(name LIKE '%.tex') THEN 'no tex file' END AS issue
FROM e GROUP BY archive""")
def archive_guards(spark, sf_dir):
    """Counts, common root and guards of archives."""
    i = F.col("page_id")
    name = F.concat(F.lit("root"), (i % 2 * (i % 40 % 3)).cast("string"), F.lit("/f"), i.cast("string"), F.when(i % 9 == 0, ".tex").otherwise(".png"))
    e = read(spark, sf_dir, "pages").select((i % 40).cast("string").alias("archive"), name.alias("name"), F.length("html").cast("long").alias("size"), F.lit(False).alias("is_dir"))
    return orders.archive_report(e, 60, 40000).select("archive", "n", "bytes", "has_tex", "common_root", "issue")


@query("""
WITH m AS (SELECT p_brand, p_size % 4 AS col, greatest(1, max(length(p_name))) AS longest FROM part GROUP BY ALL),
w AS (SELECT *, greatest(longest / sum(longest) OVER b * 16.0::DOUBLE, 16.0::DOUBLE / (10 * count(*) OVER b)) AS w FROM m WINDOW b AS (PARTITION BY p_brand)),
o AS (SELECT *, greatest(0.0::DOUBLE, sum(w) OVER b - 16) AS over_, row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, col) AS rn FROM w WINDOW b AS (PARTITION BY p_brand))
SELECT p_brand, col, CAST(longest AS INTEGER) AS longest, round(w - CASE WHEN rn = 1 THEN over_ ELSE 0 END, 6) AS width FROM o""")
def column_width(spark, sf_dir):
    """Column widths in proportion to the longest text."""
    c = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 4).alias("col"), "p_name")
    return orders.column_widths(c, ["p_brand"], "col", "p_name", 16.0)


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'heading1' WHEN 1 THEN 'equation' WHEN 2 THEN 'figure' WHEN 3 THEN 'list' ELSE 'paragraph' END AS kind FROM part""")
def render_classes(spark, sf_dir):
    """How a paragraph is rendered."""
    k = F.col("p_size") % 5
    text = F.when(k == 0, "\\section{A}").when(k == 3, "\\begin{itemize} x").otherwise(F.col("p_name"))
    label = F.when(k == 1, "式1-2").when(k == 2, "图1-1").otherwise("1.1节")
    return read(spark, sf_dir, "part").select("p_partkey", render.render_class(text, label).alias("kind"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'section' WHEN 1 THEN 'subsection' WHEN 2 THEN 'figure' WHEN 3 THEN 'math' WHEN 4 THEN 'abstract' WHEN 5 THEN 'code' ELSE 'text' END AS category FROM part""")
def paragraph_categories(spark, sf_dir):
    """The category of a paragraph."""
    k = F.col("p_partkey") % 7
    t = (
        F.when(k == 0, "x \\Section*{A}").when(k == 1, "\\paragraph{b} c").when(k == 2, " \\begin{figure*}[t] a").when(k == 3, "\\begin{table} \\begin{align} x \\end{align} \\end{table}")
        .when(k == 4, "\\section{ Abstract }").when(k == 5, "\\begin{lstlisting}").otherwise(F.col("p_name"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", structure.categorize(t).alias("category"))


@query("""
SELECT c_custkey, substr(regexp_replace(c_name || ' /é?' || c_mktsegment, '[^\\p{L}\\p{Nd}._-]', '_', 'g'), 1, 120) AS safe, right(c_name, 5) AS tail,
  CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '…' ELSE c_name END AS preview,
  CASE c_nationkey WHEN 1 THEN '一' WHEN 2 THEN '二' WHEN 10 THEN '十' ELSE CASE WHEN c_nationkey BETWEEN 3 AND 9 THEN substr('三四五六七八九', c_nationkey - 2, 1) ELSE CAST(c_nationkey AS VARCHAR) END END AS numeral
FROM customer""")
def text_scalars(spark, sf_dir):
    """Names, tails, previews, numerals."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", T.safe_name(F.concat("c_name", F.lit(" /é?"), "c_mktsegment")).alias("safe"), jobs.log_tail(F.col("c_name"), 5).alias("tail"), T.preview(F.col("c_name"), 10).alias("preview"), T.chinese_number(F.col("c_nationkey")).alias("numeral")
    )


@query()
def chapter_assignment(spark, sf_dir):
    """Wanted chapters first, then the smallest free numbers in order of upload."""
    n = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 10 + 1).cast("int").alias("wanted"))
    return orders.assign_chapters(n, "n_regionkey", "n_nationkey", "wanted")


# ---- the rest of the inventory ---------------------------------------------------------------------------------------

@query("""
WITH e AS (SELECT user_id, event_id, event_type, CAST(event_id % 10 AS VARCHAR) AS t FROM events),
n AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM n)
SELECT user_id, run, any_value(event_type) AS event_type, string_agg(t, '' ORDER BY event_id) AS t FROM r GROUP BY user_id, run""")
def style_runs(spark, sf_dir):
    """Neighbouring rows of one style as one."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 10).cast("string").alias("t"))
    return structure.merge_runs(e, ["user_id"], "event_id", "event_type", "t")


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '.' || (n - 1) END AS p_name FROM (
  SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)""")
def collision_suffix(spark, sf_dir):
    """Names made unique in their folder."""
    return structure.suffix_repeats(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "p_name")


@query("""SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id, turn) + 99 AS new_id FROM conversations""")
def footnote_renumber(spark, sf_dir):
    """Ids of each document as ids over all, from the greatest so far on."""
    return structure.renumber(read(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 100)


@query("""
WITH f AS (SELECT doc_id % 50 AS folder, doc_id AS name, CASE doc_id % 3 WHEN 0 THEN 'bib' WHEN 1 THEN 'bbl' ELSE 'tex' END AS ext FROM documents WHERE doc_id % 50 <> 7 OR doc_id % 3 <> 0),
k AS (SELECT folder, CASE WHEN bool_or(ext = 'bib') THEN 'bib' ELSE 'bbl' END AS ext FROM f WHERE ext <> 'tex' GROUP BY folder)
SELECT folder, ext, name FROM f JOIN k USING (folder, ext)""")
def reference_file_kind(spark, sf_dir):
    """The one kind of bibliography file of each folder."""
    from ..sources import files

    i = F.col("doc_id")
    f = read(spark, sf_dir, "documents").select(
        (i % 50).alias("folder"), i.alias("name"), F.when(i % 3 == 0, "bib").when(i % 3 == 1, "bbl").otherwise("tex").alias("ext"), F.lit(1).alias("depth")
    ).where("folder <> 7 OR ext <> 'bib'")
    return files.reference_files(f).select("folder", "ext", "name")


@query("""
SELECT p_partkey, '图' || p_size || '说明(a).' || 'b x' AS spaced, 'A ' || p_name AS title, 'cap ' || p_brand AS caption, 'x_' || p_size || '\\end{align}' AS math, p_name || '  z' AS fragment FROM part""")
def fragment_scalars(spark, sf_dir):
    """Spaces, titles, captions and fragments at render time."""
    p = parts(spark, sf_dir)
    size = F.col("p_size").cast("string")
    return p.select(
        "p_partkey",
        fragments.clean_spaces(F.concat(F.lit("图 "), size, F.lit(" 说明(a). b   x"))).alias("spaced"),
        fragments.clean_title(F.concat(F.lit("\\textbf{A}\\\\\\emph{"), F.col("p_name"), F.lit("}\\thanks % no"))).alias("title"),
        fragments.caption(F.concat(F.lit("x \\caption{ cap "), F.col("p_brand"), F.lit("} y"))).alias("caption"),
        fragments.strip_trailing_punctuation(F.concat(F.lit("x_"), size, F.lit(", \\end{align}"))).alias("math"),
        fragments.sanitize(F.concat(F.lit("\\begin{em}\\caption{"), F.col("p_name"), F.lit("}\\end{em} \\toprule \\bf z"))).alias("fragment"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'h1=' || greatest(6, least(72, c_custkey % 100)) END AS sizes,
  CASE WHEN c_nationkey % 2 = 0 THEN 'code_bg=AB12' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') ELSE '' END AS colors FROM customer""")
def settings_clamp(spark, sf_dir):
    """Settings of a request, whitelisted and clamped."""
    c = read(spark, sf_dir, "customer")
    size = F.when(F.col("c_custkey") % 4 == 0, "x").otherwise((F.col("c_custkey") % 100).cast("string"))
    color = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(" #ab12"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))).otherwise("red")
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return c.select(
        "c_custkey", show(fragments.rendering_settings("sizes", F.create_map(F.lit("h1"), size, F.lit("h9"), F.lit("8")))).alias("sizes"),
        show(fragments.rendering_settings("colors", F.create_map(F.lit("code_bg"), color))).alias("colors"),
    )


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 25 + 58 * (event_id % 7)::DOUBLE / 7 ELSE greatest(0, least(100, value)) END AS percent FROM events""")
def progress_percent(spark, sf_dir):
    """Percentage of a job, clamped."""
    e = read(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "click", "translate").otherwise("other")
    current = F.when(F.col("event_type") == "click", (F.col("event_id") % 7).cast("double")).otherwise(F.col("value"))
    return e.select("event_id", T.fraction_done(stage, current, F.lit(7)).alias("percent"))


@query("""
SELECT u.c_custkey AS user_id, o.o_orderkey AS session, strftime(o.o_orderdate + INTERVAL 14 DAY, '%Y-%m-%dT%H:%M:%S.%fZ') AS expires_at
FROM orders o JOIN customer u ON u.c_custkey = o.o_custkey WHERE o.o_orderdate + INTERVAL 14 DAY > TIMESTAMP '1998-01-01'""")
def live_sessions(spark, sf_dir):
    """Sessions that have not expired, with their users."""
    s = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("user_id"), fragments.iso_utc(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 14 DAYS")).alias("expires_at")
    )
    u = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return orders.live_sessions(s, u, F.lit("1998-01-01").cast("timestamp")).select("user_id", "session", "expires_at")


@query("""
WITH l AS (SELECT conv_id, turn, '{"state":"' || role || '","percent":' || turn || CASE WHEN turn % 3 = 2 THEN '' ELSE '}' END AS line FROM conversations)
SELECT conv_id, turn, json_extract_string(line, '$.state') AS state, CAST(json_extract_string(line, '$.percent') AS DOUBLE) AS percent FROM l WHERE json_valid(line)""")
def event_parse(spark, sf_dir):
    """Lines of an event log; broken ones go, places stay."""
    c = read(spark, sf_dir, "conversations")
    line = F.concat(F.lit('{"state":"'), "role", F.lit('","percent":'), F.col("turn").cast("string"), F.when(F.col("turn") % 3 == 2, "").otherwise("}"))
    from ..sources import events

    return events.parsed(c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("offset"), line.alias("line"))).select(F.col("job_id").alias("conv_id"), F.col("offset").alias("turn"), "state", "percent")


@query("""
WITH t AS (SELECT n_regionkey AS chapter, n_name AS term, CAST(n_nationkey AS VARCHAR) AS translation FROM nation) SELECT chapter, term, translation FROM t""")
def glossary_parse(spark, sf_dir):
    """Glossary JSON to rows."""
    n = read(spark, sf_dir, "nation")
    one = F.to_json(F.map_from_arrays(F.array(F.col("n_regionkey").cast("string")), F.array(F.map_from_arrays(F.array("n_name"), F.array(F.col("n_nationkey").cast("string"))))))
    return exchange.glossary(n.select(one.alias("value")))


@query("""
WITH RECURSIVE e AS (SELECT CAST(p_partkey AS INTEGER) AS src, CAST(p_partkey * 3 + k AS INTEGER) AS dst FROM part, (VALUES (1), (2), (3)) v(k)),
w AS (SELECT 0 AS name, 0 AS depth UNION ALL SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.name)
SELECT CAST(name AS VARCHAR) AS name, depth FROM w""")
def include_walk(spark, sf_dir):
    """Files reached from the main file, by depth, over the edges of all parts."""
    from ..operators import includes

    p = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos"))
    edges = p.select(F.lit("f").alias("folder"), F.col("p_partkey").cast("string").alias("src"), "pos", (F.col("p_partkey") * 3 + F.col("pos")).cast("string").alias("dst"))
    root = spark.range(1).select(F.lit("f").alias("folder"), F.col("id").cast("string").alias("name"))
    return includes.expand_order(root, edges).select("name", F.size("path").alias("depth"))


@query("""
WITH m AS (SELECT MAP {'>create': 'pending_payment', 'pending_payment>pay': 'paid', 'pending_payment>cancel': 'cancelled', 'pending_payment>expire': 'expired', 'paid>enqueue': 'queued', 'paid>refund': 'refunded',
  'queued>start': 'running', 'queued>cancel': 'cancelled', 'running>finish': 'completed', 'running>fail': 'failed', 'running>cancel': 'cancelled', 'running>requeue': 'queued', 'failed>enqueue': 'queued', 'failed>refund': 'refunded'} AS next),
e AS (SELECT user_id, event_id, ts, ['create', 'pay', 'enqueue', 'start', 'fail', 'finish', 'requeue', 'cancel', 'none'][1 + CASE WHEN event_id % 11 = 0 THEN event_id % 9 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 6 END] AS op FROM events),
l AS (SELECT user_id, list_prepend({'s': '', 'n': 0::BIGINT, 'op': ''}, list({'s': '', 'n': 0::BIGINT, 'op': op} ORDER BY ts, event_id)) AS ops FROM e GROUP BY user_id),
f AS (SELECT user_id, list_reduce(ops, lambda a, x: {'s': coalesce(next[a.s || '>' || x.op], a.s), 'n': a.n + (next[a.s || '>' || x.op] IS NULL)::BIGINT, 'op': ''}) AS r FROM l, m)
SELECT user_id, r.s AS state, r.n AS refused FROM f""")
def job_lifecycle(spark, sf_dir):
    """The state of each order after its events and how many were refused, folded by day and then by order."""
    e = read(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    ops = F.array(*map(F.lit, ("create", "pay", "enqueue", "start", "fail", "finish", "requeue", "cancel", "none")))
    op = F.get(ops, F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 9).otherwise(place % 6).cast("int"))
    rows = e.select("user_id", "ts", "event_id", op.alias("event"))
    return lifecycle.states(rows, ["user_id"], ["ts", "event_id"], lifecycle.ORDER, F.to_date("ts"))


@query("""
SELECT user_id % 16 AS job, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT event_id) AS once FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def log_lines(spark, sf_dir):
    """Logs of all events, followed as a stream by bytes: every line that is whole, once."""
    path = f"{folder(spark)}/logs-{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events").withColumn("job", F.col("user_id") % 16)
    line = F.concat(F.lit('{"state":"'), "event_type", F.lit('","current":'), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "").otherwise("}"))
    e.select("job", line.alias("value")).repartition("job").write.partitionBy("job").text(path)
    out = f"{path}-read"
    spark.dataSource.register(events_source.LogSource)
    lines = spark.readStream.format("lines").option("pattern", "*.txt").load(path)
    rows = events_source.parsed(lines.select(F.regexp_extract("path", r"job=(\d+)", 1).alias("job_id"), "offset", "line"))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    seen = spark.read.schema(rows.schema).parquet(out)
    return seen.groupBy(F.col("job_id").cast("long").alias("job")).agg(F.count(F.lit(1)).alias("n"), F.sum("current").alias("ids"), F.countDistinct("current").alias("once"))


@query(r"""
SELECT doc_id, '\rm a $\mathrm{b} \bfseries \mathcal c\$ \itx$ \$\rm d ' || translate(text, '\$', '') || ' $\mathbf{' || doc_id || '}' || '$' AS body FROM documents""")
def math_font_upgrade(spark, sf_dir):
    """font switches of inline formulas as commands, in whole texts; others and those outside of formulas stay."""
    t = F.concat(F.lit("\\rm a $\\rm{b} \\bfseries \\cal c\\$ \\itx$ \\$\\rm d "), F.translate("text", "\\$", ""), F.lit(" $\\bf{"), F.col("doc_id").cast("string"), F.lit("}$"))
    return read(spark, sf_dir, "documents").select("doc_id", fragments.math_fonts(t).alias("body"))


@query("""
WITH k AS (SELECT o_orderkey, (o_orderkey * 7919 * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 100003 ELSE 0 END) + o_orderkey % 37)::BIGINT AS n FROM orders),
d AS (SELECT o_orderkey, n, lpad(n::VARCHAR, 16, '0') AS p FROM k),
s AS (SELECT o_orderkey, n, i, substr(p, 4 * i + 1, 4) AS q FROM d, range(4) r(i)),
t AS (SELECT o_orderkey, n, i, CASE WHEN q = '0000' THEN '零' ELSE regexp_replace(
    CASE WHEN q[1] = '0' THEN '零' ELSE translate(q[1], '123456789', '一二三四五六七八九') || '千' END || CASE WHEN q[2] = '0' THEN '零' ELSE translate(q[2], '123456789', '一二三四五六七八九') || '百' END
    || CASE WHEN q[3] = '0' THEN '零' ELSE translate(q[3], '123456789', '一二三四五六七八九') || '十' END || CASE WHEN q[4] = '0' THEN '零' ELSE translate(q[4], '123456789', '一二三四五六七八九') END, '零+$', '') || ['万亿', '亿', '万', ''][i + 1] END AS w FROM s)
SELECT o_orderkey, CASE n WHEN 0 THEN '零' ELSE regexp_replace(regexp_replace(regexp_replace(string_agg(w, '' ORDER BY i), '零+', '零', 'g'), '^零|零$', '', 'g'), '^一十', '十') END AS numeral FROM t GROUP BY o_orderkey, n""")
def chinese_numerals(spark, sf_dir):
    """numbers of any size in Chinese."""
    k = F.col("o_orderkey")
    by = F.when(k % 4 == 0, 1).when(k % 4 == 1, 100).when(k % 4 == 2, 100003).otherwise(0)
    return read(spark, sf_dir, "orders").select("o_orderkey", T.chinese_numeral(k * 7919 * by + k % 37).alias("numeral"))


@query("SELECT o_orderkey AS job_id, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def own_jobs(spark, sf_dir):
    """The jobs of some users, however often their owners are named."""
    o = read(spark, sf_dir, "orders")
    owner = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"))
    users = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return orders.own_jobs(o.select(F.col("o_orderkey").alias("job_id"), "o_totalprice"), owner.unionByName(owner), users.unionByName(users))


@query("""
WITH c AS (SELECT DISTINCT lower(p_type) AS provider, p_brand AS model FROM part),
r AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'none' ELSE lower(p_type) END AS provider, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN p_brand || 'x' ELSE p_brand END AS model FROM part)
SELECT p_partkey, r.provider, r.model, CASE WHEN r.provider NOT IN (SELECT provider FROM c) THEN 'unknown provider' WHEN r.model = '' THEN 'no model' WHEN c.model IS NULL THEN 'unknown model' END AS issue
FROM r LEFT JOIN c ON c.provider = r.provider AND c.model = r.model""")
def request_issues(spark, sf_dir):
    """What is wrong with the provider and the model that a request names."""
    p, k = read(spark, sf_dir, "part"), F.col("p_size")
    provider = F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit(" "), F.upper("p_type")))
    model = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat("p_brand", F.lit("x "))).otherwise(F.col("p_brand"))
    catalog = p.select(F.lower("p_type").alias("provider"), F.col("p_brand").alias("model"))
    return orders.request_issues(p.select("p_partkey", provider.alias("provider"), model.alias("model")), catalog)


@query("""
SELECT l_orderkey, 'k' || (l_linenumber % 3) AS key, arg_max(l_partkey || '=' || l_linestatus, (l_linenumber, l_partkey, l_linestatus)) AS value FROM lineitem WHERE l_linenumber % 4 <> 3 GROUP BY ALL""")
def env_settings(spark, sf_dir):
    """The settings of environment files of all orders, the last of a key; comments and broken lines go."""
    n = F.col("l_linenumber")
    said = F.concat(F.lit("k"), (n % 3).cast("string"), F.lit(' = "'), F.col("l_partkey").cast("string"), F.lit("="), F.col("l_linestatus"), F.lit('" '))
    line = F.when(n % 4 == 3, F.concat(F.lit(" # "), said)).when(n % 4 == 2, F.concat(F.lit("export "), said)).otherwise(said)
    place = lambda more: F.struct((n + more).alias("n"), "l_partkey", "l_linestatus").alias("pos")
    rows = read(spark, sf_dir, "lineitem")
    lines = rows.select("l_orderkey", place(0), line.alias("line"))
    broken = rows.select("l_orderkey", place(100), F.lit("no sign").alias("line"))
    return files.settings(lines.unionByName(broken), ["l_orderkey"])
