"""From labelled paragraphs to a render plan - text, table grids, footnotes, figures - and from a plan to .docx files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import fragments, latex
from ..functions import text as T
from ..sources import docx
from ..sources.docx import WIDE
from ..sources.files import image_of
from ..sources.shared import materialize
from .structure import categorize, formula_float

#: Inches that the panels of a figure share.
PANELS = 5.4

# What a label's beginning says of a paragraph, in two groups, between which a formula in a float is told;
# environments that are drawn as statements and as lists.
BY_LABEL = ({"摘要": "abstract", "式": "equation"}, {"图": "figure", "表": "table", "代码": "code", "算法": "code"})
STATEMENTS = ("definition", "lemma", "theorem", "corollary", "proposition", "remark", "claim", "example", "fact")
LISTS = ("itemize", "enumerate", "description")


def render_class(text: Column, env_label: Column) -> Column:
    """How a paragraph is rendered: by its label, then by the command or the environment that it begins with."""
    s = F.regexp_replace(text, r"^\s+", "")
    command = F.lower(F.regexp_extract(s, r"^(?:\\label\{[^}]*\}\s*)*\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*\{", 1))
    env = F.regexp_replace(F.lower(F.regexp_extract(s, r"(?i)^\\begin\{([^}]*)\}", 1)), r"\*$", "")
    label = F.coalesce(env_label, F.lit(""))
    kind = F.when(F.lit(False), "")
    for group in BY_LABEL:
        for prefix, name in group.items():
            kind = kind.when((label == prefix) if name == "abstract" else label.startswith(prefix), name)
        kind = kind.when(formula_float(s), "equation") if group is BY_LABEL[0] else kind
    category = categorize(text)
    return (
        kind.when(env == "abstract", "abstract")
        .when(command.isin("part", "chapter", "section"), "heading1").when(command == "subsection", "heading2").when(command == "subsubsection", "heading3")
        .when(category == "math", "equation").when(category.isin("figure", "table", "code"), category).when(category == "algorithm", "code")
        .when(env.isin(*STATEMENTS), "mathenv").when(F.lower(text).contains("\\begin{proof}"), "proof")
        .when(command.isin("paragraph", "subparagraph"), "inline_heading").when(env.isin(*LISTS), "list")
        .otherwise("paragraph")
    )


def render_plan(paragraphs: DataFrame, drawn: bool = False) -> DataFrame:
    """(doc_idx, id, kind, level, prefix, body): what to draw, in order; rows that lost markup are left out.

    With `drawn` there are also `source`, the whole text of a paragraph, `grid`, the cells of tables, and `notes`, the
    footnotes, which leave marks in the body.
    """
    body = F.coalesce(F.nullif(F.col("translation"), F.lit("")), F.col("text")) if "translation" in paragraphs.columns else F.col("text")
    df = paragraphs
    if "syntax_error" in df.columns:
        df = df.where(~F.coalesce("syntax_error", F.lit(False)))
    df = df.withColumn("kind", render_class(F.col("text"), F.col("env_label")))
    heading = F.col("kind").startswith("heading")
    inner = F.regexp_extract(body, r"(?s)\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*\{((?:[^{}]++|\{[^{}]*\})*+)\}", 1)
    caption = F.regexp_extract(body, r"(?s)\\caption\*?(?:\[[^\]]*\])?\{((?:[^{}]++|\{[^{}]*\})*+)\}", 1)
    shown = F.when(heading | (F.col("kind") == "inline_heading"), inner).when(F.col("kind").isin("figure", "table"), caption).otherwise(body)
    level = F.when(heading, F.substring("kind", 8, 1).cast("int")).otherwise(0)
    prefix = F.when(heading, F.regexp_extract("env_label", r"^[\d.]+", 0)).when(F.col("kind").isin("figure", "table", "equation", "code"), F.col("env_label")).otherwise("")
    plan = df.select("doc_idx", "id", "kind", level.alias("level"), prefix.alias("prefix"), F.trim(T.clean_cross_references(shown)).alias("body"), *([body.alias("source")] if drawn else []))
    return _drawn(plan, F.when(F.col("kind") == "table", F.col("source"))) if drawn else plan


def _drawn(plan: DataFrame, tables: Column) -> DataFrame:
    """plan with the grids of its tables' texts, and with footnotes apart from the body."""
    schema = StructType([*plan.schema.fields, *StructType.fromDDL(f"grid {latex.GRID}, notes array<string>").fields])
    arrow, at = to_arrow_schema(schema), plan.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns[:-1]
            found = [latex.footnotes(x) for x in columns[at].to_pylist()]
            columns[at] = pa.array([body for body, _ in found], pa.string())
            columns += [pa.array([latex.grid(t) for t in b.columns[-1].to_pylist()], arrow.field("grid").type), pa.array([notes for _, notes in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return plan.withColumn("_table", tables).mapInArrow(run, schema)


def with_notes(plan: DataFrame, output: list[str], order: list[str], start: int = 1) -> DataFrame:
    """plan with its footnotes out of the body, which keeps their marks, and their ids: each output numbers all of its own
    footnotes from `start`, whatever documents they come from."""
    found = plan if "notes" in plan.columns else _drawn(plan, F.lit(None).cast("string")).drop("grid")
    before = F.coalesce(F.sum(F.size("notes")).over(Window.partitionBy(*output).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    note = lambda x, k: F.struct((k + 1).cast("int").alias("n"), (F.col("_b") + k + start).cast("int").alias("id"), x.alias("body"))
    return found.withColumn("_b", before).withColumn("notes", F.transform("notes", note)).drop("_b")


def with_panels(plan: DataFrame, images: DataFrame) -> DataFrame:
    """plan with the panels of its figures: of minipages and subfigures one each, side by side; else one for each image.

    images(folder, path, content): the files of each document. A panel shows the first of its images that is there; only
    names and paths are joined and compared, and contents come last, by path.
    """
    ids, plan = ["doc_idx", "id"], materialize(plan)  # read three times below
    panels = fragments.panels(F.col("source"))
    lone = F.transform(F.regexp_extract_all("source", F.lit(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}"), F.lit(1)), lambda x: F.struct(F.array(x).alias("images"), F.lit("").alias("caption")))
    own = plan.where(F.col("kind") == "figure").select(*ids, panels.alias("some"), lone.alias("lone")).select(
        *ids, F.when(F.size("some") > 0, PANELS / F.size("some")).otherwise(WIDE).alias("width"), F.posexplode(F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("lone"))).alias("panel", "p")
    )
    wanted = own.select(*ids, "panel", F.posexplode("p.images").alias("k", "rel"))
    paths = image_of(wanted.select(F.col("doc_idx").cast("string").alias("doc"), "rel").distinct(), images.select("folder", "path"))
    best = wanted.withColumn("doc", F.col("doc_idx").cast("string")).join(paths.where("path IS NOT NULL"), ["doc", "rel"]).groupBy(*ids, "panel").agg(F.min_by("path", "k").alias("path"))
    shown = own.join(best, [*ids, "panel"], "left").join(images.select("path", F.col("content").alias("image")), "path", "left")
    one = F.struct("panel", F.coalesce(F.get("p.images", 0), F.lit("")).alias("name"), "image", F.col("p.caption").alias("caption"), "width")
    whole = shown.groupBy(*ids).agg(F.array_sort(F.collect_list(one), lambda a, b: a["panel"] - b["panel"]).alias("_p"))
    panel = lambda x: F.struct(*(x[c].alias(c) for c in ("name", "image", "caption", "width")))
    aside = F.coalesce(F.exists("panels", lambda x: x["width"] < WIDE), F.lit(False))  # their captions are those of the panels
    return plan.join(whole, ids, "left").withColumn("panels", F.transform("_p", panel)).withColumn("body", F.when(aside, "").otherwise(F.col("body"))).drop("_p")


def reference_blocks(references: DataFrame, document: Column, after: int) -> DataFrame:
    """The reference list of a document as blocks behind its paragraphs."""
    return references.select(document.alias("document"), (F.col("id") + after).cast("int").alias("pos"), F.lit("reference").alias("kind"), F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "citation").alias("body"))


def write_documents(blocks: DataFrame, folder: str, mode: str = "append") -> None:
    """One .docx for each document of blocks(document, pos, ...; see sources.docx), written in tasks; missing columns are empty."""
    blocks.sparkSession.dataSource.register(docx.DocxSource)
    given = set(blocks.columns)
    fields = StructType.fromDDL(docx.SCHEMA)
    full = blocks.select(*((F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    full = full.withColumn("level", F.coalesce("level", F.lit(0)))
    full.repartition("document").sortWithinPartitions("document", "pos").write.format("docx").mode(mode).save(folder)
