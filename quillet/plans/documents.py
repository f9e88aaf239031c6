"""The three stages of the document engine as functions of DataFrames: preprocess, exchange, postprocess."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex
from ..functions import text as T
from ..functions.rules import Rules
from ..operators import bibliography, exchange, includes, references, render, structure
from ..sources.shared import materialize


@dataclass(frozen=True)
class Options:
    """Parameters of a run; from_layers puts later layers over earlier ones and refuses unknown names."""

    keep_commands: bool = True
    split_on_linebreak: bool = False
    strip_formatting: bool = True
    expand_macros: bool = True
    dedup: bool = True
    sort: str = "file"
    start: int = 1
    placeholder: str = "[未找到]"
    strict: bool = False
    concurrency: int = 8

    @classmethod
    def from_layers(cls, *layers: dict) -> Options:
        merged = {k: v for layer in layers for k, v in (layer or {}).items() if v is not None}
        unknown = merged.keys() - cls.__dataclass_fields__.keys()
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**merged)

    @classmethod
    def from_files(cls, spark: SparkSession, *paths: str, over: dict | None = None) -> Options:
        """Files of JSON objects, a later one over those before it, and `over` over all; a file that is missing or no object raises."""
        layers = []
        for path in paths:
            layer = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
            if not isinstance(layer, dict):
                raise ValueError(f"{path} is not a JSON object")
            layers.append(layer)
        return cls.from_layers(*layers, over or {})


def preprocess(files: DataFrame, rules: Rules = Rules(), options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files(folder, name, text) of LaTeX sources, one folder for each document, to paragraphs, titles and issues.

    Inputs are never changed. A document without a body is an issue, not a failure; with strict it raises.
    """
    edges = includes.include_edges(files)
    score = F.struct(
        (~(F.col("text").rlike(r"\\title\b") & F.col("text").rlike(r"\\author\b"))).cast("int").alias("a"),
        (~F.col("text").rlike(r"\\begin\{document\}")).cast("int").alias("b"), (-F.length("text")).alias("c"), F.col("name").alias("d"),
    )
    roots = files.where(~F.col("name").contains("/")).groupBy("folder").agg(F.min_by("name", score).alias("name"))
    order = materialize(includes.expand_order(roots, edges))
    whole = includes.inlined(files, edges, order)

    def clean(t: str | None) -> tuple[str | None, int]:
        t, left = latex.expansion(t) if options.expand_macros else (t, 0)
        return (latex.strip_formatting(t) if options.strip_formatting else t), left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            done = [clean(t) for t in texts]
            columns = [pa.array([latex.title(t) for t in texts], pa.string()), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_idx", "chapter", "title", "tex", "left"])

    # inlined and expanded once: everything below reads it more than once
    docs = whole.select("folder", F.expr("try_cast(folder AS int) AS chapter"), "text").mapInArrow(run, "doc_idx string, chapter int, title string, tex string, left int")
    docs = materialize(docs)
    paragraphs = structure.chunk(docs.drop("left"), rules, options.keep_commands, options.split_on_linebreak).join(docs.select("doc_idx", "chapter"), "doc_idx")
    issue = lambda level, stage, what: F.struct(F.lit(level).alias("level"), F.lit(stage).alias("stage"), what.alias("message"))
    no_body = docs.where(~F.coalesce(F.col("tex").rlike(r"(?s)\\begin\{document\}.*\\end\{document\}"), F.lit(False)))
    if options.strict:
        paragraphs = paragraphs.unionByName(no_body.select("doc_idx", F.raise_error(F.concat(F.lit("no document body in "), "doc_idx")).cast("int").alias("id"), "tex", "chapter").withColumnRenamed("tex", "text"))
    issues = (
        no_body.select(issue("ERROR", "chunk", F.concat(F.lit("no document body in "), "doc_idx")).alias("i"))
        .unionByName(docs.where("left > 0").select(issue("WARNING", "macros", F.concat("left", F.lit(" uses of macros without end stay in "), "doc_idx")).alias("i")))
        .unionByName(order.where("cycle").select(issue("ERROR", "include", F.concat(F.lit("cycle at "), "folder", F.lit("/"), "name")).alias("i")))
        .unionByName(edges.where("dst IS NULL").select(issue("WARNING", "include", F.concat_ws(" ", F.lit("missing"), F.concat("folder", F.lit("/"), "src"), "wanted")).alias("i")))
        .select("i.*")
    )
    return paragraphs, docs.select("doc_idx", "chapter", "title"), issues


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARNING").alias("warnings"))


def demoted(issues: DataFrame, stage: str, reason: str) -> DataFrame:
    """issues with the errors of a stage as warnings, the reason behind their messages."""
    hit = (F.col("level") == "ERROR") & (F.col("stage") == stage)
    return issues.withColumn("message", F.when(hit, F.concat("message", F.lit(f" ({reason})"))).otherwise(F.col("message"))).withColumn("level", F.when(hit, "WARNING").otherwise(F.col("level")))


def paragraph_totals(paragraphs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many documents and paragraphs there are, and how many paragraphs lost markup."""
    per = paragraphs.groupBy(*by, "doc_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("syntax_error").alias("b"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("paragraphs"), F.sum("b").alias("broken"))


def citations(entries: DataFrame, options: Options = Options()) -> DataFrame:
    """(key, id, citation) of bibliography entries(pos, id, entrytype, fields), or of what bibtex.gathered gives, whose files
    come one after another: kinds in order, paths in order. Numbers are given by ranges, so no task sees all entries."""
    if "kind" in entries.columns:
        entries = entries.withColumn("pos", F.struct("kind", "path", "pos")).withColumnRenamed("key", "id")
    df = entries.withColumn("citation", bibliography.citation(F.col("entrytype"), F.col("fields"))).withColumn("year", bibliography.year_of(F.col("fields")))
    df = df.withColumnRenamed("id", "key")
    title = F.lower(bibliography.field(F.col("fields"), "title"))
    norm = F.when(title != "", title).otherwise(F.coalesce(F.nullif(F.col("citation"), F.lit("")), F.concat(F.lit("\x00"), "key")))
    lean = df.select("key", "pos", "citation", "year", norm.alias("norm"))
    kept = bibliography.dedup(lean, F.col("norm"), "pos", "key") if options.dedup else bibliography.alone(lean, "key")
    return bibliography.lookup(structure.number_by_range(kept, [*bibliography.order_columns(options.sort, "year", "key", "pos"), F.col("key")], "id", options.start), "citation")


def sent(
    paragraphs: DataFrame, make_client: Callable, terms: DataFrame | None = None, done: DataFrame | None = None, base_prompt: str = "", rules: Rules = Rules(), options: Options = Options()
) -> DataFrame:
    """(doc_idx, id, translation) of the paragraphs that `done` does not have, as they come back."""
    terms = terms if terms is not None else paragraphs.sparkSession.createDataFrame([], "chapter int, term string, translation string")
    todo = exchange.still_to_do(paragraphs, done, ["doc_idx", "id"]) if done is not None else paragraphs
    weighed = todo.withColumn("tokens", T.estimate_tokens(F.col("text")))
    batched = exchange.greedy_batches(weighed, ["doc_idx"], ["id"], "tokens", rules.max_batch_tokens).join(todo, ["doc_idx", "id"])
    return exchange.exchange(exchange.with_terms(batched, terms), make_client, base_prompt, rules, options.concurrency)


def checked(paragraphs: DataFrame, done: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """paragraphs with the translations that there are, and what markup they lost."""
    return exchange.integrity(exchange.restore(paragraphs, done, ["doc_idx", "id"], "translation"), "text", "translation", rules)


def translate(
    paragraphs: DataFrame, make_client: Callable, terms: DataFrame | None = None, done: DataFrame | None = None, base_prompt: str = "", rules: Rules = Rules(), options: Options = Options()
) -> DataFrame:
    """paragraphs with translation and syntax_error; rows that `done` (doc_idx, id, translation) has are not sent again."""
    out = sent(paragraphs, make_client, terms, done, base_prompt, rules, options)
    if done is not None:
        out = out.unionByName(done.select("doc_idx", F.col("id").cast("int").alias("id"), "translation"))
    return checked(paragraphs, out, rules)


def postprocess(paragraphs: DataFrame, citations_: DataFrame, rules: Rules = Rules(), options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled paragraphs with references resolved in text and translation; the reference map; the report of missing keys."""
    labelled = materialize(structure.label(paragraphs, rules))
    rows = references.label_rows(labelled)
    refs = references.refmap(rows)
    columns = tuple(c for c in ("text", "translation") if c in labelled.columns)
    stripped = labelled
    for c in columns:
        stripped = stripped.withColumn(c, T.strip_labels(F.col(c)))
    out = references.replace_references(stripped, refs, citations_, options.placeholder, columns)
    lost_cites = references.missing(references.cite_keys(labelled, ["doc_idx"]), citations_, ["doc_idx"]).withColumn("kind", F.lit("cite"))
    used = labelled.select("doc_idx", F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(T.REF), F.lit(1)), T.keys_of))).alias("key"))
    lost_refs = references.missing(used, refs.select("key").distinct(), ["doc_idx"]).withColumn("kind", F.lit("ref"))
    return out, refs, lost_cites.unionByName(lost_refs)


def plan(paragraphs: DataFrame) -> DataFrame:
    return render.render_plan(paragraphs)
