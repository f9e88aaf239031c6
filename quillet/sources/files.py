"""File sources: one row for each source file, text decoded with a fallback, folders as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, folder, chapter, name, ext, depth, content, length) of all files below root; depth 1 lies right in a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    rest = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 2, F.lit(1 << 20))
    parts = F.split(rest, "/")
    return reader.load(root).select(
        "path", F.get(parts, 0).alias("folder"), F.expr("try_cast(folder AS int)").alias("chapter"), F.element_at(parts, -1).alias("name"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), (F.size(parts) - 1).alias("depth"), "content", "length",
    )


def decoded(content: Column, strict: bool = False) -> Column:
    """UTF-8, else Latin-1; with strict, null where it is not UTF-8."""
    good = F.is_valid_utf8(content.cast("string"))
    return F.when(good, F.decode(content, "UTF-8")).otherwise(F.lit(None) if strict else F.decode(content, "ISO-8859-1"))


def tex_files(files: DataFrame) -> DataFrame:
    return files.where((F.col("ext") == "tex") & (F.col("depth") == 1))


def reference_files(files: DataFrame, prefer_bbl: bool = False) -> DataFrame:
    """The one kind of bibliography file of each folder: bbl if preferred and there, else bib, else bbl."""
    own = files.where(F.col("ext").isin("bib", "bbl") & (F.col("depth") == 1))
    kinds = own.groupBy("folder").agg(F.bool_or(F.col("ext") == "bbl").alias("bbl"), F.bool_or(F.col("ext") == "bib").alias("bib"))
    choice = F.when(F.col("bbl") if prefer_bbl else ~F.col("bib"), "bbl").otherwise("bib")
    return own.join(kinds.select("folder", choice.alias("ext")), ["folder", "ext"])


def main_file(tex: DataFrame) -> DataFrame:
    """The main file of each folder: with title and author, then with a document environment, then the longest; ties by name."""
    text = decoded(F.col("content"))
    score = F.struct(
        (~(text.rlike(r"\\title\b") & text.rlike(r"\\author\b"))).cast("int").alias("a"), (~text.rlike(r"\\begin\{document\}")).cast("int").alias("b"), (-F.length(text)).alias("c"), F.col("name").alias("d")
    )
    return tex.groupBy("folder").agg(F.min_by(F.struct(*tex.columns), score).alias("m")).select("m.*")


def image_of(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(doc, rel) with the first existing of rel and rel with an image suffix.

    Each file is dealt to the names that it can be wanted by, its own and that without its suffix, and the first of each name is
    chosen there: a task sorts its share of the names alone, however few files the tables lie in. The join is a merge, as the
    chosen are as many as the files, which Spark may take for few.
    """
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), r"^.*?/(?=[^/]+$)", "")
    serves = [F.struct(F.lit(0).alias("rank"), F.col("name").alias("rel"))]
    for rank, suffix in enumerate((".png", ".jpg", ".jpeg", ".pdf"), 1):
        serves.append(F.when(F.col("name").endswith(suffix), F.struct(F.lit(rank).alias("rank"), F.expr(f"left(name, char_length(name) - {len(suffix)})").alias("rel"))))
    named = files.select(F.col("folder").alias("doc"), name.alias("name"), "path")
    each = named.select("doc", "path", F.explode(F.array_compact(F.array(*serves))).alias("s")).select("doc", "s.rel", "s.rank", "path")
    best = each.repartition("doc", "rel").groupBy("doc", "rel").agg(F.min_by("path", "rank").alias("path"))
    return wanted.join(best.hint("merge"), ["doc", "rel"], "left")


def settings(lines: DataFrame, by: list[str], line: str = "line", order: str = "pos") -> DataFrame:
    """(by..., key, value) of KEY=VALUE lines(by..., order, line): comments and lines without a sign go, `export` and quotes come off, the last
    of a key counts."""
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    t = F.regexp_replace(t, r"^export\s+", "")
    cut = F.instr(t, "=")
    value = F.trim(F.substring(t, cut + 1, F.length(t)))
    for mark in ('"', "'"):
        value = F.regexp_replace(value, f"^{mark}+|{mark}+$", "")
    rows = lines.where(~t.startswith("#") & (cut > 0)).select(*by, order, F.trim(F.substring(t, F.lit(1), cut - 1)).alias("key"), value.alias("value"))
    return rows.groupBy(*by, "key").agg(F.max_by("value", order).alias("value"))


def env_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of environment files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r\n|[\r\n]")).alias("pos", "line"))
    return settings(whole, ["path"])


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of {"documents": [...]} files: one for each paragraph, with the document's place and columns."""
    schema = "documents array<struct<tex:string,chapter:int,title:string,title_translation:string,paragraphs:array<struct<id:int,text:string,translation:string,env_label:string>>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("documents").alias("doc_idx", "d"))
    return docs.select("doc_idx", "d.tex", "d.chapter", "d.title", F.explode_outer("d.paragraphs").alias("p")).select("doc_idx", "tex", "chapter", "title", "p.*")


def write_documents(paragraphs: DataFrame, path: str) -> None:
    """One JSON line for each document, its paragraphs in order."""
    item = F.struct("id", "text", "translation", "env_label")
    paragraphs.groupBy("doc_idx", "chapter").agg(F.array_sort(F.collect_list(item)).alias("paragraphs")).write.mode("overwrite").json(path)
