"""Documents to ordered, labelled paragraphs. Every window is partitioned by document, so no partition outgrows one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.rules import Rules
from ..sources.shared import materialize


def carry_forward(df: DataFrame, keys: list[str], order: list[str], is_section: Column, is_sub: Column, own: Column | None = None) -> DataFrame:
    """section_no, sub_no and the label of the last heading: sections count within keys, subsections since the last section.

    own is the label of a row that sets its own and passes it on (an abstract); rows before any heading get "0".
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("section_no", F.sum(is_section.cast("int")).over(w))
    inner = Window.partitionBy(*keys, "section_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("sub_no", F.sum(is_sub.cast("int")).over(inner))
    head = F.when(is_section, F.col("section_no").cast("string")).when(is_sub, F.concat_ws(".", "section_no", "sub_no"))
    if own is not None:
        head = F.coalesce(own, head)
    return df.withColumn("heading", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("0")))


def merge_open(df: DataFrame, keys: list[str], order: str, depth: Column) -> DataFrame:
    """Group number `grp` of rows that belong together while the running depth is above zero; it restarts at each flush."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_sum", F.sum(depth).over(upto))
    df = df.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    return df.withColumn("grp", F.coalesce(F.sum((F.col("_depth") == 0).cast("int")).over(before), F.lit(0))).drop("_sum", "_depth")


def join_groups(df: DataFrame, keys: list[str], order: str, value: str, glue: str) -> DataFrame:
    """One row for each (keys, grp): the values in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys, "grp").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p[value]), glue).alias(value))


def attach_leading(df: DataFrame, keys: list[str], order: str, is_leading: Column) -> DataFrame:
    """Group number `grp` that puts leading tokens with the row before them; those without one form group 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("grp", F.sum((~is_leading).cast("int")).over(w))


def chunk(docs: DataFrame, rules: Rules = Rules(), keep_commands: bool = True, split_on_linebreak: bool = False) -> DataFrame:
    """(doc_idx, id, text): the paragraphs of docs(doc_idx, tex), numbered from 1; documents without a body give none."""
    t = T.drop_preamble(T.strip_comments(T.normalize_newlines(T.document_body(F.col("tex")))))
    t = T.break_environments(T.break_sections(t), rules)
    if split_on_linebreak:
        t = F.regexp_replace(t, r"\\\\\s*\n", "\n\n")
    t = T.strip_outer_space(T.collapse_blank_lines(t))
    raw = (
        docs.select("doc_idx", F.posexplode(F.split(t, r"\n\s*\n")).alias("pos", "raw"))
        .withColumn("raw", T.stripped(F.col("raw"))).where("raw <> ''")
    )
    whole = join_groups(merge_open(raw, ["doc_idx"], "pos", T.env_depth(F.col("raw"), rules)), ["doc_idx"], "pos", "raw", "\n\n")
    # a leading label is a token of its own, to be attached to what comes before
    leading = r"^((?:\s*\\label\{[^}]*\}\s*)+)"
    heads = F.filter(F.regexp_extract_all(F.regexp_extract("raw", leading, 1), F.lit(r"\\label\{[^}]*\}"), F.lit(0)), lambda x: x != "")
    rest = T.stripped(F.regexp_replace("raw", leading, ""))
    tokens = F.concat(
        F.transform(heads, lambda h: F.struct(F.lit(True).alias("lead"), h.alias("part"))),
        F.when(rest != "", F.array(F.struct(F.lit(False).alias("lead"), rest.alias("part")))).otherwise(F.array().cast("array<struct<lead:boolean,part:string>>")),
    )
    split = whole.select("doc_idx", "pos", F.posexplode(tokens).alias("k", "tok")).select(
        "doc_idx", F.struct("pos", "k").alias("at"), "tok.lead", F.col("tok.part").alias("text")
    )
    merged = join_groups(attach_leading(split, ["doc_idx"], "at", F.col("lead")), ["doc_idx"], "at", "text", "\n")
    # one evaluation for each paragraph: a filter over the cleaned text would be pushed down to it, and clean it once for each mention
    both = F.transform(F.array("text"), lambda x: F.struct(x.alias("text"), T.stripped(T.strip_macro_definitions(x)).alias("clean")))
    kept = F.filter(F.transform(both, lambda s: F.when(s["clean"] != "", s["clean"]).otherwise(s["text"])), lambda x: ~T.is_noncontent(x))
    merged = merged.select("doc_idx", "at", F.explode(kept).alias("text"))
    if not keep_commands:
        merged = merged.where(~F.col("text").rlike(r"^\\(part|chapter|section|subsection|subsubsection)\*?\{.*?\}$"))
    number = F.row_number().over(Window.partitionBy("doc_idx").orderBy("at"))
    return merged.select("doc_idx", number.alias("id"), "text")


# Environments that make a float more than a formula, without stars.
SEEN_IN_FLOATS = ("tabular", "tabularx", "tabulary", "tabularray", "tblr", "longtable", "tikzpicture", "picture", "subfigure", "subfloat", "minipage")


def formula_float(s: Column, rules: Rules = Rules()) -> Column:
    """Whether a text is a float with a formula and nothing to be seen but formulas: told by the names of the environments in it."""
    math = next(e for c, _, e in rules.categories if c == "math")
    names = F.transform(F.regexp_extract_all(s, F.lit(r"(?i)\\(?:begin|end)\{([^}]+)\}"), F.lit(1)), lambda n: F.lower(n))
    plain = F.transform(names, lambda n: F.regexp_replace(n, r"\*$", ""))
    return F.coalesce(
        (F.size(names) > 3) & F.lower(s).rlike(r"^\\begin\{(?:figure|table)") & F.get(plain, 0).isin("figure", "table")
        & F.element_at(plain, -1).isin("figure", "table") & s.rlike(r"\}\s*$") & F.lower(s).rlike(r"\\end\{(?:figure|table)\*?\}\s*$")
        & F.arrays_overlap(names, F.array(*(F.lit(m.lower()) for m in sorted(math))))
        & ~F.arrays_overlap(plain, F.array(*map(F.lit, SEEN_IN_FLOATS))) & ~F.lower(s).contains("\\includegraphics"),
        F.lit(False),
    )


def categorize(text: Column, rules: Rules = Rules()) -> Column:
    """abstract, section, subsection, a category of environments, or text."""
    s = F.regexp_replace(text, r"^\s+", "")
    command = F.lower(F.regexp_extract(s, T.SECTION, 1))
    title = F.lower(F.trim(F.regexp_extract(s, T.SECTION + r"([^}]*)\}", 2)))
    env = F.trim(F.regexp_extract(s, r"^\\begin\{([^}]+)\}", 1))
    by_env = F.lit(None).cast("string")
    for c, _, envs in reversed(rules.categories):
        by_env = F.when(env.isin(*sorted(envs)), F.lit(c)).otherwise(by_env)
    return (
        F.when(s.rlike(r"(?i)^\\begin\{abstract\}") | (title == "abstract"), "abstract")
        .when(command.isin("part", "chapter", "section"), "section")
        .when(command != "", "subsection")
        .when(s.rlike(r"^\\\[") | formula_float(s, rules), "math")
        .otherwise(F.coalesce(by_env, F.lit("text")))
    )


def label(paragraphs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """paragraphs(doc_idx, chapter, id, text, ...) with category and env_label."""
    df = paragraphs.withColumn("category", categorize(F.col("text"), rules))
    df = carry_forward(
        df, ["doc_idx"], ["id"], F.col("category") == "section", F.col("category") == "subsection",
        F.when(F.col("category") == "abstract", F.lit("摘要")),
    )
    seq = F.row_number().over(Window.partitionBy("doc_idx", "category").orderBy("id"))
    prefix = F.lit(None).cast("string")
    for c, p, _ in rules.categories:
        prefix = F.when(F.col("category") == c, F.lit(p)).otherwise(prefix)
    depth = F.size(F.split("heading", r"\."))
    inherited = F.when(F.col("heading") == "摘要", F.lit("摘要")).otherwise(
        F.concat(F.col("chapter").cast("string"), F.lit("."), F.col("heading"), F.when(depth == 2, "小节").otherwise("节"))
    )
    own = F.concat(prefix, F.col("chapter").cast("string"), F.lit("-"), seq.cast("string"))
    return df.withColumn("env_label", F.when(prefix.isNotNull(), own).otherwise(inherited)).drop("section_no", "sub_no", "heading")


def label_summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def number_by_range(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Global 1..n numbers in the given order without one task for all: sorted ranges, counted, then offset.

    The order must be total. Only one count for each range is read by the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the bounds of the ranges are sampled anew in each run: fix them before anything is counted
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    at, offsets = start - 1, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(at)]
        at += counts[p]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long")).where("false")
    return local.withColumn(name, (F.col("_n") + F.create_map(*offsets)[F.col("_part")]).cast("long")).drop("_part", "_n")


def merge_runs(df: DataFrame, keys: list[str], order: str, style: str, text: str) -> DataFrame:
    """Neighbouring rows of equal style as one, their text joined; empty rows go first (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    full = df.where(F.col(text) != "").withColumn("_new", F.coalesce((F.lag(style).over(w) != F.col(style)).cast("int"), F.lit(1)))
    full = full.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return full.groupBy(*keys, "run").agg(F.first(style).alias(style), F.array_join(F.transform(parts, lambda p: p[text]), "").alias(text))


def suffix_repeats(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Names made unique: the second of a name gets .1, the third .2."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) - 1
    return df.withColumn(name, F.when(n > 0, F.concat_ws(".", name, n.cast("string"))).otherwise(F.col(name)))


def sum_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """What the rows before each sum up to in a total order, without one task for all: sorted ranges, their sums, then offsets."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    at = [0] * (max(sums, default=-1) + 1)
    for p in range(1, len(at)):
        at[p] = at[p - 1] + (sums.get(p - 1) or 0)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, (own + F.coalesce(F.get(F.array(*map(F.lit, at or [0])), F.col("_part")), F.lit(0))).cast("long")).drop("_part")


def renumber(local: DataFrame, keys: list[str], old: str, start: int = 1) -> DataFrame:
    """Ids of each key's own as ids over all: keys in order, old ids in order, `start` first. Counts of keys move, not rows."""
    per = local.groupBy(*keys).agg(F.countDistinct(old).alias("_n"))
    offsets = sum_before(per, [F.col(k) for k in keys], "_n", "_at")
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(old))
    return local.withColumn("_r", rank).join(offsets, keys).withColumn("new_id", (F.col("_at") + F.col("_r") + (start - 1)).cast("long")).drop("_r", "_n", "_at")


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], order_left: str, order_right: str) -> DataFrame:
    """Rows of two tables side by side by their place in each key; unequal numbers leave nulls, which the caller refuses."""
    number = lambda df, o: df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    return number(left, order_left).join(number(right, order_right), [*keys, "pos"], "full")
