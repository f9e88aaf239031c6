"""Cross references: key maps, citation and reference resolution, reports of what is missing. All lookups are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.shared import materialize


def label_rows(paragraphs: DataFrame) -> DataFrame:
    """(doc_idx, chapter, para_id, category, cat_rank, match_pos, key, env_label) of paragraphs(doc_idx, chapter, id, text, env_label)."""
    return paragraphs.select(
        "doc_idx", F.col("chapter").cast("string").alias("chapter"), F.col("id").alias("para_id"), "env_label", F.explode(T.label_keys(F.col("text"))).alias("k")
    ).select("doc_idx", "chapter", "para_id", "k.*", "env_label")


def last_wins(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key; partial aggregation, no sort."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def refmap(rows: DataFrame) -> DataFrame:
    """(chapter, key, env_label): the last label of each key of a chapter."""
    return last_wins(rows, ["chapter", "key"], "env_label", ["doc_idx", "para_id", "cat_rank", "match_pos"])


def collisions(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before of the same key."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("previous", before).where(F.col("previous") != F.col(value))


def two_tier(rows: DataFrame, own: DataFrame, key: str, scope: str, value: str, placeholder: str) -> DataFrame:
    """rows with `value` looked up by (scope, key), else by key in the scope that sorts first as a string, else the placeholder.

    The second look is at a table: a join right above its aggregation could not be split where many rows have one key.
    """
    fallback = materialize(own.groupBy(key).agg(F.min_by(value, F.col(scope).cast("string")).alias("_any")))
    first = own.select(scope, key, F.col(value).alias("_own"))
    return (
        rows.join(first, [scope, key], "left").join(fallback, key, "left")
        .withColumn(value, F.coalesce("_own", "_any", F.lit(placeholder)))
        .withColumn("found", F.coalesce("_own", "_any").isNotNull())
        .drop("_own", "_any")
    )


def cite_keys(paragraphs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., cite_pos, key_pos, key): every key of every citation command, in order."""
    return (
        paragraphs.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(T.CITE), F.lit(1))).alias("cite_pos", "raw"))
        .select(*keys, "cite_pos", F.posexplode(T.keys_of(F.col("raw"))).alias("key_pos", "key"))
    )


def resolve_citations(paragraphs: DataFrame, citations: DataFrame, keys: list[str], placeholder: str) -> DataFrame:
    """(keys..., cites): each citation command as superscript numbers, in order; unknown keys become the placeholder."""
    found = cite_keys(paragraphs, keys).join(citations.select("key", F.col("id").cast("string").alias("_id")), "key", "left")
    one = found.groupBy(*keys, "cite_pos").agg(
        F.array_sort(F.collect_list(F.struct("key_pos", F.coalesce("_id", F.lit(placeholder)).alias("v")))).alias("vs")
    )
    done = F.concat(F.lit("\\textsuperscript{["), F.array_join(F.transform("vs", lambda v: v["v"]), ","), F.lit("]}"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cite_pos", done.alias("v")))).alias("cs")).select(
        *keys, F.transform("cs", lambda c: c["v"]).alias("cites")
    )


def missing(rows: DataFrame, known: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """How often each key without a match occurs, by the given columns."""
    return rows.join(known.select(key), key, "left_anti").groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))


def replace_references(paragraphs: DataFrame, refs: DataFrame, citations: DataFrame, placeholder: str = "[未找到]", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """paragraphs(doc_idx, chapter, id, ...) with references and citations of the columns resolved, prefixes tidied.

    The keys that a paragraph uses are resolved by joins and come back as one map for each paragraph, so the rewriting
    itself is an expression over the row; maps are as large as a paragraph's own keys.
    """
    ids = ["doc_idx", "id"]
    df = paragraphs.withColumn("_scope", F.col("chapter").cast("string"))
    for c in columns:
        t = F.coalesce(F.col(c), F.lit(""))
        used = F.concat(
            F.transform(F.regexp_extract_all(t, F.lit(T.HYPERREF), F.lit(1)), lambda k: F.trim(k)),
            F.flatten(F.transform(F.regexp_extract_all(t, F.lit(T.REF), F.lit(1)), T.keys_of)),
        )
        need = df.select(*ids, F.col("_scope").alias("chapter"), F.explode(F.array_distinct(used)).alias("key"))
        got = two_tier(need, refs, "key", "chapter", "env_label", placeholder).groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("key", "env_label"))).alias("_refs"))
        cites = df.select(*ids, F.explode(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(T.CITE), F.lit(1)), T.keys_of)))).alias("key"))
        numbers = cites.join(citations.select("key", F.col("id").cast("string").alias("_n")), "key").groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("key", "_n"))).alias("_cites"))
        df = df.join(got, ids, "left").join(numbers, ids, "left")

        def look(k, m="_refs"):
            return F.coalesce(F.try_element_at(F.coalesce(F.col(m), F.create_map().cast("map<string,string>")), k), F.lit(placeholder))

        def refer(match):
            command = F.regexp_extract(match, T.REF_COMMAND, 1)
            whole = F.array_join(F.transform(T.keys_of(F.regexp_extract(match, T.REF_COMMAND, 2)), lambda k: look(k)), "、")
            return F.when((command == "eqref") & ~whole.rlike(r"[（(【\[]"), F.concat(F.lit("（"), whole, F.lit("）"))).otherwise(whole)

        t = T.rewrite(t, T.HYPERREF, lambda k: look(F.trim(k)))
        t = T.rewrite(t, T.REF, refer, group=0)
        t = T.rewrite(t, T.CITE, lambda raw: F.concat(F.lit("\\textsuperscript{["), F.array_join(F.transform(T.keys_of(raw), lambda k: look(k, "_cites")), ","), F.lit("]}")))
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), T.clean_cross_references(t))).drop("_refs", "_cites")
    return df.drop("_scope")


def missing_report(missing_: DataFrame, by: list[str], key: str = "key", n: str = "n") -> DataFrame:
    """One line for each document: its unknown keys in order, each with how often it occurs."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, n))), lambda x: F.concat(x[key], F.lit(" ("), x[n].cast("string"), F.lit(")"))), ", ")
    return missing_.groupBy(*by).agg(line.alias("report"), F.sum(n).alias("total"))


def first_collisions(collisions: DataFrame, by: list[str], key: str = "key", most: int = 5) -> DataFrame:
    """The first collisions of each document by key, as a report shows them, and how many there are."""
    keys = F.array_sort(F.collect_set(key))
    return collisions.groupBy(*by).agg(F.slice(keys, 1, most).alias("shown"), F.size(keys).alias("total"))


def replace_summary(paragraphs: DataFrame, citations: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: how many documents, paragraphs, citation keys and reference keys a run has."""
    sizes = paragraphs.groupBy("doc_idx").agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("documents"), F.col("n").alias("paragraphs"))
    keys = lambda df, name: df.select(F.lit(1).alias(name))
    every = sizes.unionByName(keys(citations, "citation_keys"), True).unionByName(keys(refs, "reference_keys"), True)
    return every.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("documents", "paragraphs", "citation_keys", "reference_keys")))
