"""Quotes, orders and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tokens(chars: Column, per_token: Column) -> Column:
    """Token estimate: the quotient rounded up (to four decimals), at least 1."""
    return F.greatest(F.lit(1), F.floor(chars / per_token + 0.9999)).cast("long")


def quote(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests(provider, model, estimated_chars, ...) with tokens, costs and the amount; models not in the catalog go."""
    df = requests.join(catalog, ["provider", "model"])
    df = df.withColumn("estimated_input_tokens", tokens(F.col("estimated_chars"), F.col("chars_per_token")))
    df = df.withColumn("estimated_output_tokens", tokens(F.col("estimated_chars") * F.col("default_output_ratio"), F.col("chars_per_token")))
    cost = lambda t, p: F.col(t) / 1_000_000 * F.col(p)
    raw = cost("estimated_input_tokens", "input_price_per_mtok") + cost("estimated_output_tokens", "output_price_per_mtok")
    return df.withColumn("raw_cost", F.round(raw, 6)).withColumn("amount", F.round(F.greatest(F.col("minimum_price"), raw * F.col("markup_multiplier")), 2))


def estimated_chars(files: DataFrame, keys: list[str]) -> DataFrame:
    """Characters that a set of files (ext, size) is priced by: sources whole, bibliographies in part."""
    size = F.col("size")
    part = F.when(F.col("ext") == "tex", size).when(F.col("ext").isin("bib", "bbl"), F.round(size * 0.45)).otherwise(F.lit(0))
    return files.groupBy(*keys).agg(F.round(F.sum(part) * 0.92).cast("long").alias("estimated_chars"))


def still_paid(paid: Column, estimate: Column) -> Column:
    """Whether an estimate is near enough to what was paid for."""
    return F.abs(paid - estimate) <= F.greatest(F.lit(800), F.floor(paid * 0.08))


def valid_orders(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose order is paid, for the same model, and near enough in size."""
    r = requests.select(F.col("order_id").alias("id"), F.col("user_id").alias("_u"), F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("estimated_chars").alias("_chars"))
    return orders.join(r, "id").where(
        (F.col("status") == "paid") & (F.col("user_id") == F.col("_u")) & (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")) & still_paid(F.col("estimated_chars"), F.col("_chars"))
    ).drop("_u", "_p", "_m", "_chars")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key of a table and its changes; MERGE for tables without row-level operations."""
    every = table.unionByName(changes)
    latest = F.max_by(F.struct(*every.columns), version)
    return every.groupBy(*keys).agg(latest.alias("_r")).select("_r.*")


def order_status(job_state: Column) -> Column:
    """Status of an order by the state of its job; what is unknown is being processed."""
    return F.when(job_state.isin("completed", "failed", "cancelled"), job_state).otherwise("processing")


def owners(jobs: DataFrame, orders: DataFrame) -> DataFrame:
    """(job_id, user_id)."""
    return jobs.select(F.col("id").alias("job_id"), "order_id").join(orders.select(F.col("id").alias("order_id"), "user_id"), "order_id").select("job_id", "user_id")


def own_jobs(jobs: DataFrame, owners_: DataFrame, users: DataFrame) -> DataFrame:
    """jobs(job_id, ...) of the given users(user_id): a semi-join, which no repeated owner or user makes more rows of."""
    return jobs.join(owners_.join(users, "user_id", "left_semi"), "job_id", "left_semi")


def request_issues(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests(provider, model, ...) with their names in the form of the catalog and `issue`: an unknown provider, no model, a model that the
    provider does not have; null where a request may run. Two joins with what the catalog names, once each."""
    clean = requests.withColumn("provider", F.lower(F.trim(F.coalesce("provider", F.lit(""))))).withColumn("model", F.trim(F.coalesce("model", F.lit(""))))
    known = catalog.select("provider").distinct().withColumn("_p", F.lit(True))
    models = catalog.select("provider", "model").distinct().withColumn("_m", F.lit(True))
    issue = F.when(F.col("_p").isNull(), "unknown provider").when(F.col("model") == "", "no model").when(F.col("_m").isNull(), "unknown model")
    return clean.join(known, "provider", "left").join(models, ["provider", "model"], "left").withColumn("issue", issue).drop("_p", "_m")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.to_timestamp("expires_at") > now).join(users.select(F.col("id").alias("user_id"), "email"), "user_id")


def recent(rows: DataFrame, order: list[Column], most: int = 50) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def assign_chapters(papers: DataFrame, key: str, order: str, wanted: str, most: int = 10) -> DataFrame:
    """Chapters of the papers of each key: the wanted ones first, then the smallest free numbers in order; null if none is left or a wanted one is taken or out of range."""
    items = F.array_sort(F.collect_list(F.struct(order, wanted)))
    df = papers.groupBy(key).agg(items.alias("p")).withColumn("taken", F.array_distinct(F.filter(F.transform("p", lambda x: x[wanted]), lambda c: (c >= 1) & (c <= most))))
    free = F.array_except(F.sequence(F.lit(1), F.lit(most)), F.col("taken"))

    def step(acc: Column, x: Column) -> Column:
        asks = x[wanted].isNotNull()
        fits = F.array_contains(F.col("taken"), x[wanted]) & ~F.array_contains(acc["used"], x[wanted])
        given = F.when(asks, F.when(fits, x[wanted])).otherwise(F.get(free, acc["next"]))
        return F.struct(
            (acc["next"] + (~asks).cast("int")).alias("next"), F.when(given.isNotNull(), F.concat(acc["used"], F.array(given))).otherwise(acc["used"]).alias("used"),
            F.concat(acc["out"], F.array(F.struct(x[order].alias(order), given.alias("chapter")))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<{order}:{papers.schema[order].dataType.simpleString()},chapter:int>>").alias("out"))
    return df.withColumn("o", F.aggregate("p", zero, step, lambda a: a["out"])).select(key, F.explode("o").alias("x")).select(key, "x.*")


def archive_report(entries: DataFrame, max_entries: int = 12_000, max_bytes: int = 1 << 30) -> DataFrame:
    """For each archive of entries(archive, name, size, is_dir): counts, common root, and the first guard that fails. An issue
    that the listing gives comes first, so a damaged archive has its line as well."""
    if "issue" not in entries.columns:
        entries = entries.withColumn("issue", F.lit(None).cast("string"))
    files = entries.where(F.col("issue").isNotNull() | (~F.col("is_dir") & ~F.col("name").startswith("__MACOSX/")))
    root = F.element_at(F.split("name", "/"), 1)
    agg = files.groupBy("archive").agg(
        F.count("name").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("issue").alias("listed"), F.bool_or(F.lower(F.col("name")).endswith(".tex")).alias("has_tex"),
        F.bool_or(F.col("name").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:")).alias("escapes"),
        F.when((F.min(root) == F.max(root)) & F.bool_and(F.col("name").contains("/")), F.min(root)).alias("common_root"),
    )
    issue = (
        F.when(F.col("listed").isNotNull(), F.col("listed")).when(F.col("escapes"), "path escapes").when(F.col("n") > max_entries, "too many entries").when(F.col("bytes") > max_bytes, "too large").when(~F.coalesce("has_tex", F.lit(False)), "no tex file")
    )
    return agg.withColumn("issue", issue).drop("listed")


def column_widths(cells: DataFrame, keys: list[str], column: str, text: str, total: float) -> DataFrame:
    """Widths in proportion to the longest text of each column, a tenth of the even share at least; what is over comes off the first of the widest."""
    w = Window.partitionBy(*keys)
    df = cells.groupBy(*keys, column).agg(F.greatest(F.lit(1), F.max(F.length(text))).alias("longest"))
    share = F.col("longest") / F.sum("longest").over(w) * total
    df = df.withColumn("_w", F.greatest(share, F.lit(total) / (10 * F.count(F.lit(1)).over(w))))
    df = df.withColumn("_over", F.greatest(F.lit(0.0), F.sum("_w").over(w) - total))
    first = F.row_number().over(w.orderBy(F.desc("_w"), column)) == 1
    return df.withColumn("width", F.round(F.col("_w") - F.when(first, F.col("_over")).otherwise(0.0), 6)).drop("_w", "_over")
