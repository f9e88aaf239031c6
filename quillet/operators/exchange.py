"""The exchange stage: batches, glossary and checkpoint joins, a pluggable row transformer, and the check of what came back."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import Rules


def greedy_batches(rows: DataFrame, keys: list[str], order: list[str], weight: str, most: int) -> DataFrame:
    """rows with batch_no: a batch of each key closes when the next weight would pass `most`; a heavier row is a batch of its own.

    The reset depends on the data, so it is a fold over the ordered weights of one key, which are all that is collected; the
    fold notes where batches begin, and rows are dealt to them afterwards.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(weight).cast("long").alias("_w"))))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["i"] == 0) | ((acc["tot"] > 0) & (acc["tot"] + x["_w"] > most))
        return F.struct(
            F.when(new, x["_w"]).otherwise(acc["tot"] + x["_w"]).alias("tot"), (acc["i"] + 1).alias("i"), F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts")
        )

    zero = F.struct(F.lit(0).cast("long").alias("tot"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))
    folded = rows.groupBy(*keys).agg(items.alias("_items")).withColumn("_at", F.aggregate("_items", zero, step, lambda a: F.concat(a["starts"], F.array(a["i"]))))
    cut = F.transform(F.sequence(F.lit(0), F.size("_at") - 2), lambda b: F.slice("_items", F.get("_at", b) + 1, F.get("_at", b + 1) - F.get("_at", b)))
    batches = folded.select(*keys, F.posexplode(cut).alias("batch_no", "_rows")).select(*keys, "batch_no", F.explode("_rows").alias("_z"))
    return batches.select(*keys, *(F.col(f"_z.{o}").alias(o) for o in order), F.col("_z._w").alias(weight), "batch_no")


def glossary(raw: DataFrame, column: str = "value") -> DataFrame:
    """(chapter, term, translation) of glossary JSON: {chapter: {term: translation}} or [{chapter, terms}]; malformed parts go."""
    as_map = F.from_json(column, "map<string,map<string,string>>")
    as_list = F.map_from_entries(F.filter(F.transform(F.from_json(column, "array<struct<chapter:string,terms:map<string,string>>>"), lambda e: F.struct(e["chapter"], e["terms"])), lambda e: e["chapter"].isNotNull()))
    terms = F.when(F.ltrim(F.col(column)).startswith("["), as_list).otherwise(as_map)
    return (
        raw.select(F.explode(terms).alias("c", "t")).select(F.expr("try_cast(c AS int)").alias("chapter"), F.explode("t").alias("term", "translation")).where("chapter IS NOT NULL")
    )


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows with the map of their chapter's terms, empty where there is none."""
    by = terms.groupBy("chapter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "translation")))).alias("terms"))
    return rows.join(by, "chapter", "left").withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,string>")))


HEADING = r"(?is)^(\\(?:part|chapter|section|subsection|subsubsection)\*?)\{([^}]+)\}(\s*\\label\{[^}]*\})?$"


def cached_titles(rows: DataFrame, text: Column, rules: Rules = Rules()) -> DataFrame:
    """rows with `cached`: a heading with the standing translation of its title, command and label as they were; null for
    other texts and titles, which the exchange has to supply."""
    known = rows.sparkSession.createDataFrame(sorted(rules.titles.items()), "_t string, _new string")
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    part = lambda n: F.regexp_extract("_whole", HEADING, n)
    found = rows.withColumn("_whole", whole).withColumn("_t", F.lower(F.regexp_replace(part(2), r"^\s+|\s+$", ""))).join(F.broadcast(known), "_t", "left")
    return found.withColumn("cached", F.when(F.col("_new").isNotNull(), F.concat(part(1), F.lit("{"), "_new", F.lit("}"), part(3)))).drop("_t", "_new", "_whole")


def still_to_do(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys), keys, "left_anti")


def restore(rows: DataFrame, done: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All rows with what has been done for them, an empty string where nothing has."""
    return rows.join(done.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit("")))


def captions(text: str) -> list[tuple[int, int]]:
    """Spans of the contents of caption commands, braces balanced."""
    out = []
    for m in re.finditer(r"\\caption\*?(?:\[[^\]]*\])?\{", text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            if text[i] == "\\":
                i += 1
            elif text[i] in "{}":
                depth += 1 if text[i] == "{" else -1
            i += 1
        if not depth:
            out.append((m.end(), i - 1))
    return out


def route(text: str | None, rules: Rules = Rules()) -> tuple[str, list[str]]:
    """full, caption_only or skip, and the texts to send."""
    text = text or ""
    m = re.match(r"\s*\\begin\{([^}]+)\}", text)
    if not text.strip():
        return "skip", []
    if not m or m[1].strip() not in rules.skip_envs:
        return "full", [text]
    spans = captions(text)
    return ("caption_only", [text[a:b] for a, b in spans]) if spans else ("skip", [])


def put_back(text: str, mode: str, done: list[str]) -> str:
    """The row's text with what came back in place: all of it, its captions from the right, or nothing."""
    if mode == "full":
        return done[0]
    if mode == "caption_only":
        for (a, b), new in reversed(list(zip(captions(text), done, strict=True))):
            text = text[:a] + new + text[b:]
    return text


def prompt(texts: list[str]) -> str:
    """One text as it is; several each under a numbered separator."""
    return texts[0] if len(texts) == 1 else "\n\n".join(f"%%SEP_{i}%%\n{t}" for i, t in enumerate(texts, 1))


def system_prompt(base: str, terms: dict[str, str]) -> str:
    return base + ("\n" + "\n".join(f"{k} -> {v}" for k, v in sorted(terms.items())) if terms else "")


def parse_answer(answer: str, expected: int) -> list[str]:
    """The parts of an answer in the order of their separators' numbers (the last of equal numbers counts); if that is not
    the number expected, its blocks between blank lines, padded or cut."""
    if expected == 1:
        return [answer.strip()]
    numbered = {int(m[1]): m[2].strip() for m in re.finditer(r"%%SEP_(\d+)%%(.*?)(?=%%SEP_\d+%%|\Z)", answer, re.S)}
    if len(numbered) == expected:
        return [part for _, part in sorted(numbered.items())]
    blocks = [b.strip() for b in re.split(r"\n\s*\n|%%SEP_\d+%%", answer)]
    return ([b for b in blocks if b] + [""] * expected)[:expected]


_RETRY = re.compile(r"\b(429|500|502|503|504|529)\b")


def retryable(error: Exception) -> bool:
    return type(error).__name__ in ("RateLimitError", "APIConnectionError", "APITimeoutError", "InternalServerError", "TimeoutError", "ConnectionError") or bool(_RETRY.search(str(error)))


def call(client: Callable[[str, str], str], system: str, user: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """client(system, user), repeated with doubling, jittered waits on errors that may pass; the last try's error is raised."""
    for k in range(attempts):
        try:
            return client(system, user)
        except Exception as e:
            if not retryable(e):
                raise
            sleep(2**k + random.random())
    return client(system, user)


def exchange(rows: DataFrame, make_client: Callable[[], Callable[[str, str], str]], base_prompt: str = "", rules: Rules = Rules(), concurrency: int | None = None) -> DataFrame:
    """rows(doc_idx, id, text, batch_no, terms) -> (doc_idx, id, translation): one call for each batch of a document.

    The client is made once in each task; `concurrency` bounds the tasks and so the calls at a time. A batch's rows meet in
    one task and are at most a batch's tokens; finished rows belong in a checkpoint table (still_to_do, restore).
    """
    spread = rows.repartition(concurrency, "doc_idx", "batch_no") if concurrency else rows.repartition("doc_idx", "batch_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, held, last, kind = make_client(), [], None, None

        def send() -> pa.RecordBatch:
            routed = [route(r["text"], rules) for r in held]
            texts = [t for _, ts in routed for t in ts]
            done: list[str] = []
            if texts:
                done = parse_answer(call(client, system_prompt(base_prompt, dict(held[0]["terms"] or [])), prompt(texts)), len(texts))
            out, at = [], 0
            for r, (mode, ts) in zip(held, routed, strict=True):
                out.append(put_back(r["text"] or "", mode, done[at : at + len(ts)]))
                at += len(ts)
            return pa.RecordBatch.from_arrays([pa.array([r["doc_idx"] for r in held], kind), pa.array([r["id"] for r in held], pa.int32()), pa.array(out, pa.string())], ["doc_idx", "id", "translation"])

        for b in batches:
            kind = b.schema.field("doc_idx").type
            for r in b.to_pylist():
                key = (r["doc_idx"], r["batch_no"])
                if held and key != last:
                    yield send()
                    held.clear()
                held.append(r)
                last = key
        if held:
            yield send()

    ordered = spread.sortWithinPartitions("doc_idx", "batch_no", "id").select("doc_idx", F.col("id").cast("int"), "text", "batch_no", "terms")
    doc_type = rows.schema["doc_idx"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_idx {doc_type}, id int, translation string").withColumn("translation", T.strip_cjk_spaces(F.col("translation")))


def integrity(rows: DataFrame, before: str, after: str, rules: Rules = Rules()) -> DataFrame:
    """rows with syntax_error_tokens and syntax_error: markup of `before` that `after` lost."""
    return rows.withColumn("syntax_error_tokens", T.lost_tokens(F.coalesce(F.col(before), F.lit("")), F.coalesce(F.col(after), F.lit("")), rules)).withColumn(
        "syntax_error", F.size("syntax_error_tokens") > 0
    )
