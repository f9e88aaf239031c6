"""A run of the stages over a folder: each stage reads the tables of those before it and writes its own, so any stage can be run
alone or again; translations are saved wave by wave and not asked for twice; progress comes out as events on the side.

What a stage says of itself - rows, documents, issues - is observed while its table is written: no pass is made for it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..operators import render
from ..sources import checkpoints, events
from . import documents

#: By stage, where its share of the whole begins and ends, in percent.
STAGES = {"preprocess": (0, 25), "translate": (25, 83), "postprocess": (83, 92), "render": (92, 100)}


class Progress:
    """Events of a run, handed to whatever takes a dictionary: a list's append, or an event log."""

    def __init__(self, emit: Callable[[dict], None] | None = None) -> None:
        self.emit = emit or (lambda event: None)

    @classmethod
    def log(cls, folder: str, job: str) -> Progress:
        """Events appended to a job's log, where events.load and events.stream find them."""
        return cls(lambda event: events.append(folder, job, event))

    def say(self, stage: str, message: str, percent: float, **data) -> None:
        now = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
        self.emit({"time": now, "type": "progress", "state": "running", "stage": stage, "message": message, "percent": max(0.0, min(100.0, float(percent))), **data})

    def state(self, state: str, message: str = "", percent: float = 0.0) -> None:
        now = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
        self.emit({"time": now, "type": "status", "state": state, "stage": state, "message": message, "percent": percent})


class Run:
    """Tables and documents of a run below a folder. `waves` is the number of parts in which texts are sent and saved."""

    def __init__(
        self, spark: SparkSession, folder: str, rules: Rules = Rules(), options: documents.Options = documents.Options(), progress: Progress | None = None, waves: int = 8
    ) -> None:
        self.spark, self.folder, self.rules, self.options, self.progress, self.waves = spark, folder.rstrip("/"), rules, options, progress or Progress(), waves

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _save(self, name: str, df: DataFrame, **counts) -> dict[str, int]:
        """Writes a table and returns what was counted while it was written."""
        seen = Observation(f"{name}")
        df.observe(seen, *(c.alias(k) for k, c in {"rows": F.count(F.lit(1)), **counts}.items())).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return {k: int(v or 0) for k, v in seen.get.items()}

    def run(self, stage: str = "all", **given) -> None:
        """One stage, or all in order. given: files for preprocess, client and terms for translate, entries for postprocess,
        images for render; those that a stage needs have to be there."""
        if stage != "all" and stage not in STAGES:
            raise ValueError(f"no stage {stage}")
        self.progress.state("running", "Pipeline started")
        for name in STAGES if stage == "all" else (stage,):
            try:
                self.progress.say(name, f"{name} started", STAGES[name][0])
                counts = getattr(self, name)(**given)
            except Exception as e:
                self.progress.state("failed", f"{name}: {type(e).__name__}", STAGES[name][0])
                raise
            self.progress.say(name, f"{name} done", STAGES[name][1], **counts)
        self.progress.state("completed", "Pipeline completed" if stage == "all" else f"{stage} completed", STAGES[name][1])

    def preprocess(self, files: DataFrame, **_) -> dict[str, int]:
        paragraphs, titles, issues = documents.preprocess(files, self.rules, self.options)
        counts = self._save("paragraphs", paragraphs)
        found = self._save("issues", issues, errors=F.count_if(F.col("level") == "ERROR"), warnings=F.count_if(F.col("level") == "WARNING"))
        return {"documents": self._save("titles", titles)["rows"], "paragraphs": counts["rows"], "errors": found["errors"], "warnings": found["warnings"]}

    def translate(self, client: Callable, terms: DataFrame | None = None, base_prompt: str = "", **_) -> dict[str, int]:
        """Sends what the store does not have, one wave of documents after another; each is saved before the next begins."""
        paragraphs, store = self.table("paragraphs"), f"{self.folder}/store"
        kind = paragraphs.schema["doc_idx"].dataType.simpleString()
        low, high = STAGES["translate"]
        for wave in range(self.waves):
            own = paragraphs.where(F.pmod(F.xxhash64("doc_idx"), F.lit(self.waves)) == wave)
            sent = documents.sent(own, client, terms, checkpoints.load(self.spark, store, kind), base_prompt, self.rules, self.options)
            seen = Observation(f"wave{wave}")
            checkpoints.save(sent.observe(seen, F.count(F.lit(1)).alias("rows")), store, kind=kind)
            self.progress.say("translate", f"wave {wave + 1} of {self.waves}", low + (high - low) * (wave + 1) / self.waves, current=wave + 1, total=self.waves, rows=int(seen.get["rows"] or 0))
        done = documents.checked(paragraphs, checkpoints.load(self.spark, store, kind), self.rules)
        return self._save("translated", done, broken=F.count_if("syntax_error"))

    def postprocess(self, entries: DataFrame, **_) -> dict[str, int]:
        cites = documents.citations(entries, self.options)
        self._save("citations", cites)
        final, refs, missing = documents.postprocess(self.table("translated"), self.table("citations"), self.rules, self.options)
        counts = self._save("final", final)
        return {"paragraphs": counts["rows"], "references": self._save("refs", refs)["rows"], "missing": self._save("missing", missing)["rows"]}

    def render(self, images: DataFrame | None = None, **_) -> dict[str, int]:
        """One .docx for each document, its reference list at its end."""
        plan = render.with_notes(render.render_plan(self.table("final"), drawn=True), ["doc_idx"], ["id"])
        if images is not None:
            plan = render.with_panels(plan, images)
        blocks = plan.withColumn("document", F.col("doc_idx").cast("string")).withColumn("pos", F.col("id"))
        listed = self.table("citations").groupBy("id").agg(F.min("citation").alias("citation"))
        last = self.table("final").groupBy(F.col("doc_idx").cast("string").alias("document")).agg(F.max("id").cast("int").alias("last"))
        refs = render.reference_blocks(listed, F.lit(None).cast("string"), 0).drop("document")
        both = last.join(used(self.table("paragraphs"), self.table("citations")), "document").join(refs, "pos").withColumn("pos", F.col("pos") + F.col("last")).drop("last")
        counts = self._save("blocks", blocks.unionByName(both, True).drop("doc_idx", "id", "source"))
        render.write_documents(self.table("blocks"), f"{self.folder}/documents", "overwrite")
        return {"blocks": counts["rows"]}

    def clean(self, *names: str) -> None:
        """Deletes tables of the run that nothing will read again; by default all but the documents."""
        for name in names or ("paragraphs", "titles", "issues", "store", "translated", "citations", "final", "refs", "missing", "blocks"):
            checkpoints.remove(self.spark, f"{self.folder}/{name}")


def used(paragraphs: DataFrame, citations: DataFrame) -> DataFrame:
    """(document, pos): the numbers of the citations that each document uses, for its own reference list."""
    from ..operators import references

    keys = references.cite_keys(paragraphs, ["doc_idx"]).select(F.col("doc_idx").cast("string").alias("document"), "key").distinct()
    return keys.join(citations.select("key", F.col("id").cast("int").alias("pos")), "key").select("document", "pos").distinct()
