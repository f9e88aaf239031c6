"""A whole run: stages with tables of their own, saved translations, progress without a second pass."""

import pytest
from pyspark.sql import functions as F

from quillet.plans import documents
from quillet.plans.run import Progress, Run
from quillet.sources import events
from quillet.streaming import jobs

MAIN = r"\title{A T}\author{x}\begin{document}\section{One}\label{s1}" + "\n\nText of \\cite{k1}\\footnote{a note}, Section~\\ref{s1}.\n\nMore.\n\\end{document}"


def test_a_run_that_fails_and_goes_on(spark, tmp_path):
    log, fail = str(tmp_path / "calls"), str(tmp_path / "ok")

    def make():
        import os

        def call(system, user):
            if "fail" in user and not os.path.exists(fail):
                raise ValueError("no")
            with open(log, "a") as f:
                f.write(user.replace("\n", "|") + "\n")
            return user

        return call

    names = [str(i) for i in range(6)]
    files = spark.createDataFrame([(n, "main.tex", MAIN.replace("More.", "fail" if n == "3" else f"More {n}.")) for n in names] + [("9", "x.tex", "no body")], "folder string, name string, text string")
    entries = spark.createDataFrame([(0, "k1", "book", {"title": "B", "year": "2000"}), (1, "k2", "book", {"title": "C"})], "pos int, id string, entrytype string, fields map<string,string>")
    run = Run(spark, str(tmp_path / "run"), options=documents.Options(concurrency=2), progress=Progress.log(str(tmp_path / "log"), "job"), waves=4)
    with pytest.raises(Exception, match="no"):
        run.run(files=files, client=make, entries=entries)
    before = open(log).read().splitlines()
    assert jobs.status(events.load(spark, str(tmp_path / "log"))).first().state == "failed"
    open(fail, "w").close()
    for stage in ("translate", "postprocess", "render"):
        run.run(stage, client=make, entries=entries)
    after = open(log).read().splitlines()
    saved = run.table("store").count()
    assert saved == run.table("paragraphs").count() == run.table("final").count()
    # what the waves before the failure saved is not sent again
    first = {n for n in names if any(f"More {n}." in x for x in before)}
    sent_again = [x for x in after[len(before) :] if any(f"More {n}." in x for n in first)]
    whole_waves = spark.createDataFrame([(n,) for n in names], "d string").select("d", F.pmod(F.xxhash64("d"), F.lit(4)).alias("w")).collect()
    wave = {r.d: r.w for r in whole_waves}
    assert not [x for x in sent_again for n in first if f"More {n}." in x and wave[n] < wave["3"]]
    got = {(r.document, r.pos): (r.kind, r.text, r.notes) for r in spark.read.format("docx").load(str(tmp_path / "run" / "documents")).collect()}
    assert {d for d, _ in got} == set(names) and got["0", 1][1] == "Text of [1], Section0.1节." and got["0", 1][2] == ["a note"]
    assert [v for (d, p), v in sorted(got.items()) if d == "0"][-1] == ("reference", "[1] B[M]. 2000.", [])
    said = [r for r in events.load(spark, str(tmp_path / "log")).collect()]
    assert [r.state for r in said if r.type == "status"] == ["running", "failed"] + ["running", "completed"] * 3
    assert [r.percent for r in said if r.stage == "translate" and r.type == "progress"][-1] == 83.0 and said[-1].percent == 100.0
    run.clean()
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["documents"]


def test_counts_are_observed(spark, tmp_path):
    said = []
    files = spark.createDataFrame([("1", "main.tex", MAIN), ("2", "x.tex", "no body")], "folder string, name string, text string")
    run = Run(spark, str(tmp_path), progress=Progress(said.append))
    run.run("preprocess", files=files)
    done = next(e for e in said if e["message"] == "preprocess done")
    assert (done["documents"], done["paragraphs"], done["errors"], done["warnings"]) == (2, run.table("paragraphs").count(), 1, 0) and done["percent"] == 25.0
    with pytest.raises(ValueError):
        run.run("nothing")
