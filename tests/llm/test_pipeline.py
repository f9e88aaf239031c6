"""The corpus pipeline, stage by stage, against plain Python."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from quillet.llm import packing, queries
from quillet.llm.simhash import fingerprint

PASSAGE = "a passage of well over fifty words that stands in many documents " * 6
ITEM = "The quick brown fox jumps over the lazy dog while seven other animals watch from behind the old wooden fence."


def corpus():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(260):
        text = prose(rng.randint(40, 90))
        toxic = int(i % 4 == 0)
        if toxic:
            text = " ".join(w if rng.random() > 0.1 else rng.choice(["blorgh", "vexfop"]) for w in text.split())
        rows.append([i, text])
        labels.append((i, 1, toxic))
    rows += [[1000, rows[1][1]], [1001, rows[1][1].upper()], [1002, None], [1003, ""], [1004, prose(20) + " " + PASSAGE + prose(20)], [1005, prose(20) + " " + PASSAGE + prose(20)], [1006, prose(30) + ". " + ITEM]]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], labels


def test_stages_in_order(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    at, frames = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path)).cache()
        frames.append(at.collect())
        if k < 4:
            assert at.columns == docs.columns and [t for _, t in at.dtypes] == [t for _, t in docs.dtypes]
    clean, unique, cut, kept, packed = frames

    toxic = {i for i, _, t in labels if t}
    left = {r.doc_id for r in clean}
    assert not left & toxic and left == {r[0] for r in rows} - toxic

    fps = {r.doc_id: fingerprint(r.text) for r in clean}
    groups = {i: min(j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
    assert {r.doc_id for r in unique} == set(groups.values())

    seen = {}
    for r in unique:
        b = (r.text or "").encode()
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for r in unique:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        got = next(x for x in cut if x.doc_id == r.doc_id)
        assert got.text == want and got.n_chars == len(want)
    assert len(cut) == len(unique)

    assert {r.doc_id for r in kept} == {r.doc_id for r in cut if ITEM not in (r.text or "")} and 1006 not in {r.doc_id for r in kept}

    t = packing.Encoder(packing.default_vocabulary()).tokenizer
    sizes = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept}
    total = {}
    for p in packed:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == sizes
    whole = queries.QUERIES["pipeline"](spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in packed)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.count("*").alias("n")).first().n == 0
