import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillet.llm import packing


def test_word_answers_equal_whole_texts():
    e = packing.Encoder(packing.default_vocabulary())
    for t in ["", "It's a TEST... don't", "ÉÀ ß σΣ Σ", "a b　c", "x\x1cy", "<|endoftext|> hi <|startoftext|>x", "naïve\n\n123 4.5%%%", "é e ́", "中文 字", "a​b", "x²½ ª µ ÿ× İI", "we'll I'VE o'd'S rock'n'roll 'T", "ÀÉÎ ÜSS Straße% a_b--c 3,5€", "end<|endoftext|>"]:
        for _ in range(2):
            assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_answers_on_documents():
    import pyarrow.parquet as pq

    e = packing.Encoder(packing.default_vocabulary())
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert e.ids(t or "").tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_best_fit_under_every_constraint():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 800)
    for docs, cost in ((1000, 10**9), (3, 10**9), (1000, 90_000)):
        bins, offsets = packing.vector_best_fit(lengths, 1000, docs, cost)
        for k in set(bins.tolist()):
            own = np.flatnonzero(bins == k)
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
            assert lengths[own].sum() <= 1000 and len(own) <= docs
            assert (lengths[own].astype(int) ** 2).sum() <= cost or len(own) == 1
    bins, _ = packing.vector_best_fit(lengths, 1000)
    assert bins.max() + 1 <= -(-lengths.sum() // 1000) + 1


def test_pack_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta's", "gamma.", "délta"]) for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(500, ""), (501, None), (502, "word " * 9000), (502, "word " * 9000), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack(df, size=1024).collect()
    t = packing.Encoder(packing.default_vocabulary()).tokenizer
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(i, p, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 1024))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, (tuple(r)[:5] for r in got))) == sorted(map(key, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 8
    assert packing.pack(df.where("false")).count() == 0
