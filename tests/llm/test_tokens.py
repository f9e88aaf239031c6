import random
import time

import pyarrow.parquet as pq
import pytest
import sentencepiece

from quillet.llm import queries, tokens


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())


def agree(library, texts):
    got = tokens.Merger(tokens.default_model()).tokens(texts)
    for t, n in zip(texts, got, strict=True):
        assert n == len(library.encode(t)), t


def test_odd_texts(library):
    agree(library, ["", " ", "  ", "a", " a", "a ", "a  b", "<s> hi</s><unk><0x0A>", "▁", "▁▁ a▁b", "\x00a", "﻿x​", "日本語の文章です。中文字", "😀😀 x", "éé", "tab\tnew\nline\r\n", "½ ² ﬁ Ａ", "don't WON'T x1234567890", "\xa0a　b"])


def test_runs_of_every_length(library):
    agree(library, [c * n + tail for c in (" ", "a", "0", "-", "ab", "=", "\n", "日", "the", "▁") for n in range(1, 60) for tail in ("", "x", "the", " ")])


def test_random_texts(library):
    rng = random.Random(5)
    vocabulary = [library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(3000)]
    made = ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    made += ["".join(rng.choice("abcinrt eo") for _ in range(rng.randrange(1, 400))) for _ in range(500)]
    made += ["".join(rng.choice(" ▁ab") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    agree(library, made)


def test_long_sequences_are_finished_by_the_heap(library, monkeypatch):
    monkeypatch.setattr(tokens, "ROUNDS", 3)
    rng = random.Random(6)
    agree(library, ["".join(rng.choice("abcinrteo") for _ in range(n)) for n in (5, 50, 500, 3000)] + ["bcin" * 300, "aaaa" * 500])


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 1_000_000, "bcin" * 50_000, "x " * 300_000, "aZ" * 100_000])
def test_very_long_texts(library, text):
    began = time.perf_counter()
    assert tokens.Merger(tokens.default_model()).tokens([text]) == [len(library.encode(text))]
    assert time.perf_counter() - began < 15


def test_full_table_of_words_is_still_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    m = tokens.Merger(tokens.default_model())
    for t in ("one two three four", "five one six", "two two seven"):
        assert m.tokens([t, t]) == [len(library.encode(t))] * 2


def test_query_equals_the_library(spark, library):
    rows = queries.op11_token_counts(spark, "/root/testdata/sf0.01").collect()
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    want = {(d["doc_id"], len(d["text"].encode()), (n := len(library.encode(d["text"]))), n > 4096) for d in docs}
    assert len(rows) == len(docs) and {tuple(r) for r in rows} == want


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "hi there", 9), (3, "x" * 50_000, 9), (3, "x" * 50_000, 9)], "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in tokens.count(docs, limit=2).collect()]
    assert sorted(got, key=str)[:2] == [(1, 0, 0, False), (2, 0, 0, False)] and got.count(got[-1]) == 2 and got[-1][3]
    assert (None, 8, 2, False) in got
    assert tokens.count(docs.limit(0)).count() == 0


def test_small_pieces_of_work_are_still_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHARACTERS", 20)
    rng = random.Random(8)
    agree(library, ["".join(rng.choice("abcinrteo日é ") for _ in range(n)) for n in (0, 5, 50, 500, 3000)] + ["aaaa" * 50, "x" * 100 + " " * 100 + "日本" * 60, "aZ" * 100])
