import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillet.llm import decontaminate as d

ITEMS = [
    (1, "Anna has 12 apples and gives 5 apples to Bert before she walks 3 km home with the rest of them."),
    (2, "The quick brown fox jumps over the lazy dog while seven other animals watch from behind the old wooden fence."),
    (3, "too short to tell"),
]


def templates(text):
    """Plain form of the canonical tokens."""
    import re

    out, start = [], True
    for line in text.split("\n"):
        start = True
        for word in line.split():
            for k, t in enumerate(re.findall(r"[^\W_]+", word)):
                low = t.lower()
                if low[0].isdigit():
                    kind = d.NUMBER
                elif low in d.UNITS and out and out[-1] == d.NUMBER:
                    kind = d.UNIT
                elif t[0].isupper() and t[1:] == t[1:].lower() and not (start and k == 0):
                    kind = d.NAME
                else:
                    kind = low
                out.append(kind)
            start = bool(re.search(r"[.!?:;][^\w]*$", word))
    return out


def test_codes_equal_the_plain_form():
    texts = [t for _, t in ITEMS] + ["A b. C d-E f; 5 km X\nY 7kg can't", "", " \n ", "Été À là. 12"]
    vocabulary = {d.NUMBER: 1, d.NAME: 2, d.UNIT: 3}
    for t in texts:
        for k in templates(t):
            vocabulary.setdefault(k, len(vocabulary) + 1)
    for t in texts * 2:
        assert d.Coder(vocabulary).codes(t).tolist() == [vocabulary[k] for k in templates(t)]
    c = d.Coder(vocabulary)
    seg, d._SEGMENT = d._SEGMENT, 7
    try:
        assert c.codes(texts[0]).tolist() == [vocabulary[k] for k in templates(texts[0])]
    finally:
        d._SEGMENT = seg


def test_finds_verbatim_and_reparameterised(spark):
    rng = random.Random(1)
    fill = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "the", "and"]) for _ in range(n))
    rows = [
        (1, fill(50) + ". " + ITEMS[0][1] + " " + fill(30)),
        (2, fill(20) + ". Carl has 30 apples and gives 7 apples to Dora before she walks 9 miles home with the rest of them. " + fill(9)),
        (3, "Carl has 30 apples and gives 30 apples to Carl before she walks 9 miles home with the rest of them."),
        (4, fill(400)),
        (5, None), (6, ""), (7, "word " * 60000 + ITEMS[1][1].upper()),
        (8, "The quick brown fox jumps over the table."),
        (None, ITEMS[1][1]),
        (1, ITEMS[0][1]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*ITEMS, (2, ITEMS[1][1]), (None, "x"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in d.contaminated(docs, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 2): True, (None, 2): True}
    for bits in (15, 20):  # a sieve that lets others through changes nothing
        assert {(r.doc_id, r.item_id): r.verbatim for r in d.contaminated(docs, bench, sieve_bits=bits).collect()} == got
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contaminated(docs.where("false"), bench).count() == 0
    assert d.contaminated(docs, bench.where("false")).count() == 0
    assert d.drop_contaminated(docs, bench.where("false")).count() == 1


def holds(item, text):
    coder = d.Coder()
    windows, size = d.item_windows(coder, item)
    every = d.text_windows(coder, text, d.WINDOW, [size] if size else [], lambda h: np.ones(len(h)))
    shared = [(p, q, t, v, f) for h, p, t, v in windows for g, q, u, f in every if (h, t) == (g, u)]
    return bool(shared and d.Overlay(shared, len(windows), size > 0, d.WINDOW, d.COVER).best())


def plain(text):
    """Template tokens and values, by the plain form: names in a run are one."""
    out = []
    flat = [t.lower() for w in text.split() for t in d._TOKEN.findall(w)]
    for kind, value in zip(tokens(text), flat, strict=True):
        if kind == d.NAME and out and out[-1][0] == d.NAME:
            out[-1] = (d.NAME, out[-1][1] + " " + value)
        else:
            out.append((kind, value))
    return out


def tokens(text):
    """As templates, with whole numbers as tokens."""
    out = []
    for line in text.split("\n"):
        start = True
        for word in line.split():
            for k, t in enumerate(d._TOKEN.findall(word)):
                low = t.lower()
                if low[0].isdigit():
                    out.append(d.NUMBER)
                elif low in d.UNITS and out and out[-1] == d.NUMBER:
                    out.append(d.UNIT)
                else:
                    out.append(d.NAME if t[0].isupper() and (len(t) == 1 or t[1:].islower()) and not (start and k == 0) else low)
            start = bool(re.search(r"[.!?:;][^\w]*$", word))
    return out


def brute(item, text, window=d.WINDOW, cover=d.COVER):
    """Whether one diagonal of the text covers the item: all pairs of places tried."""
    a, b = plain(item), plain(text)
    good = [i for i in range(len(a) - window + 1) if 2 * sum(not k.startswith("\x00") for k, _ in a[i : i + window]) >= window]
    if not good:
        own, there = ([v for w in x.split() for v in map(str.lower, d._TOKEN.findall(w))] for x in (item, text))
        return bool(own) and any(there[i : i + len(own)] == own for i in range(len(there)))
    for shift in range(-len(a), len(b)):
        hit = [i for i in good if 0 <= i + shift <= len(b) - window and [k for k, _ in a[i : i + window]] == [k for k, _ in b[i + shift : i + shift + window]]]
        slots = {(j, j + shift) for i in hit for j in range(i, i + window) if a[j][0].startswith("\x00")}
        pairs = {(a[i][1], b[j][1]) for i, j in slots}
        if not (len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})):
            hit = [i for i in hit if all(a[j][1] == b[j + shift][1] for j in range(i, i + window))]
        if hit and len(hit) >= cover * len(good):
            return True
    return False


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = "the a of sold gave red blue box pears Anna Bert Carl 3 12 4.5 km min apples then and home. to".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 7, 8, 9, 14, 25]))) for i in range(40)]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 12))]
        words = rng.choice(items)[1].split()
        for k in range(len(words)):  # other values in the same slots, or in one of them
            if rng.random() < rng.choice([0, 0, 0.3]):
                words[k] = {"3": "12", "12": "7", "Anna": "Dora", "km": "kg", "red": "green"}.get(words[k], words[k])
        rows.append((i, " ".join([*parts, *words, text(rng.randint(0, 12))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, j) for i, t in rows for j, q in items if brute(q, t)}
    assert want <= got  # neighbouring diagonals may add to a single one
    assert all(holds(dict(items)[j], dict(rows)[i]) for i, j in got - want)
    assert len(want) > 100


def test_sieve_is_a_bitmap_of_leading_bits(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype=np.int64)
    sieve = d.Sieve(d._bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"), 20))
    other = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert sieve(h.view(np.uint64)).all()
    leading = set((h.view(np.uint64) >> np.uint64(44)).tolist())
    assert sieve(other).tolist() == [int(int(x) >> 44 in leading) for x in other]


def test_alignments_with_gaps_other_widths_and_edits():
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59))
    split = item.split()
    assert len(split) == 59 and holds(item, item)
    assert holds(item, " ".join([*split[:29], "inserted", *split[29:]]))
    assert holds(item, " ".join([*split[:29], *split[30:]]))
    assert not holds(item, " ".join(split[30:] + split[:15][::-1]))
    story = "the shop sold 12 pears to Ann before noon and then it sold 40 plums to Bert until the evening came at last"
    assert holds(story, "the shop sold 3.5 pears to Mary Ann before noon and then it sold 1,000 plums to Carl until the evening came at last")
    equal = "we put 5 red balls in the first old box and we put 5 blue balls in the second new box and close both lids well today"
    assert holds(equal, equal.replace("5 blue", "6 blue"))


def test_items_without_windows_or_ids(spark):
    items = [(1, "What is 17 + 25?"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, ITEMS[1][1]), (4, "!?")]
    rows = [(1, "So: what is 17 + 25? It is 42."), (2, "what is 17 + 26"), (3, "count 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12!"), (4, "1 2 3 4 5 6 7 8 9 10 11 13"), (5, ITEMS[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()} == {(1, 1), (3, 2), (5, None)}
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [2, 4]


def test_words_of_no_item_are_told(spark):
    words = ["pears", "été", "12", "\x00num"]
    bits = d._bitmap(spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")), d.WORD_BITS)
    known = d._known(bits)
    assert [known(w) for w in words] == [d.word_code(w) for w in words]
    assert sum(known(f"other{i}") >= 0 for i in range(1000)) < 5
