"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length.

Text is folded first: compatibility forms and look-alike letters to Latin ones, digits and signs that stand for
letters inside a word to those letters, letters spelt out with dots or dashes to words. The lexicon holds word
beginnings (and whole short words) whose smoothed log-odds between toxic and clean labelled documents are high; a
word takes the weight of its longest entry, and nothing if an exception phrase covers it. The summed weight per word
and its logarithm pass a logistic curve fitted on the same labelled rows, which gives the score.

The lexicon is fitted on a bounded sample of labelled rows: those of the `max_labelled` smallest hashes of doc_id, which
one scan of the documents gathers. Word beginnings have `shortest` to `longest` letters before they are grown to the
beginning that bears their evidence. Labels, language, source and doc_id are never inputs of a score.

Defined cases: null and empty texts get the score of a text without a match; a null doc_id counts as held out only if
the remainder of its (null) hash is 0, which it never is; it gets its row; rows without labels are scored like all
others; without labels of both classes there is no lexicon and all texts score the same, under 0.5; repeated rows and labels are each used; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, stash

FOLDS = 5
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнɡαοενυικρτχ", "aeopcyxijsdhlkmtbhgaoevuikptx", strict=True))
# Digits and signs read as letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "sore loser bracket", "pond scum", "worthless cheque", "scumble")
_FOLD = str.maketrans(HOMOGLYPHS)
_READ = str.maketrans(DIGITS)
_SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-*_][^\W\d_]){3,}(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
_HAS_SIGN = re.compile(r"[0134578@$!]")
SHORTEST, LONGEST = 3, 10


def _letters(token: str) -> str:
    """A token with its digits and signs, but for trailing ones, read as letters if it has two letters at least."""
    body = token.rstrip("0134578@$!")
    return body.translate(_READ) + token[len(body) :] if sum(map(str.isalpha, body)) > 1 else token


def fold(text: str) -> str:
    """Lower case, Latin look-alikes, signs inside words as letters, spelt-out words joined."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if any(c in HOMOGLYPHS for c in set(text.lower())):
            text = text.lower().translate(_FOLD)
    text = text.lower()
    if _HAS_SIGN.search(text):
        text = " ".join([_letters(t) if _HAS_SIGN.search(t) else t for t in text.split()])
    if _SPELT.search(text):
        text = _SPELT.sub(lambda m: re.sub(r"[.\-*_]", "", m[0]), text)
    return text


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text or ""))


@dataclass
class Model:
    """Entries (a word beginning, or a whole word followed by a blank) with weights; exceptions; the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-6.0, 2.0, 2.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(" " + entry, (len(entry), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (-len(phrase), 0.0))
        a.make_automaton()
        return a

    def evidence(self, text: str | None, automaton) -> tuple[float, float]:
        """Weight per word and summed weight, both compressed."""
        own = words(text)
        if not own or not self.weights:
            return 0.0, 0.0
        line = " " + " ".join(own) + " "
        best: dict[int, tuple[int, float]] = {}
        safe: dict[int, int] = {}  # end of the exception phrase that starts at a place
        for end, (size, w) in automaton.iter(line):
            if size < 0:
                safe[end + size - 1] = max(end, safe.get(end + size - 1, 0))
            else:
                start = end - size
                if start not in best or best[start][0] < size:
                    best[start] = (size, w)
        total, until, phrases = 0.0, 0, iter(sorted(safe.items()))
        at, end = next(phrases, (len(line), 0))
        for start in sorted(best):
            while at <= start:
                until = max(until, end)
                at, end = next(phrases, (len(line), 0))
            if start >= until:
                total += best[start][1]
        return math.log1p(100 * total / (len(own) + 10)), math.log1p(total)

    def score(self, evidence: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * evidence[0] + self.curve[2] * evidence[1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _entries(text: str | None, shortest: int = SHORTEST, longest: int = LONGEST) -> set[str]:
    out = set()
    for w in set(words(text)):
        out.update(w[:n] for n in range(shortest, min(len(w), longest) + 1))
        out.add(w + " ")
    return out


def choose(found: dict[str, tuple[float, int]], shortest: int = SHORTEST) -> dict[str, float]:
    """Entries without those that a shorter, as telling one covers; each grown to the beginning that bears its evidence."""
    by_start: dict[str, list[str]] = {}
    for e in found:
        for n in range(shortest, len(e)):
            by_start.setdefault(e[:n], []).append(e)
    out = {}
    for e, (v, _) in found.items():
        if any(found.get(e[:n], (-math.inf,))[0] >= v - 0.35 for n in range(shortest, len(e))):
            continue
        whole = e
        while longer := [x for x in by_start.get(whole, ()) if not x.endswith(" ") and found[x][1] >= 0.9 * found[whole][1]]:
            whole = max(longer, key=lambda x: (found[x][1], len(x), x))
        out[whole] = float(found[whole][0])
    return out


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, least: int = 6, odds: float = 2.0,
    shortest: int = SHORTEST, longest: int = LONGEST,
) -> Model:
    """Learn entries and curve from labelled rows that are not held out: at most max_labelled labels, one scan of docs."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: small enough to broadcast at any size of the corpus
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id").select("_toxic", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(seen)
            part = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([seen[k][i] for k in keys], pa.int64()) for i in (0, 1))], ["entry", "clean", "toxic"]
            )
            seen.clear()
            return part

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for e in _entries(text.as_py(), shortest, longest):
                    seen.setdefault(e, [0, 0])[toxic] += 1
            if len(seen) > 400_000:
                yield out()
        if seen:
            yield out()

    total = {r._toxic: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    model = Model()
    if not clean or not toxic:
        drop(rows)
        return model
    # an entry is kept if frequent in toxic documents and rare in others; the sample bounds how many are
    least = max(least, math.ceil(0.01 * toxic))
    value = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counted = rows.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = counted.where(F.col("toxic") >= least).withColumn("value", value).where(F.col("value") > odds).collect()
    telling.sort(key=lambda r: (-r.value, r.entry))
    model.weights = choose({r.entry: (r.value, r.toxic) for r in telling}, shortest)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.automaton()
        for b in batches:
            e = np.array([model.evidence(t.as_py(), own) for t in b.column(1)], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e[:, 0]), pa.array(e[:, 1])], ["toxic", "a", "b"])

    # equal points as one with their number, in order: the curve does not depend on how rows are dealt
    points = rows.mapInArrow(gather, "toxic int, a double, b double").groupBy("toxic", "a", "b").count().orderBy("toxic", "a", "b").collect()
    points = np.array([tuple(r) for r in points], float)
    model.curve = _logistic(points[:, 1:3], points[:, 0], points[:, 3])
    drop(rows)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Coefficients by Newton's method over points that occur n times."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            s = [model.score(model.evidence(t.as_py(), automaton)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    return (
        docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
        .mapInArrow(run, "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns and their order stay."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            yield b.filter(pa.array([model.score(model.evidence(t.as_py(), automaton)) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)
