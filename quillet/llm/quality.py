"""Document quality by hierarchical empirical Bayes over sites.

A logistic classifier on the shape of a text (length, distinct and repeated words, punctuation, capitals, separators,
repeated lines) gives each document its evidence: a log likelihood ratio of good against bad. Sites are a hierarchy -
all, host, path in the host - and each level's share of good documents has a beta prior centred on the level above,
whose strength is the empirical-Bayes (moment) estimate from the spread between the sites: many like sites make a strong
prior, and a sparse site shrinks to its host, a sparse host to the whole. A document's posterior joins its evidence with
the share of its path, from which its own part is taken out first.

Everything at corpus scale is a grouped aggregation with partial sums before the shuffle, so a host with a third of all
documents is no single task; the driver only gets a few totals. The classifier is fitted on a bounded sample of
labelled rows that are not held out: the `max_labelled` of the smallest id hashes.

Defined cases: null and empty texts have the evidence of an empty text; a null host or path is the site named ""; a null
doc_id gets its row; without labels of both classes the evidence is 0 everywhere and scores are the shares; repeated rows
count each; other columns are ignored (keep_good keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

_SPACES = b" \t\n\r\x0b\x0c"
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum()) + _SPACES + bytes(range(128, 256))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_PLAIN_END = re.compile(r"[^\W_][,.;:]?$")
NAMES = ("words", "distinct", "repeats", "marks", "capitals", "odd_ends", "bare", "lines", "same_lines")


def shape(text: str | None) -> list[float]:
    """Numbers, mostly shares, that describe a text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    odd = sum(c for w, c in counts.items() if not _PLAIN_END.search(w))
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    return [
        math.log(n), len(counts) / n, sum(map(str.__eq__, words, words[1:])) / n,
        len(raw.translate(None, _ALNUM)) / len(raw), len(raw.translate(None, _NOT_UPPER)) / len(raw),
        odd / n, bare / n, len(lines) / n, 1 - len(set(lines)) / len(lines),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Intercept, features, squares and the products with length."""
    return np.c_[np.ones(len(x)), x, x * x, x[:, :1] * x[:, 1:]]


class Classifier:
    def __init__(self, beta: np.ndarray | None = None, mean: np.ndarray | None = None, scale: np.ndarray | None = None, base: float = 0.0) -> None:
        self.beta, self.mean, self.scale, self.base = beta, mean, scale, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
        if len(y) == 0 or y.min() == y.max():
            return cls()
        z = expand(x)
        mean, scale = z.mean(axis=0), z.std(axis=0)
        mean[0], scale[scale < 1e-9] = 0.0, 1.0
        scale[0] = 1.0
        z = (z - mean) / scale
        beta, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
            beta += step
            if np.abs(step).max() < 1e-7:
                break
        share = (y.sum() + 1) / (len(y) + 2)
        return cls(beta, mean, scale, math.log(share / (1 - share)))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio: the log odds without the prior odds of the sample."""
        if self.beta is None:
            return np.zeros(len(x))
        return np.clip(((expand(x) - self.mean) / self.scale) @ self.beta - self.base, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, folds: int = 5) -> Classifier:
    held = F.crc32(F.col("doc_id").cast("string")) % folds == 0
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held)
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: small enough to broadcast at any size of the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id").select("_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shape(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(run, "y double, x array<double>").limit(2 * max_labelled).collect()
    return Classifier.fit(np.array([r.x for r in got], float).reshape(-1, len(NAMES)), np.array([r.y for r in got], float))


def _strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
    """Pseudo-documents of the beta prior: share variance within sites over variance between them, less one."""
    m = F.col(s) / F.col(n)
    t = groups.agg(
        F.sum(F.col(n) * (m - centre) ** 2).alias("spread"), F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(s).alias("s")
    ).first()
    if not t.n or t.k < 2:
        return 1e6
    mean = min(max(t.s / t.n, 1e-6), 1 - 1e-6)
    within = mean * (1 - mean)
    between = (t.spread - t.k * within) / t.n
    return min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score(docs: DataFrame, classifier: Classifier, host: Column, path: Column) -> DataFrame:
    """(doc_id, evidence, host_share, path_share, score, keep) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shape(t.as_py()) for t in b.column(3)], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(classifier.evidence(x))], ["doc_id", "host", "path", "evidence"])

    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lean = docs.select(F.col("doc_id").cast("long"), blank(host).alias("host"), blank(path).alias("path"), "text")
    rows = stash(lean.mapInArrow(run, "doc_id long, host string, path string, evidence double"))
    # the classifier's own view of a document, at the sample's prior odds, is what sites are counted by
    own = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(classifier.base))))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pn"), F.sum(own).alias("ps"))
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    centre = (total.s + 0.5) / (total.n + 1) if total.n else 0.5
    k_host = _strength(hosts, "hn", "hs", F.lit(centre))
    hosts = hosts.withColumn("h", (F.lit(k_host * centre) + F.col("hs")) / (k_host + F.col("hn")))
    joined = paths.join(hosts, "host")
    k_path = _strength(joined, "pn", "ps", F.col("h"))
    sites = joined.select("host", "path", "pn", "ps", "hn", "hs")
    all_rows = rows.withColumn("own", own).join(sites, ["host", "path"])
    # without the document itself, so that its evidence is not counted twice
    h = (F.lit(k_host * centre) + F.col("hs") - F.col("own")) / (k_host + F.col("hn") - 1)
    p = (F.lit(k_path) * F.col("h") + F.col("ps") - F.col("own")) / (k_path + F.col("pn") - 1)
    share = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), c))
    return (
        all_rows.withColumn("h", share(h)).withColumn("p", share(p))
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("p"))))))
        .select("doc_id", "evidence", F.col("h").alias("host_share"), F.col("p").alias("path_share"), "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
    )
