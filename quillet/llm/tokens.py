"""Token counts by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens (a blank mark and what follows it up to the next); the pre-tokens of a batch that were not
met before are one ragged numpy array of symbols. In a round every sequence finds its pair of least rank, and all
sequences apply theirs at once; what is left when no pair has a rank is counted. Counts of pre-tokens are kept by task.

The order of single merges is that of the library: the pair of the best score first, the leftmost among equals. All
occurrences of a sequence's least pair can go in one round, unless merging one makes a pair that is as good or better
at its side: then those up to that one go, and the next round sees the new pair. Sequences are cut further between
characters that no piece of the vocabulary holds side by side, and runs of blanks where whole blank pieces must end, so a
round is short. Sequences that still have pairs after `ROUNDS` rounds (long runs made to that end) are finished one by one
with a heap of pairs, in n log n steps.

Defined cases: a null or empty text has 0 bytes and 0 tokens; characters outside the vocabulary count one token for each
UTF-8 byte; strings of control tokens are plain text; a null doc_id is kept; repeated rows get a row each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, ROUNDS, KEPT = 4096, 512, 400_000
CHARACTERS = 1 << 18  # of texts, and of new pre-tokens, that a task works on at once
BLANK = "▁"
_NONE = np.iinfo(np.int64).max
_PRETOKENS = re.compile(f"{BLANK}+[^{BLANK}]*").findall


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merger:
    """The vocabulary of a BPE model with byte fallback as arrays: symbols of characters, pairs with rank and product."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = how.name == "identity" and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        # normal, unknown, control and byte pieces; others (user-defined, unused) follow rules that are not here
        if not plain or kinds - {1, 2, 3, 6} or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model with the identity normaliser, a blank before the text and byte fallback is needed")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        names = [*score, *sorted({c for p in score for c in p} - set(score))]
        symbol = {p: i for i, p in enumerate(names)}
        #: tokens that a surviving symbol counts as
        self.weight = np.array([1 if p in score else len(p.encode()) for p in names], np.int64)
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = sorted(
            (symbol[p[:i]] << 32 | symbol[p[i:]], ranks[score[p]], symbol[p]) for p in score for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol
        )
        self.keys, self.rank, self.product = (np.array(x, np.int64) for x in zip(*pairs))
        self.merge = {k: (r, p) for k, r, p in pairs}
        self.of = np.full(0x110000, -1, np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of[ord(p)] = i
        beside = {ord(a) << 32 | ord(b) for p in score for a, b in zip(p, p[1:])}
        self.pairs, self.beside = beside, np.array(sorted(beside), np.int64)
        # blank pieces come last of all, and no piece has a blank and something else but one at its start: a long run of
        # blanks is then cut from the left, where each of the longest pieces ends
        blanks = [p for p in score if set(p) == {BLANK}]
        least = min(score.values())
        last = {p for p in score if score[p] == least and len(p) > 1} == {p for p in blanks if len(p) > 1}
        mixed = any(BLANK in p[1:] for p in score if set(p) != {BLANK})
        self.run, longest = 0, max(map(len, blanks), default=0)
        if longest and last and not mixed:
            n = [self._one_by_one([symbol[BLANK]] * k) for k in range(4 * longest)]
            self.run = longest if all(n[k] == 1 + n[k - longest] for k in range(longest, len(n))) else 0
        if any(a != BLANK and b == BLANK for p in score for a, b in zip(p, p[1:])):
            raise ValueError("pre-tokens begin at blanks, which pieces of this model hold inside")
        self.known: dict[str, int] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of pairs of symbols; a rank of _NONE where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], _NONE), self.product[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token; arrays hold about `CHARACTERS` at once, and whole sequences."""
        total = np.zeros(len(words), np.int64)
        held: list[tuple[int, str]] = []
        size = 0
        for i, w in enumerate(words):
            at = 0
            while len(w) - at > CHARACTERS:  # a longer one is cut where characters are not beside each other in any piece
                end = next((k for k in range(at + CHARACTERS, at, -1) if ord(w[k - 1]) << 32 | ord(w[k]) not in self.pairs), at)
                end = end if end > at else next((k for k in range(at + CHARACTERS, len(w)) if ord(w[k - 1]) << 32 | ord(w[k]) not in self.pairs), len(w))
                self._add([(i, w[at:end])], total)
                at = end
            held.append((i, w[at:]))
            size += len(w) - at
            if size > CHARACTERS:
                self._add(held, total)
                held, size = [], 0
        self._add(held, total)
        return total

    def _add(self, words: list[tuple[int, str]], total: np.ndarray) -> None:
        """Adds the tokens of each numbered string to total at its number."""
        points = np.frombuffer("".join([w for _, w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if not len(points):
            return
        word = np.repeat(np.array([i for i, _ in words]), np.array([len(w) for _, w in words], np.int64))
        sym = self.of[points]
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)  # bytes in UTF-8
        np.add.at(total, word[sym < 0], size[sym < 0])
        joined = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, joined), len(self.beside) - 1)
        cut = np.r_[True, (word[1:] != word[:-1]) | (self.beside[at] != joined)]
        seq, known = np.cumsum(cut) - 1, sym >= 0
        sym, seq, word = sym[known], seq[known], word[known]
        for _ in range(ROUNDS):
            sym, seq, word = self._round(sym, seq, word, total)
            if not len(sym):
                return
        for s in np.split(np.arange(len(sym)), np.flatnonzero(seq[1:] != seq[:-1]) + 1):
            total[word[s[0]]] += self._one_by_one(sym[s].tolist())

    def _round(self, sym: np.ndarray, seq: np.ndarray, word: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One merge of its least pair in every sequence; sequences without a pair are counted and leave."""
        n = len(sym)
        if not n:
            return sym, seq, word
        first = np.r_[True, seq[1:] != seq[:-1]]
        inner = np.r_[~first[1:], False]  # the pair (i, i + 1) lies in one sequence
        rank, product = self._look(sym, np.r_[sym[1:], -1])
        rank[~inner] = _NONE
        starts = np.flatnonzero(first)
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, n]))
        done = least == _NONE
        if done.any():
            np.add.at(total, word[done], self.weight[sym[done]])
        best = np.flatnonzero((rank == least) & ~done)
        if not len(best):
            return sym[:0], seq[:0], word[:0]
        # of pairs that overlap, every second, from the left
        fresh = np.r_[True, best[1:] != best[:-1] + 1]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(best)), 0))
        best = best[(np.arange(len(best)) - begin) % 2 == 0]
        made, r = product[best], rank[best]
        # what stands left of a merged pair (itself merged just before, maybe) and right of it; -1 outside the sequence
        left = np.where(first[best], -1, sym[np.maximum(best - 1, 0)])
        touching = np.r_[False, best[1:] == best[:-1] + 2] & ~first[best]
        left = np.where(touching, np.r_[-1, made[:-1]], left)
        right = np.where(inner[best + 1], sym[np.minimum(best + 2, n - 1)], -1)
        stop = (self._look(left, made)[0] <= r) | (self._look(made, right)[0] <= r)
        before = np.cumsum(stop) - stop
        own = seq[best]
        head = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(best)), 0))
        go = best[before == before[head]]
        sym = sym.copy()
        sym[go] = product[go]
        stay = ~done
        stay[go + 1] = False
        return sym[stay], seq[stay], word[stay]

    def _one_by_one(self, sym: list[int]) -> int:
        """The count of one sequence, its pairs merged in order from a heap."""
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            got = self.merge.get(sym[i] << 32 | sym[j]) if i >= 0 and j >= 0 else None
            if got:
                heapq.heappush(heap, (got[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = self.merge[a << 32 | b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return sum(int(self.weight[s]) for s in sym if s >= 0)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the whole blank pieces that were taken off its long runs of blanks."""
        marked = BLANK + text.replace(" ", BLANK)
        if BLANK * 2 not in marked and marked[-1] != BLANK:
            return marked[1:].split(BLANK), 0  # the blank before each is left out, for shorter keys
        found, taken = [], 0
        for w in _PRETOKENS(marked):
            blanks = len(w) - len(w.lstrip(BLANK))
            if self.run and blanks > self.run:  # the last blank may belong to what follows
                whole = (blanks - 1) // self.run
                taken += whole
                w = w[whole * self.run :]
            found.append(w[1:])
        return found, taken

    def tokens(self, texts: Iterable[str]) -> list[int]:
        found: list[int] = []
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > CHARACTERS:
                found += self._tokens(held)
                held, size = [], 0
        return found + self._tokens(held)

    def _tokens(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) if t else ([], 0) for t in texts]
        known = self.known
        new = list({w for words, _ in cut for w in words if w not in known})
        fresh = known
        if new:
            own = dict(zip(new, self.counts([BLANK + w for w in new]).tolist()))
            if len(known) + len(own) <= KEPT:
                known.update(own)
            else:
                fresh = {w: known[w] if w in known else own[w] for words, _ in cut for w in words}
        return [sum(map(fresh.__getitem__, words)) + taken for words, taken in cut]


@cache
def _merger(path: str) -> Merger:
    return Merger(path)


def count(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs(doc_id, text)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(model)
        for b in batches:
            n = pa.array(merger.tokens(t.as_py().decode("utf-8", "replace") for t in b.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    found = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    found = found.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
