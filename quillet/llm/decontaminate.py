"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become the same token stream: lower-cased words, with numbers, names (capitalised words
inside a sentence) and units (a unit word after a number) replaced by typed placeholders. A number with points or commas
in it and a run of names are one token each. Windows of `window` template tokens are joined on their hash, and on their
tokens. The windows of a pair are then laid over each other: those on one diagonal, or in order on diagonals at most a
window apart, form an alignment, and its slots must be consistent - equal values in the item stand for equal values in
the document and the other way round. Of an inconsistent alignment only the windows count whose values are the item's. A
document holds an item if a consistent alignment covers at least `cover` of the item's windows, so a question asked again
with other numbers and names is found as well as a verbatim copy.

Windows with fewer literal than placeholder tokens say too little. An item without any other is looked for as a whole,
by windows of its plain words (of its own length, if it is shorter than `window`), all of which must follow each other.

Both sides of the join are tables of windows, and neither is collected. A document's windows pass a sieve first: a bitmap
of 2^`sieve_bits` bits (8 MB) of the item windows' hashes, so as long as the benchmark has far fewer windows than bits only
matches and few others leave a task; with more windows more rows are joined, with the same result. A bitmap of the items'
words (1 MB) spares the scan all others. drop_contaminated
writes the documents once, where they were read, and takes the found ones out in place (common.placed).

Defined cases: null and empty texts match nothing; repeated documents and items (the same id) each count by their
distinct (doc_id, item_id) pair, the best alignment winning; a null id of either is reported as null; other columns are
ignored (drop_contaminated keeps them); an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, drop, in_place, placed, stash

WINDOW, COVER, SIEVE_BITS, WORD_BITS = 8, 0.5, 26, 23
_SEGMENT, _WORDS = 1 << 20, 500_000
# Unit words and signs, read as units only after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mi mg g kg gram grams kilogram kilograms t ton tons oz lb lbs pound pounds "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent usd eur dollar dollars euro euros cent cents degree degrees kmh mph w kw mw v hz khz mhz ghz byte bytes kb mb gb tb".split()
)
NUMBER, NAME, UNIT, _CUT = "\x00num", "\x00name", "\x00unit", "\x1f"
_TOKEN = re.compile(r"\d+(?:[.,]\d+)+[^\W_]*|[^\W_]+")
_ENDS = re.compile(r"[.!?:;][^\w]*$")
_BASE = 0x9E3779B97F4A7C15


def word_code(word: str) -> int:
    """The code of a literal token: a 63-bit hash (as Spark's xxhash64 has it) above those of the placeholders, 1 to 3."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) >> 1 | 4


class Coder:
    """Text to codes of template tokens: hashes, or the numbers that a vocabulary or `code` gives (-1 for one unknown).

    White-space words are taken apart once and kept; the rest is array arithmetic over the numbers of their kinds.
    """

    def __init__(self, vocabulary: dict[str, int] | None = None, code: Callable[[str], int] = word_code) -> None:
        self.code = code if vocabulary is None else lambda w: vocabulary.get(w, -1)
        self.number, self.name, self.unit = (1, 2, 3) if vocabulary is None else (vocabulary.get(k, -1) for k in (NUMBER, NAME, UNIT))
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        # by kind of word: first token, tokens, end of sentence; by token: code, capital, number, unit
        self.of_word = [array("i"), array("i"), array("b")]
        self.of_token = [array("q"), array("b"), array("b"), array("b")]
        self.words["\x01"] = self._kind((), True)  # a line's end

    def _token(self, t: str) -> tuple[int, bool, bool, bool]:
        low = t.lower()
        return self.code(low), t[0].isupper() and (len(t) == 1 or t[1:].islower()), low[0].isdigit(), low in UNITS

    def _kind(self, tokens: tuple, ends: bool) -> int:
        """The number that words of equal tokens share."""
        n = self.alike.get((tokens, ends))
        if n is None:
            n = self.alike[tokens, ends] = len(self.of_word[0])
            for v, x in zip(self.of_word, (len(self.of_token[0]), len(tokens), ends), strict=True):
                v.append(x)
            for t in tokens:
                for v, x in zip(self.of_token, t, strict=True):
                    v.append(x)
        return n

    def _add(self, word: str) -> None:
        if word.isalnum():
            n = self._kind((self._token(word),), False)
        elif word[:-1].isalnum():
            n = self._kind((self._token(word[:-1]),), word[-1] in ".!?:;")
        else:
            n = self._kind(tuple(map(self._token, _TOKEN.findall(word))), bool(_ENDS.search(word)))
        self.words[word] = n

    def _segment(self, text: str, start: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        words = text.replace("\n", " \x01 ").split()
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64), start
        if len(self.words) > _WORDS:
            self._clear()
        known = self.words
        for w in {w for w in words if w not in known}:
            self._add(w)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        first, size, ends = (np.frombuffer(v, t)[at] for v, t in zip(self.of_word, ("i4", "i4", "i1"), strict=True))
        # views: they go before the arrays grow again
        code, capital, number, unit = (np.frombuffer(v, t) for v, t in zip(self.of_token, ("i8", "i1", "i1", "i1"), strict=True))
        opens = np.empty(len(at), bool)
        opens[0], opens[1:] = start, ends[:-1]
        if (size != 1).any():
            before = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(before, size)
            opens = np.repeat(opens, size) & (inner == 0)
            first = np.repeat(first, size) + inner
        num = number[first].astype(bool)
        after_num = np.zeros(len(first), bool)
        after_num[1:] = num[:-1]
        out = np.where(capital[first].astype(bool) & ~opens, self.name, code[first])
        out = np.where(unit[first].astype(bool) & after_num, self.unit, out)
        return np.where(num, self.number, out), code[first], bool(ends[-1])

    def codes(self, text: str) -> np.ndarray:
        return self.parse(text)[0]

    def parse(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes with a run of names as one token, the first word token of each, and the codes of all word tokens as they are."""
        raw, plain = self._raw(text)
        first = np.ones(len(raw), bool)
        if self.name >= 0:
            first[1:] = (raw[1:] != self.name) | (raw[:-1] != self.name)
        starts = np.flatnonzero(first)
        return raw[starts], starts, plain

    def _raw(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(text) <= _SEGMENT:
            return self._segment(text, True)[:2]
        out, at, start = [], 0, True
        while at < len(text):
            cut = at + _SEGMENT
            while cut < len(text) and not text[cut].isspace():
                cut += 1
            *part, start = self._segment(text[at:cut], start)
            out.append(part)
            at = cut
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _values(text: str) -> list[str]:
    return [t.lower() for w in text.split() for t in _TOKEN.findall(w)]


def _slots(text: str, starts: np.ndarray) -> list[str]:
    """The values of the tokens that start at starts."""
    raw = _values(text)
    return [" ".join(raw[a:b]) for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]


def _hashes(codes: np.ndarray, window: int) -> np.ndarray:
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, c = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for j in range(window):
        h = h * np.uint64(_BASE) + c[j : j + n]
    return h


def _plain_hashes(plain: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of plain words, apart from those of templates and of other sizes."""
    return _hashes(plain, size) ^ np.uint64(0xA24BAED4963EE407 * (size + 1) & 0xFFFFFFFFFFFFFFFF)


def _spelt(places: np.ndarray, window: int, codes: np.ndarray, values: list[str]) -> list[tuple[str, str]]:
    """The tokens of windows with placeholders in their places, and their values."""
    kind = {1: NUMBER, 2: NAME, 3: UNIT}
    out = []
    for p in places.tolist():
        own = values[p : p + window]
        out.append((_CUT.join([kind.get(c, v) for c, v in zip(codes[p : p + window].tolist(), own, strict=True)]), _CUT.join(own)))
    return out


#: hash, place, template, values
Row = tuple[int, int, str, str]


def item_windows(coder: Coder, text: str, window: int = WINDOW) -> tuple[list[Row], int]:
    """The windows of an item, and the number of plain words in each if it has none but those (else 0)."""
    codes, starts, plain = coder.parse(text)
    good = np.empty(0, int)
    if len(codes) >= window:
        good = np.flatnonzero(2 * np.convolve(codes > 3, np.ones(window, int), "valid") >= window)
    size = 0 if len(good) else min(len(plain), window)
    if len(good):
        h, spelt = _hashes(codes, window)[good], _spelt(good, window, codes, _slots(text, starts))
    elif size:
        good = np.arange(len(plain) - size + 1)
        h, spelt = _plain_hashes(plain, size), _spelt(good, size, plain, _values(text))
    else:
        return [], 0
    return [(a, p, t, v) for a, p, (t, v) in zip(h.view(np.int64).tolist(), good.tolist(), spelt, strict=True)], size


def text_windows(coder: Coder, text: str, window: int, sizes: list[int], sieve) -> list[Row]:
    """The windows of a document that the sieve lets through: of templates, and of plain words of given sizes."""
    codes, starts, plain = coder.parse(text)
    out: list[Row] = []
    values = None
    h = _hashes(codes, window)
    at = np.flatnonzero(sieve(h))
    if len(at):
        values = _values(text)
        slots = [" ".join(values[a:b]) if b - a > 1 else values[a] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True)]
        out += [(a, p, *x) for a, p, x in zip(h[at].view(np.int64).tolist(), at.tolist(), _spelt(at, window, codes, slots), strict=True)]
    for size in sizes:
        h = _plain_hashes(plain, size)
        at = np.flatnonzero(sieve(h))
        if len(at):
            values = values or _values(text)
            out += [(a, p, *x) for a, p, x in zip(h[at].view(np.int64).tolist(), at.tolist(), _spelt(at, size, plain, values), strict=True)]
    return out


class Sieve:
    """A bitmap of hashes: the leading bits of a hash name its bit."""

    def __init__(self, bitmap: bytes) -> None:
        self.bits = np.frombuffer(bitmap, np.uint8)
        self.shift = np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


class Overlay:
    """The windows that a document and an item share: their places in the item and in the document, tokens and values."""

    def __init__(self, rows: list[tuple[int, int, str, str, str]], n_windows: int, whole: bool, window: int, cover: float) -> None:
        self.place, self.at = np.array([(r[0], r[1]) for r in rows], np.int64).T
        self.template, self.values, self.found = ([r[k].split(_CUT) for r in rows] for k in (2, 3, 4))
        self.need, self.whole, self.window = n_windows if whole else cover * n_windows, whole, window

    def best(self) -> tuple[int, bool] | None:
        """Matched windows and whether all values are the item's, of the first alignment that covers the item: the
        fullest diagonals by themselves, then neighbouring ones joined in order."""
        place, at = self.place, self.at
        lines, inverse, count = np.unique(at - place, return_inverse=True, return_counts=True)
        for k in np.argsort(-count, kind="stable"):
            if count[k] < self.need:
                break
            found = self._consistent(np.flatnonzero(inverse == k))
            if found:
                return found
        if self.whole:
            return None
        group = np.cumsum(np.r_[0, np.diff(lines) > self.window])
        for g in range(group[-1] + 1):
            members = np.flatnonzero(group == g)
            if len(members) == 1 or len(np.unique(place[np.isin(inverse, members)])) < self.need:
                continue
            taken, row = np.full(place.max() + 1, -1), np.full(place.max() + 1, -1)
            for k in members[np.argsort(-count[members], kind="stable")]:
                own = np.flatnonzero(inverse == k)
                p = place[own]
                before = np.maximum.accumulate(taken)
                after = np.minimum.accumulate(np.where(taken < 0, at.max() + 2, taken)[::-1])[::-1]
                fits = (taken[p] < 0) & (before[p] < at[own]) & (at[own] < after[p])
                taken[p[fits]], row[p[fits]] = at[own[fits]], own[fits]
            some = row[row >= 0]
            found = self._consistent(some) if len(some) >= self.need else None
            if found:
                return found
        return None

    def _consistent(self, rows: np.ndarray) -> tuple[int, bool] | None:
        """All windows if their slots agree, else those whose values are the item's."""
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        agree, alike = True, 0
        seen: set[tuple[int, int]] = set()
        for r in rows.tolist():
            if self.values[r] == self.found[r]:
                alike += 1
            for j, t in enumerate(self.template[r]):
                if t[:1] == "\x00" and (spot := (int(self.place[r]) + j, int(self.at[r]) + j)) not in seen:
                    seen.add(spot)
                    a, b = self.values[r][j], self.found[r][j]
                    agree &= there.setdefault(a, b) == b and back.setdefault(b, a) == a
        n = len(rows) if agree else alike
        return (n, agree and alike == len(rows)) if n >= self.need else None


def _column(rows: list[tuple], k: int, kind: pa.DataType) -> pa.Array:
    return pa.array([r[k] for r in rows], kind)


_WINDOW_FIELDS = [("h", pa.int64()), ("place", pa.int32()), ("template", pa.string()), ("words", pa.string())]


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """Every window of every item, with the item's id and text hash, its number of windows and the plain words in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for b in batches:
            row, count, size, out = [], [], [], []
            for i, text in enumerate(b.column(2)):
                windows, plain = item_windows(coder, text.as_py(), window)
                out += windows
                row += [i] * len(windows)
                count += [len(windows)] * len(windows)
                size += [plain] * len(windows)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(count, pa.int32()), pa.array(size, pa.int32()), *(_column(out, k, t) for k, (_, t) in enumerate(_WINDOW_FIELDS))],
                ["item_id", "item_key", "n_windows", "size", *(n for n, _ in _WINDOW_FIELDS)],
            )

    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text")
    return rows.mapInArrow(run, "item_id long, item_key long, n_windows int, size int, h long, place int, template string, words string")


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """The bitmap of the leading bits of column h, made of pieces of 4 KB that are put together before they move: 2^bits / 8 bytes in all."""
    spot = F.shiftrightunsigned("h", 64 - bits) + 1
    pieces = hashes.select(spot.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    out = bytearray(max(1, (1 << bits) >> 3))
    for r in pieces.collect():
        out[(r.piece - 1) * 4096 : r.piece * 4096] = r.bits[: len(out)]
    return bytes(out)


def _known(bitmap: bytes) -> Callable[[str], int]:
    """word_code for words whose bit is set, -1 for all others: no item holds them."""
    shift = 64 - (len(bitmap) * 8).bit_length()

    def code(word: str) -> int:
        c = word_code(word)
        bit = c >> shift
        return c if bitmap[bit >> 3] >> (bit & 7) & 1 else -1

    return code


def _pairs(rows: DataFrame, items: DataFrame, window: int, cover: float, sieve_bits: int) -> DataFrame:
    """(doc, key, item_id, n_matched, n_windows, verbatim) of rows(doc, key, text) and the items that they hold."""
    sc = rows.sparkSession.sparkContext
    words = items.select(F.explode(F.split("template", _CUT)).alias("word")).select(F.xxhash64("word").alias("h"))
    bitmap, known = sc.broadcast(_bitmap(items, sieve_bits)), sc.broadcast(_bitmap(words, WORD_BITS))
    sizes = sorted(r["size"] for r in items.where("size > 0").select("size").distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sieve = Coder(code=_known(known.value)), Sieve(bitmap.value)
        for b in batches:
            row, out = [], []
            for i, text in enumerate(b.column(2)):
                windows = text_windows(coder, t, window, sizes, sieve) if (t := text.as_py()) else []
                out += windows
                row += [i] * len(windows)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), *(_column(out, k, t) for k, (_, t) in enumerate(_WINDOW_FIELDS))], ["doc", "key", "h", "at", "template", "found"]
            )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for i, (n, size, shared) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)):
                best = Overlay([tuple(x.values()) for x in shared], n, size > 0, window, cover).best()
                if best:
                    row.append(i)
                    out.append(best)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(at) for k in (0, 1, 2)), _column(out, 0, pa.int32()), b.column(3).take(at), _column(out, 1, pa.bool_())],
                ["doc", "key", "item_id", "n_matched", "n_windows", "verbatim"],
            )

    windows = rows.mapInArrow(cut, "doc long, key long, h long, at int, template string, found string")
    shared = windows.join(items, ["h", "template"]).groupBy("doc", "key", "item_id", "item_key", "n_windows", "size")
    enough = F.when(F.col("size") > 0, F.col("n_windows")).otherwise(F.col("n_windows") * F.lit(cover))
    laid = (
        shared.agg(F.collect_set(F.struct("place", "at", "template", "words", "found")).alias("shared"))
        .where(F.size(F.array_distinct("shared.place")) >= enough)
        .select("doc", "key", "item_id", "n_windows", "size", "shared")
    )
    return laid.mapInArrow(lay, "doc long, key long, item_id long, n_matched int, n_windows int, verbatim boolean")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, sieve_bits: int = SIEVE_BITS
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, verbatim) for each pair of a document and an item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    found = _pairs(rows, stash(_items(benchmark, window)), window, cover, sieve_bits)
    best = F.max(F.struct("n_matched", "n_windows", "verbatim")).alias("m")
    return found.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(best).select("doc_id", "item_id", "m.*")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, sieve_bits: int = SIEVE_BITS
) -> DataFrame:
    """docs without the rows that hold a benchmark item, written to the shared folder."""
    rows, buckets = placed(docs)
    lean = rows.select(F.col("rid").alias("doc"), F.col("rid").alias("key"), F.col(f"c{docs.columns.index('text')}").alias("text"))
    found = stash(_pairs(lean, stash(_items(benchmark, window)), window, cover, sieve_bits).select(F.col("doc").alias("rid")).distinct())
    with in_place(docs.sparkSession):
        kept = rows.join(dealt(found, buckets), ["part", "rid"], "left_anti")
        out = stash(kept.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns))
    drop(rows, found)
    return out
