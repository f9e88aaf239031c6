"""Byte-window arithmetic for the suffix operator: fingerprints of substrings and content-defined blocks of starts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
GRAM = 8
SLAB = 1 << 20  # starts handled at once: bounds memory for very long texts
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that all bits depend on all bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(max(n, 1 << 16), b, U)
            t[0] = 1
            made.append(np.multiply.accumulate(t))
        _tables[base] = have = (made[0], made[1])
    return have


class Digits:
    """Fingerprints of the substrings of one buffer: a polynomial over mixed byte values, from prefix sums."""

    def __init__(self, buffer: np.ndarray, base: int) -> None:
        power, self.inverse = _powers(base, len(buffer) + 1)
        values = mix(np.arange(256, dtype=U) * U(0x632BE59BD9B4E019) + U(base))
        self.prefix = np.zeros(len(buffer) + 1, U)
        terms = values[buffer]
        terms *= power[: len(buffer)]
        np.cumsum(terms, out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])


def least_grams(buffer: np.ndarray, window: int) -> np.ndarray:
    """For each start, the place of the least 8-byte gram (by a hash; leftmost of equals) inside its window."""
    grams = np.lib.stride_tricks.as_strided(
        np.ascontiguousarray(buffer), (len(buffer) - GRAM + 1, GRAM), (1, 1)
    ).copy().view(U).reshape(-1)
    grams *= U(0x9E3779B97F4A7C15)
    grams ^= grams >> U(29)
    grams *= U(0xBF58476D1CE4E5B9)
    grams &= U(0xFFFFFFFF00000000)
    grams |= np.arange(len(grams), dtype=U)
    span, out = window - GRAM + 1, len(buffer) - window + 1
    rows = np.full((-(-len(grams) // span), span), np.iinfo(U).max, U)
    rows.reshape(-1)[: len(grams)] = grams
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(behind[:out], ahead[span - 1 : span - 1 + out])
    return (low & U(0xFFFFFFFF)).astype(np.int64)


def blocks(
    buffer: np.ndarray, ends: np.ndarray, weight: np.ndarray, cut: np.ndarray, window: int, width: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, number of starts, core key, hull key) of the blocks of consecutive starts, slab by slab.

    buffer holds texts end to end, ends their ends; starts of weight zero are left out; a block never runs over a
    `cut`. A start belongs to the least gram of its own window and to a stretch of `width` distances to that gram,
    so equal windows lie in blocks of equal core, at equal places. The core is what all windows of a stretch
    share; the hull is all that the block's own windows cover. At width 1 both are the window itself.
    """
    n = len(buffer)
    for a in range(0, n, SLAB):
        part = buffer[a : min(n, a + SLAB + window - 1)]
        out = len(part) - window + 1
        if out <= 0:
            return
        live = weight[a : a + out] > 0
        of = np.searchsorted(ends, np.arange(a, a + out, 256), side="right")
        if not live.any():
            continue
        bounds = ends[of[0] : np.searchsorted(ends, a + out + window) + 1] - a
        for e in bounds:  # windows that run over the end of a text
            live[max(0, e - window + 1) : max(0, min(out, e))] = False
        at = least_grams(part, window)
        start = np.arange(out)
        stretch = (at - start) // width
        new = np.empty(out, bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (stretch[1:] != stretch[:-1]) | (live[1:] != live[:-1])
        new |= cut[a : a + out]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, out))
        keep = live[first]
        first, count = first[keep], count[keep]
        if not len(first):
            continue
        core_at = at[first] - stretch[first] * width
        core = Digits(part, BASES[0]).of(core_at, window - width + 1) + stretch[first].astype(U)
        hull = Digits(part, BASES[1]).of(first, count + (window - 1))
        hull ^= mix(((core_at - first) * 65536 + count).astype(U))
        yield first + a, count, mix(core), mix(hull)
