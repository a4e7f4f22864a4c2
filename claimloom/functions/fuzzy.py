"""Text normal form and similarity (TXT-1..6). Plain functions of strings, and Arrow-batched columns of them.

Distances are computed with one machine-word-wide integer per row of the usual table: a step per character of the
longer text, whatever the shorter one's length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLD = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "​": None, "­": None})


@lru_cache(65_536)
def _folded(char: str) -> str:
    return unicodedata.normalize("NFKC", char.translate(_FOLD)).lower()


def normalized(text: str) -> tuple[str, list[int]]:
    """TXT-1, TXT-2: folded text and, for each of its characters, the place in the source it came from."""
    out, at, i = [], [], 0
    while i < len(text):
        if text[i] == "-" and i + 1 < len(text) and text[i + 1] == "\n":
            i += 2
            continue
        for c in _folded(text[i]):
            if c.isspace():
                if not out or out[-1] == " ":
                    continue
                c = " "
            out.append(c)
            at.append(i)
        i += 1
    return "".join(out), at


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by bit vectors of the table's differences down a column."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, distance = full, 0, len(b)
    for c in a:
        match = places.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
    return distance


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        taken = row & places.get(c, 0)
        row = (row + taken | row - taken) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters in common, in per cent: 200 · LCS / both lengths."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """TXT-5: likeness of word sets in per cent; 100 if one holds the other, 0 if either is empty."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both = " ".join(sorted(one & two))
    only_a, only_b = " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if both and (not only_a or not only_b):
        return 100.0
    left, right = (" ".join(filter(None, (both, x))) for x in (only_a, only_b))
    return max(ratio(left, right), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0)


def similarity(a: Column, b: Column) -> Column:
    """TXT-5 of two columns in normal form; null counts as empty."""
    return F.pandas_udf(lambda xs, ys: pd.Series([token_set_ratio(normalized(x or "")[0], normalized(y or "")[0]) for x, y in zip(xs, ys)], dtype=float), "double")(a, b)


def contains_normalized(text: Column, part: Column) -> Column:
    """TXT-6: whether a text holds another in normal form; nothing is held by none."""
    return F.pandas_udf(lambda xs, ys: pd.Series([bool(y) and normalized(y)[0] in normalized(x or "")[0] for x, y in zip(xs, ys)], dtype=bool), "boolean")(text, part)


def window_distances(hay: np.ndarray, needle: str, starts: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the needle, of 63 characters at most, and as long windows of hay (code points): the table of edit_distance, for all windows at once."""
    n, one = len(needle), np.uint64(1)
    places = np.zeros(len(hay), np.uint64)
    for c in set(needle):
        places[hay == ord(c)] = sum(1 << i for i, x in enumerate(needle) if x == c)
    full, top = np.uint64((1 << n) - 1), np.uint64(1 << (n - 1))
    up, down, distance = np.full(len(starts), full), np.zeros(len(starts), np.uint64), np.full(len(starts), n)
    for i in range(n):
        match = places[starts + i]
        diagonal = (((match & up) + up) ^ up) | match | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        distance += ((more & top) != 0).astype(int) - ((less & top) != 0)
        more, less = (more << one | one) & full, less << one & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
    return distance


def best_window(hay: str, needle: str) -> tuple[int, int, float]:
    """TXT-4: (start, end, score) of the stretch of hay most like the needle: coarse starts, then near ones, then other ends."""
    n, end = len(needle), len(hay)
    if n > end:
        return 0, end, ratio(needle, hay)
    like = lambda s, e: 100.0 * (1 - edit_distance(needle, hay[s:e]) / max(n, e - s))
    step = max(1, n // 4)
    codes = np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), np.uint32)

    def best(starts: range) -> tuple[float, int]:
        """The highest score and its first start."""
        if n > 63:
            score, start = max((like(s, s + n), -s) for s in starts)
            return score, -start
        found = window_distances(codes, needle, np.asarray(starts))
        return 100.0 * (1 - int(found.min()) / n), starts[int(found.argmin())]

    score, start = best(range(0, end - n + 1, step))
    near, other = best(range(max(0, start - step), min(end - n, start + step) + 1))
    if near > score:
        score, start = near, other
    stop = start + n
    for e in (stop - 12, stop - 8, stop - 4, stop + 4, stop + 8, stop + 12):
        if start < e <= end and (other := like(start, e)) > score:
            score, stop = other, e
    return start, stop, score


def locate(page: str, quote: str, least: float = 82.0) -> tuple[int, int, float, bool] | None:
    """TXT-3: (start, end, score, exact) of a quote in its page, in places of the source."""
    hay, at = normalized(page)
    needle = normalized(quote)[0].strip()
    if not needle or not hay.strip():
        return None
    p = hay.find(needle)
    start, stop, score = (p, p + len(needle), 100.0) if p >= 0 else best_window(hay, needle)
    return (at[start], at[stop - 1] + 1, score, p >= 0) if score >= least and stop > start else None


_CELLS = re.compile(r"\||·|/(?=\s)|\n")


def locate_cell(page: str, quote: str, value: str, least: float = 82.0) -> tuple[int, int, float, bool] | None:
    """GRD-6: the place of one of the cells that a quote was put together from: first those with the value, then long ones."""
    cells = [c for c in (x.strip() for x in _CELLS.split(quote)) if c]
    wanted = normalized(value or "")[0].strip()
    if len(cells) > 1:
        for cell in sorted(cells, key=lambda c: (not wanted or wanted not in normalized(c)[0], -len(c))):
            if len(cell) > 1 and (found := locate(page, cell, least)):
                return found
    return None
