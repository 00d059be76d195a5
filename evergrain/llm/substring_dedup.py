"""Substring deduplication by relative Lempel-Ziv parsing.

A block of runs (see routing.py) is a reference: it is indexed by a suffix array, made by prefix doubling over word numbers. Every
text of the block is then factored greedily against the part of the reference that comes from smaller documents: a
factor is the longest match of what is left of the text. All windows inside a factor that is long enough repeat. A window that
repeats crosses one factor boundary at most, for the factor after the boundary reaches to its end at least; so
the windows across each boundary that the next factor allows are checked, and no others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .routing import Units, remove_repeats

DEPTH = 6  # names of 2 ** 0 to 2 ** 6 words at least; wider windows take more


def _names(words: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each power of two the rank of the string of so many words from each place on."""
    out, at = [words], words
    for k in range(depth):
        shifted = np.zeros(len(at), np.int64)
        shifted[: -(1 << k)] = at[1 << k :] + 1
        _, at = np.unique(at * (int(at.max()) + 2) + shifted, return_inverse=True)
        out.append(at)
    return out


def _common(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, up to 2 ** len(names) - 1 words."""
    n, length = len(names[0]), np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = x + length, y + length
        inside = (a < n) & (b < n)
        same = np.zeros(len(x), bool)
        same[inside] = names[k][a[inside]] == names[k][b[inside]]
        length[same] += 1 << k
    return length


def _nearest_smaller(label: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in suffix order the common prefix with the nearest place before it that has a smaller label.

    common[i] is that of places i - 1 and i. Ranges of doubling length without a smaller label are stepped over.
    """
    n = len(label)
    low, least = [label], [common]  # over 2 ** k places that end at i
    while (1 << len(low)) < n:
        half = 1 << (len(low) - 1)
        a, b = low[-1], least[-1]
        a2, b2 = a.copy(), b.copy()
        a2[half:] = np.minimum(a[half:], a[:-half])
        b2[half:] = np.minimum(b[half:], b[:-half])
        low.append(a2)
        least.append(b2)
    at = np.arange(n)
    length = np.full(n, 1 << 30)
    for k in range(len(low) - 1, -1, -1):
        size = 1 << k
        can = np.flatnonzero(at >= size)
        can = can[low[k][at[can] - 1] >= label[can]]
        length[can] = np.minimum(length[can], least[k][at[can]])
        at[can] -= size
    found = at > 0
    length = np.minimum(length, common[at])
    return np.where(found, length, 0)


def longest_matches(words: np.ndarray, label: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each place the longest match (up to 2 ** (depth + 1) - 1) of what starts there with a place of a smaller label."""
    names = _names(words, depth)
    order = np.argsort(names[-1], kind="stable")
    common = np.zeros(len(order), np.int64)
    common[1:] = _common(names, order[:-1], order[1:])
    sorted_label = label[order]
    before = _nearest_smaller(sorted_label, common)
    turned = np.zeros(len(order), np.int64)
    turned[1:] = common[:0:-1]
    after = _nearest_smaller(sorted_label[::-1], turned)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def parse(matches: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Greedy factors of texts side by side: for each place whether the window there repeats.

    matches: the longest match from each place on; begin, windows: where each text begins and how many windows it has.
    """
    repeats = np.zeros(len(matches) + width, bool)
    edge = np.zeros(len(matches) + 1, np.int64)
    last = begin + windows  # no window starts from here on
    at, open_, start_of = begin.copy(), np.arange(len(begin)), begin.copy()
    while len(open_):
        size = matches[at]
        long = size >= width
        np.add.at(edge, at[long], 1)
        np.add.at(edge, np.minimum(at[long] + size[long] - width + 1, last[open_][long]), -1)
        # windows across the boundary before this factor: from the factor before, no further than this one reaches
        first = np.maximum(start_of, at - width + 1)
        upto = np.minimum(np.minimum(at - 1, at + size - width), last[open_] - 1)
        n = np.maximum(0, upto - first + 1)
        if n.any():
            tried = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            repeats[tried[matches[tried] >= width]] = True
        start_of = at
        at = at + np.maximum(size, 1)
        going = start_of < last[open_]
        at, start_of, open_ = at[going], start_of[going], open_[going]
    return repeats[: len(matches)] | (np.cumsum(edge)[: len(matches)] > 0)


def factor_blocks(width: int):
    """The resolver for routing: texts, their smallest documents and window counts -> the windows that repeat."""

    depth = max(DEPTH, (width - 1).bit_length())  # 2 ** depth words are a window at least

    def resolve(texts: list[bytes], labels: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for row in words for w in (*row, None)]
        codes = pd.factorize(np.array(flat, object), use_na_sentinel=True)[0].astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        codes[ends] = codes.max() + 1 + np.arange(len(ends))  # every text ends with a sign of its own
        begin = ends - sizes
        _, rank = np.unique(labels, return_inverse=True)
        matches = longest_matches(codes, np.repeat(rank, sizes + 1), depth)
        flags = parse(matches, begin, counts, width)
        return [flags[b : b + c] for b, c in zip(begin.tolist(), counts.tolist(), strict=True)]

    return resolve


def remove_repeated_words(docs: DataFrame, width: int = 50, gram: int = 12, **options) -> DataFrame:
    """Documents without the words covered by a window of `width` words that also starts in a document with a smaller id.

    Result and edge cases as in routing.remove_repeats(), with words as units; windows of whole texts only, so a text of
    fewer than `width` words stays. gram: words in an anchor; changes what is moved, never the result.
    """
    return remove_repeats(docs, Units("words", width, gram), factor_blocks(width), **options)


