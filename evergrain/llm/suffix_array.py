"""Suffix-array deduplication by the difference-cover algorithm, over bytes.

The text is dealt out by anchors (see routing.py), so that all places where a window of bytes could repeat are in one
block; blocks are sorted independently, on as many executors as there are. In a block the runs' texts follow each other, and
their suffixes are sorted by difference cover modulo 3: the suffixes at places 1 and 2 modulo 3 are ranked by their triples,
recursing on the triples' names where these do not tell them apart; the other suffixes are sorted by first byte and the
rank of the next; the two lists are merged. Then the first `width` bytes of adjacent suffixes are compared: a
stretch of equal ones is one repeated string, and its places in all but the smallest document repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .routing import Units, remove_repeats

#: Bits for a name in a packed triple; beyond, the first two names of a triple get one name first.
NAME_BITS = 21


def difference_cover_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of s, numbers from 1 up and below 2 ** 31; the end of s is smaller than any."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda k: s[k:].tolist()), np.int64)
    padded = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    # sampled suffixes; one more where n = 1 modulo 3, so that the halves do not run into each other
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    if max(int(padded.max()), n) < 1 << NAME_BITS:
        duo, bits = (padded[:-1] << NAME_BITS) | padded[1:], NAME_BITS
    else:
        duo, bits = np.unique((padded[:-1] << 32) | padded[1:], return_inverse=True)[1], 32
    triple = (duo[sample] << bits) | padded[sample + 2]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    if names.max() < len(sample):
        order = difference_cover_order(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sample = sample[order]
    sample = sample[sample < n]
    # the others: by first number and the rank of what follows
    rest = np.arange(0, n, 3)
    key = (padded[rest] << 32) | rank[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    # merge: where each of the others stands among the sampled suffixes of either kind, and the reverse
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    pair = lambda at: (padded[at] << 32) | rank[at + 1]
    three = lambda at: (duo[at] << bits) | rank[at + 2]
    rest_pair, rest_three = pair(rest), three(rest)
    out = np.empty(n, np.int64)
    out[np.arange(len(rest)) + np.searchsorted(pair(one), rest_pair) + np.searchsorted(three(two), rest_three)] = rest
    nth = np.empty(n + 1, np.int64)
    nth[sample] = np.arange(len(sample))
    out[nth[one] + np.searchsorted(rest_pair, pair(one))] = one
    out[nth[two] + np.searchsorted(rest_three, three(two))] = two
    return out


def _starts_differ(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For adjacent suffixes, each at least `width` bytes long, whether their first `width` bytes differ."""
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    eight = np.zeros(len(text), np.uint64)  # eight bytes from each place on
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(text)]
    differ = np.zeros(max(0, len(order) - 1), bool)
    steps = [*range(0, width - 7, 8), width - 8] if width >= 8 else []
    for k in dict.fromkeys(steps):
        found = eight[order + k]
        differ |= found[1:] != found[:-1]
    for k in range(width if width < 8 else 0):
        found = padded[order + k]
        differ |= found[1:] != found[:-1]
    return differ


def suffix_blocks(width: int):
    """The resolver for routing: texts, their smallest documents and window counts -> the windows that repeat."""

    def resolve(texts: list[bytes], labels: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.frombuffer(b"".join(texts), np.uint8)
        order = difference_cover_order(text.astype(np.int64) + 1)
        begin = np.cumsum(sizes) - sizes
        owner = np.full(len(text), -1, np.int64)  # windows start at the first places of each text only
        windows = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner[windows] = np.repeat(np.arange(len(texts)), counts)
        order = order[owner[order] >= 0]
        stretch = np.flatnonzero(np.r_[True, _starts_differ(text, order, width)])
        label = labels[owner[order]]
        least = np.repeat(np.minimum.reduceat(label, stretch), np.diff(np.r_[stretch, len(order)]))
        repeats = np.zeros(len(text), bool)
        repeats[order] = least < label
        return [repeats[b : b + c] for b, c in zip(begin.tolist(), counts.tolist(), strict=True)]

    return resolve


def remove_repeated_bytes(docs: DataFrame, width: int = 50, gram: int = 20, **options) -> DataFrame:
    """Documents without the bytes covered by a string of `width` bytes that also starts in a document with a smaller id.

    Result and edge cases as in routing.remove_repeats(), with bytes of the UTF-8 text as units; matches never cross
    documents, a text shorter than `width` bytes stays. gram: bytes in an anchor; changes what is moved, never the result.
    """
    return remove_repeats(docs, Units("bytes", width, gram), suffix_blocks(width), **options)
