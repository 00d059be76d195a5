"""Byte-level BPE encoding by a walk over the trie of distinct words, and decoding.

For BPE the last token of every prefix of a word is enough to encode it: the last token t of a prefix is the one
token that ends there, follows a prefix whose own last token may stand before t, and so on back. The walk
visits the distinct words of a batch as a trie, depth first, with one stack of last tokens; what words share
as prefixes is worked out once. Encoded words are kept for later batches of the same worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from threading import Timer

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed value: white space as Unicode defines it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Encoded words that a worker keeps; beyond, it starts anew. Seconds without a partition after which it gives them back, since
#: workers outlive a stage. Both bound memory and change no result.
KEPT_WORDS = 500_000
IDLE_SECONDS = 5.0


def _byte_signs() -> dict[str, int]:
    """The printable sign for each byte: itself where it is printable Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _class_of(kind: str) -> str:
    """Ranges of a regular expression's class for a general category of Unicode (its first letter)."""
    inside = [unicodedata.category(chr(c))[0] == kind for c in range(0x110000)]
    edges = [c for c in range(0x110000) if inside[c] != (c > 0 and inside[c - 1])]
    pairs = zip(edges[::2], [*edges[1::2], 0x110000] if len(edges) % 2 else edges[1::2], strict=True)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in pairs)


def word_pattern() -> re.Pattern:
    """The word pattern of byte-level BPE: endings after an apostrophe; letters, numbers or signs after a space or none; white space, but
    the last of it before a word is that word's."""
    letter, number = _class_of("L"), _class_of("N")
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{BLANK}{letter}{number}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
    )


class Bpe:
    """A byte-level BPE vocabulary from a tokenizer file. Tokens are numbered by merge order inside, by id outside."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = _byte_signs()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        base = sorted((t for t in vocab if len(t) == 1 and t in signs), key=vocab.get)
        names = base + [a + b for a, b in merges]
        order = {t: k for k, t in enumerate(names)}
        self.ids = [vocab[t] for t in names]
        self.bytes = [bytes(signs[c] for c in t) for t in names]
        self.by_bytes = {b: k for k, b in enumerate(self.bytes)}
        self.parts = [(k, k) for k in range(len(base))] + [(order[a], order[b]) for a, b in merges]
        self.merged = {pair: k for k, pair in enumerate(self.parts) if k >= len(base)}
        self.lengths = [len(b) for b in self.bytes]
        self.longest = max(self.lengths)
        by_bytes = {b: k for k, b in enumerate(self.bytes)}
        #: For each token the longest token that is a proper end of it, -1 for single bytes.
        self.shorter = [next((by_bytes[b[n:]] for n in range(1, len(b)) if b[n:] in by_bytes), -1) for b in self.bytes]
        self.by_bytes = by_bytes
        self.starts = {b[:n] for b in self.bytes for n in range(1, len(b) + 1)}
        #: Steps of the automaton of token beginnings, found as they are met: (state, byte) -> (state, longest token that ends there).
        self.states: dict[bytes, int] = {b"": 0}
        self.state_bytes = [b""]
        self.steps: dict[int, tuple[int, int]] = {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = word_pattern()
        self.odd_blank = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c not in " \n" and (c.isspace() or re.match(f"[{BLANK}]", c))) + "]")
        self.of_id = {i: b for i, b in zip(self.ids, self.bytes, strict=True)} | {i: t.encode() for t, i in self.added.items()}
        self.packed = {k: array("I", [i]).tobytes() for k, i in enumerate(self.ids)}
        self.packed_added = {t: array("I", [i]).tobytes() for t, i in self.added.items()}
        self.follows: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.waiting: Timer | None = None

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The longest token beginning that ends the path after one more byte, and the longest token that does."""
        text = self.state_bytes[state] + bytes([byte])
        at = next(n for n in range(len(text)) if text[n:] in self.starts)
        token = next(self.by_bytes[text[n:]] for n in range(len(text)) if text[n:] in self.by_bytes)
        held = text[at:]
        if held not in self.states:
            self.states[held] = len(self.state_bytes)
            self.state_bytes.append(held)
        self.steps[state << 8 | byte] = found = (self.states[held], token)
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging, in order, leaves tokens a and b side by side: no pair at their seam merges before both exist."""
        left, right, limit, fine = a, b, len(self.parts) + 1, True
        while True:
            if self.merged.get((left, right), limit) < limit:
                fine = False
                break
            if left > right:  # undo the later of the two
                limit, inner = left, self.parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.parts[right][0]
                if inner == right:
                    break
                right = inner
            else:
                limit, inner = right + 1, self.parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.parts[left][1]
                if inner == left:
                    break
                left = inner
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        self.follows[a << 20 | b] = fine
        return fine

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers, by one depth-first walk over the words' trie.

        The trie is the sorted list of words: what a word shares with the one before it is the path to their fork. The stacks
        hold, for each length of the path, the automaton's state and the last token.
        """
        steps, step, shorter, lengths, packed = self.steps, self.step, self.shorter, self.lengths, self.packed
        follows, may_follow = self.follows, self.may_follow
        out: dict[str, bytes] = {}
        last, states, path = [-1], [0], b""
        for raw, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            fork = len(path) if raw.startswith(path) else 0
            if not fork:
                for x, y in zip(path, raw):  # noqa: B905  the shorter one ends the shared prefix
                    if x != y:
                        break
                    fork += 1
            del last[fork + 1 :], states[fork + 1 :]
            path, state, end = raw, states[fork], fork
            for byte in raw[fork:]:
                end += 1
                state, token = steps.get(state << 8 | byte) or step(state, byte)
                while True:  # the one token that ends here and may stand after what is before it
                    before = last[end - lengths[token]]
                    if before < 0:
                        break
                    fine = follows.get(before << 20 | token)
                    if fine or (fine is None and may_follow(before, token)):
                        break
                    token = shorter[token]
                last.append(token)
                states.append(state)
            tokens, at = [], end
            while at:
                token = last[at]
                tokens.append(packed[token])
                at -= lengths[token]
            tokens.reverse()
            out[word] = b"".join(tokens)
        return out

    def _chunks(self, text: str) -> list[str]:
        """text in pieces that no word crosses. Each space starts a piece, where no other white space is next to it."""
        if "  " in text or "\n " in text or " \n" in text or self.odd_blank.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        rows: list[list[str]] = []
        for text in texts:
            if self.split is not None and self.split.search(text):
                row: list[str] = []
                for part in self.split.split(text):
                    row += [part] if part in self.added else self._chunks(part)
                rows.append(row)
            else:
                rows.append(self._chunks(text))
        kept = self.kept
        new = {x for row in rows for x in row if x not in kept}
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            kept[""] = b""
            new = {x for row in rows for x in row}
        pieces = {x: self.words.findall(x) for x in new if x not in self.added}
        coded = self.encode_words({w for found in pieces.values() for w in found})
        for x, found in pieces.items():
            kept[x] = coded[found[0]] if len(found) == 1 else b"".join([coded[w] for w in found])
        kept.update(self.packed_added)
        return [b"".join(map(kept.__getitem__, row)) for row in rows]

    def release(self) -> None:
        """Gives back what was kept for later batches; a batch under way goes on with what it holds."""
        self.kept = {"": b""}
        self.follows = {}

    def busy(self) -> None:
        """A partition begins: what is kept stays."""
        if self.waiting is not None:
            self.waiting.cancel()

    def idle(self) -> None:
        """A partition has ended: what is kept goes, unless another one begins soon."""
        self.waiting = Timer(IDLE_SECONDS, self.release)
        self.waiting.daemon = True
        self.waiting.start()

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.of_id.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded, for every row.

    A null text is encoded as empty: no ids, decoded to the empty string. Added tokens in a text get their own ids. Rows
    that repeat are encoded each; null ids pass through; a text of any length is encoded whole. Narrow: no shuffle.
    vocabulary_path names a file that every executor has (a vocabulary is a few MB whatever the corpus).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(vocabulary_path)
        bpe.busy()
        for batch in batches:
            texts, begin, held = batch["text"].tolist(), 0, 0
            for k, text in enumerate(texts):
                held += len(text)
                if held >= slice_bytes or k + 1 == len(texts):
                    ids = bpe.encode_batch(texts[begin : k + 1])
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[begin : k + 1].array, "ids": ids, "decoded": [bpe.decode(x) for x in ids]})
                    begin, held = k + 1, 0
        bpe.idle()

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
