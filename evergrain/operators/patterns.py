"""Many patterns in one pass: texts meet an Aho-Corasick automaton in Arrow batches.

The patterns are rows of a table, MAX_PATTERNS and MAX_CHARS at most (more is an error, never a cut); they are broadcast once and
each Python worker makes one automaton of them. The work for a text follows its length and its matches, not the number of
patterns. Empty patterns and null texts match nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS, MAX_CHARS = 1_000_000, 64_000_000
#: Occurrences that go on together, but for those of the text that reaches the number.
SLICE_HITS = 50_000
#: Automata that a worker keeps.
_held: dict[str, ahocorasick.Automaton] = {}


def _bounded(patterns: DataFrame, column: str, ignore_case: bool) -> list[str]:
    text = F.lower(column) if ignore_case else F.col(column)
    wanted = patterns.select(text.alias("p")).where("p <> ''").distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    if size["n"] > MAX_PATTERNS or size["chars"] > MAX_CHARS:
        raise ValueError(f"{size['n']} patterns of {size['chars']} characters are more than an automaton may hold")
    return sorted(r["p"] for r in wanted.collect())


def _automaton(words: list[str], name: str) -> ahocorasick.Automaton:
    if name not in _held:
        _held.clear()
        made = ahocorasick.Automaton()
        for w in words:
            made.add_word(w, w)
        made.make_automaton()
        _held[name] = made
    return _held[name]


@lru_cache(maxsize=4096)
def _width(c: str) -> int:
    return len(c.lower())


def _lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and where each of its characters comes from where that is not its own place."""
    low = text.lower()
    return low, None if len(low) == len(text) else [k for k, c in enumerate(text) for _ in range(_width(c))]


def matches(rows: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_col: str = "pattern", longest: bool = True, ignore_case: bool = True) -> DataFrame:
    """id, pattern, start, end (in characters, end exclusive) of every occurrence.

    longest: from left to right the longest pattern at a place, without overlaps; otherwise all occurrences of all patterns.
    """
    words = _bounded(patterns, pattern_col, ignore_case)
    name = hashlib.sha256("\0".join(words).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(words)
    typed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _automaton(sent.value, name) if sent.value else None
        for f in frames:
            out = []
            for key, text in zip(f["id"], f["text"]):
                if found is None or not text:
                    continue
                low, origin = _lowered(text) if ignore_case else (text, None)
                if len(out) >= SLICE_HITS:
                    yield pd.DataFrame(out, columns=["id", "pattern", "start", "end"])
                    out = []
                for end, word in found.iter_long(low) if longest else found.iter(low):
                    a, b = end - len(word) + 1, end + 1
                    out.append((key, word, a, b) if origin is None else (key, word, origin[a], origin[b - 1] + 1))
            yield pd.DataFrame(out, columns=["id", "pattern", "start", "end"])

    made = typed.where("text is not null").mapInPandas(run, f"id {typed.schema['id'].dataType.simpleString()}, pattern string, start long, end long")
    return made.withColumnRenamed("id", id_col)


def distinct_hits(rows: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_col: str = "pattern", ignore_case: bool = True) -> DataFrame:
    """id, n_patterns: how many different patterns occur in each text; texts with none are left out."""
    words = _bounded(patterns, pattern_col, ignore_case)
    name = hashlib.sha256("\0".join(words).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(words)
    typed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _automaton(sent.value, name) if sent.value else None
        for f in frames:
            n = [len({w for _, w in found.iter(t.lower() if ignore_case else t)}) if found is not None and t else 0 for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "n_patterns": n})

    made = typed.where("text is not null").mapInPandas(run, f"id {typed.schema['id'].dataType.simpleString()}, n_patterns long")
    return made.where("n_patterns > 0").withColumnRenamed("id", id_col)
