"""Quality scores learned from preference pairs (Bradley-Terry), cut at a score quantile.

A pair is a document labelled 1 and one labelled 0; the chance that the first is preferred is the logistic function of
the difference of their scores, scores are linear in features of the text, and the pairs' logistic loss is
minimised. The cut is the quantile of the training documents' scores below which as many of them lie as are labelled 0;
the published score is a logistic function that is 0.3 at the cut.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that the model is fitted on at most, and pairs drawn from them.
FIT_ROWS = 20_000
FIT_PAIRS = 60_000
CUT_SCORE = 0.3

FEATURES = (
    "log_bytes", "log_words", "distinct_share", "top_share", "pair_share", "same_next", "mean_word", "long_word", "upper", "digit", "space", "line",
    "high_byte", "bang", "sign_mix", "bar", "dot", "comma", "other_sign", "shout_words", "sign_end_words", "line_repeat", "short_text", "one_word",
)


def text_features(text: str) -> list[float]:
    """The features of a whole text; none depends on its id, source or language column. Empty texts have features too."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1  # noqa: B905  neighbours
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda chars: float(at[list(chars)].sum()) / n
    ends = Counter(x[-1] for x in words)
    odd_end = sum(ends[c] for c in b"!#$%&*|@^~+=<>") / w
    shout = sum(map(bytes.isupper, words)) / w
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        len(counts) / w,
        top / w,
        pairs / max(1, len(words) - 1),
        same / w,
        len(raw) / w / 10,
        max(map(len, counts), default=0) / (n if len(words) < 2 else 200),
        float(at[65:91].sum()) / n,
        float(at[48:58].sum()) / n,
        share(b" "),
        share(b"\n"),
        float(at[128:].sum()) / n,
        share(b"!"),
        share(b"#$%&*"),
        share(b"|"),
        share(b"."),
        share(b","),
        share(b"@^~+=<>/\\{}[]_`"),
        shout,
        odd_end,
        1 - len(set(lines)) / max(1, len(lines)),
        1.0 if len(words) < 12 else 0.0,
        1.0 if len(counts) <= 2 else 0.0,
    ]


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features and their hinges; small, sent to every task."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        hinges = [np.maximum(0, z - k) for k in self.knots]
        return np.concatenate([z, *hinges], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + math.log(CUT_SCORE / (1 - CUT_SCORE)), -30, 30)))


def fit_ranker(x: np.ndarray, good: np.ndarray, seed: int = 7, rounds: int = 25, ridge: float = 1e-3) -> Ranker:
    """Bradley-Terry by Newton steps on the pairs' logistic loss. Without both labels every score is 0.5."""
    x, good = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(good, bool)
    scale = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    width = len(FEATURES) * 6
    ranker = Ranker(mean, np.where(scale > 1e-9, scale, 1.0), np.array([-2.0, -1.0, 0.0, 1.0, 2.0]), np.zeros(width), 0.0, 1.0)
    if not good.any() or good.all():
        level = math.log(CUT_SCORE / (1 - CUT_SCORE))
        return Ranker(ranker.mean, ranker.scale, ranker.knots, ranker.weights, level, 1.0)
    e = ranker.expand(x)
    draw = np.random.default_rng(seed)
    n_pairs = min(FIT_PAIRS, int(good.sum()) * int((~good).sum()))
    d = e[draw.choice(np.flatnonzero(good), n_pairs)] - e[draw.choice(np.flatnonzero(~good), n_pairs)]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
        gradient = d.T @ p / n_pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n_pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    raw = e @ w
    cut = float(np.quantile(raw, (~good).mean()))
    spread = float(np.median(np.abs(raw - cut))) or 1.0
    return Ranker(ranker.mean, ranker.scale, ranker.knots, w, cut, 3.0 / spread)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, label_col: str = "quality") -> Ranker:
    """A ranker from the labelled rows that are not held out, at most fit_rows of them, chosen by a hash of the id.

    Labels without id or label are left out; a repeated label counts as often as it stands there. Only features go to
    the driver: fit_rows rows of 24 numbers.
    """
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).alias("__good")).where("__id is not null and __good is not null")
    chosen = chosen.where(~held_out(F.col("__id"))).orderBy(F.xxhash64(F.lit(5), "__id"), "__id", "__good").limit(fit_rows)
    texts = docs.select(F.col("doc_id").alias("__id"), text_of().alias("text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [text_features(t) for t in batch["text"]], "good": batch["__good"], "id": batch["__id"]})

    found = texts.select("text", F.col("__good").cast("int").alias("__good"), F.col("__id").cast("string").alias("__id")).mapInPandas(
        run, "x array<double>, good int, id string"
    )
    got = found.toPandas().sort_values(["id", "good"], kind="stable")
    return fit_ranker(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["good"].to_numpy() == 1)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null text scores as an empty one; a null id is not held out; repeated rows get equal scores; an empty table gives an
    empty result; labels that are empty or of one kind give 0.5 everywhere. Whole texts are scored. Narrow: no shuffle.
    """
    ranker = learn(docs, labels, fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([text_features(t) for t in batch["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": ranker.score(x)})

    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("held_out", out)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; every column stays."""
    ranker = learn(docs, labels, fit_rows)

    @F.pandas_udf("double")  # type: ignore[call-overload]
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.where(score(text_of()) >= CUT_SCORE)
