"""Quality scores by a factorisation machine over hashed words, text structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): all
pairwise interactions through ``factors`` numbers a feature, in time linear in the features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import drop, durable
from prioscope.llm.toxicity import labelled_rows

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
STATISTICS = 12
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class QualityConfig:
    """``sample_rows`` bounds the labelled rows used for fitting; features are hashed into ``buckets``."""

    sample_rows: int = 4_000
    buckets: int = 1 << 15
    factors: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.05
    ridge: float = 1e-4
    metadata: tuple[str, ...] = ("n_chars",)
    known_words: int = 400_000
    seed: int = 11


class Buckets(dict):
    """Word -> bucket; forgets when it holds too many."""

    def __init__(self, buckets: int, most: int):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = zlib.crc32(word.encode()) % self.buckets
        return out


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Ratios that describe how a text is built; all zero for an empty one."""
    if not text:
        return [0.0] * STATISTICS
    raw, n = text.encode(), max(1, len(words))
    size = len(raw)
    lines = text.split("\n")
    filled = [line for line in lines if line.strip()]
    gone = lambda chars: (size - len(raw.translate(None, chars))) / size
    return [
        np.log1p(len(words)), len(text) / n / 10, 5 * gone(UPPER), 5 * gone(DIGITS), 5 * gone(MARKS),
        20 * gone(b"|"), 20 * gone(b"!"), 20 * gone(b"#$%&*"), len(counts) / n,
        max(counts.values(), default=0) / n, len(set(filled)) / max(1, len(filled)),
        np.log1p(n / max(1, len(filled))),
    ]


def features(text: str | None, extra: list[float], buckets: Buckets, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values: word counts (log, unit length), then statistics, then metadata."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    ids = np.fromiter((buckets[w] for w in counts), np.int64, len(counts))
    tf = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    norm = float(np.sqrt((tf * tf).sum())) or 1.0
    fixed = structure(text, words, counts) + extra
    at = np.arange(size, size + len(fixed))
    return np.concatenate([ids, at]), np.concatenate([tf / norm, np.asarray(fixed, float)])


@dataclass
class FactorisationMachine:
    """Weights, factors and the scale of the dense features; ``prior`` alone if labels have one class."""

    bias: float = 0.0
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    prior: float = 1.0
    config: QualityConfig = field(default_factory=QualityConfig)

    def scaled(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        dense = len(self.centre)
        x[-dense:] = np.clip((x[-dense:] - self.centre) / self.spread, -4, 4) / 2
        return x

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        x = self.scaled(ids, x)
        vx = self.factors[ids] * x[:, None]
        z = self.bias + float(self.weights[ids] @ x) + 0.5 * float((vx.sum(0) ** 2).sum() - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: QualityConfig) -> FactorisationMachine:
    """Mini-batch AdaGrad on the logistic loss, in a fixed order."""
    dense = STATISTICS + len(config.metadata)
    size = config.buckets + dense
    rng = np.random.default_rng(config.seed)
    fixed = np.array([x[-dense:] for _, x in rows])
    model = FactorisationMachine(
        weights=np.zeros(size), factors=rng.normal(0, 0.01, (size, config.factors)), config=config,
        centre=fixed.mean(0), spread=fixed.std(0) + 1e-6,
    )
    rows = [(i, model.scaled(i, x)) for i, x in rows]
    gw, gv, gb = np.full(size, 1e-6), np.full(model.factors.shape, 1e-6), 1e-6
    for _ in range(config.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), config.batch):
            part = order[k : k + config.batch]
            ids = np.concatenate([rows[r][0] for r in part])
            x = np.concatenate([rows[r][1] for r in part])
            lengths = np.array([len(rows[r][0]) for r in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = model.factors[ids] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = model.bias + np.add.reduceat(model.weights[ids] * x, starts)
            z += 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            missed = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            slope = np.repeat(missed, lengths) * x
            used, where = np.unique(ids, return_inverse=True)
            dw = np.bincount(where, slope, len(used)) + config.ridge * model.weights[used]
            by_row = slope[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(where, by_row[:, f], len(used)) for f in range(config.factors)], axis=1)
            dv += config.ridge * model.factors[used]
            db = float(missed.sum())
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += db * db
            model.weights[used] -= config.rate * dw / np.sqrt(gw[used])
            model.factors[used] -= config.rate * dv / np.sqrt(gv[used])
            model.bias -= config.rate * db / np.sqrt(gb)
    return model


def _extra(docs: DataFrame, config: QualityConfig):
    """The metadata columns as one array; a column that is missing, null or not finite counts as 0."""
    have = {c.lower() for c in docs.columns}
    finite = lambda c: F.when(F.abs(c) < F.lit(1e300), F.log1p(F.greatest(c, F.lit(0.0)))).otherwise(0.0)
    values = [
        F.coalesce(finite(F.expr(f"try_cast(`{c}` as double)")), F.lit(0.0)) if c.lower() in have else F.lit(0.0)
        for c in config.metadata
    ]
    return F.array(*values) if values else F.expr("cast(array() as array<double>)")


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> FactorisationMachine:
    """Train on ``labels.quality`` (0/1) of the rows that are not held out.

    No labelled row: every score is 1. One class only: every score is that class's smoothed share.
    """
    rows = labelled_rows(docs, labels, "quality", config.sample_rows, _extra(docs, config))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(config.buckets, config.known_words)
        for batch in batches:
            out = [features(t, list(e), buckets, config.buckets) for t, e in zip(batch["text"], batch["extra"], strict=True)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy(), "label": batch["label"].to_numpy(),
                "ids": [i.astype(np.int32).tobytes() for i, _ in out],
                "x": [x.astype(np.float32).tobytes() for _, x in out],
            })

    stored = durable(rows.mapInPandas(made, "doc_id long, label int, ids binary, x binary"))
    data = sorted(stored.collect(), key=lambda r: r.doc_id)  # at most sample_rows rows
    drop(stored)
    good = sum(r.label for r in data)
    if not data or good in (0, len(data)):
        return FactorisationMachine(prior=(good + 1) / (len(data) + 2) if data else 1.0, config=config)
    return train(
        [(np.frombuffer(r.ids, np.int32).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float)) for r in data],
        np.array([r.label for r in data], float), config,
    )


def quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text, metadata columns).

    predicted is 1 from a score of 0.3 on. Null and empty texts have zero word features and
    statistics. Repeated rows get a row each. A null id is not held out. An empty table gives no
    rows; columns that are neither text nor named metadata are not looked at.
    """
    model = fit(docs, labels, config)
    if model.weights is not None:
        model.weights, model.factors = model.weights.astype(np.float32), model.factors.astype(np.float32)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        buckets = Buckets(config.buckets, config.known_words)
        for texts, extras in batches:
            yield pd.Series(
                [model.score(*features(t, list(e), buckets, config.buckets)) for t, e in zip(texts, extras, strict=True)],
                dtype=float,
            )

    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out"),
        score(F.col("text"), _extra(docs, config)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
