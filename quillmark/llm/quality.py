"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of every whole text are computed once. Labelled rows of the learning folds
are lifted to random cosine features that approximate a Gaussian kernel; partitions sum
their normal equations, and the driver solves one small ridge system. Raw scores are
calibrated by isotonic regression over fixed bins, on rows the ridge fit has not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import settle

STATS = (
    "log_chars", "log_words", "word_len", "word_len_sd", "long_words", "upper", "digits", "punct", "symbols", "pipes", "bangs", "non_ascii",
    "upper_words", "title_words", "marked_words", "unique_words", "top_word", "top3_words", "word_repeats", "sentence_words", "stops_per_word",
    "log_lines", "line_dups", "line_words", "char_entropy", "short_words", "end_mark",
)
_PUNCT, _SYMBOL, _STOP = frozenset(".,;:!?'\"()-"), frozenset("$%&*#@^~=+<>{}[]\\/_`"), re.compile(r"[.!?]+(?:\s|$)")


def stats(text: str | None) -> list[float]:
    """The statistics of one whole text; zeros for a null or blank one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATS)
    n, m = len(text), len(words)
    chars = Counter(text)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lens = np.fromiter(map(len, words), np.float64, m)
    upper = punct = symbol = digit = non_ascii = 0
    entropy = 0.0
    for c, k in chars.items():
        entropy -= k / n * math.log(k / n)
        if c.isupper():
            upper += k
        elif c.isdigit():
            digit += k
        elif c in _PUNCT:
            punct += k
        elif c in _SYMBOL:
            symbol += k
        if ord(c) > 127:
            non_ascii += k
    lines = [x for x in text.split("\n") if x.strip()]
    stops = len(_STOP.findall(text))
    return [
        math.log1p(n), math.log1p(m), lens.mean(), lens.std(), float((lens > 12).mean()), upper / n, digit / n, punct / n, symbol / n, chars["|"] / m, chars["!"] / m, non_ascii / n,
        sum(w.isupper() for w in words) / m, sum(w[0].isupper() for w in words) / m, sum(not w[-1].isalnum() for w in words) / m, len(counts) / m, top[0] / m, sum(top) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, math.log1p(m / (stops + 1)), stops / m,
        math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), math.log1p(m / len(lines)), entropy, float((lens <= 3).mean()), float(text.rstrip()[-1] in ".!?"),
    ]


def _id_hash(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray  # statistics x features
    phase: np.ndarray
    beta: np.ndarray  # features and an intercept
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores, not falling

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale).clip(-8, 8) @ self.freq + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels).clip(0, 1)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, len(STATS)))


def isotonic(x: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x; knots are the pools' weighted centres."""
    pools: list[list[float]] = []
    for a, w, m in zip(x, weight, mean, strict=True):
        pools.append([a * w, w, m * w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def fit(labelled: DataFrame, features: int = 384, ridge: float = 1.0, width: float = 4.0, bins: int = 512, parts: int = 24, seed: int = 7) -> Model | None:
    """From rows ``doc_id, x array<double>, y double``; None where no row is labelled.

    What reaches the driver: one row of moments, ``features + 1`` rows of summed normal
    equations, ``bins`` rows of score sums, whatever the number of rows.
    """
    labelled = labelled.repartition(parts)  # a bounded sample; as many summed equations are shuffled
    k = len(STATS)
    sums = labelled.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)]).first()
    if not sums[0]:
        return None
    mean, scale = np.array(sums[1 : k + 1]), np.array(sums[k + 1 :])
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / width, (k, features)), rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    held = _id_hash(seed) < 200_000
    d = features + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, n = np.zeros((d, d + 1)), 0
        for pdf in batches:
            z = model.lift(_matrix(pdf["x"]))
            gram[:, :d] += z.T @ z
            gram[:, d] += z.T @ pdf["y"].to_numpy()
            n += len(pdf)
        if n:
            yield pd.DataFrame({"i": range(d), "row": list(gram)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})

    rows = labelled.where(~held).mapInPandas(equations, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    if rows:
        gram = np.zeros((d, d + 1))
        for r in rows:
            gram[r["i"]] = r["row"]
        penalty = np.eye(d) * ridge
        penalty[-1, -1] = 1e-9
        model.beta = np.linalg.solve(gram[:, :d] + penalty, gram[:, d])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = model.raw(_matrix(pdf["x"]))
            yield pd.DataFrame({"bin": ((raw + 0.5) / 2 * bins).clip(0, bins - 1).astype(int), "raw": raw, "y": pdf["y"].to_numpy()})

    seen = labelled.where(held) if labelled.where(held).limit(1).count() else labelled
    hist = seen.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).orderBy("bin").toPandas()
    model.knots, model.levels = isotonic(hist["raw"].to_numpy(), hist["n"].to_numpy(float), hist["y"].to_numpy())
    return model


def score_quality(docs: DataFrame, labels: DataFrame, learn=None, max_labels: int = 400_000, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(doc_id, *carry, score, predicted)``, one for each row of ``docs``.

    ``labels`` are ``doc_id, quality``; several labels of one document average, null ones
    don't count. Only documents for which ``learn`` (a condition on doc_id; default: all)
    holds are learned from, by a hash of doc_id at most about ``max_labels`` of them
    (documented bound of the fit; every document is scored). The calibration is fitted on
    the labelled rows held back from the ridge fit; where none fell among them, on all
    labelled rows, seen ones included. Without any label the score is 0.5. A null, empty or blank text is scored by zero statistics. Columns of ``docs``
    other than doc_id, text and ``carry`` are ignored.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} {kinds[c]}" for c in carry)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([stats(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), x], ["doc_id", *carry, "x"])

    described = settle(docs.select("doc_id", *carry, F.col("text").cast("string").alias("text")).mapInArrow(describe, f"{schema}, x array<double>"))
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        marks = marks.where(learn)
    marks = marks.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    share = min(1.0, max_labels / max(1, marks.count()))
    marks = marks.where(_id_hash(99) < int(share * 1_000_000))
    model = fit(described.select("doc_id", "x").join(marks, "doc_id"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"))], ["doc_id", *carry, "score", "predicted"])

    return described.mapInArrow(scored, f"{schema}, score double, predicted int")


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string")) % folds
