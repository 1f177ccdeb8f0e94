"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. Each n-gram's weight starts from the log ratio of its
(smoothed) document frequencies in toxic and in other texts; the n-grams whose ratio is furthest
from chance become features with that ratio as value, and a logistic regression over them is fitted.

It learns from a bounded sample of labelled texts (`per_class`, about, of each label). The n-grams are
counted on the executors; at most BUCKETS counts, and of the sample at most FEATURES numbers of two bytes for
each text, come to the driver, where the regression is fitted. The model (FEATURES numbers and an
index of BUCKETS cells) is broadcast.

Defined cases: null and empty texts, and texts without a feature, score what the intercept says; without
both labels to learn from every text scores the share of label 1 (0.0 without labels); ids and labels that are null
are not learned from; texts of any length are walked in pieces; repeated rows get equal results; other
columns are carried along unseen, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, cut, in_arrow, mixed, points, sample_by_label, small_side

BUCKETS = 1 << 20
SIZES = (4, 5, 6)
FEATURES = 1 << 14
PER_CLASS = 4000
SMOOTH = 0.5
#: Standard errors that a log ratio must be away from 0.
LEAST_Z = 3.0
RIDGE = 0.3


def buckets(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text in lower case, in pieces that overlap so that none is lost."""
    low = f" {text.lower()} "
    for k in range(0, len(low), STEP):
        p = points(low[k : k + STEP + max(SIZES) - 1]).astype(np.uint64)
        for n in SIZES:
            if len(p) >= n:
                h = p[: len(p) - n + 1].copy()
                for j in range(1, n):
                    h *= np.uint64(0x100000001B3)
                    h += p[j : len(p) - n + 1 + j]
                h *= np.uint64(0x9E3779B97F4A7C15)
                yield (h >> np.uint64(44)).astype(np.int64)


class Model:
    """index[bucket]: the feature's number or -1; weight[feature]: regression weight times log-count ratio."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index, weight, bias

    def features(self, text: str | None) -> np.ndarray:
        found = [f[f >= 0] for f in (self.index[g] for g in buckets(text or ""))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def score(self, text: str | None) -> float:
        z = float(self.weight[self.features(text)].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _regression(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 300, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over sets of features with value ratio[feature], by steps scaled for each weight."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = ratio[flat]
    x = np.zeros(len(ratio) + 1)
    x[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, rounds + 1):
        z = np.bincount(at, value * x[flat], len(rows)) + x[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.append(np.bincount(flat, value * miss[at], len(ratio)) + RIDGE * x[:-1], miss.sum()) / len(rows)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        x = x - rate * (1 - t / (rounds + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learns from docs (doc_id and text) that `labels` (doc_id and a label of 0 or 1) names.

    The sample is drawn from the labels alone, so that only its ids meet the texts.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    prior = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = prior.get(1, 0) / max(1, sum(prior.values()))
    index = np.full(BUCKETS, -1, np.int32)
    if len(prior) < 2:
        return Model(index, np.zeros(1), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    drawn = cut(sample_by_label(rows, label, per_class).select("doc_id", F.col(label).cast("int").alias("y")))
    sample = docs.join(small_side(drawn, drawn.count()), "doc_id").select("y", F.col(text_col).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = [*buckets(text.as_py() or "")]
                if got:
                    sums[y, np.unique(np.concatenate(got))] += 1
        at = np.flatnonzero(sums.sum(0) > 0).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"g": pa.array(at), "a": pa.array(sums[0, at]), "b": pa.array(sums[1, at])})

    sums = in_arrow(sample, count, "g int, a int, b int").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = {r[0]: r[1] for r in drawn.groupBy("y").count().collect()}
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    a, b = F.col("a") + SMOOTH, F.col("b") + SMOOTH
    ratio = F.log(b / F.lit(n1 + 2 * SMOOTH)) - F.log(a / F.lit(n0 + 2 * SMOOTH))
    z = ratio / F.sqrt(1 / a + 1 / b)
    best = sums.select("g", ratio.alias("r"), F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "g").limit(FEATURES).toPandas()
    index[best["g"].to_numpy(np.int64)] = np.arange(len(best), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(Model(index, np.zeros(max(1, len(best))), 0.0))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shared.value.features(t.as_py()).astype(np.int16) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int16()))], names=["y", "f"])

    seen = in_arrow(sample, found, "y int, f array<smallint>").toArrow()
    y = seen.column("y").to_numpy().astype(float)
    w, bias = _regression([x.values.to_numpy() for x in seen.column("f")], y, best["r"].to_numpy())
    # The sample holds the labels in other shares than the rows do.
    bias += float(np.log(share / (1 - share)) - np.log(n1 / n0))
    return Model(index, w * best["r"].to_numpy() if len(best) else np.zeros(1), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(_row, score): each row of docs (without its text unless keep_text), with its score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if keep_text or c != text_col]
    packed = docs.select(docs[text_col].alias("_text"), F.struct(*[docs[c] for c in names]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(1), scores], names=["_row", "score"])

    return in_arrow(packed, run, packed.select("_row").schema.add("score", "double"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns stay as they are."""
    return score(docs, model, text_col, keep_text=True).where(F.col("score") < threshold).select("_row.*")
