"""Quality: a compression classifier with zstandard dictionaries.

Two dictionaries are built, one from good and one from bad labelled texts. A text is compressed with each,
in blocks (so that a repetitive text can't hide behind its own repetitions); the difference of the two sizes,
divided by their sum, says which kind it resembles, and a logistic curve fitted on labelled
texts that the dictionaries haven't seen turns it into the probability of label 1.

It learns from a bounded sample: about `per_class` texts of each label, whatever their length (the dictionaries are built
on the driver from half of them, of each text MOST_BLOCKS blocks at most, taken evenly from all of it; the other half is
scored whole on the executors and only its scores come back). The broadcast model is two dictionaries of DICT_BYTES and two numbers.

Defined cases: null and empty texts score as a difference of 0; without both labels to learn from every text scores
the share of label 1 (0.0 without labels); null ids and labels are not learned from; texts of any
length are scored whole, block by block; repeated rows get equal results; other columns are
carried along unseen, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, sample_by_label, small_side

DICT_BYTES = 110 << 10
PER_CLASS = 1500
LEVEL = 3
BLOCK = 1024
#: Blocks of a text that a dictionary is built from, at most: 3,000 texts give 60 MB at most.
MOST_BLOCKS = 20


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float, bias: float):
        self.good, self.bad, self.slope, self.bias = good, bad, slope, bias


class Scorer:
    """The two compressors of a model, made once for each task."""

    def __init__(self, m: Model):
        self.m = m
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICT_BYTES, source_size=BLOCK, write_content_size=0, write_dict_id=0)
        self.pair = []
        for data in (m.good, m.bad):
            if data:
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(compression_params=params)
                self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) of the compressed sizes, from -1 to 1."""
        raw = memoryview((text or "").encode("utf-8", "surrogatepass"))
        if not len(raw) or len(self.pair) < 2:
            return 0.0
        good, bad = (sum(len(c.compress(raw[k : k + BLOCK])) for k in range(0, len(raw), BLOCK)) for c in self.pair)
        return (bad - good) / (bad + good)


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """slope and bias of a logistic curve by Newton's method, with a weak pull of the slope toward 0."""
    a, b = np.zeros(2), 1e-3
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (p - y) + np.array([b * a[0], 0])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([b, 1e-6]), grad)
        a = a - step * min(1.0, 20 / (1e-9 + np.abs(step).max()))
    return float(a[0]), float(a[1])


def even_blocks(text: str) -> bytes:
    """Up to MOST_BLOCKS blocks of a text, evenly from its begin to its end."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = range(0, len(raw), BLOCK)
    if len(starts) > MOST_BLOCKS:
        starts = [starts[i * (len(starts) - 1) // (MOST_BLOCKS - 1)] for i in range(MOST_BLOCKS)]
    return b"".join(raw[k : k + BLOCK] for k in starts)


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [r[k : k + BLOCK] for r in texts for k in range(0, len(r), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to pick from: the texts themselves are the dictionary
        return b"".join(blocks)[-DICT_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learns from docs (doc_id and text) that `labels` (doc_id and a label of 0 or 1) names.

    The sample is drawn from the labels alone, so that only its ids meet the texts.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    prior = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = prior.get(1, 0) / max(1, sum(prior.values()))
    flat = Model(b"", b"", 0.0, float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    if len(prior) < 2:
        return flat
    drawn = cut(sample_by_label(rows, label, per_class).select("doc_id", F.col(label).cast("int").alias("y")))
    text = F.coalesce(text_col, F.lit(""))
    half = F.pmod(F.xxhash64(text, F.lit(3)), F.lit(2))
    sample = docs.join(small_side(drawn, drawn.count()), "doc_id").select("y", text.alias("t"), half.alias("half"))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([even_blocks(t.as_py()) for t in batch.column(1)], pa.binary())], names=["y", "b"])

    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for y, b in in_arrow(sample.where("half = 0 and t != ''").select("y", "t"), taken, "y int, b binary").distinct().orderBy("y", "b").collect():
        parts[y].append(bytes(b))
    if not parts[0] or not parts[1]:
        return flat
    model = Model(_dictionary(parts[1]), _dictionary(parts[0]), 0.0, 0.0)
    seen = score(sample.where("half = 1"), model, "t").select("_row.y", "difference").toPandas()
    if seen["y"].nunique() < 2:
        return flat
    model.slope, model.bias = _curve(seen["difference"].to_numpy(), seen["y"].to_numpy(float))
    n1 = float(seen["y"].sum())
    # The sample holds the labels in other shares than the rows do.
    model.bias += float(np.log(share / (1 - share)) - np.log(n1 / (len(seen) - n1)))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(_row, difference, score): each row of docs without its text, with its score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(docs[text_col].alias("_text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = np.array([scorer.difference(t.as_py()) for t in batch.column(0)])
            scores = 1 / (1 + np.exp(-np.clip(shared.value.slope * found + shared.value.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64()), pa.array(scores, pa.float64())], names=["_row", "difference", "score"])

    return in_arrow(packed, run, packed.select("_row").schema.add("difference", "double").add("score", "double"))
