"""Hard negatives by exact integer scores: Kronecker-packed products of every anchor with every row.

The components of several rows of a block are biased to be non-negative and put into separated fields of one 64-bit integer each;
one product with an anchor's component multiplies them all, the sums over the components can't pass their field, and the
fields are unpacked and freed of the bias. Anchors are a stated query set: they are broadcast in blocks of bounded size and
rows are scanned where they are; a task sends the few best of each anchor. Two scans a block: an anchor's positives, then,
between the bounds that a positive's score sets, its negatives.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors meet only
vectors of their own length, an empty one scores 0; each repeated row counts as a row, but no row with the anchor's own id is
its partner, and of several anchors with one id the one with the smallest label and vector counts; ties go to the smaller id;
an empty table, or one without anchors, gives an empty result; where components are too large for 64-bit fields
Python's integers take their place, and scores beyond 64 bits are held at the ends of that range.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Best, by_length, finite, in_blocks, matrix
from .common import cut, in_arrow, scratch

#: Rows of one packed block, and anchors multiplied with it at a time: 0.5 MB of 64-bit sums stay in a core's cache.
ROWS, ANCHORS = 2048, 64
LARGEST = sys.float_info.max


def quantised(rows: DataFrame, vec_id: str, vec: str, label: str, scale: float) -> DataFrame:
    """(id, label, v) of the rows that take part, with v = floor(scale * x), whole numbers as doubles."""
    valid = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite(F.col(vec)))

    def whole_number(x: Column) -> Column:
        y = F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y)  # a larger double is whole

    whole = F.transform(vec, whole_number)
    return valid.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))


class Packed:
    """A block of rows with several rows' components in the fields of each 64-bit integer."""

    def __init__(self, v: np.ndarray, most: int):
        """v: rows x components, int64; most: the largest size of an anchor's component."""
        self.n, d = v.shape
        self.row_bias, self.anchor_bias = max(0, -int(v.min(initial=0))), most
        top = (int(v.max(initial=0)) + self.row_bias) * 2 * most * d
        self.width = max(1, top.bit_length())
        self.fits = self.width <= 63
        if not self.fits:
            self.v = v.astype(object)
            return
        self.fields = 64 // self.width
        self.words = -(-self.n // self.fields)
        biased = np.zeros((self.words * self.fields, d), np.uint64)
        biased[: self.n] = (v + self.row_bias).astype(np.uint64)
        shifts = (np.arange(self.fields, dtype=np.uint64) * np.uint64(self.width))[:, None, None]
        # Field f of word w is row f * words + w; components first, so that each is one contiguous line.
        self.packed = np.ascontiguousarray((biased.reshape(self.fields, self.words, d) << shifts).sum(0, dtype=np.uint64).T)
        self.sums = v.sum(1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x rows."""
        if not self.fits:
            full = anchors.astype(object) @ self.v.T if self.v.shape[1] else np.zeros((len(anchors), self.n), object)
            ends = np.iinfo(np.int64)
            return np.clip(full, ends.min, ends.max).astype(np.int64)
        d = self.packed.shape[0]
        raised = (anchors + self.anchor_bias).astype(np.uint64)
        total = np.zeros((len(anchors), self.words), np.uint64)
        step = np.empty_like(total)
        for j in range(d):  # one product multiplies the component of all rows in a word
            np.multiply(raised[:, j, None], self.packed[j], out=step)
            total += step
        mask = np.uint64((1 << self.width) - 1)
        parts = [((total >> np.uint64(f * self.width)) & mask).astype(np.int64) for f in range(self.fields)]
        out = np.concatenate(parts, axis=1)[:, : self.n]
        # sum (a + p)(c + q) = sum ac + q sum a + p sum c + d p q
        return out - self.row_bias * anchors.sum(1)[:, None] - self.anchor_bias * self.sums - d * self.anchor_bias * self.row_bias


class Anchors:
    """A block of anchors by vector length: ids, labels and whole components; with positives also the bounds of each."""

    def __init__(self, rows: pa.Table, positives: int = 0):
        self.id = rows.column("id").to_numpy()
        self.label = rows.column("label").to_numpy()
        lengths, flat = matrix(rows.column("v").combine_chunks()) if rows.num_rows else (np.zeros(0, np.int64), np.zeros(0))
        self.groups = {d: (at, _whole(v)) for d, at, v in by_length(lengths, flat)}
        self.most = {d: max(1, int(abs(v).max(initial=0))) for d, (_, v) in self.groups.items()}
        self.n = rows.num_rows
        self.positive = np.full((self.n, positives), np.iinfo(np.int64).min)
        self.lowest = np.full((self.n, positives), np.iinfo(np.int64).max)

    def bound(self, at: np.ndarray, rank: np.ndarray, score: np.ndarray, from_share: int, to_share: int) -> None:
        """The scores s with from_share * score <= to_share * s <= to_share * score."""
        self.positive[at, rank] = score
        self.lowest[at, rank] = [-((-from_share * int(x)) // to_share) for x in score]


def _whole(v: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python's integers where one is too large."""
    return v.astype(np.int64) if not v.size or abs(v).max() < 1 << 31 else np.array([[int(x) for x in r] for r in v], object).reshape(v.shape)


def _scored(batches: Iterator[pa.RecordBatch], anchors: Anchors, pairs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor numbers, ids of rows, which label each has, scores) for each part of a block that `pairs` names."""
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for d, rows, v in by_length(*matrix(batch.column(2))):
            if d not in anchors.groups:
                continue
            at, a = anchors.groups[d]
            v = _whole(v)
            order = np.lexsort((ids[rows], labels[rows]))
            rows, v = rows[order], v[order]
            for start in range(0, len(rows), ROWS):
                part = rows[start : start + ROWS]
                yield from pairs(at, a, ids[part], labels[part], v[start : start + ROWS], anchors.most[d])


def positives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(anchor, rank, id, score): the first k other rows of each anchor's label; anchor is its number in the block."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own.n, k)

        def pairs(at, a, ids, labels, v, most):  # noqa: ANN001, ANN202
            for label in np.unique(labels):
                same, here = np.flatnonzero(own.label[at] == label), labels == label
                if len(same):
                    packed = _packed(v[here], a, most)
                    for i in range(0, len(same), ANCHORS):
                        some = same[i : i + ANCHORS]
                        yield at[some], ids[here], labels[here], packed.scores(a[some])

        for at, ids, _, scores in _scored(batches, own, pairs):
            r, c = np.nonzero(best.may_enter(scores, at) & (own.id[at][:, None] != ids))
            best.add(at[r], scores[r, c], ids[c])
        row, score, ids = best.found()
        yield pa.RecordBatch.from_pydict({"anchor": row, "id": ids, "score": score})

    found = in_arrow(rows, run, "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(v: np.ndarray, anchors: np.ndarray, most: int) -> Packed:
    """Python's integers on either side need the general form."""
    if v.dtype == object or anchors.dtype == object:
        block = Packed(np.zeros((0, v.shape[1]), np.int64), 1)
        block.fits, block.v, block.n = False, v.astype(object), len(v)
        return block
    return Packed(v, most)


def negatives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(anchor, positive, rank, id, score): the first k rows of other labels between the bounds of each positive."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        per = own.positive.shape[1]
        best = [Best(own.n, k) for _ in range(per)]

        def pairs(at, a, ids, labels, v, most):  # noqa: ANN001, ANN202
            packed = _packed(v, a, most)
            for i in range(0, len(at), ANCHORS):
                yield at[i : i + ANCHORS], ids, labels, packed.scores(a[i : i + ANCHORS])

        for at, ids, labels, scores in _scored(batches, own, pairs):
            other = own.label[at][:, None] != labels
            for p in range(per):
                inside = other & (scores >= own.lowest[at, p, None]) & (scores <= own.positive[at, p, None])
                r, c = np.nonzero(inside & best[p].may_enter(scores, at))
                best[p].add(at[r], scores[r, c], ids[c])
        for p, b in enumerate(best):
            row, score, ids = b.found()
            yield pa.RecordBatch.from_pydict({"anchor": row, "positive": np.full(len(row), p, np.int32), "id": ids, "score": score})

    found = in_arrow(rows, run, "anchor long, positive int, id long, score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, from_share: int = 80, to_share: int = 100, scale: float = 256.0,
    vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each block of anchors, its positives (n_positives rows an anchor) and nothing else reach the driver, bounded by BLOCK_NUMBERS.
    """
    spark = rows.sparkSession
    whole = quantised(rows, vec_id, vec, label, scale)
    chosen = cut(quantised(anchors, vec_id, vec, label, scale).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    longest = chosen.agg(F.max(F.size("v"))).first()[0] or 1
    folder = f"{scratch(spark)}/negatives-{uuid.uuid4().hex}"
    for some in in_blocks(chosen, "id", longest + 4 * n_positives):
        own = Anchors(some.orderBy("id").toArrow(), n_positives)
        near = positives(whole, own, n_positives).toArrow()
        at, rank, score, ids = (near.column(c).to_numpy() for c in ("anchor", "rank", "score", "id"))
        own.bound(at, rank - 1, score, from_share, to_share)
        links = {"anchor": at, "positive": (rank - 1).astype(np.int32), "anchor_id": own.id[at], "positive_id": ids, "positive_score": score}
        found = negatives(whole, own, n_negatives).join(F.broadcast(spark.createDataFrame(pa.table(links))), ["anchor", "positive"])
        out = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)
