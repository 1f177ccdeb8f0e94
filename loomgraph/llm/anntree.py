"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (SAMPLE_NUMBERS components); every row goes down to its leaf where it is read, and the index is
written by leaf, a large leaf in several parts. A query takes cells from a priority queue, nearest centre first, and visits the leaves
it meets. How many is calibrated: the visits of a bounded set of queries are widened until the leaves visited hold the wanted share of
their true neighbours, which a scan of all rows gives. Queries are broadcast in blocks of bounded size with the leaves they visit; rows
are compared where they lie, and a task sends the few nearest of each query.

Defined cases: rows with a null id, a null vector, a null or non-finite component, or only zeros take no part, nor do those of another
length than the most frequent (the smaller one, if two are); each repeated row counts as a row, but no row with the query's own id is
found, and of several queries with one id the one with the smallest vector counts; ties go to the smaller id; an empty table, or
one without queries, gives an empty result; a query visits leaves until they hold k rows beside its own, so that all rows are
returned where there are at most k.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Best, finite, in_blocks, matrix
from .common import chosen, cut, in_arrow, scratch

#: Components of the sample that the tree is fitted on (32 MB), and rows of it in a leaf, about.
SAMPLE_NUMBERS, LEAF = 1 << 22, 24
#: Children of a cell, rounds of k-means in it, queries of the calibration and the share of their neighbours that is wanted.
BRANCHES, ROUNDS, TRIALS, WANTED = 8, 8, 200, 0.96


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all lines of a and b, by products (to about nine digits of the sizes)."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T))


class Tree:
    """Cells with their children's centres; a leaf has none and a number."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        self.children: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, rng)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        own = len(self.leaf)
        self.children.append(np.zeros(0, np.int64))
        self.centres.append(np.zeros((0, rows.shape[1])))
        self.leaf.append(-1)
        parts = self._split(rows, rng) if len(rows) > LEAF else []
        if len(parts) < 2:
            self.leaf[own] = self.leaves
            self.leaves += 1
            return own
        self.centres[own] = np.stack([p.mean(0) for p in parts])
        self.children[own] = np.array([self._grow(p, rng) for p in parts])
        return own

    @staticmethod
    def _split(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        different = np.unique(rows, axis=0)
        centres = different[rng.choice(len(different), min(BRANCHES, len(different)), replace=False)]
        for _ in range(ROUNDS):
            at = distances(rows, centres).argmin(1)
            centres = np.stack([rows[at == k].mean(0) for k in np.unique(at)])
        at = distances(rows, centres).argmin(1)
        return [rows[at == k] for k in np.unique(at)]

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each line, by the nearest centre in each cell on the way down."""
        out = np.zeros(len(v), np.int32)
        todo = [(self.root, np.arange(len(v)))]
        while todo:
            cell, at = todo.pop()
            if self.leaf[cell] >= 0:
                out[at] = self.leaf[cell]
            elif len(at):
                near = distances(v[at], self.centres[cell]).argmin(1)
                todo += [(int(c), at[near == k]) for k, c in enumerate(self.children[cell])]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, in the order in which a priority queue of cells by their centres' distances gives them."""
        queue: list[tuple[float, int]] = [(0.0, self.root)]
        while queue:
            _, cell = heapq.heappop(queue)
            if self.leaf[cell] >= 0:
                yield self.leaf[cell]
            else:
                near = distances(q[None], self.centres[cell])[0]
                for d, c in zip(near.tolist(), self.children[cell].tolist(), strict=True):
                    heapq.heappush(queue, (d, c))

    def visited(self, q: np.ndarray, visits: int, rows: np.ndarray, least: int) -> list[int]:
        """The first leaves of `best_first`: so many visits, and on until they hold at least so many rows."""
        out, held = [], 0
        for leaf in self.best_first(q):
            if len(out) >= visits and held >= least:
                break
            out.append(leaf)
            held += int(rows[leaf])
        return out


def _square(column: pa.ListArray) -> np.ndarray:
    lengths, flat = matrix(column)
    return flat.astype(float).reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 0))


class Queries:
    """A block of queries: ids, vectors and for each leaf which of them visit it (all of them visit leaf -1)."""

    def __init__(self, rows: pa.Table):
        self.id = rows.column("id").to_numpy()
        self.n = len(self.id)
        self.v = _square(rows.column("v").combine_chunks()) if self.n else np.zeros((0, 0))
        self.by_leaf: dict[int, np.ndarray] = {}
        if "leaves" in rows.column_names and self.n:
            lengths, leaves = matrix(rows.column("leaves").combine_chunks())
            who = np.repeat(np.arange(self.n), lengths)
            order = np.argsort(leaves, kind="stable")
            at, starts = np.unique(leaves[order], return_index=True)
            self.by_leaf = dict(zip(at.tolist(), np.split(who[order], starts[1:]), strict=True))
        else:
            self.by_leaf = {-1: np.arange(self.n)}


def nearest(rows: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, rank, id, score): the k nearest rows (id, v, leaf) of each query among those in its leaves.

    Products rule rows out; the distance that counts is summed from the differences in double precision.
    """
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own.n, k, np.float64)
        for batch in batches:
            ids, v, leaves = batch.column(0).to_numpy(), _square(batch.column(1)), batch.column(2).to_numpy()
            for leaf in np.unique(leaves):
                who = own.by_leaf.get(int(leaf), own.by_leaf.get(-1))
                if who is None or not len(who):
                    continue
                inside = np.flatnonzero(leaves == leaf)
                for start in range(0, len(inside), 1024):
                    part = inside[start : start + 1024]
                    rough = distances(own.v[who], v[part])
                    slack = 1e-9 * ((own.v[who] ** 2).sum(1)[:, None] + (v[part] ** 2).sum(1))
                    r, c = np.nonzero(best.may_enter(-np.sqrt(np.maximum(0.0, rough - slack)), who) & (own.id[who][:, None] != ids[part]))
                    for i in range(0, len(r), 1 << 16):
                        q, x = who[r[i : i + (1 << 16)]], part[c[i : i + (1 << 16)]]
                        best.add(q, -np.sqrt(((own.v[q] - v[x]) ** 2).sum(1)), ids[x])
        row, score, found = best.found()
        yield pa.RecordBatch.from_pydict({"query": row, "id": found, "score": -score})

    found = in_arrow(rows.select("id", "v", "leaf"), run, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vectors(rows: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(id, v) of the rows with a vector that can be compared."""
    valid = rows.where(F.col(vec_id).isNotNull() & finite(F.col(vec)) & F.exists(vec, lambda x: x != 0))
    return valid.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v"))


class Index:
    """Rows by leaf in the shared folder, and the tree."""

    def __init__(self, rows: DataFrame, n: int, numbers: int):
        spark = rows.sparkSession
        share = min(1.0, SAMPLE_NUMBERS / max(1, n * numbers))
        sample = rows.where(chosen(F.col("id"), share)).select("v").toArrow()
        self.tree = tree = Tree(_square(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((1, numbers)))
        shared = spark.sparkContext.broadcast(tree)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = shared.value.leaf_of(_square(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])

        found = in_arrow(rows, assign, f"id long, v {rows.schema['v'].dataType.simpleString()}, leaf int")
        # Leaves are dealt in parts, by a share of the sample: one that holds many rows goes to many tasks.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        seen = np.bincount(tree.leaf_of(_square(sample.column("v").combine_chunks())), minlength=tree.leaves) if sample.num_rows else np.ones(tree.leaves)
        parts = np.maximum(1, np.ceil(2 * tasks * seen / max(1, seen.sum()))).astype(int)
        many = {int(leaf): int(parts[leaf]) for leaf in np.flatnonzero(parts > 1)}
        split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("leaf")), F.lit(1)) if many else F.lit(1)
        self.rows = cut(found.repartition("leaf", F.pmod(F.xxhash64("id"), split)).sortWithinPartitions("leaf"))
        self.sizes = np.zeros(tree.leaves, np.int64)
        for r in self.rows.groupBy("leaf").count().collect():  # one row a leaf
            self.sizes[r.leaf] = r[1]

    def calibrated(self, queries: DataFrame, k: int, wanted: float, trials: int = TRIALS) -> tuple[int, float]:
        """(visits, recall): the fewest visits whose leaves hold the wanted share of the trial queries' true neighbours."""
        n = queries.count()
        some = queries.where(chosen(F.xxhash64("id", F.lit(5)), min(1.0, trials / max(1, n)))).orderBy("id").limit(2 * trials).toArrow()
        own = Queries(some)
        if not own.n:
            return self.tree.leaves, 1.0
        near = cut(nearest(self.rows, own, k).select("query", "id"))  # k rows a trial
        true = self.rows.select("id", "leaf").join(F.broadcast(near), "id").select("query", "leaf").toArrow()
        place = np.zeros((own.n, self.tree.leaves), np.int64)
        for i, q in enumerate(own.v):
            place[i, list(self.tree.best_first(q))] = np.arange(self.tree.leaves)
        needed = np.sort(place[true.column("query").to_numpy(), true.column("leaf").to_numpy()])
        if not len(needed):
            return self.tree.leaves, 1.0
        visits = int(needed[min(len(needed), int(np.ceil(wanted * len(needed)))) - 1]) + 1
        return visits, float((needed < visits).mean())

    def search(self, queries: DataFrame, k: int, visits: int, numbers: int) -> DataFrame:
        """(query_id, rank, vec_id, score) of queries (id, v)."""
        shared, sizes = queries.sparkSession.sparkContext.broadcast(self.tree), self.sizes

        def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = [shared.value.visited(q, visits, sizes, k + 1) for q in _square(batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], names=["id", "v", "leaves"])

        schema = f"id long, v {queries.schema['v'].dataType.simpleString()}, leaves array<int>"
        routed = cut(in_arrow(queries, traverse, schema))
        spark, folder = queries.sparkSession, f"{scratch(queries.sparkSession)}/neighbours-{uuid.uuid4().hex}"
        for some in in_blocks(routed, "id", numbers + visits):
            own = Queries(some.orderBy("id").toArrow())
            names = F.broadcast(spark.createDataFrame(pa.table({"query": np.arange(own.n), "query_id": own.id})))
            out = nearest(self.rows, own, k).join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
            out.write.mode("append").parquet(folder)
        return spark.read.schema(out.schema).parquet(folder)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, wanted: float = WANTED, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest rows found, by Euclidean distance."""
    valid = vectors(rows, vec_id, vec)
    counts = sorted(((-r.n, r.d) for r in valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()))
    n, d = (-counts[0][0], counts[0][1]) if counts else (0, 1)
    valid = valid.where(F.size("v") == d)
    asked = cut(vectors(queries, vec_id, vec).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")))
    index = Index(valid, n, d)
    visits, _ = index.calibrated(asked, k, wanted)
    return index.search(asked, k, visits, d)
