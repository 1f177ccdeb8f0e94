"""Hard negatives, nearest neighbours and resampling against brute force, on small rows with odd cases."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import anntree, hardneg, importance, queries
from loomgraph.llm.common import cut, table
from loomgraph.numbering import running_number

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def odd_vectors(n=400, d=6, seed=3):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.4), 3) for _ in range(d)], rng.randrange(3), "x") for i in range(n)]
    rows += [(n + i, rows[7][1], rows[7][2], "x") for i in range(60)]  # many copies of one vector
    rows += [(700, None, 1, "x"), (800, [0.1] * d, None, "x"), (900, [math.nan] + [0.1] * (d - 1), 1, "x"), (1000, [None] + [0.1] * (d - 1), 1, "x")]
    rows += [(1100, [0.0] * d, 2, "x"), (1200, [math.inf] * d, 2, "x"), (None, [0.1] * d, 1, "x"), (1300, [0.5, 0.25], 1, "x"), (1301, [0.25, 0.5], 1, "x"), (1302, [0.5, 0.24], 2, "x")]
    return rows + [rows[20], rows[21]]  # repeated rows


def plain_negatives(rows):
    fine = [(i, [math.floor(256 * x) for x in v], l) for i, v, l, _ in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, l in {a: (a, b, c) for a, b, c in sorted(fine, key=lambda r: (r[2], r[1]), reverse=True) if a % 100 == 0}.values():
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in fine if j != i and len(w) == len(v))
        for ps, pos, _ in [x for x in others if x[2] == l][:5]:
            some = [(j, -s) for s, j, m in others if m != l and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(i, pos, r, j, -ps, s) for r, (j, s) in enumerate(some, 1)]
    return sorted(out)


def mined(rows):
    got = hardneg.mine(rows, rows.where("vec_id % 100 = 0"))
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l, x) for i, v, l, x in rows]


@pytest.mark.parametrize("numbers", [1 << 20, 64])
def test_hard_negatives_are_all_and_exact(spark, monkeypatch, numbers):
    monkeypatch.setattr("loomgraph.llm.blocks.BLOCK_NUMBERS", numbers)  # 64: many blocks of anchors
    rows = as_floats(odd_vectors())
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_negatives(rows)


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    exact = [(i, [float(np.float32(x)) for x in v], l, "x") for i, (v, l) in enumerate([([1e7, 3.0], 0), ([1e7, 1.0], 0), ([9e6, -2.0], 1), ([1.0, 2.0], 1)] * 30)]
    assert mined(spark.createDataFrame(exact, SCHEMA)) == plain_negatives(exact)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, "x")], SCHEMA)) == []


@pytest.mark.parametrize("d, low, high", [(1, -3, 3), (64, -300, 300), (7, 0, 5), (300, -70000, 70000), (3, -5, -2)])
def test_packed_products(d, low, high):
    rng = np.random.default_rng(d)
    v, a = rng.integers(low, high + 1, (37, d)), rng.integers(low, high + 1, (5, d))
    block = hardneg.Packed(v, max(1, int(abs(a).max())))
    assert block.fits and (block.fields > 1 or d == 300)
    assert (block.scores(a) == a @ v.T).all()


def found(rows, **more):
    got = anntree.search(rows, rows.where("vec_id % 100 = 0"), **more)
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def plain_neighbours(rows, d, k=10):
    fine = [(i, v) for i, v, *_ in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sorted(fine, key=lambda r: (r[0], r[1]), reverse=True):
        if i % 100 == 0:
            out[i] = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), j) for j, w in fine if j != i)[:k]
    return out


@pytest.mark.parametrize("numbers", [1 << 20, 64])
def test_all_neighbours_where_all_leaves_are_visited(spark, monkeypatch, numbers):
    monkeypatch.setattr("loomgraph.llm.blocks.BLOCK_NUMBERS", numbers)
    rows = as_floats(odd_vectors())
    monkeypatch.setattr(anntree.Index, "calibrated", lambda self, *_: (self.tree.leaves, 1.0))
    got, want = found(spark.createDataFrame(rows, SCHEMA)), plain_neighbours(rows, 6)
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for _, j in want[q]] and np.allclose([s for _, s in got[q]], [s for s, _ in want[q]], atol=1e-12)


def test_few_rows_and_none(spark):
    rows = as_floats(odd_vectors(30))[:5]
    rows = [(100 * i, *r[1:]) for i, r in enumerate(rows)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in plain_neighbours(rows, 6).items()}
    assert found(spark.createDataFrame([], SCHEMA)) == {} and found(spark.createDataFrame([(1, [1.0], 1, "x")], SCHEMA)) == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_the_whole_table(spark, sf):
    folder = SF.replace("sf0.01", sf)
    rows = [(r.vec_id, r.embedding, r.label, "x") for r in table(spark, folder, "embeddings").collect()]
    got = {}
    for r in queries.op12_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = plain_neighbours(rows, len(rows[0][1]))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len(set(got[q]) & {j for _, j in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_best_bin_first_takes_the_nearest_cells():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(c, 0.1, (200, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    tree = anntree.Tree(rows)
    leaves = tree.leaf_of(rows)
    order = list(tree.best_first(np.array([0.0, 0.0])))
    assert sorted(order) == list(range(tree.leaves)) and set(np.unique(leaves)) <= set(order)
    own = [x for x in order if x in set(leaves[:200].tolist())]
    assert order[: len(own)] == own
    sizes = np.bincount(leaves, minlength=tree.leaves)
    assert sizes[tree.visited(np.array([0.0, 0.0]), 1, sizes, 150)].sum() >= 150


# ------------------------------------------------------------------------------------------------ resampling

TEXTS = [None, "", " ,; ", "One", "the cat sat on the mat " * 9, "Das Örtchen, déjà vu! 12 " * 7, "a b\x00c　d é " * 5, "Straße ÄÖ \U0001f600x " * 6, "x" * 50, "benchmark words are here again and again " * 4]


def plain_resampling(docs, target, percent, longest, buckets, least, seed):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for sums, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in runs(x)[1]:
                sums[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = runs(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("percent, longest, buckets, least", [(10, 1, 10_000, 20), (50, 3, 500, 0), (100, 2, 70_000, 5), (0, 1, 10, 1)])
def test_resampling(spark, monkeypatch, percent, longest, buckets, least):
    monkeypatch.setattr(importance, "PIECE", 16)  # texts are walked in many pieces
    docs = [(i, f"{TEXTS[i % len(TEXTS)] or ''}{' w' * (i % 37)}" if i % 10 else TEXTS[i % len(TEXTS)]) for i in range(300)] + [(None, "one two three " * 9), (7, TEXTS[4]), (7, TEXTS[4])]
    target = ["again and again the cat", None, "vu 12"]
    rows = spark.createDataFrame([(i, x, "v", 1, {"k": 1}) for i, x in docs], "doc_id long, text string, weight string, n_words int, rank map<string,int>").repartition(5)
    got = importance.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), percent, longest, buckets, least, 2024)
    have = got.select("_row.doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, have), key=repr) == plain_resampling(docs, target, percent, longest, buckets, least, 2024)
    assert got.select("_row.*").columns == ["doc_id", "weight", "n_words", "rank"]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none).select("rank").first()[0] is None


def test_running_numbers_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k"), (F.col("id") % 5).alias("o"), F.col("id").alias("x"))
    got = running_number(rows, [F.desc("o")], "n", cut, ["k"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.n, r.o))
    for v in by.values():
        v.sort()
        assert [n for n, _ in v] == list(range(1, len(v) + 1)) and [o for _, o in v] == sorted((o for _, o in v), reverse=True)
    assert sorted(r.n for r in running_number(rows, [F.asc("o"), F.asc("x")], "n", cut).collect()) == list(range(1, 5001))
