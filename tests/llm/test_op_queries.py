"""The registered queries of the text operators: their columns, the held-out rows, and scores against plain Python."""

import math
from collections import Counter
import os
import re
import unicodedata
import zlib

import numpy as np
import pytest
import zstandard

from loomgraph.llm import langid, quality, queries, toxicity
from loomgraph.llm.common import held_out, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op8_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
MASK = (1 << 64) - 1


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    have = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert {c: have.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def checked(rows, docs):
    """Every row of the table once, with the fifth that is held out."""
    assert {r.doc_id for r in rows} == set(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_languages_by_plain_em(spark, docs):
    model = langid.fit(table(spark, SF, "documents").where(~held_out("doc_id")))
    rows = queries.op1_language_id(spark, SF).collect()
    checked(rows, docs)

    def spread(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & MASK
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & MASK
        return x ^ x >> 31

    def mixture(text):
        low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
        low = f" {re.sub(' +', ' ', low).lstrip()} "
        if not any(unicodedata.category(c)[0] == "L" for c in low):
            return "und", 0.0
        seen = [spread(ord(low[i]) << 42 | ord(low[i + 1]) << 21 | ord(low[i + 2])) >> 48 for i in range(len(low) - 2)]
        p, n, m = [[float(x) for x in model.p[g]] for g in seen], len(seen), len(model.languages)
        price = langid.PENALTY + 0.5 * math.log(n)
        fit_of = lambda s: sum(math.log(sum(s[k] * row[k] for k in s)) for row in p)
        shares = {max(range(m), key=lambda k: sum(math.log(row[k]) for row in p)): 1.0}
        while len(shares) < m:
            slope = {k: sum(row[k] / sum(shares[j] * row[j] for j in shares) for row in p) / n for k in range(m) if k not in shares}
            k = max(slope, key=slope.get)
            new = {j: 0.9 * v for j, v in shares.items()} | {k: 0.1}
            before = -math.inf
            for _ in range(40):
                if (now := fit_of(new)) - before < 1e-3:
                    break
                before = now
                weight = {j: sum(new[j] * row[j] / sum(new[i] * row[i] for i in new) for row in p) for j in new}
                new = {j: w / sum(weight.values()) for j, w in weight.items()}
            if fit_of(new) - fit_of(shares) <= price:
                break
            shares = new
        best = min(shares, key=lambda k: (-shares[k], k))
        return model.languages[best], min(1.0, shares[best])

    short = [r for r in rows if len(docs[r.doc_id] or "") < 1500]
    assert len(short) > 50
    for r in short:
        lang, score = mixture(docs[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 2e-3


def test_toxicity_by_plain_sums(spark, docs):
    model = toxicity.fit(*queries.to_learn_from(spark, SF))
    rows = queries.op2_toxicity(spark, SF).collect()
    checked(rows, docs)
    for r in rows:
        low, found = f" {(docs[r.doc_id] or '').lower()} ", set()
        if len(low) > 4000:
            continue
        for n in toxicity.SIZES:
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) & MASK
                found.add(int(model.index[h * 0x9E3779B97F4A7C15 % (1 << 64) >> 44]))
        z = sum(float(model.weight[f]) for f in found if f >= 0) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_quality_by_plain_compression(spark, docs):
    model = quality.fit(*queries.to_learn_from(spark, SF))
    rows = queries.op10_quality(spark, SF).collect()
    checked(rows, docs)
    params = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, dict_size=quality.DICT_BYTES, source_size=quality.BLOCK, write_content_size=0, write_dict_id=0)
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=params) for d in (model.good, model.bad)]
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        good, bad = (sum(len(t.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK)) for t in tools)
        x = (bad - good) / (bad + good) if raw else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-(model.slope * x + model.bias)))) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_blocks_are_taken_from_all_of_a_text():
    text = "".join(f"{i:04d}" for i in range(10_000))
    got = quality.even_blocks(text)
    assert len(got) <= quality.MOST_BLOCKS * quality.BLOCK and got.startswith(text[:100].encode()) and got.endswith(text[-50:].encode())
    assert quality.even_blocks("short") == b"short"


@pytest.mark.parametrize("least, most", [(None, None), (0.5, None), (0.5, 500)])
def test_toxic_features_by_plain_counts(spark, docs, monkeypatch, least, most):
    """The features that the fit chooses, from counts of texts in plain Python; all labelled texts fit into its sample here, and few of its
    features tell much, so weaker ones are asked for too, all or the best 500."""
    monkeypatch.setattr(toxicity, "LEAST_Z", least or toxicity.LEAST_Z)
    monkeypatch.setattr(toxicity, "FEATURES", most or toxicity.FEATURES)
    learn, labels = queries.to_learn_from(spark, SF)
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    texts = [(y[r.doc_id], r.text or "") for r in learn.select("doc_id", "text").collect() if r.doc_id in y]
    sizes, seen = Counter(k for k, _ in texts), {0: Counter(), 1: Counter()}
    assert max(sizes.values()) <= toxicity.PER_CLASS
    for k, text in texts:
        low = f" {text.lower()} "
        grams = {low[i : i + n] for n in toxicity.SIZES for i in range(len(low) - n + 1)}
        hashed = set()
        for g in grams:
            h = 0
            for c in g:
                h = (h * 0x100000001B3 + ord(c)) & MASK
            hashed.add(h * 0x9E3779B97F4A7C15 % (1 << 64) >> 44)
        seen[k].update(hashed)
    s, z = toxicity.SMOOTH, {}
    for b in seen[0].keys() | seen[1].keys():
        good, bad = seen[0][b] + s, seen[1][b] + s
        z[b] = abs(math.log(bad / (sizes[1] + 2 * s)) - math.log(good / (sizes[0] + 2 * s))) / math.sqrt(1 / good + 1 / bad)
    model = toxicity.fit(learn, labels)
    chosen = np.flatnonzero(model.index >= 0).tolist()
    ranked = sorted((b for b in z if z[b] >= toxicity.LEAST_Z), key=lambda b: (-z[b], b))[: toxicity.FEATURES]
    assert len(chosen) == len(ranked) > (100 if least else 0)
    place = sorted(chosen, key=lambda b: model.index[b])
    assert np.allclose([z[b] for b in place], [z[b] for b in ranked], atol=1e-9)  # the same but for ties
