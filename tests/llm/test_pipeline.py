"""The pipeline on a small corpus against plain Python: every stage's decisions, one after another."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from loomgraph.llm import toxicity
from loomgraph.llm.common import held_out
from loomgraph.llm.queries import tokenizer_file

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(3, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def test_pipeline(spark, tmp_path):
    texts = {i: prose(60) + (" you zorkface grumbler " + prose(5) if i % 4 == 0 else "") for i in range(200)}
    for i in range(200, 220):
        texts[i] = texts[i - 99].replace(" ", "  ")  # copies but for white space
    for i in range(220, 240):
        w = texts[i - 119].split()
        w[30] = "changed"
        texts[i] = " ".join(w)  # near copies
    items = {1: prose(25), 2: prose(12)}
    for i in range(240, 250):
        texts[i] = prose(10) + " " + items[1 + i % 2].upper() + " " + prose(10)
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()] + [(300, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").where(~held_out("doc_id"))
    model = toxicity.fit(docs.where(~held_out("doc_id")).select("doc_id", "text"), labels)
    texts[300] = None
    left = {i: t for i, t in texts.items() if model.score(t) < 0.5}
    assert not any(i % 4 == 0 for i in left if i < 200) and sum(i % 4 != 0 for i in left if i < 200) == 150

    groups = defaultdict(list)
    for i, t in left.items():
        groups[re.sub(r"\s", "", t or "")].append(i)
    left = {i: left[i] for g in groups.values() for i in [min(g, key=lambda i: (-len(left[i] or ""), i))]}
    assert any(i >= 200 and i < 220 for i in left)  # of two copies the longer one stays

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in left.items()}
    label = {i: i for i in left}
    for _ in range(3):
        for a in left:
            for b in left:
                if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = label[b] = min(label[a], label[b])
    left = {i: t for i, t in left.items() if label[i] == i}

    windows = {tuple(w[k : k + 10]) for t in items.values() for w in [t.split()] for k in range(len(w) - 9)}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + 10]) in windows for w in [(t or "").lower().split()] for k in range(len(w) - 9))}
    assert not any(240 <= i < 250 for i in left) and len(left) > 140

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in left.items()}


def test_near_copies_from_a_similarity_of_80(spark):
    """Pairs below 0.8, between 0.80 and 0.85, and above: the stage links the last two."""
    words = lambda n, name: [f"{name}{k}" for k in range(n)]
    a, b, c = words(60, "a"), words(48, "b"), words(200, "c")
    rows = [(1, a), (2, [*a[:30], "x", *a[31:]]), (3, b), (4, [*b[:24], "x", *b[25:]]), (5, c), (6, [*c[:99], "x", *c[100:]])]
    share = lambda v, w: len(v & w) / len(v | w)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    assert 0.8 <= share(sets[0], sets[1]) < 0.85 and share(sets[2], sets[3]) < 0.8 and share(sets[4], sets[5]) > 0.85
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4, 5]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns with clashing names; then empty tables: every stage has a result and keeps the columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, _row string, label string, _maybe boolean"
    long = prose(40)
    rows = [(1, long, "en"), (1, long, "en"), (2, None, None), (3, "", "fr"), (None, long, "en"), (None, None, "en"), (4, prose(50), "de"), (5, long.upper(), "en"), (6, prose(12), "en")]
    rows = [(*r, "src", 0, "i", "r", "l", True) for r in rows]
    for name, data in {"odd": rows, "none": []}.items():
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, i % 2) for i in range(8)] if data else [], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, rows[8][1])] if data else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        left = {}
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, at)
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{at}/{stage}")
            left[stage] = spark.read.parquet(f"{at}/{stage}")
            docs = left[stage] if k else docs  # with eight labels the first stage decides nothing of interest
        if not data:
            assert all(d.count() == 0 for d in left.values())
            continue
        ids = lambda stage: sorted((r.doc_id for r in left[stage].select("doc_id").collect()), key=str)
        assert ids("exact_dedup") == [1, 2, 4, 5, 6]  # of the empty texts the smallest id, of the copies the row with an id
        assert ids("near_dedup") == [1, 2, 4, 6] and ids("decontamination") == [1, 2, 4] == ids("bpe")
        assert left["bpe"].where("doc_id = 2").first().n_tokens == 0 and set(left["bpe"].columns) >= {"lang", "_row", "label", "_maybe", "ids"}
