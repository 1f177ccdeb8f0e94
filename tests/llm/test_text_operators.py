"""Each text operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows
and columns with clashing names; and on an empty table."""

import base64
import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, decontam, exact, langid, licenses, minhash, quality, repeats, toxicity, warc
from loomgraph.llm.components import components
from loomgraph.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, kept boolean, k1 string, n string, _row string, score string, key string"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdeéß") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


PASSAGE = prose(80)
BASE = prose(120).split()


def rows():
    out = [None, "", " \t\n", "one", "One  two", "one two three four five", prose(30000)]
    out += [PASSAGE + " " + prose(20), prose(30) + "\n" + PASSAGE.upper() + prose(5), PASSAGE[:150] + "X" + PASSAGE[150:]]
    for edits in (0, 0, 1, 2, 3, 4, 8, 30):
        w = list(BASE)
        for _ in range(edits):
            w[R.randrange(len(w))] = R.choice(VOCAB)
        out.append(" ".join(w))
    out += [out[-1].replace(" ", "\n"), "  " + out[-2], "aaaa " * 200, "x" * 700, "<|endoftext|>Hi THERE'll 12٣ ΑΣ!"]
    data = [(i, t, ["en", "fr"][i % 2]) for i, t in enumerate(out)] + [(3, "one", "fr"), (3, "one", "fr"), (None, "one", None), (None, None, None)]
    return [(*r, True, "k", "n", "r", "s", "key") for r in data]


DATA = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DATA, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, want):
    assert got(df) == sorted(want, key=repr)


def test_exact(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t, *_ in DATA:
        groups[norm(t)].append((len(t or ""), i))
    want = []
    for i, t, *_ in DATA:
        g = groups[norm(t)]
        longest = max(n for n, _ in g)
        ids = [j for n, j in g if n == longest and j is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    same(exact.duplicates(docs), want)
    left = exact.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.duplicates(none).count() == exact.drop_duplicates(none).count() == 0


def test_exact_with_a_full_filter(docs):
    """With a filter far too small every row is a candidate, and results stay the same."""
    assert got(exact.duplicates(docs, cap_bits=1 << 16)) == got(exact.duplicates(docs))


def brute_components(sets, threshold=85):
    ids = sorted(sets)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                inter = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * inter >= threshold * (len(sets[a]) + len(sets[b]) - inter):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, none):
    sets = {i: shingle_set(t) for i, t, *_ in DATA if i is not None}
    label = brute_components(sets)
    want = [(i, len(shingle_set(t)), label.get(i), i is None or label[i] == i) for i, t, *_ in DATA]
    same(minhash.near_duplicates(docs), want)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == sum(w[3] for w in want)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """One text with few and many edits: stars alone would not settle who is linked with whom."""
    base, out = prose(90).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(R.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[R.randrange(len(w))] = R.choice(VOCAB)
        out.append((i, " ".join(w)))
    label = brute_components({i: shingle_set(t) for i, t in out})
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert found == label and len(set(label.values())) > 3


def test_signatures_of_tiny_sets():
    assert minhash.least_size(85) == 6
    s = minhash.shingles("a b c d e f")
    assert len(s) == 2 and (minhash.signature(s) != 0).all()
    long = "word " * 10 + "y" * (3 << 20) + " end"
    assert len(minhash.shingles(long)) == 3  # pieces end between words, also around a very long one


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 5), (7, 7)]
    got_ = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got_ == {i: i // 10 * 10 for i in range(41) if i != 40} | {100: 0}


def brute_windows(text, n=10):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[5:30]).upper()), (2, "Two"), (3, None), (4, "ONE-two, three"), (None, " ".join(BASE[3:14])), (5, "É é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, *_ in DATA:
        w, hit, found = brute_windows(t), set(), set()
        for item, x in items:
            v = brute_windows(x)
            n = min(10, len(v))
            for win in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == win:
                        hit |= set(range(k, k + n))
                        found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), sorted(found), bool(hit)))
    assert sum(x[4] for x in want) > 5
    same(decontam.report(docs, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated"), want)
    assert decontam.drop_documents(docs, bench).count() == sum(not x[4] for x in want)
    spans = {r.doc_id: r.text for r in decontam.drop_spans(docs, bench).collect()}
    assert spans[4] == "One  " and spans[5] == "   four five" or spans[5].split() == ["four", "five"]
    assert spans[0] is None and spans[6] == DATA[6][1]
    assert decontam.report(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.report(docs, bench.limit(0)).collect())


def test_bpe_is_the_librarys(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, text, *_ in DATA:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    out = bpe.encode(docs, tokenizer_file())
    same(out.select("_row.doc_id", "bpe.n_tokens", "bpe.ids", "bpe.decoded"), want)
    again = bpe.decode(out.select("_row.doc_id", "bpe.ids", F.col("bpe.decoded").alias("first")), tokenizer_file())
    assert again.where("first <> decoded").count() == 0
    assert bpe.digests(none, tokenizer_file()).count() == 0
    digest = {r[0]: r[1] for r in bpe.digests(docs.where("doc_id > 3"), tokenizer_file()).select("_row.doc_id", "bpe.decoded_sha256").collect()}
    assert digest == {i: hashlib.sha256(d.encode()).hexdigest() for i, _, _, d in want if i is not None and i > 3}


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(tokenizer_file()), bpe.Vocabulary(tokenizer_file())
    codec = bpe.Codec(v)
    pool = "abcDEF 'sΣςσİıßéÉ日本\x1c\x85\xa0　\t\n12٣Ⅷ!?👍é"
    texts = ["".join(R.choice(pool) for _ in range(R.randint(0, 40))) for _ in range(400)] + ["ab" * 3000, "x" * 9001, "".join(R.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(40_000))]
    assert len(bpe.apart(v, texts[-1].encode())) > 3 and len(bpe.apart(v, texts[-2].encode())) == 1
    for text, (words, known) in zip(texts, codec.groups(texts), strict=True):
        assert b"".join(known[w][0] for w in words) == b"".join(i.to_bytes(4, "little") for i in t.encode(text, add_special_tokens=False).ids)


def removed(texts, least):
    """Brute force: which bytes lie in a string of `least` bytes that also starts elsewhere."""
    seen = defaultdict(int)
    for x in texts:
        for k in range(len(x) - least + 1):
            seen[x[k : k + least]] += 1
    out = []
    for x in texts:
        gone = set()
        for k in range(len(x) - least + 1):
            if seen[x[k : k + least]] > 1:
                gone |= set(range(k, k + least))
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [1 << 40, 2])
def test_repeats(docs, none, hot):
    texts = [(t or "").encode() for _, t, *_ in DATA]
    want = []
    for (i, *_), x, gone in zip(DATA, texts, removed(texts, 200), strict=True):
        runs = sum(k not in gone and k + 1 in gone for k in range(-1, len(x)))
        want.append((i, len(x), len(gone), runs, hashlib.sha256(bytes(c for k, c in enumerate(x) if k not in gone)).hexdigest()))
    out = repeats.remove_repeats(docs, hot=hot)
    same(out.select("_row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256"), want)
    if hot > 2:
        kept = {r[0]: r[1] for r in out.where("_row.doc_id > 6").select("_row.doc_id", "cut.kept").collect()}
        assert all(hashlib.sha256(kept[w[0]]).hexdigest() == w[4] for w in want if w[0] in kept)
        assert repeats.remove_repeats(none).count() == 0


def test_maximal_groups():
    """All sets of strings around one anchor that share a maximal string, against every pair's own common string."""
    for _ in range(60):
        anchor = b"##"
        rows = sorted({(anchor + bytes(R.choice(b"ab") for _ in range(6)), bytes(R.choice(b"ab") for _ in range(5))) for _ in range(R.randint(1, 9))})
        suffix, before = [r[0] for r in rows], [r[1] for r in rows]
        got_ = {(tuple(m), a, b) for m, a, b in repeats.maximal_groups(suffix, before, np.zeros(len(rows), int), 5)}
        share = lambda x, y: next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))  # noqa: E731, B905
        want = set()
        for i in range(len(rows)):
            for j in range(i):
                a, b = share(before[i], before[j]), share(suffix[i], suffix[j])
                if a + b >= 5:  # what these two share, and all that have it
                    want.add((tuple(k for k in range(len(rows)) if before[k][:a] == before[i][:a] and suffix[k][:b] == suffix[i][:b]), a, b))
        assert got_ == want


def test_repeat_groups(spark):
    passage = prose(60)[:260]
    texts = [prose(30) + passage + prose(30), prose(9) + passage, passage[:230] + prose(40), prose(80), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    raw = {tuple(r[1:]): r[0].encode() for r in df.where("text is not null").select("text", *decontam.text_key(F.col("text"))).collect()}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(df).collect():
        groups[r.repeat, r.length].add((raw[r.k1, r.k2], r.start))
    assert groups and all(len({t[k : k + n] for t, k in g}) == 1 and len(g) > 1 and n >= 200 for (_, n), g in groups.items())
    covered = {t: set() for t in raw.values()}
    for (_, n), g in groups.items():
        for t, k in g:
            covered[t] |= set(range(k, k + n))
    assert [covered[t] for t in raw.values()] == removed([*raw.values()], 200)


def test_prefix_intervals():
    assert sorted(repeats.intervals([-1, 3, 5, 1, -1, 2])) == [(0, 2, 3), (0, 3, 1), (1, 2, 5), (4, 5, 2)]


def test_lookups_beyond_a_broadcast(spark, docs):
    """A large table of keys is filtered first and joined after, with the same rows."""
    keys = spark.createDataFrame([(i, f"v{i}") for i in range(3, 900, 3)], "doc_id long, found string")
    some = docs.where("doc_id is not null")
    for most in (-1, 1 << 20):
        out = {(r.doc_id, r.found) for r in common.looked_up(some, keys, ["doc_id"], most).collect()}
        assert out == {(i, f"v{i}" if i % 3 == 0 and i else None) for i, *_ in DATA if i is not None}
        assert sorted(r.doc_id for r in common.without(some, keys, ["doc_id"], most).collect()) == sorted(i for i, *_ in DATA if i is not None and (i % 3 or not i))


def test_a_full_sieve_loses_nothing(spark):
    keys = spark.range(4000).withColumn("k", F.col("id") * 7)
    sieve = common.Sieve(keys, "k", 4000)
    got_ = sieve.passed(spark.range(28000), F.col("id"))
    assert got_.join(keys, got_["id"] == keys["k"]).count() == 4000 and got_.count() < 4300
    small = common.Sieve(keys, "k", 1)
    assert small.passed(spark.range(28000), F.col("id")).join(keys.select(F.col("k").alias("id")), "id").count() == 4000


def test_warc(spark):
    schema = "page_id long, url string, html string, d string, top string, r string, i string"
    html = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1" * 2000, "x" * 3_000_000]
    data = [(k, f"http://x/{k} ü\r\nX: y", h, "d", "t", "r", "i") for k, h in enumerate(html)] + [(3, "again", "<p>a</p>", "d", "t", "r", "i"), (None, None, "lone", "d", "t", "r", "i"), (None, None, "", "d", "t", "r", "i")]
    archives = warc.write(spark.createDataFrame(data, schema).repartition(2), warc.new_folder(spark))
    assert archives.agg(F.sum("records")).first()[0] == len(data)
    assert warc.read(archives).rdd.getNumPartitions() == archives.count() == 2  # a task for each archive
    out = warc.read(archives, payloads=True).collect()
    want = []
    for k, url, h, *_ in data:
        raw = (h or "").encode()
        top = max((j for j, _, g, *_ in data if (g or "") == (h or "") and j is not None), default=None)
        first = top is None or top == k
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((k, url or "", len(raw), digest, "response" if first else "revisit", None if first else top, raw if first else None))
    assert sorted(((*r[:6], bytes(r[6]) if r[6] is not None else None) for r in out), key=repr) == sorted(want, key=repr)
    assert warc.read(warc.write(spark.createDataFrame([], schema), warc.new_folder(spark))).count() == 0


def test_warc_references_without_a_broadcast(spark):
    data = [(k, t) for k, t in enumerate(["a", "a", "b", "", None, "c", "", "a"])] + [(None, "a"), (None, "z"), (7, "a"), (2, "a")]
    pages = spark.createDataFrame(data, "i long, p string").repartition(3)
    told = lambda most: sorted(((r.i, r.p, r._refers) for r in warc.with_references(pages, "i", "p", most).collect()), key=repr)
    assert told(0) == told(100) and (0, "a", 7) in told(0) and (7, "a", None) in told(0) and (None, "a", 7) in told(0)


def test_warc_reader_rejects_damage():
    import io

    good = warc._record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None)
    assert len([*warc.records(io.BytesIO(good + good))]) == 2
    bad = warc._record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"other").digest()).decode(), None)
    for raw in (bad, good[:-12]):
        with pytest.raises(ValueError):
            [*warc.records(io.BytesIO(raw))]


def test_language(spark, docs, none):
    words = {"aa": ["kala", "mata", "lasa", "taka"], "bb": ["rono", "modo", "dolo", "noro"]}
    text = lambda l, n: " ".join(R.choice(words[l]) for _ in range(n))
    learn = spark.createDataFrame([(i, text(l, 60), l) for i in range(40) for l in words] + [(None, "x", "aa"), (7, None, "bb"), (8, "y", None)], "doc_id long, text string, lang string")
    model = langid.fit(learn)
    test = [(0, text("aa", 50)), (1, text("bb", 50)), (2, text("aa", 150) + " " + text("bb", 90)), (3, None), (4, "12 !"), (5, text("bb", 300_000))]
    got_ = {r[0]: r for r in langid.identify(spark.createDataFrame(test, "doc_id long, text string"), model).select("_row.doc_id", "found.lang", "found.score", "found.languages").collect()}
    assert [got_[i][1] for i in range(6)] == ["aa", "bb", "aa", "und", "und", "bb"]
    assert got_[2][3] == ["aa", "bb"] and got_[2][2] == pytest.approx(0.62, abs=0.06) and got_[3][2] == 0
    assert langid.identify(docs, model).count() == len(DATA) and langid.identify(none, model).count() == 0
    assert langid.fit(none).languages == []
    assert {r.lang for r in langid.identify(docs, langid.fit(none)).select("found.lang").collect()} == {"und"}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(spark, docs, none, module):
    bad = lambda i: i % 3 == 0
    spoiled = {toxicity: lambda t: t + " you grumbling zorkface " + prose(10), quality: lambda t: " ".join(w + "%%%&&&" for w in t.split())}[module]
    texts = [(i, spoiled(prose(60)) if bad(i) else prose(60)) for i in range(300)]
    good_is_one = module is quality
    labels = [(i, int(bad(i) != good_is_one)) for i in range(200)] + [(None, 1), (5000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    label = {toxicity: "toxic", quality: "quality"}[module]
    model = module.fit(df, spark.createDataFrame(labels, f"doc_id long, {label} int"))
    out = {r[0]: r[1] for r in module.score(df, model).select("_row.doc_id", "score").collect()}
    right = sum((out[i] >= 0.5) == (bad(i) != good_is_one) for i in range(200, 300))
    assert right >= 97 and all(0 <= s <= 1 for s in out.values())
    assert module.score(docs, model).count() == len(DATA) and module.score(none, model).count() == 0
    empty = module.fit(df, spark.createDataFrame([], f"doc_id long, {label} int"))
    assert max(r.score for r in module.score(docs, empty).collect()) < 1e-6


def test_licenses(spark, docs, none):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [(1, "LICENSE", mit), (2, "a/b/x.py", "code\n"), (3, "a/LICENSE.txt", gpl), (4, "a/b/c/y.py", f"# {mit.upper()}\ncode"), (5, "z/w.py", None), (6, "a/b/c/d.py", "licensed to nobody in particular, version of the public kind"), (7, None, ""), (7, None, "")]
    df = spark.createDataFrame([(*f, "x", "y") for f in files], "id long, path string, text string, own string, dir string")
    found = {r.id: (r.license, r.found, r.from_dir) for r in licenses.scan(df, "id", "path", "text").collect()}
    assert found == {1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "a"), 3: ("GPL-3.0", "file", None), 4: ("MIT", "header", None), 5: ("MIT", "inherited", ""), 6: ("GPL-3.0", "inherited", "a"), 7: ("MIT", "inherited", "")}
    named = docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    assert licenses.scan(named, "doc_id", "path", "text").where("found <> 'none'").count() == 0
    assert licenses.scan(none.withColumn("path", F.lit("p")), "doc_id", "path", "text").count() == 0


def brute_licenses(texts):
    """{text: (licence, score)} by plain TF-IDF of every unit against every template."""
    words = {t: licenses.tokens_of(t or "") for t in texts}
    n = len(texts)
    df = Counter(w for t in texts for w in set(words[t]))
    vector = lambda ws: {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(ws).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(licenses.tokens_of(t))) for name, t in licenses.TEMPLATES]
    out = {}
    for t in set(texts):
        low, units = (t or "").lower(), set()
        for line in low.split("\n"):
            units |= {line, *re.split(r"[.!?][ \t\r]+", line)}
        head = re.match(r"(?:[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*\n?)+", low)
        units |= {*re.split(r"\n[ \t\r]*\n", low), low, head[0] if head else ""}
        best = []
        for u in units:
            v = vector(licenses.tokens_of(u))
            for name, w in known:
                if v and (c := round(sum(x * w.get(k, 0) for k, x in v.items()) / size(v) / size(w), 6)) >= licenses.THRESHOLD:
                    best.append((-c, name))
        if best:
            out[t] = min(best)[1], -min(best)[0]
    return out


def test_licenses_against_plain_tf_idf(spark):
    """Copies, underscores, digits, wrapped and embedded notices, whole files; each copy counts once in the frequencies."""
    text = lambda name: next(t for k, t in reversed(licenses.TEMPLATES) if k == name)
    wrap = lambda t, mark: "\n".join(f"{mark}{line}" for line in textwrap.wrap(" ".join(t.split()), 60))
    texts = ["Released under the MIT License."] * 9 + ["Released_under_the_MIT_License.", "chapter 1", "1, 2 and 3", "version 2.0, 3 and 4", "", None, "x1 v12", prose(400)]
    texts += ["Copyright 2021 Acme. Released under the MIT License. All else is plain.", wrap(text("GPL-2.0"), "# ") + "\nimport os\n" + prose(50), "Copyright (c) 2020 Some One\n\n" + wrap(text("MIT"), "")]
    texts += [wrap(t, " * ") for _, t in licenses.TEMPLATES] + [prose(30) + "\n\n" + wrap(text("ISC"), "") + "\n\n" + prose(30)]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string").repartition(3)
    found = {r.id: (r.own_license, r.own_score) for r in licenses.scan(df, "id", "path", "text").collect()}
    want = brute_licenses(texts)
    assert {i: want.get(t, (None, None)) for i, t in enumerate(texts)} == {i: (a, s if s is None else pytest.approx(s, abs=2e-6)) for i, (a, s) in found.items()}
    assert found[9][0] == found[17][0] == found[19][0] == "MIT" and found[18][0] == "GPL-2.0" and found[len(texts) - 1][0] == "ISC" and found[12][0] is None
