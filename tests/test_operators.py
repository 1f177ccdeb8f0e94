"""Operators against closed forms and plain Python."""

import math
import os
import random
from datetime import datetime, timedelta
from statistics import median
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.functions import vocabulary as V
from loomgraph.operators import color as K
from loomgraph.operators import communities as M
from loomgraph.operators import cooccurrence as C
from loomgraph.operators import evidence as E
from loomgraph.operators import graph as G
from loomgraph.operators import metrics as Q
from loomgraph.operators import resolve as R
from loomgraph.operators import sessions as D
from loomgraph.scratch import checkpointed
from loomgraph.sources import tables as T
from loomgraph.sources.store import Store
from loomgraph.sources import texts as X
from loomgraph.streaming import streams as I

NOW = datetime(2024, 1, 1)


def edges(spark, rows):
    """rows: (source, target, axis, weight)."""
    data = [(a, b, x, w, w, w, 0, NOW, True) for a, b, x, w in rows]
    return spark.createDataFrame(data, "source_id string, target_id string, axis string, weight double, probability double, confidence double, reinforcement_count long, last_reinforced timestamp, is_explicit boolean")


def concepts(spark, names, confidence=0.5):
    return spark.createDataFrame([(n, confidence, "developing", 5, NOW, "d") for n in names], "id string, confidence double, maturity string, activation_count long, last_activated timestamp, domain string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("seed", range(3))
def test_fold_is_sequential(spark, seed, monkeypatch):
    monkeypatch.setattr(E, "CHUNK_BITS", 2)  # several chunks for each key
    r = random.Random(seed)
    rows = [(f"c{r.randrange(3)}", NOW + timedelta(minutes=i), i, r.choice(["activate", "weaken"])) for i in range(200)]
    want: dict = {}
    for c, _, _, kind in rows:
        x, a, w = want.get(c, (0.15, 0, 0))
        if kind == "activate":
            a += 1
            x = min(1.0, x + 0.06 / (1 + 0.08 * a))
        else:
            w += 1
            x = max(0.01, x - 0.06 / (1 + 0.08 * w))
        want[c] = (x, a, w)
    df = spark.createDataFrame(rows, "concept string, ts timestamp, obs_id long, kind string").repartition(7)
    got = {x.concept: (x.confidence, x.activation_count, x.disconfirmation_count) for x in E.fold_concepts(df).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_relation_golden(spark):
    spec = V.with_spec(spark.createDataFrame([("supports",)], "label string"), "label").first()
    assert (spec.axis, spec.structural, spec.propagation) == ("positive", 0.82, 0.76)
    p = E.update_probability(F.lit(0.7), F.lit(2), F.lit(0.2), F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0))
    assert one(spark, p) == pytest.approx((0.7 * 2 + 0.2) / 3)
    assert one(spark, E.update_probability(F.lit(0.7), F.lit(3), F.lit(0.2), F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0))) == pytest.approx(0.575)
    assert one(spark, V.normalize_axis(F.lit(" Part of "))) == "positive"
    assert one(spark, V.normalize_semantic(F.lit("nonsense"))) == "generic_relation"


def test_scalars(spark):
    assert one(spark, S.norm_identity(F.lit("  Ä_b--C\t1 "))) == "ä b c 1"
    assert one(spark, S.slugify(F.lit("!!"))) == "space"
    assert one(spark, S.label_color(F.lit(""))) == "#64748b"
    import colorsys
    import hashlib

    d = hashlib.sha1(b"storage").digest()
    rgb = colorsys.hls_to_rgb(int.from_bytes(d[:2], "big") % 360 / 360, 0.48 + d[3] / 255 * 0.12, 0.55 + d[2] / 255 * 0.15)
    assert one(spark, S.label_color(F.lit("Storage"))) == "#" + "".join(f"{round(c * 255):02x}" for c in rgb)
    assert one(spark, S.normalize_domain_label(F.lit("Ops: how to run it"))) == "ops"
    assert one(spark, S.excerpt(F.lit("a  b\nc" * 40), 10)) == "a b ca..."
    assert one(spark, S.keyword_seeds(F.lit("what is the raft log"))) == ["what", "raft", "log"]
    assert one(spark, S.host(F.lit("https://www.Example.com:80/x?y"))) == "example.com"
    assert one(spark, S.concept_freshness(F.lit(NOW), F.lit(NOW + timedelta(hours=168)))) == pytest.approx(0.5)


def test_pair_cap(spark):
    rows = [(1, NOW, f"c{i:03d}") for i in range(40)] + [(2, NOW + timedelta(1), f"c{i:03d}") for i in range(2)]
    pairs = C.mention_pairs(spark.createDataFrame(rows, "obs_id long, ts timestamp, concept string"))
    assert pairs.where("obs_id = 1").count() == 30
    made = C.cooccurrence_edges(pairs).collect()
    assert [(r.a, r.b, r.sightings, r.weight) for r in made] == [("c000", "c001", 2, 0.15)]


def test_activation_falls_with_distance_and_inhibition(spark):
    e = edges(spark, [("a", "b", "positive", 0.9), ("b", "c", "positive", 0.9), ("a", "x", "negative", 0.9), ("b", "x", "positive", 0.2)])
    queries = spark.createDataFrame([("q", "", [])], "query_id string, task string, active_domains array<string>")
    seeds = spark.createDataFrame([("q", "a"), ("q", "nobody")], "query_id string, id string")
    got = {r.id: r for r in G.activate(seeds, queries, concepts(spark, "abcx"), e, F.lit(NOW)).collect()}
    assert got["a"].score > got["b"].score > got["c"].score
    assert got["b"].activation == pytest.approx(0.5 * 0.9 * 0.5 * 0.6)
    assert "x" not in got  # driven below zero
    picks = G.select_mmr(G.activate(seeds, queries, concepts(spark, "abcx"), e, F.lit(NOW)), queries, concepts(spark, "abcx"), e, F.lit(NOW), k=3)
    ids = [r.id for r in picks.orderBy("rank").collect()]
    assert ids[0] == "a" and len(set(ids)) == len(ids) == 3


def test_entropy_closed_forms(spark):
    hub = [("h", n, "positive", 0.5) for n in "abc"]
    assert {r.id: r.entropy for r in Q.node_entropy(edges(spark, hub)).collect()} == {"h": pytest.approx(1.0)}
    skew = edges(spark, [("h", "a", "positive", 0.8), ("h", "b", "positive", 0.2)])
    assert Q.node_entropy(skew).first().entropy == pytest.approx(-(0.8 * math.log2(0.8) + 0.2 * math.log2(0.2)))
    assert Q.axis_entropy(skew).first().entropy == 0


def test_communities_of_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}", "positive", 0.8) for g in "xyz" for i in range(5) for j in range(i)]
    cut = checkpointed(spark)
    links = cut(G.coupling(edges(spark, rows)))
    found = M.build_communities(M.propagate_labels(links, cut), links)
    assert sorted(tuple(r.member_ids) for r in found.collect()) == [tuple(f"{g}{i}" for i in range(5)) for g in "xyz"]
    stored = spark.createDataFrame([("old", ["x0", "x1", "x2", "x3"], 6, 4), ("gone", ["q1", "q2", "q3"], 1, 1), ("rare", ["r1", "r2", "r3"], 2, 1)], "id string, member_ids array<string>, stability int, seen_count int")
    after = {r.id: r for r in M.reconcile(found, stored, cut).collect()}
    assert after["old"].stability == 6 and after["old"].seen_count == 5 and len(after["old"].member_ids) == 5
    assert after["rare"].stability == 1 and "gone" not in after and len(after) == 4


def random_cliques(seed):
    """Disjoint groups of five to eight, each held together by heavier links than any bridge to the next."""
    r = random.Random(seed)
    groups = [[f"g{g}n{i}" for i in range(r.randint(5, 8))] for g in range(6)]
    rows = [(a, b, "positive", r.choice([0.6, 0.7, 0.8])) for g in groups for i, a in enumerate(g) for b in g[:i]]
    rows += [(r.choice(groups[g]), r.choice(groups[g + 1]), "positive", 0.1) for g in range(5)]
    return groups, rows


@pytest.mark.parametrize("seed", range(3))
def test_communities_by_contraction_and_in_order(spark, seed):
    """Both find the groups, and labels are at rest: no node of the result prefers another label."""
    groups, rows = random_cliques(seed)
    cut = checkpointed(spark)
    links = cut(G.coupling(edges(spark, rows)))
    own = {r.id: r.label for r in M.propagate_labels(links, cut).collect()}
    exact = {r.id: r.label for r in M.propagate_labels(links, cut, exact=True).collect()}
    parts = lambda label: sorted(sorted(x for x in label if label[x] == v) for v in set(label.values()))
    assert parts(own) == parts(exact) == sorted(sorted(g) for g in groups)
    votes = {}
    for r in links.collect():
        votes.setdefault(r.a, {}).setdefault(own[r.b], []).append(r.weight)
    assert all(sum(v.get(own[x], [])) >= max(map(sum, v.values())) - 1e-9 for x, v in votes.items())


def test_communities_end_where_neighbours_would_swap(spark, monkeypatch):
    """Nodes that would swap labels for ever if all moved at once, from the careful steps on alone too; nothing at all; a component too large to go in order."""
    cut = checkpointed(spark)
    ring = cut(G.coupling(edges(spark, [(f"r{i:02d}", f"r{(i + 1) % 14:02d}", "positive", 0.5) for i in range(14)] + [("a", "b", "positive", 0.5)])))
    labels = {r.id: r.label for r in M.propagate_labels(ring, cut).collect()}
    assert labels["a"] == labels["b"] and len(labels) == 16
    monkeypatch.setattr(M, "CAREFUL_FROM", 0)
    assert len({r.id: r.label for r in M.propagate_labels(ring, cut).collect()}) == 16
    assert M.propagate_labels(ring.where("false"), cut).count() == 0
    monkeypatch.setattr(M, "EXACT_LINKS", 20)
    with pytest.raises(ValueError, match="too large"):
        M.propagate_labels(ring, cut, exact=True)


@pytest.mark.parametrize("seed", range(2))
def test_updates_with_evidence_fold_in_order(spark, seed, monkeypatch):
    """Reinforcements, weakenings and updates with priors and evidence against a sequential reading; also in two parts."""
    monkeypatch.setattr(E, "CHUNK_BITS", 2)
    r, rows = random.Random(seed), []
    for i in range(120):
        kind = r.choice(["reinforce", "weaken", "update"])
        of = lambda *x: r.choice(x) if kind == "update" else None  # noqa: B023, E731
        rows.append((f"k{r.randrange(3)}", NOW + timedelta(minutes=i), i, kind, of(None, 0.2, 0.9), of(1.0, 2.5, 0.0), of(None, 0.1, 0.5, 0.8, 1.7), of(2.0, 4.0)))
    schema = "k string, ts timestamp, obs_id long, kind string, prior double, prior_strength double, evidence double, evidence_strength double"
    births = spark.createDataFrame([(f"k{i}", 0.76, 0.82, 0.76, i != 1) for i in range(3)], "k string, weight double, confidence double, probability double, is_explicit boolean")
    want = {f"k{i}": [0.76, 0.82, 0.76, 0, 0, 0, i != 1] for i in range(3)}
    for k, _, _, kind, prior, sp, told, se in rows:
        s = want[k]
        if kind == "reinforce":
            s[3] += 1
            d, cap = (0.08 / (1 + 0.05 * s[3]), 1.0) if s[6] else (0.06 / (1 + 0.15 * s[3]), 0.7)
            s[0], s[1] = min(cap, s[0] + d), min(cap, s[1] + d)
        elif kind == "weaken":
            s[4] += 1
            d = 0.06 / (1 + 0.1 * s[4])
            s[0], s[1] = max(0.01, s[0] - d), max(0.01, s[1] - d)
            s[2] = s[1]
        else:
            strength = max(1.0, 2.0 + s[3] + s[4] + s[5])
            total = s[2] * strength
            if prior is not None and sp > 0:
                total, strength = total + min(1, max(0, prior)) * sp, strength + sp
            if told is not None:
                total, strength = total + min(1, max(0, told)) * se, strength + se
                s[5] += 1
                s[3 if told >= 0.5 else 4] += 1
            s[0] = s[1] = s[2] = min(1.0, max(0.0, total / strength))
    columns = ["weight", "confidence", "probability", "reinforcement_count", "disconfirmation_count", "probability_observation_count"]
    told = lambda df: {x.k: [x[c] for c in columns] for x in df.collect()}
    events = spark.createDataFrame(rows, schema).repartition(5)
    got = told(E.fold_relations(events, births, ["k"]))
    first = E.fold_relations(events.where("obs_id < 50"), births, ["k"]).join(births.select("k", "is_explicit"), "k")
    twice = told(E.fold_relations(events.where("obs_id >= 50"), checkpointed(spark)(first), ["k"]))
    for k, v in want.items():
        assert got[k] == pytest.approx(v[:6]) and twice[k] == pytest.approx(v[:6])


def test_color(spark):
    colors = spark.createDataFrame([("a", "red", 0.5)], "id string, label string, strength double")
    e = edges(spark, [("a", "b", "positive", 1.0)])
    got = {(r.id, r.label): r.strength for r in K.diffuse(colors, colors.select("id"), e, steps=1).collect()}
    assert got == {("a", "red"): 0.5, ("b", "red"): pytest.approx(0.09)}
    faded = {r.id: r.strength for r in K.fade(colors, e).collect()}
    assert faded == {"a": pytest.approx(0.5 * 0.98)}


def test_identity(spark):
    schema = "id string, name string, aliases array<string>, kind string, sense string, description string, domain string, confidence double, activation_count int, last_activated timestamp"
    c = spark.createDataFrame([("1", "Apple", ["pomme"], "", "fruit of a tree", "", "food", 0.5, 3, NOW), ("2", "apple", [], "", "computer maker", "", "tech", 0.7, 1, NOW), ("3", "Postgres", [], "", "", "relational database server", "", 0.2, 1, NOW)], schema)
    assert {r.label: r.id for r in R.label_index(c).collect()} == {"pomme": "1", "postgres": "3"}
    refs = spark.createDataFrame([("pomme",), ("apple",), ("3",), ("?",)], "ref string")
    assert {r.ref: r.concept_id for r in R.resolve(refs, c).collect()} == {"pomme": "1", "apple": None, "3": "3", "?": None}
    known = c.withColumn("identity_key", S.identity_key(F.col("name"), F.col("kind"), F.col("sense"), F.col("domain"), F.col("description")))
    new = spark.createDataFrame(
        [("a", "APPLE", [], "core", "Fruit of a tree", "", "Food", 0.0, 0, NOW), ("b", "pomme", [], "", "", "", "", 0.0, 0, NOW), ("c", "postgres server", [], "", "", "relational database server", "", 0.0, 0, NOW), ("d", "Raft", [], "", "consensus", "", "", 0.0, 0, NOW)], schema
    )
    got = {r.id: (r.concept_id, r.how) for r in R.resolve_or_create(new, known).collect()}
    assert got["a"] == ("1", "key") and got["b"] == ("1", "label") and got["c"][0] == "3" and got["d"][1] == "new"
    merged = R.merge_concepts(c, spark.createDataFrame([("2", "1")], "old string, keeper string")).where("id = '1'").first()
    assert merged.activation_count == 4 and merged.confidence == 0.7 and merged.name == "Apple"


def test_sources_and_responses(spark):
    rows = spark.createDataFrame([("a b", "s", "t"), ("a b", " s ", "t"), (None, "s", "t")], "raw_text string, source string, task string")
    assert X.record_sources(rows).count() == 2
    raw = spark.createDataFrame([(1, '```json\n{"concepts": ["Raft", {"name": "Log", "uid": "l", "aliases": ["wal"]}], "relations": [["raft", "WAL", "uses"], {"source": "l", "target": "x", "label": "r"}]}\n```'), (2, "no json"), (3, None)], "obs_id long, raw string")
    c, r = X.observations_from_responses(raw)
    assert {x.name for x in c.collect()} == {"Raft", "Log"}
    assert sorted((x.source, x.target, x.label, x.dropped) for x in r.collect()) == [("Log", "x", "r", True), ("Raft", "Log", "uses", False)]
    page = spark.createDataFrame([(1, "http://x.org/a", "<title>A &amp; B</title><script>var a='</p>'</script><p>Hi&nbsp;<b>you</b><!-- no --></p><a href='/k'>K</a>")], "page_id long, url string, html string")
    got = X.extract_page_text(page).first()
    assert (got.title, got.text) == ("A & B", "A & B Hi you K")
    assert [(x.href, x.label, x.domain) for x in X.extract_links(page).collect()] == [("/k", "K", "x.org")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"c{i % 3}") for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "i long, c string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("i long, c string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def fold(batch, store):
        new = batch.groupBy("c").agg(F.count("*").alias("n"))
        return {"counts": new.unionByName(store.table("counts", among=new)).groupBy("c").agg(F.sum("n").alias("n"))}

    store = Store(spark, f"{tmp_path}/out", {"counts": ["c"]}, {"counts": "c string, n long"})
    I.fold_batches(stream, fold, store)
    assert {r.c: r.n for r in store.table("counts").collect()} == {"c0": 10, "c1": 10, "c2": 10} and store.batch == 2


def test_upsert_and_feed(spark):
    t = spark.createDataFrame([(1, 5, 0), (2, 5, 0)], "id long, n long, w long")
    u = T.upsert(t, spark.createDataFrame([(2, 6, 1), (3, 1, 0)], "id long, n long, w long"), ["id"])
    assert sorted((r.id, r.event) for r in T.change_feed(t, u, "n", "w").collect()) == [(2, "reinforced"), (2, "weakened"), (3, "created")]


def test_communities_over_weak_edges(spark):
    """Also edges of weight 0.2 and less hold a community together."""
    from types import SimpleNamespace

    from loomgraph.plans import graph as P

    links = edges(spark, [(a, b, "positive", 0.15) for a in "abcd" for b in "abcd" if a < b] + [("d", "e", "positive", 0.0)])
    concepts = spark.createDataFrame([(c, NOW) for c in "abcde"], "id string, last_activated timestamp")
    found = P.communities(SimpleNamespace(spark=spark, edges=links, concepts=concepts)).collect()
    assert [r.member_ids for r in found] == [["a", "b", "c", "d"]]


def test_relations_of_a_long_order(spark):
    """All neighbours of an order are related, also beyond its first hundred lines; a returned line isn't."""
    from types import SimpleNamespace

    from loomgraph.plans import worlds as P

    n, back = 150, 141
    lines = [(1, k, k, "R" if k == back else "N", 0.0, 1.0) for k in range(n)]
    t = SimpleNamespace(
        spark=spark, lineitem=spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_discount double, l_quantity double"),
        orders=spark.createDataFrame([(1, NOW, "1-URGENT")], "o_orderkey long, o_orderdate timestamp, o_orderpriority string"),
        part=spark.createDataFrame([(k, "part") for k in range(n)], "p_partkey long, p_name string"),
    )
    name = {r.id: r.name for r in P._ingested(t).concepts.collect()} if hasattr(P, "_ingested") else {}
    rows = [r for r in P.ingest_edges(t).collect() if r.is_explicit]
    assert len(rows) == n - 2
    assert {frozenset((name[r.source_id], name[r.target_id])) for r in rows} == {frozenset((f"part {k - 1}", f"part {k}")) for k in range(1, n) if k != back}


def test_recovery_actions(spark):
    rows = spark.createDataFrame([("search_fetch_failed",), ("tool_round_limit",), ("unknown",), ("none",), (None,)], "f string")
    assert [r[0] for r in rows.select(S.recovery_actions(F.col("f"))).collect()] == [["retry_without_focus", "retry_without_domains"], ["manual_compact"], [], [], []]


def test_relation_listings(spark):
    rows = spark.createDataFrame([("conflict",), ("unheard",), (None,)], "l string")
    names, about, every = zip(*rows.select(V.relation_names(F.col("l")), V.axis_descriptions(F.col("l")), V.relation_names()).collect(), strict=True)
    of = lambda axis: sorted(s[0] for s in V.SPECS if s[1] == axis)
    assert list(names) == [of("negative"), of("parallel"), of("parallel")] and about[0] == V.AXIS_DESCRIPTIONS["negative"] and about[2] == V.AXIS_DESCRIPTIONS["parallel"]
    assert every[0] == sorted(s[0] for s in V.SPECS)


def test_newest_sessions(spark):
    """Ages are rounded down at each border; sessions without a time come last, ties by conv_id."""
    ago = [(1, timedelta(minutes=59, seconds=59)), (2, timedelta(minutes=60)), (3, timedelta(hours=23, minutes=59)), (4, timedelta(days=1)), (6, None), (5, timedelta(days=1)), (7, timedelta(0))]
    rows = [(c, 0, "user", NOW - d if d is not None else None) for c, d in ago] + [(4, 1, "assistant", NOW - timedelta(days=9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, ts timestamp")
    out = D.list_sessions(df, None, 6, F.lit(NOW)).collect()
    assert [(r.conv_id, r.age) for r in out] == [(7, "0m ago"), (1, "59m ago"), (2, "1h ago"), (3, "23h ago"), (4, "1d ago"), (5, "1d ago")]
    assert {r.conv_id: (r.age, r.updated_at) for r in D.list_sessions(df, None, None, F.lit(NOW)).collect()}[6] == (None, None)
    assert D.list_sessions(df.limit(0), None, 6, F.lit(NOW)).collect() == []


def test_sliding_activity(spark):
    df = spark.createDataFrame([("a", NOW + timedelta(hours=7)), ("a", NOW + timedelta(hours=13)), (None, None)], "concept string, ts timestamp")
    out = {(r.window.start - NOW, r.n) for r in I.activity(df, "12 hours", slide="6 hours").collect()}
    assert out == {(timedelta(0), 1), (timedelta(hours=6), 2), (timedelta(hours=12), 1)}


def test_a_users_number_is_no_status_code(spark):
    """user 429's messages are classified by what they say, as in SQL."""
    import duckdb

    from loomgraph.plans import ORACLE_SQL
    from loomgraph.plans import scalars as P

    rows = [(i, u) for u in (429, 401, 1503, 7, None) for i in range(36)]
    got = P.recovery(SimpleNamespace(events=spark.createDataFrame(rows, "event_id long, user_id long"))).collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT)")
    db.executemany("INSERT INTO events VALUES (?, ?)", rows)
    want = db.sql("SELECT team, failure, n, retryable, actions FROM (" + ORACLE_SQL["b21_recovery_actions"] + ")").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_sightings_equal_their_statement(spark):
    """F9 to F27: pairs are made inside observations, in as many tasks as asked for; odd rows count as in a join of mentions with themselves."""
    from loomgraph.plans import adapters as A

    rng = random.Random(3)
    lines = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)])) for _ in range(400)]
    orders = [(k, NOW + timedelta(days=k % 5), rng.choice("ab")) for k in [*range(30), *range(0, 30, 3), 4, 4]] + [(None, NOW, "a"), (31, None, "a"), (32, None, None), (32, NOW, None)]
    l, o = spark.createDataFrame(lines, "l_orderkey long, l_partkey long"), spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_orderpriority string")
    got = A._sightings(l, o).select("a", "b", "n", "last_reinforced").collect()
    want = spark.sql(A.text("sightings"), lineitem=l, orders=o).select("a", "b", "n", "last_reinforced").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) > 50
    seen, at = l.selectExpr("l_orderkey obs_id", "concat('p', l_partkey) concept"), o.selectExpr("o_orderkey obs_id", "o_orderdate ts", "o_orderpriority task")
    df = C.sightings(seen, at, 23)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, got), key=repr) and df.rdd.getNumPartitions() == 23
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange") == 2


@pytest.mark.parametrize("name", ["concepts", "edges"])
def test_tasks_grow_with_the_lines(spark, name, monkeypatch):
    """F11 to F27: twice the lines in a task's bound is twice the tasks; the rows stay the same."""
    from loomgraph.plans import adapters as A

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("the driver's tables are not here")
    lines = A.load(spark, at, "lineitem").count()
    monkeypatch.setattr(A, "TASK_ROWS", lines // 12)
    df = A.load(spark, at, name)
    want = spark.sql(A.text(name), **{t: A.load(spark, at, t) for t in ("lineitem", "orders", "part")})
    rounded = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert df.rdd.getNumPartitions() >= 12 and rounded(df.select(*want.columns).collect()) == rounded(want.collect())


def _lines_in_a_task(spark, monkeypatch, tasks):
    """The driver's smallest tables, with a bound that gives so many tasks."""
    from loomgraph.plans import adapters as A

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("the driver's tables are not here")
    monkeypatch.setattr(A, "TASK_ROWS", A.load(spark, at, "lineitem").count() // tasks)
    return A, at


def test_parts_are_not_sent_to_every_task(spark, monkeypatch):
    """F10 to F24: edges and concepts meet the parts by merge joins in tasks whose number grows with the lines, however small the file of the parts looks."""
    A, at = _lines_in_a_task(spark, monkeypatch, 12)
    for name, joins in (("edges", 2), ("concepts", 1)):
        df = A.load(spark, at, name)
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("SortMergeJoin") >= joins and plan.count("concat(p, cast(p_partkey") >= joins
        assert not any("pid#" in line for line in plan.splitlines() if "BroadcastHashJoin" in line), name
        assert df.rdd.getNumPartitions() >= 12


def test_export_meets_by_concept(spark, monkeypatch):
    """colours and the log are put together where the concepts are, in tasks whose number grows with the lines, and the rows stay the same."""
    from loomgraph.plans import QUERIES

    A, at = _lines_in_a_task(spark, monkeypatch, 12)
    want = sorted(map(tuple, QUERIES["a08_export_graph"](spark, at).collect()), key=repr)
    monkeypatch.setattr(A, "TASK_ROWS", 1_000_000)
    assert want == sorted(map(tuple, QUERIES["a08_export_graph"](spark, at).collect()), key=repr) and want
    monkeypatch.setattr(A, "TASK_ROWS", A.load(spark, at, "lineitem").count() // 12)
    colors = A.load(spark, at, "colors")
    assert colors.rdd.getNumPartitions() >= 12
    plan = QUERIES["a08_export_graph"](spark, at)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    by_concept = [line for line in plan.splitlines() if "Exchange hashpartitioning(concept#" in line]
    assert len(by_concept) == 3 and all("REPARTITION_BY_NUM" in line for line in by_concept)


def test_half_steps_move_integers(spark):
    """nodes are numbered once; what the half-steps write and read again has no names, and the graph no rows of nodes that are only asked at the end."""
    groups, rows = random_cliques(7)
    cut, seen = checkpointed(spark), []

    class Seen(type(cut)):
        def __call__(self, df):
            seen.append({t for _, t in df.dtypes})
            return super().__call__(df)

    labels = {r.id: r.label for r in M.propagate_labels(cut(G.coupling(edges(spark, rows))), Seen(spark)).collect()}
    assert [len({labels[x] for x in g}) for g in groups] == [1] * len(groups) and len(set(labels.values())) == len(groups)
    assert len(seen) > 6 and not any("string" in types for types in seen[2:])  # after the sorted names and their numbers


def test_fade_sums_what_neighbours_have(spark):
    """against plain Python, with one join of the links with the colours and none of the result with itself; labels that only one side has count nothing."""
    r = random.Random(4)
    rows = [(f"n{i}", f"n{j}", "positive", r.choice([0.2, 0.5, 0.9])) for i in range(8) for j in range(i) if r.random() < 0.6]
    have = {(f"n{i}", x): r.choice([0.1, 0.4, 0.8]) for i in range(10) for x in "uvw" if r.random() < 0.7}
    colors = spark.createDataFrame([(*k, s) for k, s in have.items()], "id string, label string, strength double")
    near = {}
    for a, b, _, w in rows:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    q = {(i, x): sum(w * have.get((b, x), 0) for b, w in near.get(i, [])) / max(1e-9, sum(w for _, w in near.get(i, []))) for i, x in have}
    want = {}
    for (i, x), s in have.items():
        ref = median(v for (j, _), v in q.items() if j == i)
        mu = 0.02 if ref <= 0 else max(0.02, max(0, 1 - q[i, x] / ref) / 4)
        want[i, x] = s * (1 - mu)
    df = K.fade(colors, edges(spark, rows))
    assert {(t.id, t.label): pytest.approx(t.strength) for t in df.collect()} == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3
