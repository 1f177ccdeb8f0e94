"""Ingest of observations against a sequential reading of its passes in plain Python; onto a world that is there; with candidates."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import vocabulary as V
from loomgraph.operators import world as W
from loomgraph.scratch import checkpointed

R = random.Random(3)
LABELS = ["supports", "part_of", "related_to", "contradicts", "parallel_to"]
SCHEMA = "obs_id long, ts timestamp, task string, domain string, source string, concepts array<string>, relations array<struct<source:string,target:string,label:string>>, weakened array<string>, contradicted_relations array<struct<source:string,target:string,label:string>>, descriptions map<string,string>"


def observations(n):
    out = []
    for i in range(n):
        names = R.sample("abcdefgh", R.randint(1, 4))
        links = [(*R.sample(names, 2), R.choice(LABELS)) for _ in range(R.randint(0, 2))] if len(names) > 1 else []
        against = [(*R.sample("abcdefgh", 2), R.choice(LABELS))] if R.random() < 0.3 else []
        out.append((i, datetime(2024, 1, 1) + timedelta(hours=i // 2), "t", R.choice(["", "dom"]), f"s{i % 3}", names, links, R.sample("abcdefgh", 1) if R.random() < 0.2 else [], against, {names[0]: f"about {i}"} if i % 4 == 0 else {}))
    return out


def sequential(rows, specs, priors=None):
    """{name: (confidence, activations, weakenings)}, {(low, high, axis): edge}, descriptions. priors: {(obs_id, source, target, relation): (p, strength)}."""
    concepts, edges, waiting, texts = {}, {}, {}, {}

    def weaken(x):
        x["down"] += 1
        x["c"] = max(0.01, x["c"] - 0.06 / (1 + 0.08 * x["down"]))

    def reinforce(e):
        e["up"] += 1
        step, cap = (0.08 / (1 + 0.05 * e["up"]), 1.0) if e["explicit"] else (0.06 / (1 + 0.15 * e["up"]), 0.7)
        e["w"], e["c"] = min(cap, e["w"] + step), min(cap, e["c"] + step)

    for obs, _, _, _, _, names, links, weak, against, about in rows:
        for name in names:
            x = concepts.setdefault(name, {"c": 0.15, "up": 0, "down": 0})
            x["up"] += 1
            x["c"] = min(1.0, x["c"] + 0.06 / (1 + 0.08 * x["up"]))
        for a, b, label in links:
            axis, structural, propagation, relation = specs[label]
            key = (min(a, b), max(a, b), axis)
            prior = (priors or {}).get((obs, a, b, relation))
            if key in edges:
                e = edges[key]
                e["relation"] = relation
                if prior is None:
                    reinforce(e)
                else:
                    known, (p, strength) = max(1.0, 2.0 + e["up"] + e["down"]), prior
                    strength = max(0.0, strength)
                    e["w"] = e["c"] = e["p"] = min(1.0, max(0.0, (e["p"] * known + min(1.0, max(0.0, p)) * strength) / (known + strength)))
            elif prior is not None:
                p = min(1.0, max(0.0, prior[0])) if prior[1] > 0 else propagation
                edges[key] = {"ends": (a, b), "w": p, "c": p, "p": p, "up": 0, "down": 0, "explicit": True, "relation": relation}
            else:
                edges[key] = {"ends": (a, b), "w": propagation, "c": structural, "p": propagation, "up": 0, "down": 0, "explicit": True, "relation": relation}
        for a, b in itertools.combinations(sorted(names), 2):
            mine = [e for k, e in edges.items() if k[:2] == (a, b)]
            for e in mine:
                reinforce(e)
            if not mine:
                waiting[a, b] = waiting.get((a, b), 0) + 1
                if waiting[a, b] == 2:
                    edges[a, b, "parallel"] = {"ends": (a, b), "w": 0.15, "c": 0.15, "p": 0.15, "up": 0, "down": 0, "explicit": False, "relation": "co_membership"}
        texts |= about
        for name in weak:
            if name in concepts:
                weaken(concepts[name])
        for a, b, label in against:
            if a not in concepts or b not in concepts:
                continue
            e = edges.get((min(a, b), max(a, b), specs[label][0]))
            if e is None:
                weaken(concepts[a])
                weaken(concepts[b])
            else:
                e["down"] += 1
                step = 0.06 / (1 + 0.1 * e["down"])
                e["w"], e["c"] = max(0.01, e["w"] - step), max(0.01, e["c"] - step)
                e["p"] = e["c"]
    return concepts, edges, texts


def told(world):
    """The world's tables with names for ids, rounded."""
    names = {r.id: r.name for r in world.concepts.collect()}
    concepts = {r.name: (round(r.confidence, 6), r.activation_count, r.disconfirmation_count) for r in world.concepts.collect()}
    edges = {}
    for r in world.edges.collect():
        a, b = names[r.source_id], names[r.target_id]
        ends = (a, b) if r.is_explicit else tuple(sorted((a, b)))
        edges[min(a, b), max(a, b), r.axis] = (ends, r.relation, round(r.weight, 6), round(r.confidence, 6), round(r.probability, 6), r.reinforcement_count, r.disconfirmation_count, r.is_explicit)
    return concepts, edges


@pytest.fixture(scope="module")
def rows():
    out = observations(60)
    seen = set()  # contradictions may name only what is known by then, as ends are resolved for all observations at once
    for k, o in enumerate(out):
        seen |= set(o[5])
        out[k] = (*o[:7], [x for x in o[7] if x in seen], [x for x in o[8] if x[0] in seen and x[1] in seen], o[9])
    return out


def test_ingest_is_the_sequential_passes(spark, rows):
    cut = checkpointed(spark)
    table = V.with_spec(spark.createDataFrame([(x,) for x in LABELS], "label string"), "label").collect()
    specs = {r.label: (r.axis, r.structural, r.propagation, r.relation) for r in table}
    world, changes = W.ingest(spark.createDataFrame(rows, SCHEMA))
    world = W.written(world, cut)
    concepts, edges, texts = sequential(rows, specs)
    got_concepts, got_edges = told(world)
    assert got_concepts == {n: (round(x["c"], 6), x["up"], x["down"]) for n, x in concepts.items()}
    assert got_edges == {k: (e["ends"], e["relation"], *(round(e[x], 6) for x in "wcp"), e["up"], e["down"], e["explicit"]) for k, e in edges.items()}
    assert any(not e["explicit"] for e in edges.values()) and any(e["down"] for e in edges.values())
    assert {r.name: r.description for r in world.concepts.where("description is not null").collect()} == texts
    assert world.source_refs.agg(F.sum("n")).first()[0] == world.token_refs.agg(F.sum("n")).first()[0] == sum(len(o[5]) for o in rows)
    assert changes.where("kind = 'new'").count() == len(concepts) and changes.where("kind in ('new_relation', 'reinforced_relation')").count() == sum(len(o[6]) for o in rows)
    assert changes.where("kind = 'weakened_relation'").count() == sum(e["down"] for e in edges.values()) and changes.where("kind = 'cooccurrence'").count() == sum(not e["explicit"] for e in edges.values())
    assert changes.where("kind = 'weakened'").count() == sum(x["down"] for x in concepts.values()) and {r.label for r in changes.where("kind = 'weakened'").collect()} <= set(concepts)

    first, _ = W.ingest(spark.createDataFrame(rows[:25], SCHEMA))
    both, _ = W.ingest(spark.createDataFrame(rows[25:], SCHEMA), W.written(first, cut))
    assert told(W.written(both, cut)) == (got_concepts, got_edges)  # in two steps as in one
    same = lambda t: sorted(map(tuple, t.collect()))
    assert same(both.source_refs) == same(world.source_refs) and same(both.token_refs) == same(world.token_refs) and same(both.pending) == same(world.pending)


def test_priors_are_mixed_in_order(spark, rows):
    """Priors set births and are weighed with what is known, between reinforcements and weakenings; the last prior of a relation counts."""
    cut, rng = checkpointed(spark), random.Random(5)
    specs = {r.label: (r.axis, r.structural, r.propagation, r.relation) for r in V.with_spec(spark.createDataFrame([(x,) for x in LABELS], "label string"), "label").collect()}
    given, priors = [], {}
    for o in rows:
        mine = [(a, b, label, rng.choice([0.0, 0.3, 0.55, 0.9, 1.4]), rng.choice([1.0, 1.0, 3.0, 0.0, 250.0])) for a, b, label in o[6] if rng.random() < 0.6]
        mine += [("a", "h", "supports", 0.5, 1.0)] * rng.randint(0, 1) + mine[:1] * rng.randint(0, 1)
        priors |= {(o[0], a, b, specs[label][3]): (p, s) for a, b, label, p, s in mine}
        given.append((*o, mine))
    schema = SCHEMA + ", relation_priors array<struct<source:string,target:string,relation_type:string,probability:double,strength:double>>"
    table = spark.createDataFrame(given, schema)
    concepts, edges, _ = sequential(rows, specs, priors)
    want = {k: (e["ends"], e["relation"], *(round(e[x], 6) for x in "wcp"), e["up"], e["down"], e["explicit"]) for k, e in edges.items()}
    plain = sequential(rows, specs)[1]
    assert any(abs(edges[k]["w"] - plain[k]["w"]) > 0.1 for k in edges)
    world, _ = W.ingest(table)
    assert told(W.written(world, cut))[1] == want
    first, _ = W.ingest(table.where("obs_id < 20"))
    both, _ = W.ingest(table.where("obs_id >= 20"), W.written(first, cut))
    assert told(W.written(both, cut))[1] == want


def test_all_pairs_without_a_cap(spark):
    rows = [(i, datetime(2024, 1, 1 + i), "t", "", "s", [f"n{k:02d}" for k in range(12)], [], [], [], {}) for i in range(2)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert W.ingest(table)[0].edges.count() == 30 and W.ingest(table, pair_cap=None)[0].edges.count() == 66


def test_a_shared_observation_reinforces_an_explicit_edge(spark):
    rows = [(i, datetime(2024, 1, 1 + i), "t", "", "s", ["a", "b"], [("a", "b", "supports")] if i == 0 else [], [], [], {}) for i in range(6)]
    edge = W.ingest(spark.createDataFrame(rows, SCHEMA))[0].edges.collect()
    assert len(edge) == 1 and edge[0].reinforcement_count == 6 and edge[0].weight == 1.0


def test_candidates_are_resolved(spark):
    cand = "array<struct<uid:string,name:string,kind:string,sense:string,domain:string,description:string,aliases:array<string>,evidence:string>>"
    schema = SCHEMA.replace("concepts array<string>", f"concept_candidates {cand}")
    bank = lambda uid, sense: (uid, "Bank", "place", sense, "", "", ["the bank"], "seen")
    rows = [(1, datetime(2024, 1, 1), "t", "", "s", [bank("x", "river side"), bank("y", "money house")], [("x", "y", "supports")], [], [], {}), (2, datetime(2024, 1, 2), "t", "", "s", [bank("z", "river side")], [], ["z"], [], {})]
    world, _ = W.ingest(spark.createDataFrame(rows, schema))
    got = sorted((r.activation_count, r.disconfirmation_count) for r in world.concepts.collect())
    assert got == [(1, 0), (2, 1)] and world.edges.count() == 1


def test_empty_ingest(spark):
    world, changes = W.ingest(spark.createDataFrame([], SCHEMA))
    assert world.concepts.count() == world.edges.count() == changes.count() == world.pending.count() == 0


def test_keys_that_fit_one_chunk_are_not_dealt_by_ranges(spark, monkeypatch):
    """Before, all events were sorted by ranges and written once more."""
    from loomgraph.operators import evidence as E

    rows = [(c, i, i, "weaken" if i % 3 == 0 else "activate") for c, n in (("a", 5), ("b", 40)) for i in range(n)]
    many = [("c", i, i, "weaken" if i % 3 == 0 else "activate") for i in range(5000)]
    df = lambda r: spark.createDataFrame(r, "concept string, t long, obs_id long, kind string").selectExpr("concept", "timestamp_seconds(t) AS ts", "obs_id", "kind")
    told = lambda d: {r.concept: (round(r.confidence, 9), r.activation_count, r.disconfirmation_count, r.last_weakened) for r in E.fold_concepts(d).collect()}
    both = told(df(rows + many))  # c goes by ranges, a and b don't
    dealt = []
    monkeypatch.setattr(E, "in_ranges", lambda *a, **k: dealt.append(a))
    assert told(df(rows)) == {c: both[c] for c in "ab"} and not dealt
    x, up, down = 0.15, 0, 0
    for _, _, _, kind in many:
        up, down = up + (kind == "activate"), down + (kind == "weaken")
        x = min(1.0, x + 0.06 / (1 + 0.08 * up)) if kind == "activate" else max(0.01, x - 0.06 / (1 + 0.08 * down))
    assert both["c"][:3] == (round(x, 9), up, down)


def test_only_open_ends_are_looked_up_among_labels(spark, monkeypatch):
    """Before, every relation was joined with the labels of all concepts, for each end."""
    from loomgraph.operators import resolve
    from loomgraph.scratch import checkpointed

    rows = lambda r: spark.createDataFrame(r, "obs_id long, source string, target string")
    near = spark.createDataFrame([(1, "A", "ia"), (1, "B", "ib"), (2, "A", "other")], "obs_id long, ref string, id string")
    known = spark.createDataFrame([("ic", "C", [])], "id string, name string, aliases array<string>")
    told = lambda d, cut: sorted(tuple(r) for r in resolve.resolve_endpoints(d, near, known, cut).collect())
    some, all_near = rows([(1, "a", "b"), (1, "B ", "c"), (2, "a", "nobody"), (2, "A", "a")]), rows([(1, "a", "b"), (1, "A", "a")])
    assert told(some, checkpointed(spark)) == told(some, None) == [(1, "B ", "c", "ib", "ic"), (1, "a", "b", "ia", "ib")]
    monkeypatch.setattr(resolve, "label_index", None)
    assert told(all_near, checkpointed(spark)) == [(1, "a", "b", "ia", "ib")]


def test_shuffles_go_with_the_table_that_they_made(spark, tmp_path):
    """Before, they stayed on disk until the driver collected its garbage."""
    import time

    from loomgraph.sources.tables import write_world

    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.rsplit("/", 1)[-1] for x in at.getAllFiles().mkString(" ").split(" ") if "/shuffle_" in x}
    spread = lambda: spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before = held()
    out = checkpointed(spark)(spread())
    write_world({"t": spread()}, str(tmp_path / "w"), 1)
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    left = sorted(held() - before)
    assert not left and out.count() == 100


def test_what_ingest_wrote_can_be_cleared(spark):
    """Before, nothing could remove what an ingest had written to scratch, however many batches came."""
    from pathlib import Path

    from loomgraph.scratch import folder

    left = lambda: set(Path(folder(spark).removeprefix("file://")).glob("cut-*"))
    before, cut = left(), checkpointed(spark, "zstd")
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), "t", "d", x) for x in "ab"], "obs_id long, ts timestamp, task string, domain string, name string")
    links = spark.createDataFrame([(1, datetime(2024, 1, 1), 0, "a", "b", "supports", False), (1, datetime(2024, 1, 1), 1, "b", "a", "supports", True)], "obs_id long, ts timestamp, ordinal int, source string, target string, label string, against boolean")
    world, _ = W.ingest_rows(rows, links, None, rows.select("obs_id", "ts", "name").where("false"), cut=cut)
    assert world.edges.select("reinforcement_count", "disconfirmation_count").collect() == [(1, 1)]
    mine = left() - before
    cut.clear()
    assert len(mine) > 8 and len(left() - before) <= 3, (len(mine), len(left() - before))  # running numbers and long keys are written by their own helpers


def test_passes_move_numbers(spark, monkeypatch):
    """Before, pairs and events were shuffled and written under ids of 19 characters; the numbers keep the order of the ids."""
    pairs = []
    was = W.cooccurrence.mention_pairs
    monkeypatch.setattr(W.cooccurrence, "mention_pairs", lambda m, cap: pairs.append(m.schema["concept"].dataType.typeName()) or was(m, cap))
    rows = [(i, datetime(2024, 1, 1 + i), "t", "", "s", list("dacb"), [], [], [], {}) for i in range(2)]
    world, _ = W.ingest(spark.createDataFrame(rows, SCHEMA))
    ids = {r.id for r in world.concepts.collect()}
    edges = [(r.source_id, r.target_id) for r in world.edges.collect()]
    assert pairs == ["long"] and len(edges) == 6 and all(a < b and {a, b} <= ids for a, b in edges)


def test_keys_of_one_chunk_are_folded_once(spark, monkeypatch):
    """Before, what came from a key's only chunk was folded again with nothing, and each fold began with a step that does nothing."""
    from loomgraph.operators import evidence as E

    built, then = [], E._then
    monkeypatch.setattr(E, "_then", lambda f, g: built.append(1) or then(f, g))
    rows = lambda n: spark.range(n).selectExpr("'c' AS concept", "timestamp_seconds(id) AS ts", "id AS obs_id", "IF(id % 3 = 0, 'weaken', 'activate') AS kind")

    def folded(n):
        built.clear()
        got = E.fold_concepts(rows(n)).first()
        x, up, down = 0.15, 0, 0
        for i in range(n):
            up, down = up + (i % 3 > 0), down + (i % 3 == 0)
            x = min(1.0, x + 0.06 / (1 + 0.08 * up)) if i % 3 else max(0.01, x - 0.06 / (1 + 0.08 * down))
        assert (round(got.confidence, 9), got.activation_count, got.disconfirmation_count) == (round(x, 9), up, down)
        return len(built)

    monkeypatch.setattr(E, "CHUNK_BITS", 3)
    assert folded(1) == folded(8) == 1 and folded(30) == 2
