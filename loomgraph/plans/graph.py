"""Queries on spreading activation, selection, communities, colour, entropy and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import color as K
from ..operators import communities as M
from ..operators import graph as G
from ..operators import metrics as Q
from ..scratch import checkpointed
from .evidence import AS_OF, as_of
from .registry import Inputs, query

FLAGSHIP = "f01_activate"
FRESH = f"epoch_us(TIMESTAMP '{AS_OF}' - {{}}) / 3.6e9"
C_FRESH = "greatest(1e-1, pow(5e-1, " + FRESH.format("last_activated") + " / 168))"
E_FRESH = "greatest(15e-2, pow(5e-1, " + FRESH.format("last_reinforced") + " / (72 * (1 + 5e-1 * reinforcement_count))))"
FACTOR = "CASE axis WHEN 'positive' THEN 1e0 WHEN 'parallel' THEN 75e-2 ELSE 6e-1 END"
NODES = f"nodes AS (SELECT id, confidence, domain, greatest(confidence, 3e-1) AS ready, {C_FRESH} AS fresh FROM {{concepts}})"
LINKS = f"""e AS (SELECT source_id, target_id, axis, weight * {FACTOR} * {E_FRESH} AS s FROM {{edges}}), both_ways AS (SELECT source_id AS id, target_id AS nb, axis, s FROM e UNION ALL SELECT target_id, source_id, axis, s FROM e),
    near AS (SELECT b.id, b.nb, b.axis, b.s * n.ready * n.fresh * CASE WHEN n.domain = 'Brand#1' THEN 13e-1 ELSE 1 END AS s FROM both_ways b JOIN nodes n ON n.id = b.nb)"""


def _step(d: int, boost: str = "") -> str:
    """One synchronous step of spreading, from frontier f{d} and state a{d}."""
    return f"""m{d} AS (SELECT f.query_id, near.nb AS id, near.axis, f.a * near.s * {0.6 ** (d + 1)!r}::DOUBLE{boost} AS raw, fl.floor FROM f{d} f JOIN near ON near.id = f.id JOIN floors fl ON fl.query_id = f.query_id WHERE f.a >= 1e-2),
    i{d} AS (SELECT query_id, id, max(raw) * 6e-1 AS inh FROM m{d} WHERE axis = 'negative' AND raw * 6e-1 >= 1e-2 GROUP BY 1, 2),
    g{d} AS (SELECT query_id, id, max(v) AS m FROM (SELECT query_id, id, CASE WHEN raw > 0 AND raw < floor THEN floor ELSE raw END AS v FROM m{d} WHERE axis <> 'negative') WHERE v >= 1e-2 GROUP BY 1, 2),
    a{d + 1} AS (SELECT coalesce(a.query_id, g.query_id) AS query_id, coalesce(a.id, g.id) AS id, CASE WHEN coalesce(g.m, 0) > coalesce(a.a, 0) THEN g.m ELSE a.a END AS a, coalesce(g.m, 0) > coalesce(a.a, 0) AS better FROM a{d} a FULL JOIN g{d} g ON a.query_id = g.query_id AND a.id = g.id),
    f{d + 1} AS (SELECT query_id, id, a FROM a{d + 1} WHERE better)"""


NET = """inh AS (SELECT query_id, id, max(inh) AS inh FROM (SELECT * FROM i0 UNION ALL SELECT * FROM i1) GROUP BY 1, 2),
    net AS (SELECT a2.query_id, a2.id, a2.a AS activation, coalesce(inh, 0) AS inhibition, a2.a - coalesce(inh, 0) AS score FROM a2 LEFT JOIN inh ON inh.query_id = a2.query_id AND inh.id = a2.id WHERE a2.a - coalesce(inh, 0) > 1e-2)"""
ACTIVE = f"""{NODES}, {LINKS}, a0 AS (SELECT s.query_id, s.id, CASE WHEN n.domain = 'Brand#1' THEN least(1e0, n.confidence * 13e-1) ELSE n.confidence END AS a, true AS better FROM {{seeds}} s JOIN nodes n ON n.id = s.id), f0 AS (SELECT query_id, id, a FROM a0),
    floors AS (SELECT query_id, max(a) * 3e-2 AS floor FROM a0 GROUP BY 1), {_step(0)}, {_step(1)}, {NET}"""
# With tasks: a concept has those in which it was seen six times or more, an edge the ones that its ends share, a query its order's priority.
TASKED = f"""{NODES}, tk AS (SELECT id, label FROM {{colors}} WHERE strength >= 3e-1), qt AS (SELECT concat('q', CAST(o_orderkey AS VARCHAR)) AS query_id, o_orderpriority AS task FROM orders WHERE o_orderkey % 20 = 0),
    e AS (SELECT source_id, target_id, axis, weight * {FACTOR} * {E_FRESH} AS s FROM {{edges}}), both_ways AS (SELECT source_id AS id, target_id AS nb, axis, s FROM e UNION ALL SELECT target_id, source_id, axis, s FROM e),
    near AS (SELECT b.id, b.nb, b.axis, b.s * n.ready * n.fresh * CASE WHEN n.domain = 'Brand#1' THEN 13e-1 ELSE 1 END AS s FROM both_ways b JOIN nodes n ON n.id = b.nb),
    a0 AS (SELECT s.query_id, s.id, CASE WHEN n.domain = 'Brand#1' THEN least(1e0, c * 13e-1) ELSE c END AS a, true AS better FROM (SELECT s.query_id, s.id, CASE WHEN t.id IS NULL THEN n.confidence ELSE least(1e0, n.confidence * 15e-1) END AS c FROM {{seeds}} s JOIN nodes n ON n.id = s.id JOIN qt ON qt.query_id = s.query_id LEFT JOIN tk t ON t.id = s.id AND t.label = qt.task) s JOIN nodes n ON n.id = s.id),
    f0 AS (SELECT query_id, id, a FROM a0), floors AS (SELECT query_id, max(a) * 3e-2 AS floor, min(task) AS task FROM a0 JOIN qt USING (query_id) GROUP BY 1), {_step(0, " * CASE WHEN (near.nb, fl.task) IN (SELECT (id, label) FROM tk) THEN 15e-1 ELSE 1 END")}, {_step(1, " * CASE WHEN (near.nb, fl.task) IN (SELECT (id, label) FROM tk) THEN 15e-1 ELSE 1 END")}, {NET}"""


def _mmr(k: int, source: str = "net", task: bool = False) -> str:
    """The greedy selection with its k rounds written out."""
    fits = "CASE WHEN t.id IS NULL THEN 6e-1 ELSE 1 END" if task else "1"
    tasked = "JOIN qt ON qt.query_id = n.query_id LEFT JOIN tk t ON t.id = n.id AND t.label = qt.task" if task else ""
    like = "CASE WHEN len(l.n) + len(p.n) = 0 THEN 0 ELSE len(list_intersect(l.n, p.n))::DOUBLE / len(list_distinct(l.n || p.n)) END"
    out = f"""nbs AS (SELECT id, list(DISTINCT nb) AS n FROM both_ways GROUP BY 1), tops AS (SELECT query_id, max(score) AS top FROM {source} GROUP BY 1),
        l1 AS (SELECT n.query_id, n.id, n.score, n.score / CASE WHEN top = 0 THEN 1 ELSE top END * {fits} * (7e-1 + 3e-1 * coalesce(c.fresh, 1)) AS rel, coalesce(b.n, []) AS n, 0e0 AS sim
            FROM {source} n JOIN tops USING (query_id) LEFT JOIN nodes c ON c.id = n.id LEFT JOIN nbs b ON b.id = n.id {tasked})"""
    for r in range(1, k + 1):
        out += f""", p{r} AS (SELECT query_id, {r} AS rank, id, score, mmr, n FROM (SELECT *, round(7e-1 * rel - 3e-1 * sim, 9) AS mmr FROM l{r}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mmr DESC, id) = 1),
        l{r + 1} AS (SELECT l.query_id, l.id, l.score, l.rel, l.n, greatest(l.sim, {like}) AS sim FROM l{r} l JOIN p{r} p ON p.query_id = l.query_id AND p.id <> l.id)"""
    return out + ", picks AS (" + " UNION ALL ".join(f"SELECT query_id, rank, id, score, mmr FROM p{r}" for r in range(1, k + 1)) + ")"


def _queries(t: Inputs) -> DataFrame:
    return t.seeds.select("query_id").distinct().withColumns({"task": F.lit(""), "active_domains": F.array(F.lit("Brand#1"))})


def _active(t: Inputs) -> DataFrame:
    return G.activate(t.seeds, _queries(t), t.concepts, t.edges, as_of())


ROUND = "round(activation, 4) AS activation, round(inhibition, 4) AS inhibition, round(score, 4) AS score"


@query("f01_activate", "WITH " + ACTIVE + f" SELECT query_id, id, {ROUND} FROM net")
def activate(t: Inputs):
    """F1 to F3: excitation and inhibition for all queries at once."""
    return _active(t).select("query_id", "id", *[F.round(c, 4).alias(c) for c in ("activation", "inhibition", "score")])


@query("f02_inhibition", "WITH " + ACTIVE + " SELECT query_id, count(*) AS n, count(*) FILTER (inhibition > 0) AS inhibited, round(sum(inhibition), 3) AS total FROM net GROUP BY 1")
def inhibition(t: Inputs):
    return _active(t).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("inhibition") > 0).alias("inhibited"), F.round(F.sum("inhibition"), 3).alias("total"))


@query("f03_record_activation", "WITH " + ACTIVE + " SELECT id, count(*) AS touched FROM net GROUP BY 1")
def record(t: Inputs):
    return _active(t).groupBy("id").agg(F.count("*").alias("touched"))


@query("f07_top_concepts", "WITH " + ACTIVE + ", r AS (SELECT query_id, id, round(score, 6) AS score FROM net), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) SELECT query_id, rank, id, round(score, 4) AS score FROM k WHERE rank <= 10")
def top(t: Inputs):
    scores = _active(t).select("query_id", "id", F.round("score", 6).alias("score"))
    return G.top_concepts(scores, 10).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def _selected(t: Inputs, k: int = 6) -> DataFrame:
    cut = checkpointed(t.spark)
    return G.select_mmr(cut(_active(t)), _queries(t), t.concepts, t.edges, as_of(), k=k, cut=cut)


def _for_tasks(t: Inputs) -> tuple:
    """(queries, concepts, edges) with tasks: see TASKED."""
    queries = t.orders.where("o_orderkey % 20 = 0").select(F.concat(F.lit("q"), "o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("task"), F.array(F.lit("Brand#1")).alias("active_domains"))
    tasks = t.colors.where("strength >= 0.3").groupBy("id").agg(F.collect_set("label").alias("tasks"))
    shared = lambda a, b: F.array_intersect(a, b)
    ends = t.edges.join(tasks.toDF("source_id", "_a"), "source_id", "left").join(tasks.toDF("target_id", "_b"), "target_id", "left")
    return queries, t.concepts.join(tasks, "id", "left"), ends.withColumn("tasks", shared("_a", "_b")).drop("_a", "_b")


@query("f01_activate_for_task", "WITH " + TASKED + f" SELECT query_id, id, {ROUND} FROM net")
def activate_for_task(t: Inputs):
    """Activation with the order's priority as the task: what was seen in it is boosted."""
    out = G.activate(t.seeds, *_for_tasks(t), as_of())
    return out.select("query_id", "id", *[F.round(c, 4).alias(c) for c in ("activation", "inhibition", "score")])


@query("f04_select_for_task", "WITH " + TASKED + ", " + _mmr(4, task=True) + " SELECT query_id, rank, id, round(mmr, 5) AS mmr FROM picks")
def select_for_task(t: Inputs):
    cut = checkpointed(t.spark)
    queries, concepts, edges = _for_tasks(t)
    scores = cut(G.activate(t.seeds, queries, concepts, edges, as_of()))
    return G.select_mmr(scores, queries, concepts, edges, as_of(), k=4, cut=cut).select("query_id", "rank", "id", F.round("mmr", 5).alias("mmr"))


@query("f04_select_mmr", "WITH " + ACTIVE + ", " + _mmr(6) + " SELECT query_id, rank, id, round(score, 6) AS score, round(mmr, 6) AS mmr FROM picks")
def mmr(t: Inputs):
    return _selected(t).select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.round("mmr", 6).alias("mmr"))


@query("f05_induced_subgraph", "WITH " + ACTIVE + " SELECT n.query_id, e.source_id, e.target_id, e.axis FROM net n JOIN {edges} e ON e.source_id = n.id JOIN net m ON m.query_id = n.query_id AND m.id = e.target_id")
def induced(t: Inputs):
    return G.induced_subgraph(_active(t).select("query_id", "id"), t.edges).select("query_id", "source_id", "target_id", "axis")


@query("f06_project")
def project(t: Inputs):
    chosen = _selected(t)
    return G.render_projection(chosen.select("query_id", "id", "score"), t.edges, t.concepts)


@query("c08_edges_between", "SELECT DISTINCT e.source_id, e.target_id, e.axis FROM {edges} e JOIN (SELECT DISTINCT a.id AS x, b.id AS y FROM {seeds} a JOIN {seeds} b USING (query_id)) p ON p.x = e.target_id AND p.y = e.source_id")
def between(t: Inputs):
    s = t.seeds
    pairs = s.toDF("query_id", "a").join(s.toDF("query_id", "b"), "query_id").select("a", "b")
    return G.edges_between(t.edges, pairs).select("source_id", "target_id", "axis")


@query("c08_neighbors", "SELECT id, list_sort(list(DISTINCT nb)) AS neighbors FROM (SELECT source_id AS id, target_id AS nb FROM {edges} UNION ALL SELECT target_id, source_id FROM {edges}) GROUP BY 1")
def neighbors(t: Inputs):
    return G.neighbor_sets(t.edges)


COUPLE = f"c AS (SELECT source_id, target_id, weight * {FACTOR} AS w FROM {{edges}})"
TEMPORAL = f"""{NODES}, c AS (SELECT e.source_id, e.target_id, e.weight * {FACTOR} * {E_FRESH} * (x.fresh + y.fresh) / 2 AS w FROM {{edges}} e JOIN nodes x ON x.id = e.source_id JOIN nodes y ON y.id = e.target_id)"""
SYMMETRIC = "SELECT a, b, round(sum(w), 10) AS weight FROM (SELECT source_id AS a, target_id AS b, w FROM c UNION ALL SELECT target_id, source_id, w FROM c) GROUP BY 1, 2"


@query("f08_coupling", f"WITH {COUPLE} {SYMMETRIC}")
def coupling(t: Inputs):
    return G.coupling(t.edges).withColumn("weight", F.round("weight", 10))


@query("f08_temporal_coupling", f"WITH {TEMPORAL} {SYMMETRIC}")
def temporal(t: Inputs):
    return G.coupling(t.edges, t.concepts, as_of()).withColumn("weight", F.round("weight", 10))


def _found(t: Inputs) -> DataFrame:
    cut = checkpointed(t.spark)
    links = cut(G.coupling(t.edges.where("weight > 0"), t.concepts, as_of()))
    return M.build_communities(M.propagate_labels(links, cut), links)


@query("f09_detect_communities")
def communities(t: Inputs):
    return _found(t)


@query("f10_reconcile_communities")
def reconcile(t: Inputs):
    cut = checkpointed(t.spark)
    found = cut(_found(t))
    stored = found.select("id", F.filter("member_ids", lambda m: F.pmod(F.xxhash64(m), F.lit(5)) > 0).alias("member_ids"), F.lit(3).alias("stability"), F.lit(2).alias("seen_count"))
    stored = stored.withColumn("id", F.concat("id", F.lit("x")))
    return M.reconcile(found, stored, cut).select("id", F.size("member_ids").alias("size"), "stability", "seen_count", "state")


@query("f11_color_sources")
def sources(t: Inputs):
    return M.color_sources(_found(t).withColumn("stability", F.when(F.col("size") > 3, 2).otherwise(1)))


BLEND = "least(1e0, {0} + {1} * (1 - {0}))"


@query("f12_seed_color", "SELECT id, label, round(strength + 55e-2 * (1 - strength), 4) AS strength FROM {colors} WHERE label = '1-URGENT' UNION ALL SELECT id, label, round(strength, 4) FROM {colors} WHERE label <> '1-URGENT'")
def seed(t: Inputs):
    seeds = t.colors.where("label = '1-URGENT'").select("id", "label", F.lit(0.55).alias("amount"))
    return K.seed_color(t.colors, seeds).withColumn("strength", F.round("strength", 4))


@query("f12_dominant_domain", "SELECT id, arg_min(label, (-strength, label)) AS domain, round(max(strength), 4) AS strength FROM {colors} GROUP BY 1")
def dominant(t: Inputs):
    return K.dominant(t.colors).withColumn("strength", F.round("strength", 4))


def _flow(s: int, rate: float, decay: float) -> str:
    r = repr(rate * decay**s) + "::DOUBLE"
    return f"""t{s} AS (SELECT b.nb AS id, k.label, least(1e0, sum(k.strength * b.w * {r})) AS amount FROM k{s} k JOIN adj b ON b.id = k.id WHERE k.id IN (SELECT id FROM f{s}) AND b.w * {r} >= 1e-2 AND k.strength * b.w * {r} >= 1e-2 GROUP BY 1, 2),
    x{s} AS (SELECT coalesce(k.id, t.id) AS id, coalesce(k.label, t.label) AS label, coalesce(k.strength, 0) AS before, least(1e0, coalesce(k.strength, 0) + coalesce(t.amount, 0) * (1 - coalesce(k.strength, 0))) AS after FROM k{s} k FULL JOIN t{s} t ON k.id = t.id AND k.label = t.label),
    k{s + 1} AS (SELECT id, label, CASE WHEN abs(after - before) < 1e-6 THEN before ELSE after END AS strength FROM x{s}), f{s + 1} AS (SELECT DISTINCT id FROM x{s} WHERE abs(after - before) >= 1e-6)"""


ADJ = f"adj AS (SELECT source_id AS id, target_id AS nb, weight * {FACTOR} AS w FROM {{edges}} UNION ALL SELECT target_id, source_id, weight * {FACTOR} FROM {{edges}})"


@query("f13_diffuse", f"WITH {ADJ}, k0 AS (SELECT * FROM {{colors}}), f0 AS (SELECT id FROM {{concepts}} WHERE domain = 'Brand#1'), {_flow(0, 0.18, 0.62)}, {_flow(1, 0.18, 0.62)} SELECT id, label, round(strength, 4) AS strength FROM k2")
def diffuse(t: Inputs):
    return K.diffuse(t.colors, t.concepts.where("domain = 'Brand#1'").select("id"), t.edges).withColumn("strength", F.round("strength", 4))


@query("f14_settle", f"WITH {ADJ}, k0 AS (SELECT * FROM {{colors}}), f0 AS (SELECT id FROM k0), {_flow(0, 0.08, 0.62)} SELECT id, label, round(strength, 4) AS strength FROM k1")
def settle(t: Inputs):
    return K.settle(t.colors, t.edges).withColumn("strength", F.round("strength", 4))


@query("f15_seed_from_communities", f"""WITH {ADJ}, s AS (SELECT id, domain AS label, CASE WHEN maturity = 'established' THEN 65e-2 ELSE 35e-2 END AS amount FROM {{concepts}}),
    k0 AS (SELECT id, label, strength FROM {{colors}} UNION ALL SELECT id, label, amount FROM s), f0 AS (SELECT id FROM s), {_flow(0, 0.126, 0.62)} SELECT id, label, round(strength, 4) AS strength FROM k1""")
def from_communities(t: Inputs):
    members = t.concepts.select("id", F.col("domain").alias("label"), (F.col("maturity") == "established").alias("core"))
    return K.seed_from_communities(t.colors, members, t.edges).withColumn("strength", F.round("strength", 4))


@query("f16_fade", f"""WITH {COUPLE}, l AS (SELECT a, b, sum(w) AS w FROM (SELECT source_id AS a, target_id AS b, w FROM c UNION ALL SELECT target_id, source_id, w FROM c) GROUP BY 1, 2),
    o AS (SELECT k.id, k.label, k.strength, coalesce((SELECT sum(l.w * n.strength) FROM l JOIN {{colors}} n ON n.id = l.b AND n.label = k.label WHERE l.a = k.id) / (SELECT sum(l.w) FROM l WHERE l.a = k.id), 0) AS q FROM {{colors}} k),
    r AS (SELECT id, median(q) AS ref FROM o GROUP BY 1)
    SELECT id, label, round(s, 5) AS strength FROM (SELECT o.id, o.label, o.strength * (1 - CASE WHEN ref <= 0 THEN 2e-2 ELSE greatest(2e-2, greatest(0, 1 - q / ref) / 4) END) AS s FROM o JOIN r ON r.id = o.id) WHERE s >= 15e-3""")
def fade(t: Inputs):
    return K.fade(t.colors, t.edges).withColumn("strength", F.round("strength", 5))


MASS = f"m AS (SELECT source_id, target_id, axis, greatest(0, probability) * {FACTOR} * CASE WHEN is_explicit THEN 1e0 ELSE 75e-2 END AS mass FROM {{edges}})"
ENTROPY = f"""{MASS}, b AS (SELECT id, nb, sum(mass) AS m FROM (SELECT source_id AS id, target_id AS nb, mass FROM m UNION ALL SELECT target_id, source_id, mass FROM m) WHERE mass > 0 GROUP BY 1, 2),
    p AS (SELECT id, m / sum(m) OVER (PARTITION BY id) AS p FROM b), h AS (SELECT id, count(*) AS neighbors, -sum(p * log2(p)) / log2(count(*)) AS entropy FROM p GROUP BY 1 HAVING count(*) >= 2)"""


@query("f17_node_entropy", f"WITH {ENTROPY} SELECT id, neighbors, round(entropy, 5) AS entropy FROM h")
def entropy(t: Inputs):
    return Q.node_entropy(t.edges).withColumn("entropy", F.round("entropy", 5))


@query("f17_network_entropy", f"""WITH {ENTROPY}, w AS (SELECT c.id, entropy, greatest(confidence, 5e-2) * CASE maturity WHEN 'embryonic' THEN 5e-1 WHEN 'developing' THEN 75e-2 WHEN 'established' THEN 1e0 WHEN 'core' THEN 12e-1 ELSE 35e-2 END AS w FROM {{concepts}} c LEFT JOIN h ON h.id = c.id)
    SELECT round(sum(entropy * w) / sum(w) FILTER (entropy IS NOT NULL), 5) AS entropy, count(entropy) AS considered, count(*) FILTER (entropy IS NULL) AS isolated, count(*) FILTER (entropy >= 7e-1) AS high, count(*) FILTER (entropy <= 2e-1) AS low FROM w""")
def network(t: Inputs):
    return Q.network_entropy(t.concepts, t.edges).withColumn("entropy", F.round("entropy", 5))


@query("f18_axis_entropy", f"WITH {MASS}, a AS (SELECT axis, sum(mass) AS m FROM m GROUP BY 1), p AS (SELECT axis, m, m / sum(m) OVER () AS p FROM a) SELECT count(*) AS axes, round(-sum(p * log2(p)) / log2(count(*)), 5) AS entropy, round(sum(m) FILTER (axis = 'positive'), 3) AS positive_mass, round(sum(m) FILTER (axis = 'negative'), 3) AS negative_mass, round(sum(m) FILTER (axis = 'parallel'), 3) AS parallel_mass FROM p")
def axes(t: Inputs):
    return Q.axis_entropy(t.edges).select("axes", F.round("entropy", 5).alias("entropy"), *[F.round(f"{a}_mass", 3).alias(f"{a}_mass") for a in ("positive", "negative", "parallel")])


@query("d15_world_status", f"""WITH {ENTROPY}, {{W}}, g AS (SELECT domain, count(*) AS n, count(*) FILTER (maturity = 'established') AS e FROM {{concepts}} GROUP BY 1),
    k AS (SELECT id, strength, row_number() OVER (PARTITION BY id ORDER BY strength DESC, label) AS r, sum(strength) OVER (PARTITION BY id) AS total FROM {{colors}}),
    q AS (SELECT id, max(strength) FILTER (r = 1) / max(total) AS purity, coalesce(max(strength) FILTER (r = 2) >= 0.08 AND max(strength) FILTER (r = 2) / max(strength) >= 0.55, false) AS bridge FROM k GROUP BY 1),
    t AS (SELECT axis, sum(mass) AS m FROM m GROUP BY 1), u AS (SELECT m / sum(m) OVER () AS p FROM t)
    SELECT (SELECT count(*) FROM {{concepts}}) AS concepts, (SELECT count(*) FROM {{concepts}} WHERE maturity = 'embryonic') AS n_embryonic, (SELECT count(*) FROM {{concepts}} WHERE maturity = 'developing') AS n_developing, (SELECT count(*) FROM {{concepts}} WHERE maturity = 'established') AS n_established,
    (SELECT count(*) FROM {{concepts}} WHERE maturity = 'core') AS n_core, (SELECT count(*) FROM {{concepts}} WHERE maturity = 'fading') AS n_fading, (SELECT round(avg(confidence), 5) FROM {{concepts}}) AS avg_confidence, count(*) AS relations, count(*) FILTER (is_explicit) AS explicit_relations, round(avg(weight), 5) AS avg_weight,
    (SELECT count(*) FROM g) AS communities, (SELECT count(*) FROM g WHERE e >= 2 AND n >= 3) AS stable_communities, (SELECT count(*) FROM q WHERE bridge) AS bridges, (SELECT round(avg(purity), 5) FROM q) AS avg_purity,
    (SELECT round(sum(entropy * w) / sum(w) FILTER (entropy IS NOT NULL), 5) FROM w) AS network_entropy, (SELECT count(*) FILTER (entropy >= 7e-1) FROM w) AS high_entropy, (SELECT round(-sum(p * log2(p)) / log2(count(*)), 5) FROM u) AS type_entropy FROM {{edges}}""".replace("{W}", "w AS (SELECT c.id, entropy, greatest(confidence, 5e-2) * CASE maturity WHEN 'embryonic' THEN 5e-1 WHEN 'developing' THEN 75e-2 WHEN 'established' THEN 1e0 WHEN 'core' THEN 12e-1 ELSE 35e-2 END AS w FROM {concepts} c LEFT JOIN h ON h.id = c.id)"))
def status(t: Inputs):
    """The domains stand for communities, as stable as they have established concepts."""
    groups = t.concepts.groupBy(F.col("domain").alias("id")).agg(F.collect_list("id").alias("member_ids"), F.count_if(F.col("maturity") == "established").alias("stability"))
    out = Q.world_status(t.concepts, t.edges, groups, t.colors)
    return out.withColumns({c: F.round(c, 5) for c in ("avg_confidence", "avg_weight", "avg_purity", "network_entropy", "type_entropy")})


RANKED = "ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM net), rel AS (SELECT query_id, id, 1 AS rel FROM {seeds})"


def _ranked(t: Inputs) -> DataFrame:
    return G.top_concepts(_active(t).select("query_id", "id", F.round("score", 6).alias("score")), 5).select("query_id", "id", "rank")


@query("j01_precision_recall", "WITH " + ACTIVE + ", " + RANKED + """ SELECT s.query_id, count(r.id) AS hits, round(count(r.id) / least(5, max(n)), 4) AS precision, round(count(r.id) / count(*), 4) AS recall
    FROM rel s LEFT JOIN ranked r ON r.query_id = s.query_id AND r.id = s.id AND r.rank <= 5 JOIN (SELECT query_id, count(*) AS n FROM net GROUP BY 1) c ON c.query_id = s.query_id GROUP BY 1""")
def precision(t: Inputs):
    return Q.precision_recall(_ranked(t), t.seeds).withColumns({"precision": F.round("precision", 4), "recall": F.round("recall", 4)})


@query("j02_ndcg", "WITH " + ACTIVE + ", " + RANKED + """, i AS (SELECT query_id, sum(1 / log2(k + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM rel) WHERE k <= 5 GROUP BY 1),
    d AS (SELECT r.query_id, sum(1 / log2(r.rank + 1)) AS dcg FROM ranked r JOIN rel s ON s.query_id = r.query_id AND s.id = r.id WHERE r.rank <= 5 GROUP BY 1) SELECT i.query_id, round(coalesce(dcg, 0) / idcg, 4) AS ndcg FROM i LEFT JOIN d ON d.query_id = i.query_id""")
def ndcg(t: Inputs):
    return Q.ndcg_at_k(_ranked(t), t.seeds.withColumn("rel", F.lit(1))).withColumn("ndcg", F.round("ndcg", 4))


@query("j03_projection_diversity", "WITH " + ACTIVE + ", " + RANKED + """, nb AS (SELECT id, list(DISTINCT nb) AS n FROM (SELECT source_id AS id, target_id AS nb FROM {edges} UNION ALL SELECT target_id, source_id FROM {edges}) GROUP BY 1),
    s AS (SELECT r.query_id, r.id, coalesce(nb.n, []) AS n FROM ranked r LEFT JOIN nb ON nb.id = r.id WHERE r.rank <= 5)
    SELECT a.query_id, round(avg(CASE WHEN len(a.n) + len(b.n) = 0 THEN 1 ELSE 1 - len(list_intersect(a.n, b.n))::DOUBLE / len(list_distinct(a.n || b.n)) END), 4) AS diversity FROM s a JOIN s b ON a.query_id = b.query_id AND a.id < b.id GROUP BY 1""")
def diversity(t: Inputs):
    return Q.projection_diversity(_ranked(t).select("query_id", "id"), G.neighbor_sets(t.edges)).withColumn("diversity", F.round("diversity", 4))


@query("j04_connected_coverage", "WITH " + ACTIVE + ", " + RANKED + """, s AS (SELECT query_id, id FROM ranked WHERE rank <= 5), l AS (SELECT source_id AS id, target_id AS nb FROM {edges} UNION ALL SELECT target_id, source_id FROM {edges})
    SELECT a.query_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM l JOIN s b ON b.id = l.nb WHERE l.id = a.id AND b.query_id = a.query_id) THEN 1 ELSE 0 END), 4) AS coverage FROM s a GROUP BY 1""")
def coverage(t: Inputs):
    return Q.connected_coverage(_ranked(t).select("query_id", "id"), t.edges).withColumn("coverage", F.round("coverage", 4))


@query("b19_perspective_weight", "SELECT source_id, target_id, round(weight * CASE axis WHEN 'positive' THEN 5e-1 WHEN 'parallel' THEN 75e-2 ELSE 6e-1 END, 5) AS strength FROM {edges}")
def perspective(t: Inputs):
    from ..functions.vocabulary import axis_factor

    own = F.create_map(F.lit("positive"), F.lit(0.5))
    return t.edges.select("source_id", "target_id", F.round(F.col("weight") * F.coalesce(F.element_at(own, F.col("axis")), axis_factor(F.col("axis"))), 5).alias("strength"))


@query("j01_jaccard_distance", "WITH " + ACTIVE + ", " + RANKED + """, b AS (SELECT coalesce(r.query_id, s.query_id) AS query_id, r.id IS NOT NULL AND s.id IS NOT NULL AS common FROM (SELECT * FROM ranked WHERE rank <= 5) r FULL JOIN rel s ON s.query_id = r.query_id AND s.id = r.id)
    SELECT query_id, round(1 - count(*) FILTER (common)::DOUBLE / count(*), 4) AS distance FROM b GROUP BY 1""")
def distance(t: Inputs):
    return Q.jaccard_distance(_ranked(t), t.seeds).withColumn("distance", F.round("distance", 4))
