"""Queries on evidence folds, co-occurrence, resolution and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import identity_key
from ..operators import cooccurrence as C
from ..operators import evidence as E
from ..operators import lifecycle as L
from ..operators import resolve as R
from ..scratch import checkpointed
from ..sources import tables as T
from .registry import Inputs, query

AS_OF = "2002-01-01"
R4 = lambda c: F.round(c, 4)


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


@query("d01_fold_activation", "SELECT concept, round(confidence, 4) AS confidence, n AS activation_count, last_activated FROM (SELECT concept, least(1e0, 15e-2 + sum(6e-2 / (1 + 8e-2 * i))) AS confidence, count(*) AS n, max(ts) AS last_activated FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY ts, obs_id) AS i FROM {name_mentions}) GROUP BY 1)")
def activation(t: Inputs):
    return E.fold_activations(t.name_mentions).select("concept", R4("confidence").alias("confidence"), "activation_count", "last_activated")


FOLD = """WITH n AS (SELECT concept, ts, obs_id, kind, count(*) FILTER (kind = 'activate') OVER w AS a, count(*) FILTER (kind = 'weaken') OVER w AS k FROM {evidence} WINDOW w AS (PARTITION BY concept ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT concept, list(CASE WHEN kind = 'activate' THEN 6e-2 / (1 + 8e-2 * a) ELSE -6e-2 / (1 + 8e-2 * k) END ORDER BY ts, obs_id) AS d, count(*) FILTER (kind = 'activate') AS up, count(*) FILTER (kind = 'weaken') AS down, max(ts) AS last FROM n GROUP BY 1)"""


@query("d02_fold_weaken", FOLD + " SELECT concept, round(list_reduce(list_prepend(15e-2, d), lambda x, y: CASE WHEN y > 0 THEN least(1e0, x + y) ELSE greatest(1e-2, x + y) END), 4) AS confidence, up AS activation_count, down AS disconfirmation_count FROM l")
def weaken(t: Inputs):
    return E.fold_concepts(t.evidence).select("concept", R4("confidence").alias("confidence"), "activation_count", "disconfirmation_count")


def typed(t: Inputs):
    """Typed rows with the axis and strengths of their label."""
    return V.with_spec(t.typed, "label")


TYPED = """t AS (SELECT *, CASE label WHEN 'supports' THEN 0.82 ELSE 0.94 END AS st, CASE label WHEN 'supports' THEN 0.76 ELSE 0.88 END AS pr, CASE label WHEN 'supports' THEN 'enables' ELSE 'membership' END AS rel FROM {typed})"""


@query("d03_discover_relations", "WITH " + TYPED + """, o AS (SELECT *, least(src, tgt) AS low, greatest(src, tgt) AS high, row_number() OVER (PARTITION BY least(src, tgt), greatest(src, tgt) ORDER BY ts, obs_id, ordinal) AS i FROM t)
    SELECT max(src) FILTER (i = 1) AS source_id, max(tgt) FILTER (i = 1) AS target_id, 'positive' AS axis, max(rel) AS relation, round(max(pr) FILTER (i = 1), 4)::DOUBLE AS birth_weight, round(max(st) FILTER (i = 1), 4)::DOUBLE AS birth_confidence, count(*) AS sightings, max(ts) AS last_reinforced FROM o GROUP BY low, high""")
def discover(t: Inputs):
    return E.discover_relations(typed(t)).select("source_id", "target_id", "axis", "relation", "birth_weight", "birth_confidence", "sightings", "last_reinforced")


@query("d04_fold_reinforce", "WITH " + TYPED + """, n AS (SELECT least(src, tgt) AS low, greatest(src, tgt) AS high, count(*) - 1 AS n, max(pr) AS pr, max(st) AS st FROM t GROUP BY 1, 2)
    SELECT low, high, n AS reinforcement_count, round(least(1e0, pr + list_sum(list_prepend(0e0, list_transform(range(1, n + 1), lambda i: 8e-2 / (1 + 5e-2 * i))))), 4) AS weight, round(least(1e0, st + list_sum(list_prepend(0e0, list_transform(range(1, n + 1), lambda i: 8e-2 / (1 + 5e-2 * i))))), 4) AS confidence FROM n""")
def reinforce(t: Inputs):
    e = E.discover_relations(typed(t))
    n = F.col("sightings") - 1
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    return e.select(low.alias("low"), high.alias("high"), n.alias("reinforcement_count"), R4(E.reinforced(F.col("birth_weight"), n, True)).alias("weight"), R4(E.reinforced(F.col("birth_confidence"), n, True)).alias("confidence"))


@query("d05_fold_relation_weaken", """WITH n AS (SELECT low, high, ts, obs_id, kind, count(*) FILTER (kind = 'reinforce') OVER w AS a, count(*) FILTER (kind = 'weaken') OVER w AS k FROM {supply_events} WINDOW w AS (PARTITION BY low, high ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT low, high, list(CASE WHEN kind = 'reinforce' THEN 8e-2 / (1 + 5e-2 * a) ELSE -6e-2 / (1 + 1e-1 * k) END ORDER BY ts, obs_id) AS d, count(*) FILTER (kind = 'reinforce') AS up, count(*) FILTER (kind = 'weaken') AS down FROM n GROUP BY 1, 2)
    SELECT low, high, round(list_reduce(list_prepend(76e-2, d), lambda x, y: CASE WHEN y > 0 THEN least(1e0, x + y) ELSE greatest(1e-2, x + y) END), 4) AS weight, up AS reinforcement_count, down AS disconfirmation_count FROM l""")
def relation_fold(t: Inputs):
    ev = t.supply_events
    births = ev.select("low", "high").distinct().withColumns({"weight": F.lit(0.76), "confidence": F.lit(0.82)})
    out = E.fold_relations(ev, births, ["low", "high"])
    return out.select("low", "high", R4("weight").alias("weight"), "reinforcement_count", "disconfirmation_count")


@query("d06_update_probability", """SELECT source_id, target_id, round((probability * greatest(1, 2 + reinforcement_count) + 2e-1 * 1 + CASE WHEN is_explicit THEN 9e-1 * 2 ELSE 0 END) / (greatest(1, 2 + reinforcement_count) + 1 + CASE WHEN is_explicit THEN 2 ELSE 0 END), 4) AS probability FROM {edges}""")
def probability(t: Inputs):
    evidence = F.when(F.col("is_explicit"), 0.9)
    p = E.update_probability(F.col("probability"), 2 + F.col("reinforcement_count"), F.lit(0.2), F.lit(1.0), evidence, F.lit(2.0))
    return t.edges.select("source_id", "target_id", R4(p).alias("probability"))


PAIRS = """r AS (SELECT obs_id, ts, concept, row_number() OVER (PARTITION BY obs_id ORDER BY concept) AS i FROM {name_mentions}),
    p AS (SELECT a.obs_id, a.ts, a.concept AS a, b.concept AS b, row_number() OVER (PARTITION BY a.obs_id ORDER BY a.concept, b.concept) AS k FROM r a JOIN r b ON a.obs_id = b.obs_id AND a.concept < b.concept),
    s AS (SELECT a, b, obs_id, ts, row_number() OVER (PARTITION BY a, b ORDER BY ts, obs_id) AS n FROM p WHERE k <= 30)"""


@query("d07_cooccurrence", "WITH " + PAIRS + """ SELECT a, b, count(*) AS sightings, round(least(7e-1, 15e-2 + list_sum(list_prepend(0e0, list_transform(range(1, count(*) - 1), lambda i: 6e-2 / (1 + 15e-2 * i))))), 4) AS weight,
    max(ts) FILTER (n = 2) AS discovered_at, max(ts) AS last_reinforced FROM s GROUP BY a, b HAVING count(*) >= 2""")
def cooccurrence(t: Inputs):
    e = C.cooccurrence_edges(C.mention_pairs(t.name_mentions))
    return e.select("a", "b", "sightings", R4("weight").alias("weight"), "discovered_at", "last_reinforced")


@query("d07_cooccurrence_all", """WITH p AS (SELECT a.concept AS a, b.concept AS b, a.ts FROM {name_mentions} a JOIN {name_mentions} b ON a.obs_id = b.obs_id AND a.concept < b.concept)
    SELECT a, b, count(*) AS sightings, max(ts) AS last_reinforced FROM p GROUP BY 1, 2 HAVING count(*) >= 2""")
def every_pair(t: Inputs):
    """All pairs of each observation."""
    return C.cooccurrence_edges(C.mention_pairs(t.name_mentions, None)).select("a", "b", "sightings", "last_reinforced")


@query("d07_cooccurrence_sparse", """WITH r AS (SELECT obs_id, ts, concept FROM {mentions}), p AS (SELECT a.obs_id, a.ts, a.concept AS a, b.concept AS b, row_number() OVER (PARTITION BY a.obs_id ORDER BY a.concept, b.concept) AS k FROM r a JOIN r b ON a.obs_id = b.obs_id AND a.concept < b.concept)
    SELECT a, b, count(*) AS sightings, max(ts) AS last_reinforced FROM p WHERE k <= 30 GROUP BY 1, 2 HAVING count(*) >= 2""")
def sparse(t: Inputs):
    return C.cooccurrence_edges(C.mention_pairs(t.mentions)).select("a", "b", "sightings", "last_reinforced")


@query("d08_latest_description", "SELECT concept, arg_max(description, (ts, obs_id)) AS description FROM (SELECT concept, ts, obs_id, trim(source) AS description FROM {evidence}) WHERE description <> '' GROUP BY 1")
def description(t: Inputs):
    return E.latest_description(t.evidence, "concept", "source", ["ts", "obs_id"])


@query("d09_fold_source_refs", "SELECT concept, task AS source_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS n, arg_min(task, (ts, obs_id)) AS task FROM {mentions} GROUP BY concept, task")
def source_refs(t: Inputs):
    rows = t.mentions.select("concept", F.col("task").alias("source_id"), "ts", "obs_id", "task", F.lit("").alias("excerpt"))
    return E.fold_source_refs(rows).drop("excerpt")


@query("d10_fold_token_refs", "SELECT concept, lower(trim(source)) AS token, count(*) AS n, min(ts) AS first_seen_at, max(ts) AS last_seen_at, true AS merged FROM {evidence} GROUP BY 1, 2")
def token_refs(t: Inputs):
    rows = t.evidence.select("concept", F.col("source").alias("token"), F.lit("").alias("source"), F.lit("").alias("task"), "ts", "obs_id", F.lit("observed").alias("role"))
    return E.fold_token_refs(rows).drop("source", "task", "role")


KNOWN = "k AS (SELECT DISTINCT least(source_id, target_id) AS low, greatest(source_id, target_id) AS high FROM (SELECT concat('s', l_suppkey) AS source_id, concat('p', l_partkey) AS target_id FROM lineitem WHERE l_returnflag <> 'R'))"


def _contradicted(t: Inputs):
    known = t.lineitem.where("l_returnflag <> 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("positive").alias("axis"))
    return E.contradict(t.returns, known)


@query("c09_contradict", "WITH " + KNOWN + """, c AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE k.low = least(src, tgt) AND k.high = greatest(src, tgt)) AS hit FROM {returns})
    SELECT 'edge' AS target, least(src, tgt) || '|' || greatest(src, tgt) AS id, count(*) AS n FROM c WHERE hit GROUP BY 2 UNION ALL SELECT 'concept', x, count(*) FROM (SELECT unnest([src, tgt]) AS x FROM c WHERE NOT hit) GROUP BY 2""")
def contradict(t: Inputs):
    edges, ends = _contradicted(t)
    a = edges.groupBy(F.lit("edge").alias("target"), F.concat_ws("|", "low", "high").alias("id")).agg(F.count("*").alias("n"))
    return a.union(ends.groupBy(F.lit("concept").alias("target"), F.col("concept").alias("id")).agg(F.count("*").alias("n")))


@query("d11_apply_disconfirmation", "WITH " + KNOWN + """, c AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE k.low = least(src, tgt) AND k.high = greatest(src, tgt)) AS hit FROM {returns}),
    n AS (SELECT x AS concept, count(*) AS n FROM (SELECT unnest([src, tgt]) AS x FROM c WHERE NOT hit) GROUP BY 1)
    SELECT concept, n AS disconfirmation_count, round(greatest(1e-2, 5e-1 - list_sum(list_transform(range(1, n + 1), lambda i: 6e-2 / (1 + 8e-2 * i)))), 4) AS confidence FROM n""")
def disconfirm(t: Inputs):
    _, ends = _contradicted(t)
    return E.fold_concepts(ends, start=0.5).select("concept", "disconfirmation_count", R4("confidence").alias("confidence"))


@query("d12_adjust", "SELECT id, round(least(1e0, greatest(1e-2, confidence + CASE domain WHEN 'Brand#1' THEN -5e-1 WHEN 'Brand#2' THEN 2e-1 ELSE 0 END)), 4) AS confidence FROM {concepts}")
def adjust(t: Inputs):
    delta = F.when(F.col("domain") == "Brand#1", -0.5).when(F.col("domain") == "Brand#2", 0.2)
    return t.concepts.select("id", R4(E.adjust(F.col("confidence"), delta)).alias("confidence"))


@query("d13_refine_type", "SELECT source_id, target_id, CASE WHEN is_explicit THEN 'positive' ELSE axis END AS axis FROM {edges}")
def refine(t: Inputs):
    e = t.edges.withColumn("id", F.concat_ws("|", "source_id", "target_id"))
    changes = e.where("is_explicit").select("id", F.lit("positive").alias("new_axis"))
    return E.refine_type(e, changes).select("source_id", "target_id", "axis")


HALF = "CASE maturity WHEN 'embryonic' THEN 24 WHEN 'developing' THEN 168 WHEN 'established' THEN 720 WHEN 'core' THEN 2160 ELSE 24 END"
DECAYED = f"d AS (SELECT *, epoch_us(TIMESTAMP '{AS_OF}' - last_activated) / 3.6e9 AS h FROM {{concepts}}), x AS (SELECT *, confidence * pow(5e-1, h / {HALF}) AS c FROM d)"


@query("e01_decay_concepts", "WITH " + DECAYED + " SELECT id, round(c, 4) AS confidence, CASE WHEN c < 5e-2 THEN 'fading' ELSE maturity END AS maturity, c < 5e-2 AS newly_fading FROM x")
def decay(t: Inputs):
    return L.decay_concepts(t.concepts, as_of()).select("id", R4("confidence").alias("confidence"), "maturity", "newly_fading")


EDGE_DECAY = f"SELECT *, pow(5e-1, epoch_us(TIMESTAMP '{AS_OF}' - last_reinforced) / 3.6e9 / (72 * (1 + 5e-1 * reinforcement_count))) AS f FROM {{edges}}"


@query("e02_decay_relations", f"SELECT source_id, target_id, round(weight * f, 6) AS weight, round(confidence * f, 6) AS confidence, weight * f < 2e-2 AS weak FROM ({EDGE_DECAY})")
def decay_edges(t: Inputs):
    return L.decay_relations(t.edges, as_of()).select("source_id", "target_id", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"), "weak")


@query("e03_prune", "WITH " + DECAYED + """, g AS (SELECT id FROM x WHERE c < 5e-2 AND c < 2e-2)
    SELECT source_id, target_id FROM {edges} WHERE weight >= 2e-1 AND source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)""")
def prune(t: Inputs):
    faded = L.decay_concepts(t.concepts, as_of())
    _, edges = L.prune(faded, t.edges.withColumn("weight", F.when(F.col("weight") < 0.2, 0.0).otherwise(F.col("weight"))))
    return edges.select("source_id", "target_id")


@query("d16_degree", "SELECT id, count(*) AS degree FROM (SELECT unnest([source_id, target_id]) AS id FROM {edges}) GROUP BY 1")
def degree(t: Inputs):
    return L.degree(t.edges)


@query("e04_evaluate_lifecycle", """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT unnest([source_id, target_id]) AS id FROM {edges}) GROUP BY 1)
    SELECT c.id, coalesce(degree, 0) AS degree, CASE WHEN maturity = 'embryonic' AND activation_count >= 3 AND confidence >= 3e-1 THEN 'developing' WHEN maturity = 'developing' AND activation_count >= 10 AND confidence >= 6e-1 THEN 'established'
        WHEN maturity = 'established' AND activation_count >= 30 AND coalesce(degree, 0) >= greatest(2, 5 - floor((activation_count - 30) / 20)) THEN 'core' ELSE maturity END AS next_maturity FROM {concepts} c LEFT JOIN d USING (id)""")
def lifecycle(t: Inputs):
    return L.evaluate_lifecycle(t.concepts, t.edges).select("id", "degree", "next_maturity")


@query("e05_recent_activity", "SELECT concept, ts, obs_id, kind, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY ts DESC, obs_id DESC) AS rank FROM {evidence}) WHERE rank <= 8")
def recent(t: Inputs):
    return L.recent_activity(t.evidence, 8)


# Parts as concepts to resolve: suppliers' views name them by name, brand or type.
def _parts(t: Inputs):
    return t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat("p_name", F.lit(" "), "p_brand")).alias("aliases"), F.lit("").alias("kind"), F.lit("").alias("sense"), F.col("p_type").alias("description"), F.col("p_brand").alias("domain"), (F.col("p_size") / 100).alias("confidence"), F.col("p_size").alias("activation_count"), F.col("p_partkey"))


UNIQUE = "l AS (SELECT label, min(id) AS id FROM (SELECT concat('p', p_partkey) AS id, unnest([lower(p_name), lower(p_name || ' ' || p_brand)]) AS label FROM part) GROUP BY 1 HAVING min(id) = max(id))"


@query("c01_label_index", "WITH " + UNIQUE + " SELECT label, id FROM l")
def labels(t: Inputs):
    return R.label_index(_parts(t))


@query("c01_resolve", "WITH " + UNIQUE + " SELECT ref, id AS concept_id FROM (SELECT DISTINCT p_name || ' ' || p_brand AS ref FROM part) r LEFT JOIN l ON lower(r.ref) = l.label")
def resolve(t: Inputs):
    refs = t.part.select(F.concat("p_name", F.lit(" "), "p_brand").alias("ref")).distinct()
    return R.resolve(refs, _parts(t)).select("ref", "concept_id")


def _candidates(t: Inputs):
    """Two hundredth parts as new descriptions that look for their concept among all parts."""
    return _parts(t).where("p_partkey % 20 = 0")


SIM = """w AS (SELECT p_partkey, concat('p', p_partkey) AS id, p_brand, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+'), lambda x: len(x) >= 2))) AS w FROM part),
    s AS (SELECT a.id AS q, b.id AS c, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)) * CASE WHEN a.p_brand <> b.p_brand THEN 3e-1 ELSE 1 END AS similarity FROM w a JOIN w b ON a.p_partkey % 20 = 0)"""


@query("c05_find_similar", "WITH " + SIM + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM s WHERE similarity >= 3e-1) SELECT q, rank, c, round(similarity, 6) AS similarity FROM r WHERE rank <= 5")
def find_similar(t: Inputs):
    return R.find_similar(_candidates(t), _parts(t)).select("q", "rank", "c", F.round("similarity", 6).alias("similarity"))


@query("c04_consolidate", "WITH " + SIM + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM s WHERE similarity >= 6e-1) SELECT q, c, round(similarity, 6) AS similarity FROM r WHERE rank = 1")
def consolidate(t: Inputs):
    return R.consolidate_by_signature(_candidates(t), _parts(t)).select("q", "c", F.round("similarity", 6).alias("similarity"))


@query("c03_match_synonyms", """WITH p AS (SELECT p_partkey, concat('p', p_partkey) AS id, lower(p_brand) AS domain, trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g')) AS sense, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: len(x) >= 2)) AS s,
        list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_name || ' ' || p_brand), '[a-z0-9]+'), lambda x: len(x) >= 2)) AS l FROM part),
    j AS (SELECT q.id AS q, c.id AS c, len(list_intersect(q.s, c.s)) AS k, len(q.s) AS nq, len(c.s) AS nc, len(list_intersect(q.l, c.l)) > 0 AS lexical, q.sense = c.sense AS exact FROM p q JOIN p c ON q.p_partkey % 20 = 0 AND q.domain = c.domain),
    s AS (SELECT q, c, CASE WHEN lexical AND (k / least(nq, nc) >= 6e-1 OR (exact AND nq >= 3)) THEN greatest(9e-1, k / least(nq, nc)) WHEN exact AND k / (nq + nc - k) >= 78e-2 THEN k / (nq + nc - k) WHEN k >= 4 AND k / (nq + nc - k) >= 82e-2 THEN k / (nq + nc - k) END AS score FROM j WHERE k > 0)
    SELECT q, arg_min(c, (-score, c)) AS c, max(score) AS score FROM s WHERE score >= 78e-2 GROUP BY 1""")
def synonyms(t: Inputs):
    return R.match_synonyms(_candidates(t), _parts(t))


@query("c02_resolve_or_create")
def resolve_or_create(t: Inputs):
    """All parts, of which the twentieths are known already."""
    known = _candidates(t)
    key = identity_key(F.col("name"), F.col("kind"), F.col("sense"), F.col("domain"), F.col("description"))
    return R.resolve_or_create(_parts(t).where("p_partkey % 20 <> 0"), known.withColumn("identity_key", key))


@query("c06_set_aliases", """SELECT concat('p', p_partkey) AS id, CASE WHEN p_partkey % 2 = 0 THEN ['set ' || p_partkey] ELSE [p_name || ' ' || p_brand] END AS aliases FROM part""")
def set_aliases(t: Inputs):
    new = t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("set "), "p_partkey").alias("alias"))
    return R.set_aliases(_parts(t), new).select("id", "aliases")


@query("c06_add_aliases", "WITH " + UNIQUE + """, o AS (SELECT concat('p', p_partkey) AS id, lower(p_brand || ' ' || p_partkey) AS a FROM part)
    SELECT concat('p', p_partkey) AS id, [p_name || ' ' || p_brand, p_brand || ' ' || p_partkey] AS aliases FROM part""")
def add_aliases(t: Inputs):
    new = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.explode(F.array(F.concat("p_brand", F.lit(" "), "p_partkey"), F.lit("everyone wants this"))).alias("alias"))
    return R.add_aliases(_parts(t), new).select("id", "aliases")


@query("c07_resolve_endpoints", "SELECT obs_id, src AS source_id, tgt AS target_id, count(*) AS n FROM {typed} WHERE label = 'supports' AND src <> 's1' GROUP BY 1, 2, 3")
def endpoints(t: Inputs):
    rows = t.typed.where("label = 'supports'").select("obs_id", F.upper("src").alias("source"), F.col("tgt").alias("target"))
    local = rows.select("obs_id", F.col("source").alias("ref"), F.lower("source").alias("id")).distinct().where("id <> 's1'")
    concepts = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return R.resolve_endpoints(rows, local, concepts).groupBy("obs_id", "source_id", "target_id").agg(F.count("*").alias("n"))


def _mapping(t: Inputs):
    """Parts with a number that ends in 3 are merged into the part before."""
    return t.part.where("p_partkey % 10 = 3").select(F.concat(F.lit("p"), "p_partkey").alias("old"), F.concat(F.lit("p"), (F.col("p_partkey") - 1)).alias("keeper"))


@query("c10_merge_concepts", """SELECT concat('p', k) AS id, max(n) FILTER (p_partkey = k) AS name, max(p_size / 100e0) AS confidence, sum(p_size)::BIGINT AS activation_count FROM (SELECT *, p_name AS n, CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 1 ELSE p_partkey END AS k FROM part) GROUP BY k""")
def merge(t: Inputs):
    c = _parts(t).withColumn("last_activated", F.lit(None).cast("timestamp"))
    return R.merge_concepts(c, _mapping(t)).select("id", "name", "confidence", "activation_count")


@query("c10_merge_chains", """WITH RECURSIVE m AS (SELECT p_partkey AS old, p_partkey - 1 AS keeper FROM part WHERE p_partkey % 10 BETWEEN 1 AND 4 AND p_partkey > 10),
    r AS (SELECT old, keeper FROM m UNION ALL SELECT r.old, m.keeper FROM r JOIN m ON m.old = r.keeper),
    k AS (SELECT p.*, coalesce((SELECT min(keeper) FROM r WHERE r.old = p.p_partkey), p.p_partkey) AS k, CASE WHEN p_size > 40 THEN 4 WHEN p_size > 20 THEN 2 ELSE 1 END AS rank FROM part p),
    s AS (SELECT k, p_brand, least(1, sum(p_size / 100e0)) AS strength FROM k GROUP BY 1, 2),
    f AS (SELECT k, array_to_string(list(p_brand || '=' || printf('%.2f', strength) ORDER BY p_brand), ';') AS profile FROM s GROUP BY 1)
    SELECT concat('p', k.k) AS id, max(p_name) FILTER (p_partkey = k.k) AS name, max(p_size / 100e0) AS confidence, sum(p_size)::BIGINT AS activation_count, sum(p_partkey % 3)::BIGINT AS disconfirmation_count,
        CASE max(rank) WHEN 4 THEN 'core' WHEN 2 THEN 'developing' ELSE 'embryonic' END AS maturity, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS tags, count(*) AS log, max(profile) AS profile FROM k JOIN f ON f.k = k.k GROUP BY k.k""")
def merge_chains(t: Inputs):
    """Parts whose number ends in 1 to 4 are merged into the part before, so four of them end at the one that ends in 0."""
    mapping = t.part.where("p_partkey % 10 between 1 and 4 and p_partkey > 10").select(F.concat(F.lit("p"), "p_partkey").alias("old"), F.concat(F.lit("p"), (F.col("p_partkey") - 1)).alias("keeper"))
    brand = t.part.select("p_partkey", "p_brand", "p_size")
    c = _parts(t).join(brand, "p_partkey").withColumns({
        "last_activated": F.lit(None).cast("timestamp"), "disconfirmation_count": F.col("p_partkey") % 3, "tags": F.array("p_brand"), "domain_profile": F.create_map("p_brand", F.col("p_size") / 100),
        "maturity": F.when(F.col("p_size") > 40, "core").when(F.col("p_size") > 20, "developing").otherwise("embryonic"), "reinforcement_log": F.array(F.col("p_partkey")),
    })
    out = R.merge_concepts(c, R.keepers(mapping, checkpointed(t.spark)))
    profile = F.transform(F.map_entries("domain_profile"), lambda e: F.format_string("%s=%.2f", e["key"], e["value"]))
    return out.select("id", "name", "confidence", "activation_count", "disconfirmation_count", "maturity", F.array_join("tags", ";").alias("tags"), F.size("reinforcement_log").cast("long").alias("log"), F.array_join(profile, ";").alias("profile"))


@query("c11_migrate_edges", """WITH m AS (SELECT CASE WHEN source_id LIKE '%3' THEN concat('p', substr(source_id, 2)::INT - 1) ELSE source_id END AS s, CASE WHEN target_id LIKE '%3' THEN concat('p', substr(target_id, 2)::INT - 1) ELSE target_id END AS t, * FROM {edges})
    SELECT s AS source_id, t AS target_id, axis, round(least(1, sum(weight)), 6) AS weight, max(probability) AS probability, sum(reinforcement_count)::BIGINT AS reinforcement_count FROM m WHERE s <> t GROUP BY 1, 2, 3""")
def migrate(t: Inputs):
    return R.migrate_edges(t.edges, _mapping(t)).select("source_id", "target_id", "axis", F.round("weight", 6).alias("weight"), "probability", "reinforcement_count")


@query("c12_split_concept", "SELECT concat('p', p_partkey) AS id, p_name AS name, CASE WHEN p_partkey = 7 THEN [] ELSE [p_name || ' ' || p_brand] END AS aliases FROM part UNION ALL SELECT 'new', 'A New One', [p_name || ' ' || p_brand] FROM part WHERE p_partkey = 7")
def split(t: Inputs):
    row = _parts(t).where("id = 'p7'").select("aliases").collect()  # one concept
    return R.split_concept(_parts(t), "p7", "new", "A New One", row[0][0] if row else []).select("id", "name", "aliases")


@query("b17_search_concepts", "SELECT concat('p', p_partkey) AS id FROM part WHERE lower(p_name || '|' || p_brand || '|' || p_type) LIKE '%economy%'")
def search(t: Inputs):
    return R.search_concepts(_parts(t), "Economy").select("id")


@query("a03_upsert", "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 0")
def upsert(t: Inputs):
    p = t.part.select("p_partkey", "p_name", "p_size")
    changed = T.upsert(p, p.where("p_size > 40").withColumn("p_size", F.lit(0)), ["p_partkey"])
    return T.delete(changed, p.where("p_partkey % 10 = 0"), "p_partkey")


@query("a14_change_feed", """WITH s AS (SELECT concept, count(*) FILTER (kind = 'activate' AND ts < TIMESTAMP '2024-01-15') AS a0, count(*) FILTER (kind = 'weaken' AND ts < TIMESTAMP '2024-01-15') AS w0, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS n0, count(*) FILTER (kind = 'activate') AS a1, count(*) FILTER (kind = 'weaken') AS w1 FROM {evidence} GROUP BY 1)
    SELECT concept, 'created' AS event FROM s WHERE n0 = 0 UNION ALL SELECT concept, 'reinforced' FROM s WHERE n0 > 0 AND a1 > a0 UNION ALL SELECT concept, 'weakened' FROM s WHERE w1 > CASE WHEN n0 > 0 THEN w0 ELSE 0 END""")
def feed(t: Inputs):
    ev = t.evidence
    before = E.fold_concepts(ev.where("ts < timestamp '2024-01-15'"))
    return T.change_feed(before, E.fold_concepts(ev), "activation_count", "disconfirmation_count", "concept")


@query("a15_ingest_report", "SELECT obs_id, 'reinforced' AS kind, list_sort(list(concept)) AS labels, count(*) AS n FROM {mentions} GROUP BY 1")
def report(t: Inputs):
    return T.ingest_report(t.mentions.select("obs_id", F.lit("reinforced").alias("kind"), F.col("concept").alias("label")))
