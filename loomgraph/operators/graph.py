"""Spreading activation, diverse selection and subgraphs, for many queries at once.

concepts: id, confidence, last_activated, domain, tasks array<string> (optional).
edges: source_id, target_id, axis, weight, reinforcement_count, last_reinforced, tasks array<string> (optional).
queries: query_id, task string, active_domains array<string>; seeds: query_id, id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import concept_freshness, relation_freshness
from ..functions.vocabulary import axis_factor

INHIBITION, TASK_BOOST, DOMAIN_BOOST, READINESS, FLOOR_RATIO = 0.6, 1.5, 1.3, 0.3, 0.03
MMR_LAMBDA, TASK_DISCOUNT, FRESH_SHARE = 0.3, 0.6, 0.3


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends: id, neighbor and the edge's other columns."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    one = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"), *rest)
    return one.union(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbor"), *rest))


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges of unordered pairs (a, b)."""
    keyed = edges.withColumns({"_l": F.least("source_id", "target_id"), "_h": F.greatest("source_id", "target_id")})
    p = pairs.select(F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_h")).distinct()
    return keyed.join(p, ["_l", "_h"], "left_semi").drop("_l", "_h")


def _matches(tasks: Column, task: Column) -> Column:
    return (task != "") & F.coalesce(F.exists(tasks, lambda t: F.lower(t).contains(task)), F.lit(False))


def _with_defaults(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def activate(
    seeds: DataFrame, queries: DataFrame, concepts: DataFrame, edges: DataFrame, as_of: Column, max_depth: int = 2, decay: float = 0.6, least: float = 0.01, factor=axis_factor
) -> DataFrame:
    """(query_id, id, activation, inhibition, score): excitation and inhibition spread from the seeds.

    Each step moves only from concepts that improved in the step before; of all messages to a concept the
    strongest counts. `factor` maps an axis to its weight. Negative edges inhibit and pass nothing on.
    """
    task = F.lower(F.trim(F.coalesce("task", F.lit(""))))
    q = queries.select("query_id", task.alias("task"), F.coalesce("active_domains", F.array().cast("array<string>")).alias("focus"))
    nodes = _with_defaults(concepts, tasks="array<string>", domain="string").select(
        "id", "confidence", "domain", F.col("tasks").alias("c_tasks"), concept_freshness(F.col("last_activated"), as_of).alias("fresh"), F.greatest("confidence", F.lit(READINESS)).alias("ready")
    )
    links = adjacency(_with_defaults(edges, tasks="array<string>")).select(
        "id", "neighbor", "axis", (F.col("weight") * factor(F.col("axis"))).alias("strength"), F.col("tasks").alias("e_tasks"),
        relation_freshness(F.col("last_reinforced"), as_of, F.col("reinforcement_count")).alias("e_fresh"),
    )
    near = links.join(nodes.select(F.col("id").alias("neighbor"), "domain", "c_tasks", "fresh", "ready"), "neighbor")
    in_focus = F.coalesce(F.array_contains("focus", F.col("domain")), F.lit(False))

    first = seeds.select("query_id", "id").distinct().join(nodes, "id").join(q, "query_id")
    score = F.when(_matches(F.col("c_tasks"), F.col("task")), F.least(F.lit(1.0), F.col("confidence") * TASK_BOOST)).otherwise(F.col("confidence"))
    score = F.when(in_focus, F.least(F.lit(1.0), score * DOMAIN_BOOST)).otherwise(score)
    state = first.select("query_id", "id", score.alias("activation"))
    q = q.join(state.groupBy("query_id").agg((F.max("activation") * FLOOR_RATIO).alias("floor")), "query_id")
    frontier, inhibited = state, None
    for depth in range(max_depth):
        sent = frontier.where(F.col("activation") >= least).join(q, "query_id").join(near, "id")
        boost = F.when(_matches(F.col("e_tasks"), F.col("task")) | _matches(F.col("c_tasks"), F.col("task")), TASK_BOOST).otherwise(1.0) * F.when(in_focus, DOMAIN_BOOST).otherwise(1.0)
        raw = F.col("activation") * F.col("strength") * F.col("ready") * F.lit(decay ** (depth + 1)) * boost * F.col("e_fresh") * F.col("fresh")
        sent = sent.select("query_id", F.col("neighbor").alias("id"), "axis", raw.alias("raw"), "floor")
        against = sent.where((F.col("axis") == "negative") & (F.col("raw") * INHIBITION >= least)).groupBy("query_id", "id").agg((F.max("raw") * INHIBITION).alias("inhibition"))
        inhibited = against if inhibited is None else inhibited.union(against)
        lifted = F.when((F.col("raw") > 0) & (F.col("raw") < F.col("floor")), F.col("floor")).otherwise(F.col("raw"))
        got = sent.where(F.col("axis") != "negative").select("query_id", "id", lifted.alias("m")).where(F.col("m") >= least).groupBy("query_id", "id").agg(F.max("m").alias("m"))
        both = state.join(got, ["query_id", "id"], "full_outer")
        better = F.coalesce(F.col("m") > F.coalesce("activation", F.lit(0.0)), F.lit(False))
        state = both.select("query_id", "id", F.when(better, F.col("m")).otherwise(F.col("activation")).alias("activation"), better.alias("better"))
        frontier = state.where("better").select("query_id", "id", "activation")
        state = state.select("query_id", "id", "activation")
    stop = inhibited.groupBy("query_id", "id").agg(F.max("inhibition").alias("inhibition"))
    out = state.join(stop, ["query_id", "id"], "left").withColumn("inhibition", F.coalesce("inhibition", F.lit(0.0)))
    return out.withColumn("score", F.col("activation") - F.col("inhibition")).where(F.col("score") > least)


def neighbor_sets(edges: DataFrame) -> DataFrame:
    """(id, neighbors array): the distinct neighbours of each concept, sorted."""
    return adjacency(edges.select("source_id", "target_id")).groupBy("id").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))


def select_mmr(scores: DataFrame, queries: DataFrame, concepts: DataFrame, edges: DataFrame, as_of: Column, k: int = 15, share: float = MMR_LAMBDA, cut=None) -> DataFrame:
    """(query_id, rank, id, score, mmr): in each round the candidate that is most relevant and least like those chosen before.

    Redundancy is the largest Jaccard similarity of neighbour sets with a chosen concept. Rounds are bounded by k; within a
    round all queries and candidates go in parallel. `cut` may write the state between rounds.

    A candidate's value, (1 - share) relevance - share likeness, only falls, and likeness is 1 at most. So in each of the k rounds there is
    one left of the k most relevant whose value is (1 - share) r_k - share or more, and who stays below that with no likeness at all is never
    chosen: only the others get neighbour sets and go through the rounds. Values are compared with nine digits.
    """
    task = F.lower(F.trim(F.coalesce("task", F.lit(""))))
    info = _with_defaults(concepts, tasks="array<string>").select("id", F.col("tasks").alias("c_tasks"), concept_freshness(F.col("last_activated"), as_of).alias("fresh"))
    top = scores.groupBy("query_id").agg(F.max("score").alias("top"))
    asked = queries.select("query_id", task.alias("task"))
    rows = scores.select("query_id", "id", "score").join(top, "query_id").join(asked, "query_id").join(info, "id", "left")
    fits = F.when((F.col("task") == "") | _matches(F.col("c_tasks"), F.col("task")), 1.0).otherwise(TASK_DISCOUNT)
    relevance = F.col("score") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")) * fits * (1 - FRESH_SHARE + FRESH_SHARE * F.coalesce("fresh", F.lit(1.0)))
    rows = rows.select("query_id", "id", "score", relevance.alias("relevance"))
    rows = cut(rows) if cut else rows
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id"))
    bound = rows.withColumn("_r", kth).where(F.col("_r") <= k).groupBy("query_id").agg(F.count("*").alias("_n"), F.min("relevance").alias("_least"))
    low = F.when(F.col("_n") == k, (1 - share) * F.col("_least") - share - 1e-6).otherwise(float("-inf"))
    rows = rows.join(bound.select("query_id", low.alias("_low")), "query_id").where((1 - share) * F.col("relevance") >= F.col("_low")).drop("_low")
    none = F.array().cast("array<string>")
    left = rows.join(neighbor_sets(edges), "id", "left").select("query_id", "id", "score", "relevance", F.coalesce(F.col("neighbors").cast("array<string>"), none).alias("neighbors"), F.lit(0.0).alias("like"))
    picks = None
    for rank in range(1, k + 1):
        left = cut(left) if cut else left
        mmr = F.round((1 - share) * F.col("relevance") - share * F.col("like"), 9)
        best = left.withColumn("mmr", mmr).groupBy("query_id").agg(F.min_by(F.struct("id", "score", "mmr", "neighbors"), F.struct(-F.col("mmr"), "id")).alias("b"))
        best = cut(best) if cut else best
        pick = best.select("query_id", F.lit(rank).alias("rank"), "b.id", "b.score", "b.mmr")
        picks = pick if picks is None else picks.union(pick)
        both = left.join(best.select("query_id", F.col("b.id").alias("_id"), F.col("b.neighbors").alias("_n")), "query_id").where(F.col("id") != F.col("_id"))
        union = F.size(F.array_union("neighbors", "_n"))
        same = F.when(union > 0, F.size(F.array_intersect("neighbors", "_n")) / union).otherwise(0.0)
        left = both.select("query_id", "id", "score", "relevance", "neighbors", F.greatest("like", same).alias("like"))
    return picks


def induced_subgraph(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the selected (query_id, id) of one query."""
    a = selected.select("query_id", F.col("id").alias("source_id"))
    b = selected.select("query_id", F.col("id").alias("target_id"))
    return a.join(edges, "source_id").join(b, ["query_id", "target_id"], "left_semi")


def top_concepts(scores: DataFrame, n: int) -> DataFrame:
    """The n best concepts of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def render_projection(selected: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, text): concepts by maturity and score, then the ten heaviest relations, one line each."""
    lines = selected.join(concepts.select("id", "maturity"), "id").select(
        "query_id", F.struct(F.lit(0).alias("part"), (-F.col("score")).alias("by"), F.col("id").alias("tie"), F.format_string("[%s] %s (%.2f)", "maturity", "id", "score").alias("line")).alias("l")
    )
    sub = induced_subgraph(selected, edges)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "source_id", "target_id"))
    name = F.format_string("%s -> %s -> %s (%.2f)", "source_id", "axis", "target_id", "weight")
    rel = sub.withColumn("r", rank).where("r <= 10").select("query_id", F.struct(F.lit(1).alias("part"), (-F.col("weight")).alias("by"), name.alias("tie"), name.alias("line")).alias("l"))
    return lines.union(rel).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))


def coupling(edges: DataFrame, concepts: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """(a, b, weight), symmetric: weight times axis factor, and freshness of edge and ends if concepts are given."""
    base = edges.withColumn("w", F.col("weight") * axis_factor(F.col("axis")))
    if concepts is not None:
        fresh = concepts.select("id", concept_freshness(F.col("last_activated"), as_of).alias("f"))
        base = base.join(fresh.toDF("source_id", "fa"), "source_id").join(fresh.toDF("target_id", "fb"), "target_id")
        base = base.withColumn("w", F.col("w") * relation_freshness(F.col("last_reinforced"), as_of, F.col("reinforcement_count")) * (F.col("fa") + F.col("fb")) / 2)
    both = base.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "w").union(base.select("target_id", "source_id", "w"))
    return both.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("weight"))
