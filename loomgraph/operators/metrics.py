"""Status, entropy and retrieval-quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import color_purity, is_bridge
from ..functions.vocabulary import axis_factor
from .graph import adjacency

# How much a concept's entropy counts by maturity; what an edge without explicit evidence counts.
MATURITY_WEIGHT = {"embryonic": 0.50, "developing": 0.75, "established": 1.00, "core": 1.20, "fading": 0.35}
IMPLICIT = 0.75


def world_status(concepts: DataFrame, edges: DataFrame, communities: DataFrame | None = None, colors: DataFrame | None = None) -> DataFrame:
    """One row: how many concepts, of each maturity, mean confidence, relations by kind; communities (id, member_ids, stability) and how many of them give a
    colour; bridges and mean purity of the concepts that have colours (id, label, strength); entropies of network and relation types."""
    count = lambda m: F.count_if(F.col("maturity") == m).alias(f"n_{m}")
    out = concepts.agg(F.count("*").alias("concepts"), *map(count, MATURITY_WEIGHT), F.avg("confidence").alias("avg_confidence"))
    parts = [edges.agg(F.count("*").alias("relations"), F.count_if("is_explicit").alias("explicit_relations"), F.avg("weight").alias("avg_weight"))]
    if communities is not None:
        stable = (F.col("stability") >= 2) & (F.size("member_ids") >= 3)
        parts.append(communities.agg(F.count("*").alias("communities"), F.count_if(stable).alias("stable_communities")))
    if colors is not None:
        profile = colors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "strength"))).alias("p"))  # a concept's few labels
        profile = profile.join(concepts.select("id"), "id", "left_semi")
        parts.append(profile.agg(F.count_if(is_bridge(F.col("p"))).alias("bridges"), F.coalesce(F.avg(color_purity(F.col("p"))), F.lit(1.0)).alias("avg_purity")))
        parts.append(network_entropy(concepts, edges).select(F.col("entropy").alias("network_entropy"), F.col("high").alias("high_entropy")))
        parts.append(axis_entropy(edges).select(F.col("entropy").alias("type_entropy")))
    for part in parts:  # tables of one row
        out = out.join(F.broadcast(part))
    return out


def jaccard_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, distance) of two selections (query_id, id): 1 minus what both have of what either has."""
    both = a.select("query_id", "id", F.lit(1).alias("a")).distinct().join(b.select("query_id", "id", F.lit(1).alias("b")).distinct(), ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg((1 - F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("distance"))


def masses(edges: DataFrame) -> DataFrame:
    """edges with mass: probability times axis factor, less where the edge was only seen together."""
    return edges.withColumn("mass", F.greatest(F.lit(0.0), F.col("probability")) * axis_factor(F.col("axis")) * F.when(F.col("is_explicit"), 1.0).otherwise(IMPLICIT))


def node_entropy(edges: DataFrame) -> DataFrame:
    """(id, neighbors, entropy): the normalised Shannon entropy of a concept's mass over its neighbours, two at least."""
    pair = adjacency(masses(edges).where("mass > 0").select("source_id", "target_id", "mass")).groupBy("id", "neighbor").agg(F.sum("mass").alias("m"))
    # sum p log p from sums of m and m log m: no window over a hub's neighbours.
    sums = pair.groupBy("id").agg(F.count("*").alias("neighbors"), F.sum("m").alias("t"), F.sum(F.col("m") * F.log2("m")).alias("s"))
    return sums.where("neighbors >= 2").select("id", "neighbors", ((F.log2("t") - F.col("s") / F.col("t")) / F.log2("neighbors")).alias("entropy"))


def network_entropy(concepts: DataFrame, edges: DataFrame, high: float = 0.70, low: float = 0.20) -> DataFrame:
    """One row: the importance-weighted mean of node entropies and how many concepts are isolated, high and low."""
    weight = F.lit(1.0)
    for m, w in MATURITY_WEIGHT.items():
        weight = F.when(F.col("maturity") == m, w).otherwise(weight)
    rows = concepts.join(node_entropy(edges), "id", "left").withColumn("w", F.greatest("confidence", F.lit(0.05)) * weight)
    known = F.col("entropy").isNotNull()
    return rows.agg(
        (F.sum(F.when(known, F.col("entropy") * F.col("w"))) / F.sum(F.when(known, F.col("w")))).alias("entropy"), F.count_if(known).alias("considered"), F.count_if(~known).alias("isolated"),
        F.count_if(F.col("entropy") >= high).alias("high"), F.count_if(F.col("entropy") <= low).alias("low"),
    )


def axis_entropy(edges: DataFrame) -> DataFrame:
    """One row: the normalised entropy of mass over axes (0 with fewer than two) and the mass of each."""
    by = masses(edges).groupBy("axis").agg(F.sum("mass").alias("m")).where("m > 0")
    out = by.agg(F.count("*").alias("axes"), F.sum("m").alias("t"), F.sum(F.col("m") * F.log2("m")).alias("s"), *[F.sum(F.when(F.col("axis") == a, F.col("m"))).alias(f"{a}_mass") for a in ("positive", "negative", "parallel")])
    return out.select("axes", F.when(F.col("axes") < 2, 0.0).otherwise((F.log2("t") - F.col("s") / F.col("t")) / F.log2("axes")).alias("entropy"), "positive_mass", "negative_mass", "parallel_mass")


def precision_recall(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, hits, precision, recall) of (query_id, id) tables."""
    hit = retrieved.join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    a, b = retrieved.groupBy("query_id").agg(F.count("*").alias("n")), relevant.groupBy("query_id").agg(F.count("*").alias("m"))
    out = b.join(a, "query_id", "left").join(hit, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("query_id", "hits", F.when(F.coalesce("n", F.lit(0)) > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("precision"), (F.col("hits") / F.col("m")).alias("recall"))


def ndcg_at_k(ranked: DataFrame, relevance: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ndcg): ranked (query_id, id, rank from 1), relevance (query_id, id, rel)."""
    gain = ranked.where(F.col("rank") <= k).join(relevance, ["query_id", "id"]).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "id"))
    best = relevance.withColumn("r", order).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("idcg"))
    return best.join(gain, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def projection_diversity(selected: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(query_id, diversity): mean Jaccard distance of the neighbour sets of selected concepts (query_id, id)."""
    rows = selected.join(neighbors, "id", "left").select("query_id", "id", F.coalesce("neighbors", F.array().cast("array<string>")).alias("n"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") < F.col("b.id")))  # k of a query, k bounded
    union = F.size(F.array_union("a.n", "b.n"))
    distance = F.when(union > 0, 1 - F.size(F.array_intersect("a.n", "b.n")) / union).otherwise(1.0)
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg(distance).alias("diversity"))


def connected_coverage(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, coverage): the share of selected concepts with an edge to another selected one."""
    a = selected.select("query_id", "id")
    pairs = adjacency(edges.select("source_id", "target_id")).join(a, "id").join(a.withColumnRenamed("id", "neighbor"), ["query_id", "neighbor"], "left_semi")
    linked = pairs.select("query_id", "id", F.lit(1).alias("l")).distinct()
    return a.join(linked, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("l") / F.count("*")).alias("coverage"))
