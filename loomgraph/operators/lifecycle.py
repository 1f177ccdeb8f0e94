"""Decay, pruning and promotion of concepts and relations at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hours_between

# Half-lives of confidence in hours by maturity; of a relation's weight.
HALF_LIFE = {"embryonic": 24.0, "developing": 168.0, "established": 720.0, "core": 2160.0, "fading": 24.0}
RELATION_HALF_LIFE = 72.0


def decay_concepts(concepts: DataFrame, as_of: Column, since: str = "last_activated") -> DataFrame:
    """Confidence halves with every half-life since the last activation; below .05 a concept fades (newly_fading)."""
    h = hours_between(F.col(since), as_of)
    half = F.lit(24.0)
    for name, hours in HALF_LIFE.items():
        half = F.when(F.col("maturity") == name, hours).otherwise(half)
    rest = F.col(since).isNull() | (h < 1) | ((F.col("maturity") == "fading") & (F.col("confidence") <= 0))
    after = F.when(rest, F.col("confidence")).otherwise(F.col("confidence") * F.pow(F.lit(0.5), h / half))
    fades = ~rest & (after < 0.05) & (F.col("maturity") != "fading")
    return concepts.withColumns({"newly_fading": fades, "maturity": F.when(fades, "fading").otherwise(F.col("maturity")), "confidence": after})


def decay_relations(edges: DataFrame, as_of: Column, since: str = "last_reinforced") -> DataFrame:
    """Weight and confidence halve with every 72 h, longer with reinforcement; weak marks weights below .02."""
    h = hours_between(F.col(since), as_of)
    factor = F.when(F.col(since).isNull() | (h < 1), 1.0).otherwise(F.pow(F.lit(0.5), h / (RELATION_HALF_LIFE * (1 + 0.5 * F.col("reinforcement_count")))))
    out = edges.withColumns({"weight": F.col("weight") * factor, "confidence": F.col("confidence") * factor, "probability": F.col("confidence") * factor})
    return out.withColumn("weak", F.col("weight") < 0.02)


def prune(concepts: DataFrame, edges: DataFrame, threshold: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Without weak edges, concepts that have faded away, and the edges of those."""
    gone = concepts.where((F.col("maturity") == "fading") & (F.col("confidence") < threshold)).select("id")
    kept = edges.where(F.col("weight") >= threshold)
    for end in ("source_id", "target_id"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return concepts.join(gone, "id", "left_anti"), kept


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): how many edges meet each concept."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def evaluate_lifecycle(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """concepts with next_maturity: at most one step up by activations, confidence and, for core, connections."""
    c = concepts.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    n, conf = F.col("activation_count"), F.col("confidence")
    needed = F.greatest(F.lit(2), 5 - F.floor((n - 30) / 20))
    up = (
        F.when((F.col("maturity") == "embryonic") & (n >= 3) & (conf >= 0.3), "developing")
        .when((F.col("maturity") == "developing") & (n >= 10) & (conf >= 0.6), "established")
        .when((F.col("maturity") == "established") & (n >= 30) & (F.col("degree") >= needed), "core")
        .otherwise(F.col("maturity"))
    )
    return c.withColumn("next_maturity", up)


def recent_activity(events: DataFrame, k: int, key: str = "concept") -> DataFrame:
    """The last k events of each concept, newest first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("obs_id")))
    return events.withColumn("rank", rank).where(F.col("rank") <= k)
