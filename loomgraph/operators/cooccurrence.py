"""Edges between concepts that are mentioned together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import reinforced

PAIR_CAP = 30


def mention_pairs(mentions: DataFrame, cap: int | None = PAIR_CAP) -> DataFrame:
    """(a, b, obs_id, ts) with a < b: the pairs of each observation, of its first 30 pairs by id where it has more; all with None.

    The cap is the operator's definition: an observation with very many concepts says little about any two of them.
    """
    seen = mentions.select("obs_id", "ts", "concept").distinct()
    each = seen.groupBy("obs_id", "ts").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    # The first pairs by id only need the first concepts; a pair is built inside its row, not by a join.
    tops = each if cap is None else each.select("obs_id", "ts", F.slice("c", 1, cap + 1).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice(F.col("c"), i + 2, F.greatest(F.size("c"), F.lit(1))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return tops.select("obs_id", "ts", F.explode(pairs if cap is None else F.slice(pairs, 1, cap)).alias("p")).select("p.a", "p.b", "obs_id", "ts")


def sightings(seen: DataFrame, observations: DataFrame, tasks: int) -> DataFrame:
    """(a, b, n, last_reinforced) with a < b: how often concepts are mentioned together, and when last; all pairs of each observation.

    seen: obs_id, concept; observations: obs_id, ts, task; what differs in ts or task under one id is a mention of its own. Observations are dealt to so
    many tasks, which make the pairs of one after the other and count them before they send them; pairs are dealt to as many. So what a task holds
    doesn't grow with the input if their number does, and a pair that is everywhere comes as one row a task.
    """
    both = seen.select("obs_id", "concept").unionByName(observations.select("obs_id", F.struct("ts", "task").alias("at")), allowMissingColumns=True).where("obs_id is not null")
    dealt = both.withColumn("_chunk", F.pmod(F.xxhash64("obs_id"), F.lit(16 * tasks))).repartition(tasks, "_chunk")
    each = dealt.groupBy("_chunk", "obs_id").agg(F.array_sort(F.collect_set("concept")).alias("c"), F.collect_set("at").alias("at")).where(F.size("c") > 1)
    each = each.select("_chunk", "c", F.size("at").cast("long").alias("m"), F.array_max("at.ts").alias("ts")).where("m > 0")
    firsts = each.select("_chunk", "m", "ts", "c", F.posexplode("c").alias("_i", "a"))
    pairs = firsts.where(F.col("_i") < F.size("c") - 1).select("_chunk", "m", "ts", "a", F.explode(F.slice("c", F.col("_i") + 2, F.size("c"))).alias("b"))
    # Every mention of one meets every mention of the other.
    counts = [F.sum(F.col("m") * F.col("m")).alias("n"), F.max("ts").alias("last_reinforced")]
    own = pairs.groupBy("_chunk", "a", "b").agg(*counts).select("a", "b", "n", "last_reinforced")
    return own.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last_reinforced").alias("last_reinforced"))


def cooccurrence_edges(pairs: DataFrame, birth: float = 0.15) -> DataFrame:
    """(a, b, sightings, weight, discovered_at, last_reinforced): the second sighting makes an edge, later ones reinforce it."""
    at = F.struct("ts", "obs_id")
    made = pairs.groupBy("a", "b").agg(F.count("*").alias("sightings"), F.min(at).alias("_first"), F.max("ts").alias("last_reinforced")).where("sightings >= 2")
    second = pairs.join(made.select("a", "b", "_first"), ["a", "b"]).where(at > F.col("_first")).groupBy("a", "b").agg(F.min("ts").alias("discovered_at"))
    made = made.join(second, ["a", "b"], "left").withColumn("discovered_at", F.coalesce("discovered_at", F.col("_first.ts"))).drop("_first")
    return made.withColumn("weight", reinforced(F.lit(birth), F.col("sightings") - 2, explicit=False))
