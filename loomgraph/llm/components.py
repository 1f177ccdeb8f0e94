"""Connected components of a table of links, by passing on smallest labels and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (id, label) for every end of a link: the smallest id it is connected with.

    Each round takes the smallest label of the neighbours and then the label's own label, so chains
    shrink by half and more; state is cut to the shared folder after each round.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    state = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = state.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = state.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = cut(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        moved = not step.where("new <> label").isEmpty()
        state = step.select("id", F.col("new").alias("label"))
        if not moved:
            return state
