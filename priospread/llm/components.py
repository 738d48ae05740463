"""Connected components of links, by minimum labels and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_round


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (smallest reachable id) of every id in ``links(a, b)``.

    A round gives each id the least label among its neighbours and then the label of its label,
    so chains shorten by halves. Each round is written to the checkpoint folder; nothing but two
    counters comes to the driver. Ids without links are not in the result.
    """
    both = checkpoint(links.where("a <> b").select("a", "b").unionAll(links.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    state = checkpoint_round(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = state.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = state.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = checkpoint_round(low.join(up, "component").select("id", "was", F.least("component", "up").alias("component")))
        changed = not new.where("component <> was").isEmpty()
        state = new.select("id", "component")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
