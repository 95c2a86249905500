"""Connected components of a link table, as a sequence of joins with a written table between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.plans.store import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (the smallest id of the component) for every id that occurs in ``links``.

    Each round gives every id the smallest label among itself and its neighbours (pre-aggregated minimum), then the
    label of its label (pointer jumping), so chains shrink geometrically. Rounds stop when nothing changes; nothing
    but that count comes to the driver. Links with a null end are ignored, repeated links and self-links are harmless,
    an empty link table gives an empty result. Raises RuntimeError if ``max_rounds`` isn't enough.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = written(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("root"))
        step = lower.join(jump, "low", "left").select("id", "old", F.least("low", "root").alias("component"))
        new = written(step, "labels")
        moved = new.where(F.col("component") != F.col("old")).limit(1).count()
        discard(labels)
        labels = new.select("id", "component")
        if not moved:
            discard(edges)
            return labels
    raise RuntimeError("components did not settle")
