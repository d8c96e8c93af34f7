"""Connected components of links between long ids: least labels over neighbours with pointer jumping, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the least node it is joined with. Each round lets
    a label cross one link and then follow its own label, so rounds grow as the logarithm of the longest chain."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("m"))
        over = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
        step = F.least("m", F.coalesce("up", "m"))
        labels = stored(new.join(over, "m", "left").select("node", step.alias("component"), (step < F.col("component")).alias("moved")), "labels", done=[labels])
        if not labels.filter("moved").limit(1).count():
            discard(both)
            return labels.select("node", "component")
    raise RuntimeError(f"not settled after {rounds} rounds")
