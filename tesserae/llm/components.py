"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Workspace, lookup


def components(ws: Workspace, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of `links` (a, b): the least node it reaches.

    Least labels spread along links and are followed to their own labels until nothing
    changes, so the number of rounds is about logarithmic in a component's diameter.  Sums
    are combined before each shuffle.  A node with many links, and a label that many nodes
    have, are looked up by broadcast (lookup), so neither gathers its rows in a task.  Each
    round is a written table, which cuts the lineage.
    """
    both = ws.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}_links")
    n_links = both.count()
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree"))
    labels = ws.save(first, f"{name}_0")
    n_nodes = labels.count()
    step = 0
    while True:
        seen = lookup(both, labels.select(F.col("node").alias("b"), "label", "degree"), "b", "degree", n_links)
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step += 1
        least = ws.save(labels.join(near, "node").select("node", F.col("label").alias("old"), "degree", F.least("label", "near").alias("to")), f"{name}_{step}_to")
        beyond = least.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("node").alias("to"), F.col("label").alias("beyond")), "to")
        jumped = lookup(least, beyond, "to", "n", n_nodes)
        after = ws.save(jumped.select("node", "old", F.least("to", "beyond").alias("label"), "degree"), f"{name}_{step}")
        changed = not after.where("label < old").isEmpty()
        ws.drop(f"{name}_{step - 1}")
        ws.drop(f"{name}_{step}_to")
        labels = after.select("node", "label", "degree")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
