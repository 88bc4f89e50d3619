"""Connected components of a graph of links, as tables.

Each round a node takes the smallest label among its own and its neighbours' (hooking), then the label of
its label (jumping), until nothing changes. Every round is written to the shared folder, so lineage stays short and a
lost executor costs one round. Nothing is collected but whether anything changed. More links are met by the components found so far,
as nodes of a smaller graph, not by all links anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of ``links`` (a, b: long); comp is the smallest node of the component."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "comp", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "comp", F.col("comp").alias("was"))
        held = written(near.unionByName(own).groupBy("node").agg(F.max("was").alias("was"), F.min("comp").alias("comp")), f"hooked-{turn}")
        if held.filter("comp != was").isEmpty():  # the ends of each link have one label
            return labels
        jump = held.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = written(held.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("next", "comp")).alias("comp")), f"labels-{turn}")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp), written, after more links (a, b), of whatever nodes; the same frame if these join nothing."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = written(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a != b").distinct(), "between")
    if between.isEmpty():
        return labels
    higher = components(between)
    moved = labels.join(higher.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return written(moved.unionByName(higher.join(labels.select("node"), "node", "left_anti")), "joined")
