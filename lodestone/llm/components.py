"""Connected components of a link table by distributed min-hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link: label is the smallest node that it can reach.

    Each round hooks every node to its smallest neighbour, if that is smaller, follows the pointers to their
    roots by doubling, and goes on with the links between different roots. A root that took no node in has
    a neighbour that went to a smaller root, and hooks to it in the next round; so two rounds halve the roots
    that still have links at least, whatever the graph's diameter. Rounds go on until no link is left.

    Repeated links count once; links of a node with itself or with null are none; an empty table gives no row.
    Each table of a round is deleted when the next one is written; the result is a stored table.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).filter("node <> other")
    edges = scratch(both.distinct(), "edges")
    rounds = []
    while not rounds or not edges.isEmpty():
        roots = _roots(scratch(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels"))
        rounds.append(roots)
        one, two = (roots.select(F.col("node").alias(n), F.col("label").alias(f"{n}_root")) for n in ("node", "other"))
        left = scratch(edges.join(one, "node").join(two, "other").filter("node_root <> other_root").select(F.col("node_root").alias("node"), F.col("other_root").alias("other")).distinct(), "edges")
        discard(edges)
        edges = left
    discard(edges)
    # The rounds' roots shrink; put together from the last, each table is written once more at most.
    labels = rounds.pop()
    while rounds:
        later, own = labels.select(F.col("node").alias("label"), F.col("label").alias("last")), rounds.pop()
        whole = scratch(own.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")
        discard(own, labels)
        labels = whole
    return labels.select("node", "label")


def _roots(pointers: DataFrame) -> DataFrame:
    """The stored table (node, label) with every pointer followed to the node that points to itself; ``pointers`` is deleted."""
    while True:
        ahead = pointers.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = scratch(pointers.select("node", "label").join(ahead, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "labels")
        discard(pointers)
        pointers = step
        if step.filter("moved").isEmpty():
            return step
