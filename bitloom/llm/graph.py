"""Connected components of an edge table, without collecting links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut, drop_table


def _some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root): every node's smallest neighbour, if smaller than itself, followed to its end.

    Each pointer leads to a smaller node, so they form trees; a step doubles how far a pointer reaches.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = cut(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")), "stars")
    while True:
        above = stars.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        further = stars.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = cut(further, "stars")
        moved = _some(after.where("moved"))
        drop_table(stars)
        stars = after
        if not moved:
            return stars.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge table (u, v): root is the smallest node reachable.

    In each round the nodes gather in trees (``_stars``) and every tree becomes one node: edges are
    renamed, those within a tree and repeated ones go. So a round's joins take what is left, not all
    edges again. Minima are aggregated before they are shuffled, so a node with very many neighbours is
    no hot spot. All tables are in the shared folder; a lost executor costs one step at most.
    Self-loops and repeated edges do no harm; nodes with nothing but self-loops are their own roots. An
    empty table gives an empty one.
    """
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    edges = cut(edges.select(low, high).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or _some(edges):
        stars = _stars(edges)
        rounds.append(stars)
        of = lambda end, name: stars.select(F.col("node").alias(end), F.col("root").alias(name))
        renamed = edges.where("u <> v").join(of("u", "_u"), "u").join(of("v", "_v"), "v").where("_u <> _v")
        after = cut(renamed.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct(), "edges")
        drop_table(edges)
        edges = after
    # a root of one round may be a node of the next
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        found = rounds.pop().join(later, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return found
