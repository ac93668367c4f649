"""Connected components of a table of links, by alternating star contraction.

Each round points every node's larger neighbours at its smallest one, then the
smaller ones as well; the links shrink to a star for each component in a number
of rounds that grows with the logarithm of the nodes.  A node's smallest
neighbour is an aggregate with partial sums and its links are dealt by both
ends, so a component of any size, or a node with very many links, is never
gathered in one task.  Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Rounds after which something is wrong.
MOST_ROUNDS = 60


def _contract(links: DataFrame, large: bool) -> DataFrame:
    """One star operation; links are pairs a > b."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = written(least.select("a", F.least("a", "m").alias("m")), "least")
    met = both.join(least, "a")
    if large:  # neighbours above a go to the least one of all
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a and its neighbours below go to the least of those
        moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _is_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link, and its smaller end no smaller one itself."""
    per = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    if per.where("n > 1").limit(1).count():
        return False
    return not links.select("b").join(links.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is its smallest node.

    Loops and repeated links are ignored, except that a node with nothing but a
    loop is a component of its own; links with a null end are dropped.  No links
    give an empty table.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    current = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    alone = current.where("a = b").select(F.col("a").alias("node"))
    current = current.where("a <> b")
    for _ in range(MOST_ROUNDS):
        if _is_stars(current):
            break
        current = written(_contract(current, True), "large-star")
        current = written(_contract(current, False), "small-star")
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    lonely = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(lonely)
