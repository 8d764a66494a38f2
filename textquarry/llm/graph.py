"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class Forest:
    """Components that links are added to, in passes of one large-star and one small-star step each.

    labels(): node, label, where nodes of equal labels are connected; once settled, also the other way round, and the label is the smallest node that
    can be reached (a node without a row is its own label). Every pass goes on from the one before, on no more edges than
    that had and the new links together, so nothing grows with the square of a group; its result is a written table.
    """

    def __init__(self):
        self.edges, self.mark, self.settled = None, None, True

    def grow(self, links: DataFrame | None = None) -> None:
        """One pass, over new links too (columns a, b: long)."""
        now = self.edges
        if links is not None:
            new = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            now = new if now is None else now.unionByName(new)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        self.edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, self.mark = self.mark, _mark(self.edges)
        self.settled = links is None and before == self.mark  # only a pass without new links shows that

    def settle(self) -> None:
        while not self.settled:
            self.grow()

    def labels(self) -> DataFrame:
        return self.edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). node, label: the smallest node that can be reached, for every node but the smallest ones themselves."""
    forest = Forest()
    forest.grow(edges)
    forest.settle()
    return forest.labels()
