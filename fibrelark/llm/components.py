"""Connected components of a table of links over written tables: alternating stars, or contraction of labels as links come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibrelark.llm.common import Scratch


def _nearest(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours; partial sums keep hot nodes cheap."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = both.filter("b > a").join(_nearest(both), F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _nearest(down)
    moved = down.join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = low.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def near_labels(links: DataFrame) -> DataFrame:
    """(node, label) in one pass: the least node within three links downhill.

    Nodes with one label are connected; connected nodes may still differ.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _nearest(both)
    up = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
    once = low.join(up, "low").select("node", F.col("next").alias("low"))
    return once.join(up, "low").select("node", F.col("next").alias("label"))


class Labels:
    """Labels of the components of links that come in parts: (node, label) for every node with a link so far.

    New links are mapped to the labels of their ends and contracted until none is left
    between two labels. Nothing that was contracted before is looked at again, and the
    number of rounds grows with the logarithm of the longest chain of new links.
    """

    def __init__(self, scratch: Scratch, name: str = "labels") -> None:
        self.scratch, self.name, self.turn = scratch, name, 0
        self.table: DataFrame | None = None

    def _mapped(self, links: DataFrame, labels: DataFrame) -> DataFrame:
        side = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
        named = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
        ends = F.coalesce("label_a", "a"), F.coalesce("label_b", "b")
        return named.filter(ends[0] != ends[1]).select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).distinct()

    def add(self, links: DataFrame) -> None:
        own = links.filter("a <> b") if self.table is None else self._mapped(links, self.table)
        k = 0
        own = self.scratch.write(own.select("a", "b"), f"{self.name}-{self.turn}-links-0")
        while own.limit(1).count():
            near = self.scratch.write(near_labels(own), f"{self.name}-{self.turn}-near-{k}")
            k += 1
            own = self.scratch.write(self._mapped(own, near), f"{self.name}-{self.turn}-links-{k}")
            if self.table is not None:
                moved = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
                kept = self.table.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
                near = kept.union(near.join(self.table.select("node"), "node", "left_anti"))
            self.table = self.scratch.write(near, f"{self.name}-{self.turn}-{k}")
        self.turn += 1
        if self.table is None:
            self.table = self.scratch.write(links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0), f"{self.name}-none")


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, label) for every node with a link: label is the least node it is connected with.

    ``links`` has long columns a and b; order, repeats and loops do not matter. The
    links stay distributed: each round writes them to the shared folder, and the
    number of rounds grows with the logarithm of the longest chain.
    """
    now = scratch.write(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        now = scratch.write(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
