"""Connected components of a graph that no machine holds, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.tables import settle


class Forest:
    """Union-find over the nodes of one batch; keeps the links that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def add(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the
    smallest neighbour, until nothing changes; rounds grow with the logarithm of the
    longest chain. Every round is a table in the shared folder, so a lost executor costs
    its tasks only. Links to oneself and repeated links do no harm.
    """
    larger, smaller = F.greatest(a, b), F.least(a, b)
    links = links.where(F.col(a) != F.col(b)).select(larger.alias("a"), smaller.alias("b")).distinct()
    links = settle(links, "links")
    before = _signature(links)
    while before[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        links = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        hung = links.join(least, "a")
        links = hung.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        links = settle(links.distinct(), "links")
        after = _signature(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
