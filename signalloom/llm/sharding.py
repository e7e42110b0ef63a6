"""Reproducible shuffles into shards by a Feistel permutation (operator 7). DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import settle

ROUNDS = 6
#: ``monotonically_increasing_id`` keeps the row's place in its partition below this bit.
PARTITION_BIT = 33


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. n - 1 that any row can compute for itself.

    Numbers are written as (left, right) on a grid of nearly equal sides that holds at
    least n. A round adds to each side, modulo its length, a hash of the other. Numbers
    that land outside 0 .. n - 1 go through the rounds again until they are inside. A
    walk meets every outside number at most once, which bounds it; and there are fewer
    outside numbers than the grid has rows, so few rows walk at all.
    """

    n: int
    seed: int = 0
    rounds: int = ROUNDS

    @property
    def rows(self) -> int:
        return max(1, math.isqrt(max(self.n - 1, 0)) + 1)

    @property
    def columns(self) -> int:
        return max(1, -(-self.n // self.rows))

    def _key(self, side: Column, k: Column, salt: int, modulus: int) -> Column:
        return F.pmod(F.xxhash64(side, k, F.lit(self.seed), F.lit(salt)), F.lit(modulus))

    def _through(self, x: Column, back: bool) -> Column:
        rows, columns = self.rows, self.columns

        def ahead_of(s: Column, k: Column) -> Column:
            left = F.pmod(s["left"] + self._key(s["right"], k, 1, rows), F.lit(rows))
            return F.struct(left.alias("left"), F.pmod(s["right"] + self._key(left, k, 2, columns), F.lit(columns)).alias("right"))

        def back_of(s: Column, k: Column) -> Column:
            right = F.pmod(s["right"] - self._key(s["left"], k, 2, columns), F.lit(columns))
            return F.struct(F.pmod(s["left"] - self._key(right, k, 1, rows), F.lit(rows)).alias("left"), right.alias("right"))

        order = range(self.rounds)
        ks = F.array(*[F.lit(k) for k in (reversed(order) if back else order)])
        start = F.struct(_div(x, columns).alias("left"), F.pmod(x, F.lit(columns)).alias("right"))
        return F.aggregate(ks, start, back_of if back else ahead_of, lambda s: s["left"] * F.lit(columns) + s["right"])

    def _walk(self, x: Column, back: bool) -> Column:
        y = self._through(x, back)
        outside = self.rows * self.columns - self.n
        if not outside:
            return y
        n = F.lit(self.n)
        steps = F.sequence(F.lit(1), F.lit(outside))
        again = F.aggregate(steps, y, lambda z, _: F.when(z < n, z).otherwise(self._through(z, back)))
        return F.when(y < n, y).otherwise(again)

    def forward(self, x: Column) -> Column:
        """Where number ``x`` (long, 0 .. n - 1) goes."""
        return self._walk(x, False)

    def backward(self, y: Column) -> Column:
        """The number that goes to ``y``."""
        return self._walk(y, True)


def _div(x: Column, by: int) -> Column:
    """Whole quotient of longs that are not negative."""
    return F.call_function("div", x, F.lit(by))


def shard_and_slot(position: Column, shards: int) -> tuple[Column, Column]:
    return F.pmod(position, F.lit(shards)).cast("int"), _div(position, shards)


def row_of(shard: Column, slot: Column, permutation: Permutation, shards: int) -> Column:
    """The row number that stands in a slot of a shard."""
    return permutation.backward(slot * F.lit(shards) + shard)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``row_number``: 0, 1, ... over the whole table in the given order.

    Ranges of rows are sorted side by side; a row's number is its place in its range
    after all rows of the ranges before. Rows that agree in ``order`` must be equal.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ranges.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", PARTITION_BIT)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    rows = placed.withColumn("__part", part).join(sizes, "__part")
    place = F.col("__id").bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))
    return rows.withColumn("row_number", F.col("__ahead") + place).drop("__id", "__part", "__ahead")


def shards_of(docs: DataFrame, shards: int = 16, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row under the law ``rows``: counts at most one apart.

    Gives key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (0, 1, ... in each
    shard), grown_shard (NULL under this law), row_number. Only these narrow columns move.
    The table, ``shards`` and ``seed`` decide; neither files nor partitions do. A NULL text
    has size 1 and the checksum of nothing; a NULL key comes first. Equal rows are counted
    before they are sorted and dealt out again, so copies do not meet in one task.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    narrow = docs.select(F.col(key).alias("key"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"))
    narrow = narrow.groupBy("key", "size", "text_crc32").count()
    narrow = narrow.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    rows = numbered(settle(narrow, "sizes"), ["key", "text_crc32", "size", "copy"])
    n = docs.count()
    shard, slot = shard_and_slot(F.col("position"), shards)
    return rows.withColumn("position", Permutation(n, seed).forward(F.col("row_number"))).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
