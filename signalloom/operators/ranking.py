"""Exact ranks in huge groups without one task per group.

A window ordered within a group sends the whole group to one task. Five classes
would mean five tasks, however many executors there are. Both helpers below
count first, on a coarse key, and then look closely only where it matters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.ordering import hash_order
from signalloom.runtime import attach, materialise, small_table

#: Leading hex digits of the order hash used as bucket: 4096 buckets per group.
BUCKET_DIGITS = 3

#: Distinct values that one task may sort in :func:`running_totals`.
ROWS_PER_BUCKET = 2_000_000


def _order_key(seed: int, keys: Sequence[str]) -> Column:
    """Hash first, key second: rows can share a hash but not a key."""
    return F.array(hash_order(seed, *keys), *[F.col(k).cast("string") for k in keys])


def hash_order_cuts(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    seed: int,
    counts: Callable[[Column], Sequence[Column]],
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Per group, its size and the order key of the last row taken for each number wanted.

    ``counts`` maps the group size to the wanted numbers of rows. The result has the group
    columns, ``__n`` and one ``__cut_<j>`` per number, NULL where no row is wanted. Only the
    group and key columns of ``df`` are read.

    1. Count rows per (group, hash prefix): a partial aggregate over two narrow
       columns, at most ``16**digits`` counts per group.
    2. Running sums over those counts name the one prefix in which each cut lies.
    3. Only rows of these prefixes, about ``1 / 16**digits`` of the data, are
       ranked; this gives the order key of the last row taken.
    """
    groups, keys = list(groups), list(keys)
    narrow = df.select(*groups, _order_key(seed, keys).alias("__key"))
    narrow = narrow.withColumn("__bucket", F.substring(F.get("__key", F.lit(0)), 1, digits))

    per_group = Window.partitionBy(*groups)
    histogram = (
        narrow.groupBy(*groups, "__bucket")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__n", F.sum("__c").over(per_group))
        .withColumn("__upto", F.sum("__c").over(per_group.orderBy("__bucket")))
    )
    n = F.col("__n")
    wanted = F.array(*[F.least(c.cast("long"), n) for c in counts(n)])
    n_cuts = len(counts(n))
    edges = (
        histogram.select(
            *groups,
            "__bucket",
            "__n",
            (F.col("__upto") - F.col("__c")).alias("__before"),
            "__upto",
            F.posexplode(wanted).alias("__j", "__m"),
        )
        .where(
            ((F.col("__before") < F.col("__m")) & (F.col("__m") <= F.col("__upto")))
            # Nothing wanted: no rank to look for, but the group's size is kept.
            | ((F.col("__m") <= 0) & (F.col("__before") == 0))
        )
        .select(
            *groups, "__bucket", "__n", "__j", (F.col("__m") - F.col("__before")).alias("__local")
        )
    )
    edges, _ = small_table(edges)
    local_order = Window.partitionBy(*groups, "__bucket", "__j").orderBy("__key")
    near = (
        attach(narrow, edges, [*groups, "__bucket"], how="inner")
        .withColumn("__rn", F.row_number().over(local_order))
        .where(F.col("__rn") == F.col("__local"))
    )
    found = near.select(*groups, "__n", "__j", "__key")
    sizes = edges.select(*groups, "__n", F.lit(-1).alias("__j"))
    return found.unionByName(sizes, allowMissingColumns=True).groupBy(*groups).agg(
        F.max("__n").alias("__n"),
        *[F.max(F.when(F.col("__j") == j, F.col("__key"))).alias(f"__cut_{j}") for j in range(n_cuts)],
    )


def mark_by_cuts(
    df: DataFrame, cuts: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int
) -> DataFrame:
    """Add ``__n`` and one boolean ``__in_<j>`` per cut of :func:`hash_order_cuts`.

    Every row compares its own order key with that of its group, so the rows are read
    once and, while the cuts are few, not shuffled. ``df`` may hold other rows than those the cuts were
    taken from.
    """
    names = [c for c in cuts.columns if c.startswith("__cut_")]
    marked = attach(df.withColumn("__key", _order_key(seed, list(keys))), cuts, list(groups))
    flags = {
        c.replace("cut", "in"): F.coalesce(F.col("__key") <= F.col(c), F.lit(False)) for c in names
    }
    return marked.withColumns(flags).drop("__key", *names)


def take_in_hash_order(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    seed: int,
    counts: Callable[[Column], Sequence[Column]],
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Mark, per group, the first ``m`` rows in hash order for each ``m`` wanted.

    The result is ``df`` with ``__n`` (rows in the group) and one boolean ``__in_<j>`` per
    number. Rows with equal keys share their fate, so ``keys`` should identify a row.
    """
    cuts = hash_order_cuts(df, groups, keys, seed, counts, digits)
    return mark_by_cuts(df, cuts, groups, keys, seed)


def first_in_hash_order(
    df: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int, most: int
) -> DataFrame:
    """Groups, keys and ``rank`` (from 1) of the first ``most`` different keys of each group in hash order.

    Only group and key columns are read, and only rows before the cuts are ranked.
    """
    groups, keys = list(groups), list(keys)
    narrow = df.select(*groups, *keys)
    taken = take_in_hash_order(narrow, groups, keys, seed, lambda n: [F.lit(most)]).where("__in_0")
    order = Window.partitionBy(*groups).orderBy(hash_order(seed, *keys), *keys)
    ranked = taken.select(*groups, *keys).distinct().withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most)


def number_copies(df: DataFrame, key: str, output: str = "copy") -> DataFrame:
    """Number the rows that share a key: 0, 1, ... in column ``output``.

    Rows of one key are told apart by nothing else, so which gets which number does not
    matter. They are counted by (key, input partition) first; a row's number is its place in its
    partition after the rows of the partitions before. So no task sees more rows of a key than
    one partition holds, and where no key occurs twice only keys were shuffled. The table
    is stored on the way, so that rows keep their places.
    """
    placed = materialise(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    # The upper bits of a generated id are the partition that wrote the row.
    narrow = placed.select(key, "__at", F.shiftright("__at", 33).alias("__part"))
    counted = narrow.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))
    by_key = Window.partitionBy(key)
    before = F.sum("__c").over(by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    copied = counted.select(
        key, "__part", F.sum("__c").over(by_key).alias("__all"), F.coalesce(before, F.lit(0)).alias("__before")
    )
    copied = materialise(copied.where("__all > 1").drop("__all"), "copied")
    if copied.isEmpty():
        return placed.withColumn(output, F.lit(0).cast("long")).drop("__at")
    place = F.row_number().over(Window.partitionBy(key, "__part").orderBy("__at")) - 1
    numbers = narrow.join(copied, [key, "__part"]).select("__at", (F.col("__before") + place).alias(output))
    numbered = attach(placed, numbers, ["__at"])
    return numbered.withColumn(output, F.coalesce(F.col(output), F.lit(0)).cast("long")).drop("__at")


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    sums: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """For each (group, value) row add two columns per sum.

    ``<sum>_below`` is the total over smaller values, ``<sum>_total`` that of the group.

    ``df`` holds one row per (group, value), so ties and hot values were already
    collapsed by a partial aggregate. When the largest group is too long for one
    task, values are cut into ranges at approximate quantiles: running sums are
    taken inside each range and shifted by the totals of the ranges before it.
    The quantiles only balance the ranges, the result is exact either way.
    """
    groups, sums = list(groups), list(sums)
    base = materialise(df, "distinct-values").withColumn("__g", F.lit(1))
    by = [*groups, "__g"]
    sizes, _ = small_table(
        base.groupBy(*by).agg(
            F.count(F.lit(1)).alias("__rows"), *[F.sum(s).alias(f"{s}_total") for s in sums]
        )
    )
    base = attach(base, sizes.drop("__rows"), by)
    longest = sizes.agg(F.max("__rows")).first()[0] or 0
    n_ranges = math.ceil(longest / rows_per_bucket)
    if n_ranges <= 1:
        return _running(base, by, value, sums).drop("__g")

    steps = [i / n_ranges for i in range(1, n_ranges)]
    limits = base.groupBy(*by).agg(
        F.percentile_approx(value, steps, 10 * n_ranges).alias("__limits")
    )
    position = F.size(F.filter("__limits", lambda b: b < F.col(value)))
    ranged = attach(base, limits, by).withColumn("__range", position).drop("__limits")

    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *by,
        "__range",
        *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in sums],
    )
    local = _running(ranged, [*by, "__range"], value, sums)
    shifted = attach(local, offsets, [*by, "__range"])
    for s in sums:
        shifted = shifted.withColumn(f"{s}_below", F.col(f"{s}_below") + F.col(f"__{s}"))
    return shifted.drop("__g", "__range", *[f"__{s}" for s in sums])


def _running(df: DataFrame, groups: list[str], value: str, sums: list[str]) -> DataFrame:
    before = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {f"{s}_below": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums}
    )
