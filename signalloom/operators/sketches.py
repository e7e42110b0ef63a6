"""Profiles that can be added up: one stored row of sums and a quantile sketch per group and descriptor.

New data gets sketches of its own; a report over any coarser grouping, or over old and new
data together, merges stored rows and does not read a signal again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.descriptors import FEATURE_COLUMNS, ensure_descriptors
from signalloom.operators.profile import DEFAULT_QUANTILES, quantile_name
from signalloom.spec import HEARTBEAT, SignalSpec

#: Size parameter of the sketches, and the error of a rank, as a share of the rows, that it allows for.
SKETCH_SIZE, RANK_ERROR = 200, 0.0165


def profile_sketches(
    df: DataFrame,
    by: Sequence[str] = ("source", "split", "label_name"),
    features: Sequence[str] | None = None,
    spec: SignalSpec = HEARTBEAT,
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """One row per group and descriptor: n, total, squares, least, most, sketch. One pass over the signals."""

    def line(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.struct(
            F.lit(name).alias("feature"),
            F.count(x).alias("n"),
            F.sum(x).alias("total"),
            F.sum(x * x).alias("squares"),
            F.min(x).alias("least"),
            F.max(x).alias("most"),
            F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"),
        )

    lines = F.array(*[line(f) for f in features or FEATURE_COLUMNS])
    return ensure_descriptors(df, spec=spec).groupBy(*by).agg(lines.alias("__lines")).select(*by, F.inline("__lines"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ("source", "label_name")) -> DataFrame:
    """The rows of a coarser grouping, from stored rows of a finer one, of several tables if they were put together."""
    return sketches.groupBy(*by, "feature").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "squares")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketch_summary(
    sketches: DataFrame,
    by: Sequence[str] = ("source", "label_name"),
    quantiles: Sequence[float] = DEFAULT_QUANTILES,
    decimals: int = 4,
) -> DataFrame:
    """Group, descriptor, n, mean, std, min, quantiles, max. Quantiles are off by a rank of at most about :data:`RANK_ERROR`.

    A group without a value has n = 0 and NULLs.
    """
    n, mean = F.nullif(F.col("n"), F.lit(0)), F.col("total") / F.nullif(F.col("n"), F.lit(0))
    spread = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, quantiles))))
    values = {"mean": mean, "std": F.sqrt(spread), "min": F.col("least")}
    values |= {quantile_name(q): F.get("__q", F.lit(i)) for i, q in enumerate(quantiles)}
    values["max"] = F.col("most")
    rows = sketches.withColumn("__q", found)
    return rows.select(*by, "feature", "n", *[F.round(v, decimals).alias(c) for c, v in values.items()])
