"""Tables that compare experiments: arms, seeds, training sizes, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.operators.metrics import PRIMARY_METRIC
from signalloom.runtime import small_table

# The arms in report order; the first is the reference arm.
ARMS = ["scratch", "frozen", "finetune"]
REFERENCE_ARM = "scratch"


def _arm_order():
    return F.array_position(F.array(*[F.lit(a) for a in ARMS]), F.col("arm"))


def _value_of(table: DataFrame, metric: str, arm: str) -> float:
    """One number of one arm; an error when the arm is not in the table."""
    row = table.where(F.col("arm") == arm).select(F.col(metric).cast("double").alias("v")).first()
    if row is None:
        raise KeyError(f"the {arm!r} arm is needed as the reference")
    return row["v"]


def transfer_gain(
    arms: DataFrame, metric: str = PRIMARY_METRIC, keep: Sequence[str] = ()
) -> DataFrame:
    """Each arm against the reference arm.

    ``relative_error_reduction`` is the share of the distance to a perfect score
    that the arm closed; NULL when the reference is already perfect.
    """
    arms, _ = small_table(arms)  # a line per arm, looked at twice
    base = _value_of(arms, metric, REFERENCE_ARM)
    headroom = 1.0 - base
    value = F.col(metric)
    delta = value - F.lit(base)
    reduction = F.round(delta / F.lit(headroom), 4) if headroom > 1e-9 else F.lit(None)
    return arms.select(
        "arm",
        F.lit(metric).alias("metric"),
        F.round(value, 4).alias("value"),
        F.round(delta, 4).alias("delta_vs_scratch"),
        reduction.cast("double").alias("relative_error_reduction"),
        *keep,
    )


def curve_deltas(
    curve: DataFrame, metric: str = PRIMARY_METRIC, arms: Sequence[str] = tuple(ARMS)
) -> DataFrame:
    """Learning curve with one column per arm and the gain over the reference arm."""
    wide = curve.groupBy("n_train").pivot("arm", list(arms)).agg(F.first(metric))
    for arm in arms:
        if arm != REFERENCE_ARM and REFERENCE_ARM in arms:
            gain = F.round(F.col(arm) - F.col(REFERENCE_ARM), 4)
            wide = wide.withColumn(f"{arm} - {REFERENCE_ARM}", gain)
    return wide.orderBy("n_train")


def seed_summary(runs: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    """Mean, sample spread, range and number of runs per arm, in arm order.

    The difference to the reference arm is taken between the rounded means that
    the table shows, and is left out when there is no reference arm.
    """
    value = F.col(metric)
    stats = runs.where(F.col("arm").isin(ARMS)).groupBy("arm").agg(
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.stddev(value), 4).alias("std"),
        F.round(F.min(value), 4).alias("min"),
        F.round(F.max(value), 4).alias("max"),
        F.count(value).alias("n_seeds"),
    )
    stats, _ = small_table(stats)  # a line per arm, looked at twice
    reference = stats.where(F.col("arm") == REFERENCE_ARM).first()
    if reference is not None:
        delta = F.round(F.col("mean") - F.lit(reference["mean"]), 4)
        stats = stats.withColumn("delta_vs_scratch", delta)
    return stats.withColumn("metric", F.lit(metric)).orderBy(_arm_order())


def seed_pivot(
    runs: DataFrame, metric: str = PRIMARY_METRIC, arms: Sequence[str] = tuple(ARMS)
) -> DataFrame:
    """One line per seed, one column per arm."""
    return runs.groupBy("seed").pivot("arm", list(arms)).agg(F.first(metric)).orderBy("seed")


def history_to_long(
    history: DataFrame, keep: Sequence[str] = (), id_col: str = "epoch"
) -> DataFrame:
    """Training history with one line per epoch and measured quantity."""
    ids = [id_col, *keep]
    values = [c for c in history.columns if c not in ids]
    return history.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        ids, values, "metric", "value"
    )


def checkpoint_rules(
    history: DataFrame,
    loss: str = "val_loss",
    metric: str = "val_macro_f1",
    by: Sequence[str] = (),
) -> DataFrame:
    """The epoch chosen by lowest loss and by highest metric; the earliest on a tie."""
    epoch = F.struct("epoch", F.col(loss), F.col(metric))
    picked = history.groupBy(*by).agg(
        F.min_by(epoch, F.struct(F.col(loss), F.col("epoch"))).alias("by_loss"),
        F.max_by(epoch, F.struct(F.col(metric), -F.col("epoch"))).alias("by_metric"),
    )
    rules = F.array(
        F.struct(F.lit("lowest validation loss").alias("selection_rule"), "by_loss.*"),
        F.struct(F.lit("highest validation macro-F1").alias("selection_rule"), "by_metric.*"),
    )
    return picked.select(*by, F.inline(rules))


def history_digest(
    history: DataFrame, by: Sequence[str] = ("arm",), metric: str = "val_macro_f1"
) -> DataFrame:
    """Per arm: epochs, best epoch and value, value after the first epoch, minutes."""
    return history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("best_epoch"),
        F.round(F.max(metric), 4).alias("best_val_macro_f1"),
        F.round(F.min_by(metric, "epoch"), 4).alias("first_val_macro_f1"),
        F.round(F.sum("seconds") / 60, 1).alias("minutes"),
    )
