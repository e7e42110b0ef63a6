"""Signal tables made from ordinary event tables.

An event table becomes fixed-length signals by putting events on a time grid: the
samples of a signal are the totals of its grid cells. Every event lands in exactly
one cell, and totals are taken before the shuffle, so a key with very many events
costs no more than one row of ``n_samples`` totals per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.spec import Collection, SignalSpec


def grid_signals(
    df: DataFrame, keys: Sequence[str], slot: Column, amount: Column, n_samples: int
) -> DataFrame:
    """One row per key with ``signal``: totals per slot, divided by the largest total.

    ``amount`` should be a whole number type, so that totals do not depend on the
    order of rows. Slots without events, and the padding behind the last one, are 0.
    """
    # Rows of a key meet before the sums of all slots are taken: a task that held those of every key
    # it reads, most of them spread over all tasks, would need many times its input.
    totals = (
        df.select(*keys, slot.cast("int").alias("__slot"), amount.alias("__amount"))
        .groupBy(*keys, "__slot")
        .agg(F.sum("__amount").alias("__amount"))
    )
    cells = (
        totals.repartition(*keys)
        .groupBy(*keys)
        .agg(
            F.array(
                *[
                    F.sum(F.when(F.col("__slot") == i, F.col("__amount")).otherwise(F.lit(0)))
                    for i in range(n_samples)
                ]
            ).alias("__totals")
        )
    )
    top = F.array_max("__totals")
    scaled = F.transform(
        "__totals", lambda x: F.when(F.col("__top") > 0, x / F.col("__top")).otherwise(F.lit(0.0))
    )
    return (
        cells.withColumn("__top", top).withColumn("signal", scaled).drop("__totals", "__top")
    )


def hash_split(key: Column | str, test_digits: str = "012") -> Column:
    """``test`` for keys whose MD5 starts with one of the given hex digits, else ``train``."""
    first = F.substring(F.md5(F.col(key) if isinstance(key, str) else key), 1, 1)
    return F.when(first.isin(list(test_digits)), "test").otherwise("train")


# --- daily event totals -----------------------------------------------------

EVENT_CLASSES = {0: "click", 1: "error", 2: "purchase", 3: "signup", 4: "view"}
EVENT_SPEC = SignalSpec(
    n_samples=31,
    sampling_hz=1.0 / 86_400.0,
    collections={
        "a": Collection("a", EVENT_CLASSES, {n: f"daily {n} amounts" for n in EVENT_CLASSES.values()}),
        "b": Collection("b", EVENT_CLASSES, {n: f"daily {n} amounts" for n in EVENT_CLASSES.values()}),
    },
)


def _code_of(name: Column, classes: dict[int, str]) -> Column:
    pairs = [F.lit(x) for code, text in classes.items() for x in (text, code)]
    return F.create_map(*pairs)[name]


def event_signals(events: DataFrame) -> DataFrame:
    """A signal per user, event type and month: the amount on each day of the month."""
    prepared = events.select(
        F.col("user_id"),
        F.col("event_type").alias("label_name"),
        F.date_format("ts", "yyyyMM").alias("month"),
        (F.dayofmonth("ts") - 1).alias("day"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    signals = grid_signals(
        prepared, ["user_id", "label_name", "month"], F.col("day"), F.col("cents"), 31
    )
    return (
        signals.withColumn("beat_id", F.concat_ws("-", "user_id", "label_name", "month"))
        .withColumn("source", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
        .withColumn("split", hash_split("beat_id"))
        .withColumn("label", _code_of(F.col("label_name"), EVENT_CLASSES))
        .select("beat_id", "source", "split", "label", "label_name", "signal")
    )


# --- monthly order quantities -----------------------------------------------

FLAG_CLASSES = {0: "A", 1: "N", 2: "R"}
LINE_SPEC = SignalSpec(
    n_samples=84,
    sampling_hz=12.0,
    collections={"lines": Collection("lines", FLAG_CLASSES)},
)


def line_signals(lineitem: DataFrame) -> DataFrame:
    """A signal per part, return flag and seven-year period: quantity per month."""
    months = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - 1995 * 12
    prepared = lineitem.select(
        "l_partkey",
        F.col("l_returnflag").alias("label_name"),
        F.floor(months / 84).cast("int").alias("period"),
        F.pmod(months, F.lit(84)).alias("slot"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    signals = grid_signals(
        prepared, ["l_partkey", "label_name", "period"], F.col("slot"), F.col("quantity"), 84
    )
    return (
        signals.withColumn("beat_id", F.concat_ws("-", "l_partkey", "label_name", "period"))
        .withColumn("source", F.lit("lines"))
        .withColumn("split", hash_split("beat_id"))
        .withColumn("label", _code_of(F.col("label_name"), FLAG_CLASSES))
        .select("beat_id", "source", "split", "label", "label_name", "signal")
    )


# --- deterministic predictions ----------------------------------------------


def pseudo_predictions(
    events: DataFrame,
    n_classes: int = 5,
    salt: Column | str = "",
    pull: Column | int = 40,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A prediction for every event, from hashes instead of a trained model.

    Each class gets a whole-number weight from the event's hash, the true class
    gets ``pull`` on top, and probabilities are the weights over their sum. The
    outcome is the same in any engine and has tied scores.
    """
    salt = F.lit(salt) if isinstance(salt, str) else salt
    pull = F.lit(pull) if isinstance(pull, int) else pull
    label = _code_of(F.col("event_type"), EVENT_CLASSES)
    if n_classes == 2:
        label = (F.col("event_type") == "purchase").cast("int")
    digest = F.md5(F.concat_ws(":", salt, F.col("event_id").cast("string")))
    weights = F.array(
        *[
            F.conv(F.substring("__digest", 1 + 2 * c, 2), 16, 10).cast("int")
            % 64
            + F.when(F.col("label") == c, F.col("__pull")).otherwise(F.lit(0))
            + 1
            for c in range(n_classes)
        ]
    )
    total = F.aggregate("__w", F.lit(0), lambda acc, x: acc + x)
    return (
        events.select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("beat_id"),
            F.col("event_id"),
            label.alias("label"),
            digest.alias("__digest"),
            pull.alias("__pull"),
            *keep,
        )
        .withColumn("__w", weights)
        .withColumn("__total", total)
        .select(
            "beat_id",
            *keep,
            "label",
            (F.array_position("__w", F.array_max("__w")) - 1).cast("double").alias("prediction"),
            F.transform("__w", lambda x: x / F.col("__total")).alias("probability"),
        )
    )
