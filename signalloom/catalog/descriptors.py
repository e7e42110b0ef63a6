"""Section B: array functions and descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.catalog.base import (
    EVENT_FEATS,
    EVENT_LONG,
    LINE_FEATS,
    SPEC,
    beats,
    big,
    lines,
    query,
    r,
    r6,
    rounded_doubles,
    table,
)
from signalloom.functions import arrays as A
from signalloom.operators.descriptors import FEATURE_COLUMNS, add_descriptors, add_fingerprint
from signalloom.sources.views import LINE_SPEC

INT_FEATURES = {"signal_length", "n_zeros", "peak_index"}


def _valid():
    return A.valid_signal("signal")


def _per_beat(name: str, column: str, make, sql_value: str) -> None:
    """A query that shows one array function for every event signal."""

    @query(name, f"WITH {EVENT_FEATS} SELECT beat_id, {sql_value} AS {column} FROM feats")
    def run(spark, sf_dir):
        value = make()
        return rounded_doubles(beats(spark, sf_dir).select("beat_id", value.alias(column)))


_per_beat("b01_effective_length", "signal_length", lambda: A.effective_length("signal"), "signal_length")


@query(
    "b02_valid_signal",
    f"""WITH {EVENT_FEATS}
SELECT beat_id, CAST(slot AS INTEGER) AS t, {r('x')} AS x FROM valid""",
)
def b02(spark, sf_dir):
    trimmed = beats(spark, sf_dir).select("beat_id", F.posexplode(_valid()).alias("t", "x"))
    return trimmed.withColumn("x", r6("x"))


@query(
    "b03_array_sum",
    f"WITH {EVENT_LONG} SELECT beat_id, {r('sum(x)')} AS total FROM long GROUP BY beat_id",
)
def b03(spark, sf_dir):
    return beats(spark, sf_dir).select("beat_id", r6(A.array_sum("signal")).alias("total"))


@query(
    "b04_array_sum_squares",
    f"WITH {EVENT_LONG} SELECT beat_id, {r('sum(x * x)')} AS total FROM long GROUP BY beat_id",
)
def b04(spark, sf_dir):
    return beats(spark, sf_dir).select("beat_id", r6(A.array_sum_squares("signal")).alias("total"))


@query(
    "b05_safe_divide",
    f"""SELECT o_orderkey, {r('CASE WHEN c_acctbal > 0 THEN o_totalprice / c_acctbal END')} AS ratio
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def b05(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    ratio = A.safe_divide(F.col("o_totalprice"), F.col("c_acctbal"))
    return joined.select("o_orderkey", r6(ratio).alias("ratio"))


_per_beat("b06_array_mean", "value", lambda: A.array_mean(_valid()), r("amp_mean"))
_per_beat("b07_array_std", "value", lambda: A.array_std(_valid()), r("amp_std"))


@query(
    "b08_absolute_differences",
    f"""WITH {EVENT_FEATS}
SELECT beat_id, CAST(slot - 1 AS INTEGER) AS t, {r('d')} AS d FROM valid WHERE d IS NOT NULL""",
)
def b08(spark, sf_dir):
    steps = beats(spark, sf_dir).select(
        "beat_id", F.posexplode(A.absolute_differences(_valid())).alias("t", "d")
    )
    return steps.withColumn("d", r6("d"))


@query(
    "b09_signal_fingerprint",
    f"""WITH {EVENT_LONG},
sets AS (SELECT beat_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY slot) AS s FROM long GROUP BY beat_id),
copies AS (SELECT s, count(*) AS copies FROM sets GROUP BY s)
SELECT {big('copies')} AS copies, {big('count(*)')} AS n_fingerprints FROM copies GROUP BY copies""",
)
def b09(spark, sf_dir):
    prints = beats(spark, sf_dir).select(A.signal_fingerprint("signal").alias("f"))
    copies = prints.groupBy("f").agg(F.count(F.lit(1)).alias("copies"))
    return copies.groupBy("copies").agg(F.count(F.lit(1)).alias("n_fingerprints"))


@query(
    "b10_add_fingerprint",
    f"""WITH {EVENT_LONG}
SELECT beat_id, CAST(64 AS INTEGER) AS hash_digits FROM long GROUP BY beat_id""",
)
def b10(spark, sf_dir):
    hashed = add_fingerprint(beats(spark, sf_dir))
    return hashed.select("beat_id", F.length("signal_hash").alias("hash_digits"))


def _feature(number: int, feature: str) -> None:
    value = feature if feature in INT_FEATURES else r(feature)

    @query(
        f"b{number:02d}_{feature}",
        f"WITH {EVENT_FEATS} SELECT beat_id, label_name, {value} AS {feature} FROM feats",
    )
    def run(spark, sf_dir):
        described = add_descriptors(beats(spark, sf_dir), spec=SPEC)
        return rounded_doubles(described.select("beat_id", "label_name", feature))


for _i, _name in enumerate(FEATURE_COLUMNS):
    _feature(11 + _i, _name)

_ALL = ", ".join(f if f in INT_FEATURES else f"{r(f)} AS {f}" for f in FEATURE_COLUMNS)


@query(
    "b26_descriptors",
    f"WITH {EVENT_FEATS} SELECT beat_id, source, split, label, label_name, {_ALL} FROM feats",
)
def b26(spark, sf_dir):
    return rounded_doubles(add_descriptors(beats(spark, sf_dir), spec=SPEC).drop("signal"))


#: Descriptors that hold no sum, so that they are equal to the last digit.
ORDER_FREE = [
    "signal_length",
    "duration_s",
    "padding_ratio",
    "n_zeros",
    "amp_min",
    "amp_max",
    "amp_range",
    "peak_index",
    "peak_time_s",
    "max_abs_diff",
]


@query(
    "b26_descriptors_of_lines",
    f"WITH {LINE_FEATS} SELECT beat_id, label, label_name, {', '.join(ORDER_FREE)} FROM feats",
)
def b26_lines(spark, sf_dir):
    described = add_descriptors(lines(spark, sf_dir), spec=LINE_SPEC)
    return described.select("beat_id", "label", "label_name", *ORDER_FREE)
