import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signal_rows import as_dicts, beat_rows, pad
from signalloom.functions import arrays as A
from signalloom.operators.descriptors import FEATURE_COLUMNS, add_descriptors, add_fingerprint, pin
from signalloom.spec import canonical_schema


def describe(spark, *signals):
    rows = beat_rows([(str(i), "train", 0, s) for i, s in enumerate(signals)])
    df = add_descriptors(spark.createDataFrame(rows, canonical_schema()))
    return as_dicts(df.orderBy(F.col("beat_id").cast("int")))


def test_known_signal(spark):
    (row,) = describe(spark, pad([1.0, 0.5, 0.0, 0.25]))
    std = math.sqrt(1.3125 / 4 - 0.4375**2)
    expected = {
        "signal_length": 4,
        "duration_s": 4 / 125,
        "padding_ratio": 183 / 187,
        "n_zeros": 184,
        "amp_min": 0.0,
        "amp_max": 1.0,
        "amp_range": 1.0,
        "amp_mean": 0.4375,
        "amp_std": std,
        "energy": 1.3125,
        "rms": math.sqrt(1.3125 / 4),
        "peak_index": 0,
        "peak_time_s": 0.0,
        "mean_abs_diff": 1.25 / 3,
        "max_abs_diff": 0.5,
    }
    assert list(expected) == FEATURE_COLUMNS
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, rel=1e-9), name


def test_length_edges(spark):
    rows = describe(spark, pad([1, 0, 1]), pad([]), [0.5] * 187, [0.3], None)
    assert [r["signal_length"] for r in rows] == [3, 0, 187, 1, None]


def test_padding_is_left_out(spark):
    (row,) = describe(spark, pad([0.8, 0.4]))
    assert row["amp_mean"] == pytest.approx(0.6)
    assert row["amp_min"] == 0.4


def test_all_zero_and_one_sample_signals_do_not_fail(spark):
    zero, single = describe(spark, pad([]), pad([0.7]))
    assert zero["energy"] == 0.0
    for name in ("amp_min", "amp_mean", "amp_std", "rms", "peak_index", "mean_abs_diff"):
        assert zero[name] is None, name
    assert single["amp_std"] == 0.0
    assert single["mean_abs_diff"] is None and single["max_abs_diff"] is None


def test_null_and_nan_samples(spark):
    null, nan = describe(spark, [0.5, None, 0.25], [0.5, float("nan"), 0.25])
    assert null["signal_length"] == 3 and null["amp_mean"] is None and null["amp_min"] == 0.25
    assert math.isnan(nan["amp_mean"]) and math.isnan(nan["amp_max"]) and nan["peak_index"] == 1


def test_fingerprint(spark):
    rows = beat_rows([("a", "train", 0, pad([1])), ("b", "test", 1, pad([1])), ("c", "train", 0, pad([0.5]))])
    a, b, c = as_dicts(add_fingerprint(spark.createDataFrame(rows, canonical_schema())).orderBy("beat_id"))
    assert a["signal_hash"] == b["signal_hash"] != c["signal_hash"]
    assert len(a["signal_hash"]) == 64


def test_same_answer_on_any_partitioning(spark, five_classes):
    one = add_descriptors(five_classes.repartition(1)).orderBy("beat_id").collect()
    eight = add_descriptors(five_classes.repartition(8)).orderBy("beat_id").collect()
    assert one == eight


def test_filter_does_not_repeat_pinned_expressions(spark, five_classes):
    described = add_descriptors(five_classes)
    free = described.na.drop(subset=FEATURE_COLUMNS)
    pinned = pin(described, FEATURE_COLUMNS).na.drop(subset=FEATURE_COLUMNS)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(pinned).count("aggregate(") == plan(described).count("aggregate(")
    assert plan(free).count("aggregate(") > plan(pinned).count("aggregate(")
    assert pinned.columns == described.columns
    assert free.count() == pinned.count()


samples = st.lists(
    st.one_of(st.just(0.0), st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 3))), max_size=12
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(samples, min_size=1, max_size=20))
def test_against_plain_python(spark, signals):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signals)], "i int, s array<double>")
    rows = df.select(
        "i",
        A.effective_length("s").alias("length"),
        A.valid_signal("s").alias("valid"),
        A.array_sum("s").alias("total"),
        A.array_sum_squares("s").alias("squares"),
        A.array_mean("s").alias("mean"),
        A.array_std("s").alias("std"),
        A.absolute_differences("s").alias("diffs"),
    ).collect()
    for row in rows:
        s = signals[row.i]
        nonzero = [i + 1 for i, x in enumerate(s) if x != 0]
        length = max(nonzero, default=0)
        assert row.length == length
        assert row.valid == s[:length]
        assert row.total == pytest.approx(sum(s))
        assert row.squares == pytest.approx(sum(x * x for x in s))
        assert row.diffs == pytest.approx([abs(b - a) for a, b in zip(s, s[1:])])
        if s:
            mean = sum(s) / len(s)
            assert row["mean"] == pytest.approx(mean, abs=1e-12)
            variance = sum((x - mean) ** 2 for x in s) / len(s)
            assert row["std"] == pytest.approx(math.sqrt(variance), abs=1e-6)
        else:
            assert row["mean"] is None and row["std"] is None
