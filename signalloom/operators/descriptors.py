"""Fifteen descriptors per signal, as one chain of narrow projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions import arrays as A
from signalloom.spec import HEARTBEAT, SignalSpec

# Descriptor names in report order, and those kept as model inputs
# once columns that carry the same information are left out.
FEATURE_COLUMNS = [
    "signal_length",
    "duration_s",
    "padding_ratio",
    "n_zeros",
    "amp_min",
    "amp_max",
    "amp_range",
    "amp_mean",
    "amp_std",
    "energy",
    "rms",
    "peak_index",
    "peak_time_s",
    "mean_abs_diff",
    "max_abs_diff",
]
MODEL_FEATURE_COLUMNS = [
    "signal_length",
    "amp_min",
    "amp_mean",
    "amp_std",
    "peak_index",
    "mean_abs_diff",
    "max_abs_diff",
]


def add_descriptors(
    df: DataFrame, signal_col: str = "signal", spec: SignalSpec = HEARTBEAT
) -> DataFrame:
    """Append :data:`FEATURE_COLUMNS`.

    The arrays and sums that several descriptors share are columns of a middle
    projection, so each lambda runs once per row. Nothing is shuffled, and the
    optimizer drops descriptors nobody reads.
    """
    sig = F.col(signal_col)
    base = df.withColumn("signal_length", A.effective_length(sig))
    length = F.col("signal_length")
    trimmed = base.withColumn("__valid", A.valid_signal(sig, length))
    parts = trimmed.withColumns(
        {
            "__diffs": A.absolute_differences("__valid"),
            "__sum": A.array_sum("__valid"),
            "energy": A.array_sum_squares("__valid"),
            "amp_min": F.array_min("__valid"),
            "amp_max": F.array_max("__valid"),
        }
    )
    described = parts.withColumns(
        {
            "duration_s": length / F.lit(float(spec.sampling_hz)),
            "padding_ratio": (F.lit(spec.n_samples) - length) / F.lit(float(spec.n_samples)),
            "n_zeros": F.size(F.filter(sig, lambda x: x == 0.0)),
            "amp_range": F.col("amp_max") - F.col("amp_min"),
            "amp_mean": A.safe_divide(F.col("__sum"), length),
            "amp_std": A.std_from_sums(F.col("__sum"), F.col("energy"), length),
            "rms": F.sqrt(A.safe_divide(F.col("energy"), length)),
            "peak_index": (F.array_position("__valid", F.col("amp_max")) - 1).cast("int"),
            "mean_abs_diff": A.array_mean("__diffs"),
            "max_abs_diff": F.array_max("__diffs"),
        }
    )
    described = described.withColumn(
        "peak_time_s", F.col("peak_index") / F.lit(float(spec.sampling_hz))
    )
    keep = [c for c in df.columns if c not in FEATURE_COLUMNS]
    return described.select(*keep, *FEATURE_COLUMNS)


def ensure_descriptors(
    df: DataFrame, signal_col: str = "signal", spec: SignalSpec = HEARTBEAT
) -> DataFrame:
    """Add the descriptors unless the frame already carries them."""
    return df if "signal_length" in df.columns else add_descriptors(df, signal_col, spec)


def pin(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fix the values of ``columns`` so that a later filter reads them.

    The optimizer moves a filter below the projections that define its columns
    and repeats their expressions there. For a NULL check over fifteen nested
    array expressions this costs many times the descriptors themselves (measured:
    81 s instead of 2 s on 60,000 signals). Rows that come out of a generator are
    a point no filter on them can pass.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def add_fingerprint(df: DataFrame, signal_col: str = "signal") -> DataFrame:
    """Append ``signal_hash``."""
    return df.withColumn("signal_hash", A.signal_fingerprint(signal_col))
