"""Dealing rows to ordered buckets of nearly equal counts, without a sort in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most buckets; the limits between them travel with the tasks.
MAX_BUCKETS = 65_536


def bucket_limits(df: DataFrame, key: str, rows: int) -> list[int]:
    """Keys that cut the table into ordered buckets of about ``rows`` rows.

    They balance the work and decide nothing else. Only the key column is read.
    """
    n = df.count()
    buckets = min(MAX_BUCKETS, -(-n // rows))
    if buckets < 2:
        return []
    shares = [k / buckets for k in range(1, buckets)]
    accuracy = min(20 * buckets, 1_000_000)
    found = df.agg(F.percentile_approx(key, shares, accuracy).alias("q")).first()["q"]
    return sorted(int(x) for x in found or [])


def buckets_of(keys: pa.Array, limits: list[int], spread: np.ndarray) -> np.ndarray:
    """Bucket of every key. A key that fills several buckets is dealt to them by ``spread``,
    a number from the row itself; a NULL key comes before all others."""
    values = pc.fill_null(keys.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    cuts = np.array(limits, np.int64)
    low = np.searchsorted(cuts, values, side="left")
    high = np.searchsorted(cuts, values, side="right")
    return (low + spread.astype(np.int64) % (high - low + 1)).astype(np.int64)
