"""A random but repeatable order that does not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: Column | str) -> Column:
    """MD5 text of seed and row key: uniform, and equal in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
