"""Every operator as a runnable query on the driver's tables, with SQL to check it by."""

from signalloom.catalog import (  # noqa: F401  (importing registers the queries)
    descriptors,
    experiments,
    ingestion,
    metrics,
    models,
    profiles,
    splits,
)
from signalloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
