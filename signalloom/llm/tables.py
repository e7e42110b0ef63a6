"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from signalloom.runtime import scratch_path

#: Tables made in each open :func:`phase`.
_PHASES: list[list[str]] = []

#: Tells Spark to delete a statement's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that Spark sends to a function over Arrow batches at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def held_at(spark: SparkSession, conf: dict[str, object]) -> Iterator[None]:
    """Settings of the session inside the block."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def phase(spark: SparkSession) -> Iterator[None]:
    """Delete the tables settled inside when the block ends, but for those that outlive it."""
    made: list[str] = []
    _PHASES.append(made)
    try:
        yield
    finally:
        _PHASES[:] = [m for m in _PHASES if m is not made]
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str, outlives: bool = False, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go at once.

    Lineage ends here: a lost executor costs what follows, not what came before. A table that
    ``outlives`` the open phase belongs to the one around it. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    owners = _PHASES[: -1 if outlives else None]
    if owners:
        owners[-1].append(path)
    with held_at(spark, {CLEANUP: "true"}):
        df.write.options(compression="zstd", **options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
