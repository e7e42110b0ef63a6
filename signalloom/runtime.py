"""Two helpers that need to know where Spark runs: scratch folders and small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: A table of at most this many rows and bytes may be copied to every executor.
SMALL_ROWS = 10_000
SMALL_BYTES = 32 << 20

#: Paths handed out in each open :func:`scratch_scope`.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, which
    has no other machine, gets a temporary folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="signalloom-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for handed_out in _SCOPES:
        handed_out.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside when the block ends.

    Results are lazy: what is needed later must be collected or written inside.
    """
    handed_out: list[str] = []
    _SCOPES.append(handed_out)
    try:
        yield
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not handed_out]
        for path in handed_out:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy outlives any executor, and what follows is planned from its file
    sizes instead of repeating the work behind ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A table from values in the program, as a local relation of known size."""
    return spark.createDataFrame(pa.table(columns), schema)


def _open_ended(df: DataFrame) -> bool:
    """Whether a row may be of any length: a column holds arrays or maps."""
    return any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in df.schema.fields)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Check that ``df`` is small and, if so, turn it into a local relation.

    At most ``max_rows + 1`` rows reach the driver, as one Arrow table. Where columns hold
    arrays or maps, their length is summed on the executors first.
    When the table fits, Catalyst knows its exact size and later plans do not recompute it;
    when it does not, ``df`` comes back unchanged and the caller joins by shuffle.
    """
    few = df.limit(max_rows + 1)
    if _open_ended(df):
        size = few.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0]
        if (size or 0) > SMALL_BYTES:
            return df, False
    rows = few.toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def attach(
    df: DataFrame,
    side: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Join a per-key table to ``df``, treating NULL keys as equal.

    The side is broadcast only after its size was checked; a larger one goes
    through an ordinary shuffle join, where adaptive execution splits hot keys.
    """
    side, fits = small_table(side, max_rows)
    renamed = side.select(
        *[F.col(k).alias(f"__side_{k}") for k in keys],
        *[c for c in side.columns if c not in keys],
    )
    if fits:
        renamed = F.broadcast(renamed)
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__side_{k}"))
        condition = same if condition is None else condition & same
    return df.join(renamed, condition, how).drop(*[f"__side_{k}" for k in keys])
