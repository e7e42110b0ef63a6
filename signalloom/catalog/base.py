"""Registry, table access, and the SQL form of the derived signal tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.sources import views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query and, when SQL can say it, the SQL that must agree with it."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_signals(table(spark, sf_dir, "events"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.line_signals(table(spark, sf_dir, "lineitem"))


def rounded(df: DataFrame, *columns: str, decimals: int = 6) -> DataFrame:
    """Round so that the order of additions does not show."""
    return df.withColumns({c: F.round(c, decimals) for c in columns})


def rounded_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    return rounded(df, *[n for n, t in df.dtypes if t == "double"], decimals=decimals)


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# --- SQL building blocks ----------------------------------------------------

SPEC = views.EVENT_SPEC
NAMES = list(views.EVENT_CLASSES.values())
EVENT_CODE = (
    "CASE event_type "
    + " ".join(f"WHEN '{n}' THEN {c}" for c, n in views.EVENT_CLASSES.items())
    + " END"
)


def _grid_sql(events_cte: str, keys: str, n: int, finish: str) -> str:
    using = keys
    return f"""{events_cte},
cells AS (SELECT {keys}, slot, CAST(sum(amount) AS BIGINT) AS c FROM prepared GROUP BY {keys}, slot),
tops AS (SELECT {keys}, max(c) AS top FROM cells GROUP BY {keys}),
grid AS (
  SELECT tops.*, s.slot,
         CASE WHEN top > 0 THEN CAST(coalesce(c, 0) AS DOUBLE) / top ELSE CAST(0 AS DOUBLE) END AS x
  FROM tops CROSS JOIN (SELECT CAST(range AS INTEGER) AS slot FROM range({n})) s
  LEFT JOIN cells USING ({using}, slot)),
long0 AS ({finish}),
long AS (SELECT *, CASE WHEN substr(md5(beat_id), 1, 1) IN ('0','1','2') THEN 'test' ELSE 'train' END AS split FROM long0)"""


#: ``long``: one row per sample of the event signals.
EVENT_LONG = _grid_sql(
    """prepared AS (
  SELECT user_id, event_type AS label_name, strftime(ts, '%Y%m') AS month,
         CAST(day(ts) - 1 AS INTEGER) AS slot, CAST(round(value * 100) AS BIGINT) AS amount
  FROM events)""",
    "user_id, label_name, month",
    31,
    f"""SELECT concat_ws('-', user_id, label_name, month) AS beat_id,
         CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source,
         CAST({EVENT_CODE.replace('event_type', 'label_name')} AS INTEGER) AS label, label_name, slot, x
  FROM grid""",
)

LINE_LONG = _grid_sql(
    """dated AS (
  SELECT l_partkey, l_returnflag AS label_name, CAST(l_quantity AS BIGINT) AS amount,
         year(l_shipdate) * 12 + month(l_shipdate) - 1 - 1995 * 12 AS months FROM lineitem),
prepared AS (
  SELECT l_partkey, label_name, CAST(floor(months / 84.0) AS INTEGER) AS period,
         CAST(((months % 84) + 84) % 84 AS INTEGER) AS slot, amount FROM dated)""",
    "l_partkey, label_name, period",
    84,
    """SELECT concat_ws('-', l_partkey, label_name, period) AS beat_id, 'lines' AS source,
         CAST(CASE label_name WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER) AS label,
         label_name, slot, x
  FROM grid""",
)


def features_sql(n: int, hz: str) -> str:
    """``feats``: the descriptors, computed from ``long`` by joins and windows."""
    return f"""
lengths AS (
  SELECT beat_id, source, split, label, label_name,
         CAST(coalesce(max(CASE WHEN x <> 0 THEN slot + 1 END), 0) AS INTEGER) AS signal_length,
         CAST(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_zeros
  FROM long GROUP BY ALL),
valid AS (
  SELECT l.beat_id, l.slot, l.x,
         abs(l.x - lag(l.x) OVER (PARTITION BY l.beat_id ORDER BY l.slot)) AS d
  FROM long l JOIN lengths k ON l.beat_id = k.beat_id AND l.slot < k.signal_length),
stats AS (
  SELECT beat_id, min(x) AS amp_min, max(x) AS amp_max, avg(x) AS amp_mean,
         sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS amp_std,
         sum(x * x) AS energy, sqrt(avg(x * x)) AS rms,
         avg(d) AS mean_abs_diff, max(d) AS max_abs_diff
  FROM valid GROUP BY beat_id),
peaks AS (
  SELECT v.beat_id, CAST(min(v.slot) AS INTEGER) AS peak_index
  FROM valid v JOIN stats s ON v.beat_id = s.beat_id AND v.x = s.amp_max GROUP BY v.beat_id),
feats AS (
  SELECT k.*, k.signal_length / {hz} AS duration_s,
         CAST({n} - k.signal_length AS DOUBLE) / {n} AS padding_ratio,
         s.amp_min, s.amp_max, s.amp_max - s.amp_min AS amp_range, s.amp_mean, s.amp_std,
         coalesce(s.energy, 0) AS energy, s.rms, p.peak_index, p.peak_index / {hz} AS peak_time_s,
         s.mean_abs_diff, s.max_abs_diff
  FROM lengths k LEFT JOIN stats s USING (beat_id) LEFT JOIN peaks p USING (beat_id))"""


EVENT_HZ = "(CAST(1 AS DOUBLE) / 86400)"
EVENT_FEATS = EVENT_LONG + "," + features_sql(31, EVENT_HZ)
LINE_FEATS = LINE_LONG + "," + features_sql(84, "CAST(12 AS DOUBLE)")
#: ``rows``: one row per event signal, without its samples.
EVENT_ROWS = EVENT_LONG + (
    ",\nrows AS (SELECT DISTINCT beat_id, source, split, label, label_name FROM long)"
)


def r(expr: str, decimals: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {decimals})"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def share(n: str, total: str, decimals: int) -> str:
    return r(f"CAST({n} AS DOUBLE) * 100 / ({total})", decimals)


def predictions_sql(
    source: str = "events",
    salt: str = "'p'",
    pull: str = "40",
    n_classes: int = 5,
    keep: str = "",
    name: str = "pred",
) -> str:
    """CTEs ending in ``pred``: label, prediction and p0 .. p<k-1> for every event."""
    label = EVENT_CODE if n_classes > 2 else "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"
    extra = f", {keep}" if keep else ""
    w = ", ".join(
        f"CAST('0x' || substr(digest, {1 + 2 * c}, 2) AS INTEGER) % 64 "
        f"+ CASE WHEN label = {c} THEN pull ELSE 0 END + 1 AS w{c}"
        for c in range(n_classes)
    )
    every = ", ".join(f"w{c}" for c in range(n_classes))
    total = " + ".join(f"w{c}" for c in range(n_classes))
    arg = " ".join(f"WHEN w{c} = greatest({every}) THEN {c}" for c in range(n_classes))
    p = ", ".join(f"CAST(w{c} AS DOUBLE) / ({total}) AS p{c}" for c in range(n_classes))
    return f"""{name}_digest AS (
  SELECT event_id, CAST({label} AS INTEGER) AS label, {pull} AS pull,
         md5(concat_ws(':', {salt}, CAST(event_id AS VARCHAR))) AS digest{extra} FROM {source}),
{name}_w AS (SELECT *, {w} FROM {name}_digest),
{name} AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS beat_id, label{extra},
         CAST(CASE {arg} END AS INTEGER) AS prediction, {p} FROM {name}_w)"""


CLASSES = "classes(code, name) AS (VALUES " + ", ".join(
    f"({c}, '{n}')" for c, n in views.EVENT_CLASSES.items()
) + ")"


def confusion_sql(by: str = "", pred: str = "pred", classes: str = "classes") -> str:
    """CTEs ``cm`` (dense confusion) and ``per_class`` from ``pred``."""
    if by:
        groups = f"groups AS (SELECT DISTINCT {by} FROM {pred}), "
        head = f"{by}, "
        source = f"groups CROSS JOIN {classes} t CROSS JOIN {classes} p"
        on = " AND ".join(f"groups.{b.strip()} = c.{b.strip()}" for b in by.split(","))
        select = ", ".join(f"groups.{b.strip()}" for b in by.split(",")) + ", "
        on = f"{on} AND "
    else:
        groups, head, select, on = "", "", "", ""
        source = f"{classes} t CROSS JOIN {classes} p"
    return f"""{groups}counted AS (SELECT {head}label, prediction, count(*) AS n FROM {pred} GROUP BY ALL),
cm AS (
  SELECT {select}CAST(t.code AS INTEGER) AS label, t.name AS "true",
         CAST(p.code AS INTEGER) AS prediction, p.name AS predicted, {big('coalesce(c.n, 0)')} AS n
  FROM {source} LEFT JOIN counted c ON {on}c.label = t.code AND c.prediction = p.code),
truth AS (SELECT {head}label AS code, "true" AS class, sum(n) AS support,
            sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cm GROUP BY ALL),
guess AS (SELECT {head}prediction AS code, sum(n) AS predicted_n FROM cm GROUP BY ALL),
per_class AS (
  SELECT *, CASE WHEN predicted_n > 0 THEN tp / CAST(predicted_n AS DOUBLE) ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall,
         CASE WHEN support + predicted_n > 0 THEN 2 * tp / CAST(support + predicted_n AS DOUBLE) ELSE 0 END AS f1
  FROM truth JOIN guess USING ({head}code)),
base AS (
  SELECT {head}CAST(sum(support) AS DOUBLE) AS nn, CAST(sum(tp) AS DOUBLE) AS d,
         sum(CAST(support AS DOUBLE) * predicted_n) AS rk, sum(CAST(support AS DOUBLE) * support) AS rr,
         sum(CAST(predicted_n AS DOUBLE) * predicted_n) AS kk,
         avg(CASE WHEN support + predicted_n > 0 THEN f1 END) AS macro_f1,
         sum(support * f1) / sum(support) AS weighted_f1,
         avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy
  FROM per_class GROUP BY ALL),
summary AS (
  SELECT {head}{big('nn')} AS n, {r('macro_f1', 4)} AS macro_f1, {r('weighted_f1', 4)} AS weighted_f1,
         {r('balanced_accuracy', 4)} AS balanced_accuracy, {r('d / nn', 4)} AS accuracy,
         {r('CASE WHEN (nn * nn - kk) * (nn * nn - rr) > 0 THEN (nn * d - rk) / sqrt((nn * nn - kk) * (nn * nn - rr)) ELSE 0 END', 4)} AS mcc,
         {r('CASE WHEN rk < nn * nn THEN (d / nn - rk / (nn * nn)) / (1 - rk / (nn * nn)) END', 4)} AS cohen_kappa
  FROM base)"""
