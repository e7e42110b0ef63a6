"""Section D: splits, weights and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalloom.catalog.base import (
    EVENT_LONG,
    EVENT_ROWS,
    LINE_LONG,
    NAMES,
    SPEC,
    beats,
    big,
    lines,
    query,
    r,
    share,
    table,
)
from signalloom.operators import balance as B
from signalloom.operators import splits as S

LABEL_COLUMNS = ["beat_id", "source", "split", "label", "label_name"]


def keyed(spark, sf_dir):
    return beats(spark, sf_dir).select(*LABEL_COLUMNS)


def _ordered(source: str = "rows", seed: int = 42, key: str = "beat_id", label: str = "label") -> str:
    order = f"PARTITION BY {label} ORDER BY md5('{seed}:' || {key}), {key}"
    return (
        f"ordered AS (SELECT *, percent_rank() OVER ({order}) AS p, "
        f"row_number() OVER ({order}) AS rn, count(*) OVER (PARTITION BY {label}) AS n FROM {source})"
    )


STRATIFIED = f"""{EVENT_ROWS},
{_ordered()},
assigned AS (SELECT *, CASE WHEN p < CAST(0.7 AS DOUBLE) THEN 'train'
    WHEN p < CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) THEN 'val' ELSE 'test' END AS split_assigned FROM ordered)"""


@query(
    "d01_stratified_split",
    f"WITH {STRATIFIED} SELECT beat_id, label, split_assigned FROM assigned",
)
def d01(spark, sf_dir):
    return S.stratified_split(keyed(spark, sf_dir)).select("beat_id", "label", "split_assigned")


@query(
    "d01_stratified_split_of_orders",
    f"""WITH keyed AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus FROM orders),
{_ordered('keyed', 7, 'k', 'o_orderstatus')}
SELECT o_orderkey, o_orderstatus, CASE WHEN p < CAST(0.5 AS DOUBLE) THEN 'left' ELSE 'right' END AS side
FROM ordered""",
)
def d01_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_split(
        orders, {"left": 0.5, "right": 0.5}, "o_orderstatus", "side", 7, ["o_orderkey"]
    )


HOLDOUT = f"""{EVENT_ROWS},
trains AS (SELECT * FROM rows WHERE split = 'train'),
{_ordered('trains')},
final AS (
  SELECT beat_id, source, split, label, label_name,
         CASE WHEN p < CAST(0.85 AS DOUBLE) THEN 'train' ELSE 'val' END AS split_final FROM ordered
  UNION ALL
  SELECT beat_id, source, split, label, label_name, split FROM rows WHERE split <> 'train')"""


def held_out(spark, sf_dir):
    return S.holdout_validation(keyed(spark, sf_dir))


@query("d02_holdout_validation", f"WITH {HOLDOUT} SELECT * FROM final")
def d02(spark, sf_dir):
    return held_out(spark, sf_dir)


@query(
    "d03_class_counts",
    f"""WITH {EVENT_ROWS} SELECT label, {big('count(*)')} AS n FROM rows GROUP BY label""",
)
def d03(spark, sf_dir):
    return B.class_counts(keyed(spark, sf_dir))


@query(
    "d03_class_counts_with_zeros",
    f"""WITH {EVENT_ROWS},
codes(label) AS (VALUES (0), (1), (2), (3), (4), (5), (6))
SELECT label, {big('count(beat_id)')} AS n FROM codes LEFT JOIN rows USING (label) GROUP BY label""",
)
def d03_zeros(spark, sf_dir):
    return B.class_counts(keyed(spark, sf_dir), labels=range(7))


@query(
    "d04_class_weights",
    f"""WITH g AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY ALL)
SELECT label, {big('n')} AS n,
       {r('CAST((SELECT sum(n) FROM g) AS DOUBLE) / ((SELECT count(*) FROM g) * n)')} AS weight FROM g""",
)
def d04(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"))
    return B.class_weights(rows).withColumn("weight", F.round("weight", 6))


@query(
    "d04_class_weights_with_absent",
    f"""WITH codes(label) AS (VALUES (0), (1), (2)),
g AS (SELECT label, count(doc_id) AS n FROM codes LEFT JOIN labels ON toxic = label GROUP BY label)
SELECT label, {big('n')} AS n,
       {r('CASE WHEN n > 0 THEN CAST((SELECT sum(n) FROM g) AS DOUBLE) / (3 * n) ELSE 0 END')} AS weight FROM g""",
)
def d04_absent(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"))
    return B.class_weights(rows, labels=range(3)).withColumn("weight", F.round("weight", 6))


@query(
    "d05_add_class_weight",
    f"""WITH {EVENT_ROWS},
g AS (SELECT label, count(*) AS n FROM rows GROUP BY label)
SELECT beat_id, label,
       {r('CAST((SELECT sum(n) FROM g) AS DOUBLE) / ((SELECT count(*) FROM g) * n)')} AS class_weight
FROM rows JOIN g USING (label)""",
)
def d05(spark, sf_dir):
    weighted = B.add_class_weight(keyed(spark, sf_dir)).select("beat_id", "label", "class_weight")
    return weighted.withColumn("class_weight", F.round("class_weight", 6))


def flags(spark, sf_dir):
    """Documents with a lopsided two-class label."""
    return table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("toxic").alias("label"))


_FLAGS = "flags AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, quality, toxic AS label FROM labels)"


@query(
    "d06_undersample",
    f"""WITH {_FLAGS}, {_ordered('flags', 42, 'k')}
SELECT doc_id, quality, label FROM ordered WHERE rn <= (SELECT min(n) FROM ordered)""",
)
def d06(spark, sf_dir):
    return B.resample(flags(spark, sf_dir), "undersample", key_cols=["doc_id"])


def _near_target(spark, sf_dir, strategy: str):
    """Per label, whether a Bernoulli sample's size is within five standard deviations of the target."""
    rows = flags(spark, sf_dir)
    sample = B.resample(rows, strategy, mode="bernoulli", key_cols=["doc_id"])
    before = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    after = sample.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    every = Window.partitionBy()  # a row per label
    target = F.min("n").over(every) if strategy == "undersample" else F.max("n").over(every)
    sizes = before.join(after, "label", "left").select("label", "n", F.coalesce("m", F.lit(0)).alias("m"), target.alias("target"))
    tries = F.col("n") * F.ceil(F.col("target") / F.col("n"))
    spread = F.sqrt(F.col("target") * (1 - F.col("target") / tries))
    return sizes.select("label", "n", (F.abs(F.col("m") - F.col("target")) <= 5 * spread).alias("near"))


_NEAR = f"WITH {_FLAGS} SELECT label, {big('count(*)')} AS n, true AS near FROM flags GROUP BY label"


@query("d06_undersample_bernoulli", _NEAR)
def d06_bernoulli(spark, sf_dir):
    return _near_target(spark, sf_dir, "undersample")


@query(
    "d07_oversample",
    f"""WITH {_FLAGS}, {_ordered('flags', 42, 'k')},
top AS (SELECT max(n) AS target FROM ordered)
SELECT doc_id, quality, label FROM (
  SELECT *, unnest(range(CAST(target // n + CASE WHEN rn <= target % n THEN 1 ELSE 0 END AS BIGINT)))
  FROM ordered CROSS JOIN top)""",
)
def d07(spark, sf_dir):
    return B.resample(flags(spark, sf_dir), "oversample", key_cols=["doc_id"])


@query("d07_oversample_bernoulli", _NEAR)
def d07_bernoulli(spark, sf_dir):
    return _near_target(spark, sf_dir, "oversample")


@query(
    "d08_split_summary",
    f"""WITH {HOLDOUT},
g AS (SELECT split_final, label, label_name, count(*) AS n FROM final GROUP BY ALL)
SELECT split_final, label, label_name, {big('n')} AS n_beats,
       {share('n', 'sum(n) OVER (PARTITION BY split_final)', 3)} AS pct FROM g""",
)
def d08(spark, sf_dir):
    return S.split_summary(held_out(spark, sf_dir))


@query(
    "d09_split_shares",
    f"""WITH {HOLDOUT},
g AS (SELECT split_final, label, label_name, count(*) AS n FROM final GROUP BY ALL),
s AS (SELECT *, {share('n', 'sum(n) OVER (PARTITION BY split_final)', 3)} AS pct FROM g)
SELECT label, label_name, max(CASE WHEN split_final = 'train' THEN pct END) AS train,
       max(CASE WHEN split_final = 'val' THEN pct END) AS val,
       max(CASE WHEN split_final = 'test' THEN pct END) AS test FROM s GROUP BY label, label_name""",
)
def d09(spark, sf_dir):
    return S.split_shares(held_out(spark, sf_dir), "split_final", ["train", "val", "test"])


@query(
    "d10_split_frames",
    f"""WITH {HOLDOUT} SELECT split_final AS name, beat_id, label FROM final""",
)
def d10(spark, sf_dir):
    frames = S.split_frames(held_out(spark, sf_dir))
    tagged = [
        frame.select(F.lit(name).alias("name"), "beat_id", "label") for name, frame in frames.items()
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "d11_stratified_subsample",
    f"""WITH {EVENT_ROWS}, {_ordered()}
SELECT beat_id, label FROM ordered
WHERE rn <= least(n, greatest(2, round_even(n * CAST(0.05 AS DOUBLE), 0)))""",
)
def d11(spark, sf_dir):
    return S.stratified_subsample(keyed(spark, sf_dir), 0.05).select("beat_id", "label")


_SPLIT_COUNTS = ", ".join(
    f'{big(f"sum(CASE WHEN label = {c} THEN 1 ELSE 0 END)")} AS "{n}"' for c, n in enumerate(NAMES)
)


@query(
    "d12_describe_splits",
    f"""WITH {HOLDOUT}
SELECT split_final AS split, {big('count(*)')} AS n_beats, CAST(31 AS INTEGER) AS samples, {_SPLIT_COUNTS}
FROM final GROUP BY split_final""",
)
def d12(spark, sf_dir):
    return S.describe_splits(S.holdout_validation(beats(spark, sf_dir)), NAMES)


@query(
    "d13_resample_comparison",
    f"""WITH {LINE_LONG},
rows AS (SELECT DISTINCT beat_id, label, label_name FROM long),
g AS (SELECT label, label_name, count(*) AS n FROM rows GROUP BY ALL)
SELECT label, label_name, {big('n')} AS original, {big('(SELECT min(n) FROM g)')} AS undersampled,
       {big('(SELECT max(n) FROM g)')} AS oversampled FROM g""",
)
def d13(spark, sf_dir):
    return B.resample_comparison(lines(spark, sf_dir).select(*LABEL_COLUMNS))


__all__ = ["EVENT_LONG", "HOLDOUT", "SPEC", "flags", "held_out", "keyed"]
