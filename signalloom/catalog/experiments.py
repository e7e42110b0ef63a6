"""Section G: experiment tables, on pseudo models and histories made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.catalog.base import (
    CLASSES,
    EVENT_ROWS,
    NAMES,
    big,
    confusion_sql,
    predictions_sql,
    query,
    r,
    table,
)
from signalloom.catalog.splits import keyed
from signalloom.operators import experiments as X
from signalloom.operators import metrics as M
from signalloom.operators.balance import class_counts
from signalloom.sources import views

# How much each pseudo arm knows, per training share.
STRENGTHS = {"scratch": 20, "frozen": 14, "finetune": 28}
FRACTIONS = {0.1: -8, 0.5: -3, 1.0: 0}
SEEDS = [42, 7, 2024]


def _runs(spark, sf_dir, lines, by):
    """Scores of many pseudo runs in one pass; ``lines`` hold the run columns and a strength."""
    runs = F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in line.items()])
            for line in lines
        ]
    )
    events = table(spark, sf_dir, "events").select("*", F.inline(runs))
    salt = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    rows = views.pseudo_predictions(events, salt=salt, pull=F.col("strength"), keep=by)
    return M.summary_metrics(M.confusion_counts(rows, NAMES, by), by)


def _runs_sql(lines: list[dict], by: list[str]) -> str:
    columns = list(lines[0])
    values = ", ".join(
        "(" + ", ".join(repr(line[c]) if isinstance(line[c], str) else str(line[c]) for c in columns) + ")"
        for line in lines
    )
    salt = "concat_ws('/', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in by) + ")"
    keys = ", ".join(by)
    return f"""runs({', '.join(columns)}) AS (VALUES {values}),
variants AS (SELECT * FROM events CROSS JOIN runs),
{predictions_sql('variants', salt, 'strength', keep=keys)},
{CLASSES},
{confusion_sql(keys)}"""


ARM_LINES = [{"arm": a, "strength": s} for a, s in STRENGTHS.items()]
ARM_SQL = _runs_sql(ARM_LINES, ["arm"])


@query(
    "g06_transfer_gain",
    f"""WITH {ARM_SQL},
ref AS (SELECT macro_f1 AS base FROM summary WHERE arm = 'scratch')
SELECT arm, 'macro_f1' AS metric, macro_f1 AS value, {r('macro_f1 - base', 4)} AS delta_vs_scratch,
       {r('CASE WHEN 1 - base > 1e-9 THEN (macro_f1 - base) / (1 - base) END', 4)} AS relative_error_reduction
FROM summary CROSS JOIN ref""",
)
def g06(spark, sf_dir):
    return X.transfer_gain(_runs(spark, sf_dir, ARM_LINES, ["arm"]))


CURVE_LINES = [
    {"fraction": str(f), "arm": a, "strength": s + shift}
    for f, shift in FRACTIONS.items()
    for a, s in STRENGTHS.items()
]


@query(
    "g08_curve_deltas",
    f"""WITH {EVENT_ROWS},
sizes AS (SELECT label, count(*) AS n FROM rows WHERE split = 'train' GROUP BY label),
shares(fraction) AS (VALUES ('0.1'), ('0.5'), ('1.0')),
kept AS (SELECT fraction, {big('sum(least(n, greatest(2, round_even(n * CAST(fraction AS DOUBLE), 0))))')} AS n_train
  FROM shares CROSS JOIN sizes GROUP BY fraction),
{_runs_sql(CURVE_LINES, ['fraction', 'arm'])},
wide AS (SELECT n_train, max(CASE WHEN arm = 'scratch' THEN macro_f1 END) AS scratch,
    max(CASE WHEN arm = 'frozen' THEN macro_f1 END) AS frozen,
    max(CASE WHEN arm = 'finetune' THEN macro_f1 END) AS finetune
  FROM summary JOIN kept USING (fraction) GROUP BY n_train)
SELECT *, {r('frozen - scratch', 4)} AS "frozen - scratch", {r('finetune - scratch', 4)} AS "finetune - scratch"
FROM wide""",
)
def g08(spark, sf_dir):
    scores = _runs(spark, sf_dir, CURVE_LINES, ["fraction", "arm"])
    train = keyed(spark, sf_dir).where(F.col("split") == "train")
    shares = F.explode(F.array(*[F.lit(str(f)) for f in FRACTIONS])).alias("fraction")
    wanted = F.bround(F.col("n") * F.col("fraction").cast("double"), 0)
    kept = (
        class_counts(train)
        .select("n", shares)
        .groupBy("fraction")
        .agg(F.sum(F.least("n", F.greatest(F.lit(2), wanted))).cast("long").alias("n_train"))
    )
    return X.curve_deltas(scores.join(kept, "fraction"))


SEED_LINES = [
    {"seed": seed, "arm": a, "strength": s} for seed in SEEDS for a, s in STRENGTHS.items()
]
SEED_SQL = _runs_sql(SEED_LINES, ["seed", "arm"])


@query(
    "g10_seed_summary",
    f"""WITH {SEED_SQL},
stats AS (SELECT arm, {r('avg(macro_f1)', 4)} AS mean, {r('stddev_samp(macro_f1)', 4)} AS std,
    {r('min(macro_f1)', 4)} AS min, {r('max(macro_f1)', 4)} AS max, {big('count(*)')} AS n_seeds
  FROM summary GROUP BY arm),
ref AS (SELECT mean AS base FROM stats WHERE arm = 'scratch')
SELECT stats.*, {r('mean - base', 4)} AS delta_vs_scratch, 'macro_f1' AS metric FROM stats CROSS JOIN ref""",
)
def g10(spark, sf_dir):
    return X.seed_summary(_runs(spark, sf_dir, SEED_LINES, ["seed", "arm"]))


@query(
    "g11_seed_pivot",
    f"""WITH {SEED_SQL}
SELECT seed, max(CASE WHEN arm = 'scratch' THEN macro_f1 END) AS scratch,
       max(CASE WHEN arm = 'frozen' THEN macro_f1 END) AS frozen,
       max(CASE WHEN arm = 'finetune' THEN macro_f1 END) AS finetune FROM summary GROUP BY seed""",
)
def g11(spark, sf_dir):
    return X.seed_pivot(_runs(spark, sf_dir, SEED_LINES, ["seed", "arm"]))


# A history per arm: days stand for epochs, and quotients of whole-number totals of the day
# for what a training loop would have measured. They are equal to the last digit in any
# engine, so the queries do not round them.
HISTORY_SQL = """cents AS (SELECT CASE user_id % 3 WHEN 0 THEN 'scratch' WHEN 1 THEN 'frozen' ELSE 'finetune' END AS arm,
    CAST(dayofyear(ts) AS INTEGER) AS epoch, CAST(round(value * 100) AS BIGINT) AS c FROM events),
history AS (SELECT arm, epoch, CAST(sum(c) AS DOUBLE) / (count(*) * 10000) AS train_loss,
    CAST(max(c) AS DOUBLE) / 10000 AS val_loss, CAST(sum(c % 1000) AS DOUBLE) / (count(*) * 1000) AS val_macro_f1,
    CAST(count(*) AS DOUBLE) AS seconds FROM cents GROUP BY arm, epoch)"""


def history(spark, sf_dir):
    arm = F.when(F.col("user_id") % 3 == 0, "scratch").when(F.col("user_id") % 3 == 1, "frozen")
    n = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "events")
        .select(
            arm.otherwise("finetune").alias("arm"),
            F.dayofyear("ts").alias("epoch"),
            F.round(F.col("value") * 100).cast("long").alias("c"),
        )
        .groupBy("arm", "epoch")
        .agg(
            (F.sum("c") / (n * 10000)).alias("train_loss"),
            (F.max("c") / 10000).alias("val_loss"),
            (F.sum(F.col("c") % 1000) / (n * 1000)).alias("val_macro_f1"),
            n.cast("double").alias("seconds"),
        )
    )


@query(
    "g12_history_to_long",
    f"WITH {HISTORY_SQL} "
    + " UNION ALL ".join(
        f"SELECT epoch, arm, '{m}' AS metric, {m} AS value FROM history"
        for m in ("train_loss", "val_loss", "val_macro_f1", "seconds")
    ),
)
def g12(spark, sf_dir):
    return X.history_to_long(history(spark, sf_dir), ["arm"])


@query(
    "g13_checkpoint_rules",
    f"""WITH {HISTORY_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY val_loss, epoch) AS l,
        row_number() OVER (PARTITION BY arm ORDER BY val_macro_f1 DESC, epoch) AS m FROM history)
SELECT arm, 'lowest validation loss' AS selection_rule, epoch, val_loss, val_macro_f1 FROM o WHERE l = 1
UNION ALL
SELECT arm, 'highest validation macro-F1', epoch, val_loss, val_macro_f1 FROM o WHERE m = 1""",
)
def g13(spark, sf_dir):
    return X.checkpoint_rules(history(spark, sf_dir), by=["arm"])


@query(
    "g13_history_digest",
    f"""WITH {HISTORY_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY val_macro_f1 DESC, epoch) AS m,
        row_number() OVER (PARTITION BY arm ORDER BY epoch) AS e FROM history)
SELECT arm, {big('count(*)')} AS epochs, max(CASE WHEN m = 1 THEN epoch END) AS best_epoch,
       {r('max(val_macro_f1)', 4)} AS best_val_macro_f1,
       {r('max(CASE WHEN e = 1 THEN val_macro_f1 END)', 4)} AS first_val_macro_f1,
       {r('sum(seconds) / 60', 1)} AS minutes FROM o GROUP BY arm""",
)
def g13_digest(spark, sf_dir):
    return X.history_digest(history(spark, sf_dir))
