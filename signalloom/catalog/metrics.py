"""Section F: evaluation metrics on deterministic predictions for every event."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalloom.catalog.base import (
    CLASSES,
    NAMES,
    big,
    confusion_sql,
    predictions_sql,
    query,
    r,
    rounded,
    table,
)
from signalloom.operators import metrics as M
from signalloom.sources import views

K = len(NAMES)
PRED = predictions_sql()
PRED2 = predictions_sql(n_classes=2)
SCORED = f"{PRED},\n{CLASSES},\n{confusion_sql()}"
SUMMARY_COLUMNS = ", ".join(["n", *M.SUMMARY_METRICS])


def predictions(spark, sf_dir, **options):
    return views.pseudo_predictions(table(spark, sf_dir, "events"), salt="p", **options)


def two_class(spark, sf_dir):
    return predictions(spark, sf_dir, n_classes=2)


def confusion(spark, sf_dir):
    return M.confusion_counts(predictions(spark, sf_dir), NAMES)


@query(
    "f01_narrow_predictions",
    f"WITH {PRED} SELECT beat_id, label, prediction, "
    + ", ".join(f"{r(f'p{c}')} AS p{c}" for c in range(K))
    + " FROM pred",
)
def f01(spark, sf_dir):
    model_output = predictions(spark, sf_dir).withColumn(
        "probability", array_to_vector("probability")
    )
    narrow = M.narrow_predictions(model_output, keep=["beat_id"])
    parts = [F.round(F.get("probability", F.lit(c)), 6).alias(f"p{c}") for c in range(K)]
    return narrow.select("beat_id", "label", "prediction", *parts)


@query("f02_confusion_counts", f"WITH {SCORED} SELECT * FROM cm")
def f02(spark, sf_dir):
    return confusion(spark, sf_dir)


@query(
    "f02_wide_confusion",
    f"""WITH {SCORED} SELECT "true", """
    + ", ".join(
        f"""{big(f"sum(CASE WHEN predicted = '{n}' THEN n ELSE 0 END)")} AS "{n}" """ for n in NAMES
    )
    + """ FROM cm GROUP BY "true" """,
)
def f02_wide(spark, sf_dir):
    return M.wide_confusion(confusion(spark, sf_dir), NAMES)


FEWER = NAMES[:-1]
_CODES = range(len(FEWER))
# The last class is not in the list: rows with its label or its prediction are outside.
_FEW = f"""{PRED},
coded AS (SELECT CASE WHEN label < {len(FEWER)} THEN label END AS label,
                 CASE WHEN prediction < {len(FEWER)} THEN prediction END AS prediction FROM pred),
per_code AS (SELECT c AS code,
    count(*) FILTER (label = c AND prediction = c) AS tp,
    count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted_n
  FROM coded, (VALUES {", ".join(f"({c})" for c in _CODES)}) codes(c) GROUP BY c),
f AS (SELECT *, CAST(tp AS DOUBLE) / nullif(support, 0) AS recall,
    CAST(2 * tp AS DOUBLE) / nullif(support + predicted_n, 0) AS f1 FROM per_code),
rest AS (SELECT count(*) AS n, count(*) FILTER (label IS NULL) AS t, count(*) FILTER (prediction IS NULL) AS p FROM coded),
shares AS (SELECT n, (SELECT sum(tp) FROM f) / CAST(n AS DOUBLE) AS accuracy,
    ((SELECT sum(support * predicted_n) FROM f) + t * p) / (CAST(n AS DOUBLE) * n) AS chance,
    ((SELECT sum(support * support) FROM f) + t * t) / (CAST(n AS DOUBLE) * n) AS tt,
    ((SELECT sum(predicted_n * predicted_n) FROM f) + p * p) / (CAST(n AS DOUBLE) * n) AS pp FROM rest)"""
_FEW_SUMMARY = f"""SELECT {big('n')} AS n, {r('(SELECT avg(f1) FROM f)', 4)} AS macro_f1,
  {r('(SELECT sum(f1 * support) FROM f) / n', 4)} AS weighted_f1,
  {r('(SELECT avg(recall) FROM f)', 4)} AS balanced_accuracy, {r('accuracy', 4)} AS accuracy,
  {r('(accuracy - chance) / sqrt((1 - tt) * (1 - pp))', 4)} AS mcc, {r('(accuracy - chance) / (1 - chance)', 4)} AS cohen_kappa"""


def _few_confusion(spark, sf_dir):
    return M.confusion_counts(predictions(spark, sf_dir), FEWER)


@query(
    "f02_confusion_outside",
    f"""WITH {_FEW},
names(code, name) AS (VALUES {", ".join(f"({c}, '{n}')" for c, n in enumerate(FEWER))}, (NULL, '{M.OUTSIDE}')),
cells AS (SELECT t.code AS label, t.name AS "true", p.code AS prediction, p.name AS predicted FROM names t, names p)
SELECT CAST(c.label AS INTEGER) AS label, "true", CAST(c.prediction AS INTEGER) AS prediction, predicted, {big('count(x.one)')} AS n
FROM cells c LEFT JOIN (SELECT *, 1 AS one FROM coded) x
  ON x.label IS NOT DISTINCT FROM c.label AND x.prediction IS NOT DISTINCT FROM c.prediction
GROUP BY ALL HAVING count(x.one) > 0 OR (c.label IS NOT NULL AND c.prediction IS NOT NULL)""",
)
def f02_outside(spark, sf_dir):
    return _few_confusion(spark, sf_dir)


@query("f05_summary_outside", f"WITH {_FEW} {_FEW_SUMMARY} FROM shares")
def f05_outside(spark, sf_dir):
    return M.summary_metrics(_few_confusion(spark, sf_dir))


def _normalised(axis: str) -> str:
    total = f"sum(n) OVER (PARTITION BY {axis})"
    share = f"CASE WHEN {total} > 0 THEN CAST(n AS DOUBLE) / {total} ELSE 0 END"
    return f"WITH {SCORED} SELECT *, {r(share)} AS value FROM cm"


@query("f03_confusion_by_true", _normalised("label"))
def f03_true(spark, sf_dir):
    return rounded(M.confusion_matrix(confusion(spark, sf_dir), "true"), "value")


@query("f03_confusion_by_predicted", _normalised("prediction"))
def f03_pred(spark, sf_dir):
    return rounded(M.confusion_matrix(confusion(spark, sf_dir), "pred"), "value")


PER_CLASS_LINES = f"""
SELECT class, {r('precision', 4)} AS precision, {r('recall', 4)} AS recall, {r('f1', 4)} AS f1,
       {big('support')} AS support FROM per_class
UNION ALL
SELECT 'macro avg', {r('avg(precision)', 4)}, {r('avg(recall)', 4)}, {r('avg(f1)', 4)}, {big('sum(support)')}
FROM per_class
UNION ALL
SELECT 'weighted avg', {r('sum(precision * support) / sum(support)', 4)},
       {r('sum(recall * support) / sum(support)', 4)}, {r('sum(f1 * support) / sum(support)', 4)},
       {big('sum(support)')} FROM per_class"""


@query("f04_per_class_report", f"WITH {SCORED} {PER_CLASS_LINES}")
def f04(spark, sf_dir):
    return M.per_class_report(confusion(spark, sf_dir))


@query("f05_summary_metrics", f"WITH {SCORED} SELECT {SUMMARY_COLUMNS} FROM summary")
def f05(spark, sf_dir):
    return M.summary_metrics(confusion(spark, sf_dir))


_TIED_RANKS = "rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / CAST(2 AS DOUBLE)"
_AUC = """(sum(CASE WHEN pos THEN rk ELSE 0 END)
  - CAST(count(*) FILTER (pos) AS DOUBLE) * (count(*) FILTER (pos) + 1) / 2)
  / (CAST(count(*) FILTER (pos) AS DOUBLE) * count(*) FILTER (NOT pos))"""


@query(
    "f06_roc_auc",
    f"""WITH {PRED2},
ranked AS (SELECT label = 1 AS pos, {_TIED_RANKS.format(s='p1')} AS rk FROM pred)
SELECT {r(_AUC)} AS roc_auc FROM ranked""",
)
def f06(spark, sf_dir):
    return rounded(M.binary_curves(two_class(spark, sf_dir)).select("roc_auc"), "roc_auc")


@query(
    "f07_average_precision",
    f"""WITH {PRED2},
steps AS (SELECT p1, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM pred GROUP BY p1),
down AS (SELECT pos, sum(pos) OVER (ORDER BY p1 DESC) AS tp, sum(n) OVER (ORDER BY p1 DESC) AS seen FROM steps)
SELECT {r('sum(CAST(pos AS DOUBLE) / (SELECT sum(pos) FROM steps) * tp / seen)')} AS pr_auc FROM down""",
)
def f07(spark, sf_dir):
    return rounded(M.binary_curves(two_class(spark, sf_dir)).select("pr_auc"), "pr_auc")


_ONE_VS_REST = " UNION ALL ".join(
    f"SELECT {c} AS code, label = {c} AS pos, {_TIED_RANKS.format(s=f'p{c}')} AS rk FROM pred"
    for c in range(K)
)


@query(
    "f08_one_vs_rest_auc",
    f"""WITH {PRED},
ranked AS ({_ONE_VS_REST}),
auc AS (SELECT code, {_AUC} AS a FROM ranked GROUP BY code)
SELECT {r('avg(a)')} AS roc_auc_ovr_macro FROM auc""",
)
def f08(spark, sf_dir):
    return rounded(M.one_vs_rest_auc(predictions(spark, sf_dir), K), "roc_auc_ovr_macro")


@query(
    "f09_majority_class_baseline",
    f"""WITH counts AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM ({'SELECT ' + 'label FROM pred0'}) GROUP BY label),
pred AS (SELECT label, (SELECT label FROM counts ORDER BY n DESC, label LIMIT 1) AS prediction FROM pred0),
{CLASSES},
{confusion_sql()}
SELECT 'majority-class' AS model, 'test' AS split, {SUMMARY_COLUMNS} FROM summary""".replace(
        "WITH counts", f"WITH {predictions_sql(name='pred0')},\ncounts"
    ),
)
def f09(spark, sf_dir):
    truth = predictions(spark, sf_dir).select("label")
    return M.majority_class_baseline(truth, NAMES)["summary"]


@query(
    "f10_evaluate",
    f"""WITH {SCORED},
ranked AS ({_ONE_VS_REST}),
auc AS (SELECT code, {_AUC} AS a FROM ranked GROUP BY code)
SELECT 'hash' AS model, 'test' AS split, {SUMMARY_COLUMNS},
       (SELECT {r('avg(a)', 4)} FROM auc) AS roc_auc_ovr_macro FROM summary""",
)
def f10(spark, sf_dir):
    narrow = M.narrow_predictions(predictions(spark, sf_dir))
    return M.evaluate(narrow, NAMES, "hash", "test")["summary"]


_FEW_VS_REST = " UNION ALL ".join(
    f"SELECT {c} AS code, label = {c} AS pos, {_TIED_RANKS.format(s=f'p{c}')} AS rk FROM pred" for c in _CODES
)


@query(
    "f10_evaluate_outside",
    f"""WITH {_FEW},
ranked AS ({_FEW_VS_REST}),
auc AS (SELECT code, {_AUC} AS a FROM ranked GROUP BY code)
{_FEW_SUMMARY}, 'hash' AS model, 'test' AS split,
       (SELECT {r('avg(a)', 4)} FROM auc) AS roc_auc_ovr_macro FROM shares""",
)
def f10_outside(spark, sf_dir):
    narrow = M.narrow_predictions(predictions(spark, sf_dir))
    listed = narrow.withColumn("probability", F.slice("probability", 1, len(FEWER)))
    return M.evaluate(listed, FEWER, "hash", "test")["summary"]


def _variants(spark, sf_dir, names_and_pulls, keep=()):
    """The same events predicted by several pseudo models, told apart by ``model``."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("model"), F.lit(p).alias("strength")) for n, p in names_and_pulls]
    )
    events = table(spark, sf_dir, "events").select("*", F.inline(pairs))
    return views.pseudo_predictions(
        events, salt=F.col("model"), pull=F.col("strength"), keep=["model", *keep]
    )


MODELS = [("weak", 12), ("medium", 25), ("strong", 45)]
_MODEL_ROWS = "models(model, strength) AS (VALUES ('weak', 12), ('medium', 25), ('strong', 45)),\nvariants AS (SELECT * FROM events CROSS JOIN models)"
_MODEL_PRED = _MODEL_ROWS + ",\n" + predictions_sql(
    "variants", "model", "strength", keep="model, user_id"
)


@query(
    "f11_comparison_table",
    f"""WITH {_MODEL_PRED},
{CLASSES},
{confusion_sql('model')}
SELECT model, {SUMMARY_COLUMNS} FROM summary""",
)
def f11(spark, sf_dir):
    scored = M.summary_metrics(
        M.confusion_counts(_variants(spark, sf_dir, MODELS), NAMES, ["model"]), ["model"]
    )
    return M.comparison_table([scored])


@query(
    "f12_top_confusions",
    f"""WITH {SCORED}
SELECT label, prediction, "true", predicted, n AS n_beats FROM cm WHERE label <> prediction AND n > 0
ORDER BY n DESC, label, prediction LIMIT 6""",
)
def f12(spark, sf_dir):
    return M.top_confusions(confusion(spark, sf_dir), 6)


@query(
    "f13_error_examples",
    f"""WITH {SCORED},
kinds AS (SELECT label, prediction, "true", predicted, n AS n_beats FROM cm
  WHERE label <> prediction AND n > 0 ORDER BY n DESC, label, prediction LIMIT 4),
ranked AS (SELECT p.beat_id, k.*, CAST(row_number() OVER (PARTITION BY k.label, k.prediction
    ORDER BY md5('42:' || beat_id), beat_id) AS INTEGER) AS rank
  FROM pred p JOIN kinds k ON p.label = k.label AND p.prediction = k.prediction)
SELECT * FROM ranked WHERE rank <= 4""",
)
def f13(spark, sf_dir):
    rows = predictions(spark, sf_dir).drop("probability")
    return M.error_examples(rows, NAMES, n_examples=4, top=4)


@query(
    "f14_recall_delta",
    f"""WITH {_MODEL_PRED},
{CLASSES},
{confusion_sql('model')},
wide AS (SELECT class, max(CASE WHEN model = 'strong' THEN round(recall, 4) END) AS strong,
           max(CASE WHEN model = 'weak' THEN round(recall, 4) END) AS weak FROM per_class GROUP BY class)
SELECT class, {r('strong', 4)} AS strong, {r('weak', 4)} AS weak, {r('strong - weak', 4)} AS delta FROM wide""",
)
def f14(spark, sf_dir):
    cm = M.confusion_counts(_variants(spark, sf_dir, MODELS), NAMES, ["model"])
    return M.recall_delta(M.per_class_report(cm, ["model"]), "model", "strong", "weak")


@query(
    "f15_overall_table",
    f"""WITH {_MODEL_PRED.replace('pred AS', 'pred_all AS')},
pred AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS collection FROM pred_all),
{CLASSES},
{confusion_sql('collection, model')}
SELECT collection, model, {SUMMARY_COLUMNS} FROM summary""",
)
def f15(spark, sf_dir):
    rows = _variants(spark, sf_dir, MODELS, keep=["user_id"]).withColumn(
        "collection", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    )
    by = ["collection", "model"]
    scored = M.summary_metrics(M.confusion_counts(rows, NAMES, by), by)
    return M.comparison_table([scored], by=["collection"])
