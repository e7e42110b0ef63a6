"""Imbalance-aware classification metrics, computed from prediction tables in Spark.

A prediction row has a true ``label``, a ``prediction`` and, for the ranking
metrics, an array of class ``probability``. All functions take ``by`` columns
(model, split, seed ...), so many evaluations are scored in one pass. Rows are
reduced to confusion counts or to distinct scores first; the rest is arithmetic
on a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.operators.ranking import ROWS_PER_BUCKET, first_in_hash_order, running_totals
from signalloom.runtime import attach, materialise, small_table

PRIMARY_METRIC = "macro_f1"

#: Class of labels and predictions that are NULL or not in the class list.
OUTSIDE = "outside"

# Metric names in report order.
SUMMARY_METRICS = [
    "macro_f1",
    "weighted_f1",
    "balanced_accuracy",
    "accuracy",
    "mcc",
    "cohen_kappa",
]


def narrow_predictions(
    predictions: DataFrame,
    label_col: str = "label",
    prediction_col: str = "prediction",
    probability_col: str | None = "probability",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Only what scoring needs: label and prediction as int, probability as array if there."""
    columns = [
        F.col(label_col).cast("int").alias("label"),
        F.col(prediction_col).cast("int").alias("prediction"),
    ]
    if probability_col is not None and probability_col in predictions.columns:
        p = F.col(probability_col)
        if not isinstance(predictions.schema[probability_col].dataType, T.ArrayType):
            p = vector_to_array(p)
        columns.append(p.alias("probability"))
    return predictions.select(*keep, *columns)


# --- confusion --------------------------------------------------------------


def confusion_counts(
    predictions: DataFrame, label_names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Dense confusion counts: one line per true and predicted class, zeros included.

    A label or prediction that is NULL or not in the class list is ``OUTSIDE``: its rows
    get lines of their own, with a NULL code, where there are any. So the counts always
    add up to all rows.
    """
    by, k = list(by), len(label_names)

    def code(name: str) -> Column:
        # The rest shares code k. A filter on the prediction would be moved below the
        # model and have it predict twice.
        return F.when(F.col(name).between(0, k - 1), F.col(name).cast("int")).otherwise(F.lit(k))

    cell = code("label") * (k + 1) + code("prediction")
    counts = predictions.groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # The collected map has at most (k + 1) * (k + 1) entries.
    found = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("__n")
    )
    names = F.array(*[F.lit(name) for name in label_names])
    true, pred = F.floor(F.col("cell") / (k + 1)).cast("int"), F.pmod("cell", F.lit(k + 1))
    cells = found.select(
        *by, "__n", F.explode(F.sequence(F.lit(0), F.lit((k + 1) * (k + 1) - 1))).alias("cell")
    )
    lines = cells.select(
        *by,
        F.when(true < k, true).alias("label"),
        F.coalesce(F.get(names, true), F.lit(OUTSIDE)).alias("true"),
        F.when(pred < k, pred).alias("prediction"),
        F.coalesce(F.get(names, pred), F.lit(OUTSIDE)).alias("predicted"),
        F.coalesce(F.try_element_at("__n", F.col("cell")), F.lit(0)).alias("n"),
    )
    inside = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    return lines.where(inside | (F.col("n") > 0))


def confusion_matrix(
    confusion: DataFrame, normalize: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``value``: the count, or its share of the true row or predicted column."""
    axes = {None: None, "true": "label", "pred": "prediction"}
    if normalize not in axes:
        raise ValueError(f"unknown normalize {normalize!r}, use None, 'true' or 'pred'")
    axis = axes[normalize]
    if axis is None:
        return confusion.withColumn("value", F.col("n").cast("double"))
    total = F.sum("n").over(Window.partitionBy(*by, axis))
    share = F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0))
    return confusion.withColumn("value", share)


def wide_confusion(
    confusion: DataFrame, label_names: Sequence[str], by: Sequence[str] = (), value: str = "n"
) -> DataFrame:
    """One line per true class and one column per predicted class."""
    return (
        confusion.groupBy(*by, "label", "true")
        .pivot("predicted", list(label_names))
        .agg(F.first(value))
        .orderBy(*by, "label")
        .drop("label")
    )


def _class_lines(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Per class: correct rows, rows of the class, rows predicted as the class."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")

    def entry(code: str, name: str, tp: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(code).alias("code"),
            F.col(name).alias("class"),
            tp.alias("tp"),
            support.alias("support"),
            predicted.alias("predicted_n"),
        )

    both = F.array(
        entry("label", "true", hit, F.col("n"), none),
        entry("prediction", "predicted", none, none, F.col("n")),
    )
    lines = (
        confusion.select(*by, F.inline(both))
        .groupBy(*by, "code", "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted_n")])
    )

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted_n")
    return lines.withColumns(
        {
            "precision": ratio(tp, predicted),
            "recall": ratio(tp, support),
            "f1": ratio(2 * tp, support + predicted),
        }
    )


def per_class_report(
    confusion: DataFrame, by: Sequence[str] = (), decimals: int | None = 4
) -> DataFrame:
    """Precision, recall, F1 and support per class, then the macro and weighted averages.

    The averages run over every class of the list, seen or not. Rows outside the list count
    against the recall of their class, or the precision of the one predicted; they have no
    line of their own.
    """
    by = list(by)
    scores = ["precision", "recall", "f1"]
    lines = _class_lines(confusion, by).where(F.col("code").isNotNull())
    total = F.sum("support")

    def average(name: str, order: int, fn) -> Column:
        return F.struct(
            F.lit(order).alias("code"),
            F.lit(name).alias("class"),
            *[fn(c).alias(c) for c in scores],
            total.alias("support"),
        )

    def weighted(c: str) -> Column:
        return F.when(total > 0, F.sum(F.col(c) * F.col("support")) / total).otherwise(F.lit(0.0))

    big = 1_000_000  # sorts after every class code
    report = lines.groupBy(*by).agg(
        F.concat(
            F.collect_list(F.struct("code", "class", *scores, "support")),  # one per class
            F.array(average("macro avg", big, F.avg), average("weighted avg", big + 1, weighted)),
        ).alias("__lines")
    )
    out = report.select(*by, F.inline("__lines")).orderBy(*by, "code").drop("code")
    if decimals is None:
        return out
    return out.withColumns({c: F.round(c, decimals) for c in scores})


def summary_metrics(
    confusion: DataFrame, by: Sequence[str] = (), decimals: int | None = 4
) -> DataFrame:
    """Headline metrics from confusion counts, one line per ``by`` group.

    ``macro_f1`` averages classes seen in truth or prediction, ``balanced_accuracy``
    those seen in truth. Kappa is NULL when chance agreement is already perfect. Rows
    outside the class list count in ``n`` and are never right; for kappa and ``mcc`` they
    are one more class.
    """
    by = list(by)
    lines = _class_lines(confusion, by)
    all_rows = F.sum("support")
    listed = F.col("code").isNotNull()
    seen = listed & (F.col("support") + F.col("predicted_n") > 0)
    sums = lines.groupBy(*by).agg(
        all_rows.alias("n"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        (
            F.sum(F.when(listed, F.col("f1") * F.col("support"))) / F.nullif(all_rows, F.lit(0))
        ).alias("weighted_f1"),
        F.avg(F.when(listed & (F.col("support") > 0), F.col("recall"))).alias("balanced_accuracy"),
        F.sum("tp").alias("__hits"),
        F.collect_list(F.struct("support", "predicted_n")).alias("__classes"),  # one per class
    )
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")

    def dot(left: str, right: str) -> Column:
        # Shares instead of counts: products of counts would leave the long range.
        return F.aggregate(
            "__classes", F.lit(0.0), lambda acc, c: acc + (c[left] / n) * (c[right] / n)
        )

    scored = sums.withColumns(
        {
            "accuracy": F.col("__hits") / n,
            "__chance": dot("support", "predicted_n"),
            "__rest_true": 1.0 - dot("support", "support"),
            "__rest_pred": 1.0 - dot("predicted_n", "predicted_n"),
        }
    )
    above_chance = F.col("accuracy") - F.col("__chance")
    spread = F.sqrt(
        F.greatest(F.col("__rest_true"), F.lit(0.0)) * F.greatest(F.col("__rest_pred"), F.lit(0.0))
    )
    scored = scored.withColumns(
        {
            "mcc": F.when(spread > 1e-12, above_chance / spread).otherwise(F.lit(0.0)),
            "cohen_kappa": F.when(
                F.col("__chance") < 1.0 - 1e-12, above_chance / (1.0 - F.col("__chance"))
            ),
        }
    )
    metrics = [
        F.col(m) if decimals is None else F.round(m, decimals).alias(m) for m in SUMMARY_METRICS
    ]
    return scored.select(*by, "n", *metrics)


# --- ranking metrics --------------------------------------------------------


def _curve_sums(scores: DataFrame, by: list[str], rows_per_bucket: int) -> DataFrame:
    """ROC AUC and average precision per group of (score, positive) rows.

    ROC AUC is the share of (positive, negative) pairs ranked right, equal
    scores counting one half. Average precision sums, from the highest score
    down, the recall gained at a score times the precision reached there.
    """
    distinct = scores.groupBy(*by, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    steps = running_totals(distinct, by, "score", ["pos", "neg"], rows_per_bucket)
    pos, neg = F.col("pos"), F.col("neg")
    all_pos = F.nullif(F.col("pos_total"), F.lit(0)).cast("double")
    all_neg = F.nullif(F.col("neg_total"), F.lit(0)).cast("double")
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    right_pairs = (pos / all_pos) * ((F.col("neg_below") + neg / 2.0) / all_neg)
    gained = (pos / all_pos) * (tp / F.nullif(tp + fp, F.lit(0)))
    return steps.groupBy(*by).agg(
        F.sum(right_pairs).alias("roc_auc"), F.sum(gained).alias("pr_auc")
    )


def binary_curves(
    predictions: DataFrame,
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` (average precision) of class 1; NULL if a class is missing.

    Any label but 1, NULL included, is a negative row.
    """
    scores = predictions.select(
        *by,
        F.get("probability", F.lit(1)).alias("score"),
        F.coalesce(F.col("label") == 1, F.lit(False)).alias("positive"),
    )
    return _curve_sums(scores, list(by), rows_per_bucket)


def one_vs_rest_auc(
    predictions: DataFrame,
    n_classes: int,
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``roc_auc_ovr_macro``: mean over classes of one-against-the-rest ROC AUC.

    NULL when any class is missing from the truth, or has no probability.
    """
    by = list(by)
    # Exploding an expression, not the column: for a column the optimizer adds a
    # size filter, moves it below the model and has it predict twice.
    per_code = F.transform(
        "probability", lambda p, i: F.struct(i.alias("code"), p.alias("score"))
    )
    scores = predictions.select(*by, "label", F.inline(per_code)).select(
        *by,
        "code",
        "score",
        F.coalesce(F.col("label") == F.col("code"), F.lit(False)).alias("positive"),
    )
    per_class = _curve_sums(scores, [*by, "code"], rows_per_bucket)
    defined = (F.count("roc_auc") == n_classes) & (F.count(F.lit(1)) == n_classes)
    return per_class.groupBy(*by).agg(F.when(defined, F.avg("roc_auc")).alias("roc_auc_ovr_macro"))


# --- bundles ----------------------------------------------------------------


def evaluate(
    predictions: DataFrame,
    label_names: Sequence[str],
    model_name: str = "model",
    split: str = "test",
    decimals: int | None = 4,
) -> dict[str, DataFrame]:
    """Summary, per-class report and confusion (counts and row shares) of one model.

    Every table shares one set of confusion counts. Ranking metrics need a second
    look at the predictions, so these are stored first and the model runs once.
    """
    k = len(label_names)
    if "probability" in predictions.columns:
        narrow = predictions.select("label", "prediction", "probability")
        predictions = materialise(narrow, "predictions")
    confusion, _ = small_table(confusion_counts(predictions, label_names), (k + 1) ** 2)
    summary = summary_metrics(confusion, decimals=decimals)
    if "probability" in predictions.columns:
        curves = (
            binary_curves(predictions) if k == 2 else one_vs_rest_auc(predictions, k)
        ).first().asDict()
        for name, value in curves.items():
            column = F.lit(value).cast("double")
            summary = summary.withColumn(
                name, column if decimals is None else F.round(column, decimals)
            )
    summary = summary.select(
        F.lit(model_name).alias("model"), F.lit(split).alias("split"), *summary.columns
    )
    return {
        "summary": summary,
        "per_class": per_class_report(confusion, decimals=decimals),
        "confusion": confusion,
        "confusion_normalised": confusion_matrix(confusion, "true"),
    }


def majority_predictions(truth: DataFrame) -> DataFrame:
    """Predict the most frequent label for every row; the smallest label on a tie.

    Rows without a label have no vote, but get the prediction too.
    """
    counts = truth.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "label").first()
    code = None if top is None else top["label"]
    return truth.withColumn("prediction", F.lit(code).cast("int"))


def majority_class_baseline(truth: DataFrame, label_names: Sequence[str]) -> dict[str, DataFrame]:
    """Scores of the model that always answers with the majority class."""
    predictions = majority_predictions(truth.select("label"))
    return evaluate(predictions, label_names, model_name="majority-class", split="test")


def comparison_table(
    summaries: Iterable[DataFrame], by: Sequence[str] = (), metric: str = PRIMARY_METRIC
) -> DataFrame:
    """Stack summary tables, best first; a metric a model lacks is NULL."""
    table = None
    for summary in summaries:
        table = summary if table is None else table.unionByName(summary, allowMissingColumns=True)
    if table is None:
        raise ValueError("no summaries to compare")
    tie = ["model"] if "model" in table.columns else []
    return table.orderBy(*by, F.col(metric).desc_nulls_last(), *tie)


# --- reading the errors -----------------------------------------------------


def top_confusions(confusion: DataFrame, top: int = 6) -> DataFrame:
    """The most frequent kinds of error."""
    return (
        confusion.where((F.col("label") != F.col("prediction")) & (F.col("n") > 0))
        .select("label", "prediction", "true", "predicted", F.col("n").alias("n_beats"))
        .orderBy(F.col("n_beats").desc(), "label", "prediction")
        .limit(top)
    )


def error_examples(
    predictions: DataFrame,
    label_names: Sequence[str],
    n_examples: int = 4,
    top: int = 4,
    seed: int = 42,
    key_cols: Sequence[str] = ("beat_id",),
) -> DataFrame:
    """A few repeatable example rows for each of the most frequent kinds of error."""
    kinds = top_confusions(confusion_counts(predictions, label_names), top)
    errors = attach(
        predictions.withColumns(
            {"label": F.col("label").cast("int"), "prediction": F.col("prediction").cast("int")}
        ),
        kinds,
        ["label", "prediction"],
        how="inner",
    )
    # Keys are chosen without the other columns, from a stored list: the predictions may cost a model's run.
    keys = list(key_cols)
    found = materialise(errors.select("label", "prediction", *keys), "errors")
    chosen = first_in_hash_order(found, ["label", "prediction"], keys, seed, n_examples)
    return attach(errors, chosen, ["label", "prediction", *keys], how="inner")


def recall_delta(
    reports: DataFrame,
    variant_col: str,
    first: str,
    second: str,
    metric: str = "recall",
    decimals: int = 4,
) -> DataFrame:
    """Per class, the metric of two variants side by side and ``first - second``."""
    lines = reports.where(~F.col("class").isin("macro avg", "weighted avg"))
    wide = lines.groupBy("class").pivot(variant_col, [first, second]).agg(F.first(metric))
    return wide.withColumn("delta", F.round(F.col(first) - F.col(second), decimals)).orderBy("class")
