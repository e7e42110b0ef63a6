import pytest
from pyspark.sql import functions as F

from signal_rows import as_dicts, by_key
from signalloom.operators import metrics as M

FIVE = ["N", "S", "V", "F", "Q"]

# Published confusion counts and the scores that belong to them.
GOLDEN = [
    (
        FIVE,
        [[17823, 83, 31, 163, 18], [164, 391, 0, 0, 1], [110, 2, 1293, 35, 8], [26, 0, 7, 129, 0], [72, 0, 7, 0, 1529]],
        {"macro_f1": 0.8323, "weighted_f1": 0.9679, "balanced_accuracy": 0.8654, "accuracy": 0.9668, "mcc": 0.8903, "cohen_kappa": 0.8901},
        {"N": (0.9796, 0.9837, 0.9816, 18118), "F": (0.3945, 0.7963, 0.5276, 162),
         "macro avg": (0.8289, 0.8654, 0.8323, 21892), "weighted avg": (0.9706, 0.9668, 0.9679, 21892)},
    ),
    (
        ["normal", "abnormal"],
        [[549, 58], [322, 1254]],
        {"macro_f1": 0.8057, "weighted_f1": 0.8335, "balanced_accuracy": 0.8501, "accuracy": 0.8259, "mcc": 0.6406, "cohen_kappa": 0.6176},
        {"normal": (0.6303, 0.9044, 0.7429, 607), "abnormal": (0.9558, 0.7957, 0.8684, 1576)},
    ),
    (
        FIVE,
        [[11329, 2660, 1998, 1717, 414], [112, 381, 31, 23, 9], [78, 37, 1180, 124, 29], [2, 1, 10, 149, 0], [71, 22, 47, 7, 1461]],
        {"macro_f1": 0.4876, "weighted_f1": 0.7315, "balanced_accuracy": 0.7908, "accuracy": 0.6623, "mcc": 0.4536, "cohen_kappa": 0.3761},
        {"S": (0.1229, 0.6853, 0.2084, 556), "macro avg": (0.4598, 0.7908, 0.4876, 21892)},
    ),
]


def from_counts(spark, counts):
    cells = [(t, float(p), n) for t, row in enumerate(counts) for p, n in enumerate(row) if n]
    df = spark.createDataFrame(cells, "label int, prediction double, n int")
    return df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n"))).select("label", "prediction")


@pytest.mark.parametrize("names,counts,summary,report", GOLDEN)
def test_published_scores(spark, names, counts, summary, report):
    cm = M.confusion_counts(from_counts(spark, counts), names)
    (row,) = as_dicts(M.summary_metrics(cm))
    assert {k: row[k] for k in summary} == summary
    lines = by_key(M.per_class_report(cm), "class")
    for name, (p, r, f, n) in report.items():
        line = lines[name]
        assert (line["precision"], line["recall"], line["f1"], line["support"]) == (p, r, f, n)
    wide = by_key(M.wide_confusion(cm, names), "true")
    assert [[wide[t][p] for p in names] for t in names] == counts


def rows(spark, truth, guess):
    return spark.createDataFrame(list(zip(truth, map(float, guess))), "label int, prediction double")


def test_small_confusion(spark):
    cm = M.confusion_counts(rows(spark, [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 2, 2, 2, 0]), ["a", "b", "c"])
    cells = {(r["label"], r["prediction"]): r["n"] for r in cm.collect()}
    assert len(cells) == 9 and cells[0, 0] == 1 and cells[2, 2] == 2 and cells[1, 0] == 0
    for axis in ("true", "pred"):
        shares = M.confusion_matrix(cm, axis).groupBy(axis if axis == "true" else "predicted").agg(F.sum("value").alias("s"))
        assert all(r["s"] == pytest.approx(1) for r in shares.collect())
    with pytest.raises(ValueError):
        M.confusion_matrix(cm, "all")
    (top, *_) = as_dicts(M.top_confusions(cm, 2))
    assert (top["label"], top["prediction"], top["n_beats"]) == (0, 1, 1)


def test_accuracy_hides_rare_classes(spark):
    cm = M.confusion_counts(rows(spark, [0] * 98 + [1, 2], [0] * 100), ["a", "b", "c"])
    (row,) = as_dicts(M.summary_metrics(cm))
    assert row["accuracy"] == 0.98 and row["macro_f1"] < 0.34 and row["mcc"] == 0.0


def test_class_seen_only_in_predictions(spark):
    cm = M.confusion_counts(rows(spark, [0, 0, 0, 1], [0, 0, 2, 1]), ["a", "b", "c", "d"])
    (row,) = as_dicts(M.summary_metrics(cm))
    assert row["macro_f1"] == pytest.approx((0.8 + 1 + 0) / 3, abs=1e-4)
    assert row["balanced_accuracy"] == pytest.approx((2 / 3 + 1) / 2, abs=1e-4)
    macro = by_key(M.per_class_report(cm), "class")["macro avg"]
    assert macro["f1"] == pytest.approx((0.8 + 1 + 0 + 0) / 4, abs=1e-4)


def test_one_class_everywhere(spark):
    (row,) = as_dicts(M.summary_metrics(M.confusion_counts(rows(spark, [0, 0], [0, 0]), ["a", "b"])))
    assert row["cohen_kappa"] is None and row["accuracy"] == 1.0


def test_no_rows(spark):
    cm = M.confusion_counts(rows(spark, [], []), ["a", "b"])
    assert [r["n"] for r in cm.collect()] == [0, 0, 0, 0]
    (row,) = as_dicts(M.summary_metrics(cm))
    assert row["n"] == 0 and row["accuracy"] is None


def scored(spark, labels, scores):
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, s double")
    return df.select("label", F.array(1 - F.col("s"), F.col("s")).alias("probability"))


@pytest.mark.parametrize("limit", [10, 1])
@pytest.mark.parametrize(
    "labels,scores,roc,ap",
    [
        ([0, 0, 1, 1], [0.1, 0.2, 0.7, 0.8], 1.0, 1.0),
        ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75, 5 / 6),
        ([0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5], 0.5, 0.5),
        ([1, 1], [0.2, 0.3], None, 1.0),
    ],
)
def test_curves(spark, labels, scores, roc, ap, limit):
    (row,) = as_dicts(M.binary_curves(scored(spark, labels, scores), rows_per_bucket=limit))
    assert row["roc_auc"] == (None if roc is None else pytest.approx(roc))
    assert row["pr_auc"] == pytest.approx(ap)


def test_curves_against_all_pairs(spark):
    data = [(i * 7 % 3 % 2, (i * 13 % 29) / 29) for i in range(120)]
    labels, scores = zip(*data)
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    expected = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    for limit in (1000, 5):
        (row,) = as_dicts(M.binary_curves(scored(spark, labels, scores), rows_per_bucket=limit))
        assert row["roc_auc"] == pytest.approx(expected)


def test_missing_class_has_no_one_vs_rest(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.2, 0.7, 0.1])], "label int, probability array<double>")
    assert M.one_vs_rest_auc(df, 3).first()[0] is None
    assert M.one_vs_rest_auc(df, 2).first()[0] is None  # three scores, two classes asked for


def test_majority_takes_the_smallest_label_on_a_tie(spark):
    truth = rows(spark, [2, 2, 1, 1, 0], [0] * 5)
    assert M.majority_predictions(truth).first()["prediction"] == 1
    counts = [18118, 556, 1448, 162, 1608]
    labels = spark.createDataFrame(list(enumerate(counts)), "label int, n int")
    labels = labels.select("label", F.explode(F.sequence(F.lit(1), "n"))).select("label")
    (row,) = as_dicts(M.majority_class_baseline(labels, FIVE)["summary"])
    assert (row["macro_f1"], row["weighted_f1"], row["accuracy"], row["balanced_accuracy"]) == (0.1811, 0.7495, 0.8276, 0.2)


def test_evaluate_and_compare(spark):
    two = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]).withColumn("prediction", F.lit(0.0))
    a = M.evaluate(two, ["x", "y"], "a")
    b = M.evaluate(two.drop("probability").withColumn("prediction", F.col("label").cast("double")), ["x", "y"], "b")
    assert a["summary"].first()["roc_auc"] == 0.75 and "roc_auc" not in b["summary"].columns
    table = as_dicts(M.comparison_table([a["summary"], b["summary"]]))
    assert [r["model"] for r in table] == ["b", "a"] and table[0]["roc_auc"] is None
    assert a["confusion_normalised"].count() == 4
    with pytest.raises(ValueError):
        M.comparison_table([])


def test_error_examples_and_recall_delta(spark):
    data = [(f"r{i}", i % 2, float((i // 2) % 2)) for i in range(40)]
    df = spark.createDataFrame(data, "beat_id string, label int, prediction double")
    one = M.error_examples(df.repartition(1), ["a", "b"], 3, 4).orderBy("label", "rank").collect()
    assert one == M.error_examples(df.repartition(8), ["a", "b"], 3, 4).orderBy("label", "rank").collect()
    assert len(one) == 6 and all(r["label"] != r["prediction"] for r in one)
    tagged = df.withColumn("loss", F.lit("w")).unionByName(df.withColumn("prediction", F.col("label").cast("double")).withColumn("loss", F.lit("u")))
    report = M.per_class_report(M.confusion_counts(tagged, ["a", "b"], ["loss"]), ["loss"])
    deltas = as_dicts(M.recall_delta(report, "loss", "w", "u"))
    assert [d["delta"] for d in deltas] == [-0.5, -0.5]


def test_rows_outside_the_class_list_count(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 2.0), (None, 0.0)], "label int, prediction double")
    df = df.withColumn("probability", F.array(F.lit(0.4), F.col("prediction") * 0.1 + 0.2))
    out = M.evaluate(df, ["a", "b"])
    (row,) = as_dicts(out["summary"])
    assert row["n"] == 4 and row["accuracy"] == 0.5
    # Two positives against a labelled and an unlabelled negative.
    assert row["roc_auc"] == 1.0
    cells = {(r["true"], r["predicted"]): r["n"] for r in out["confusion"].collect()}
    assert cells["b", "outside"] == 1 and cells["outside", "a"] == 1 and sum(cells.values()) == 4
    lines = by_key(out["per_class"], "class")
    assert lines["b"]["recall"] == 0.5 and lines["a"]["precision"] == 0.5 and "outside" not in lines


def test_majority_ignores_missing_labels(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "label int")
    assert {r["prediction"] for r in M.majority_predictions(df).collect()} == {1}
