import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from signal_rows import as_dicts, beat_rows, by_key
from signalloom.operators import metrics as M
from signalloom.plans import arms as R
from signalloom.plans import features as P
from signalloom.plans import models as L
from signalloom.plans import tables as T
from signalloom.spec import SignalSpec, canonical_schema

SPEC = SignalSpec(24, 125.0, {})
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def signals(spark):
    """Three classes with bumps at different places."""
    rows = []
    for label in range(3):
        for i in range(40):
            wave = [round(0.05 + 0.9 * (abs(t - 4 - 7 * label) < 3) + 0.01 * ((i * 7 + t) % 5), 4) for t in range(24)]
            rows.append((f"{label}-{i}", "test" if i % 4 == 0 else "train", label, wave))
    return spark.createDataFrame(beat_rows(rows), canonical_schema()).cache()


@pytest.fixture(scope="module")
def dataset(spark, signals, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    rows, model = P.build_dataset(signals, "mitbih", True, destination=path, spec=SPEC)
    return rows.cache(), model, path


def test_dataset(spark, signals, dataset):
    rows, model, path = dataset
    n = {r["split_final"]: r["count"] for r in rows.groupBy("split_final").count().collect()}
    assert n["test"] == 30 and n["train"] + n["val"] == 90 and n["val"] >= 12
    width = rows.select(F.size(vector_to_array("features")).alias("w")).first()["w"]
    assert width == 24 + 7 == len(P.assembled_feature_names(spec=SPEC))
    train = rows.where("split_final = 'train'")
    means = train.select(F.posexplode(vector_to_array("features"))).groupBy("pos").agg(F.avg("col").alias("m"))
    assert all(abs(r["m"]) < 1e-9 for r in means.collect())
    again = P.load_stages(path).transform(signals.where("beat_id = '0-1'")).first()["features"]
    assert again == rows.where("beat_id = '0-1'").first()["features"]
    assert P.load_dataset(spark, path).count() == 120


def test_a_class_missing_from_train_has_no_weight(spark, signals):
    only_test = signals.withColumn("split", F.when(F.col("label") == 2, "test").otherwise(F.col("split")))
    rows, _ = P.build_dataset(only_test, "mitbih", True, spec=SPEC)
    assert rows.where("label = 2 and class_weight is not null").count() == 0


def test_own_split_for_a_collection_without_one(spark, signals):
    rows, _ = P.build_dataset(signals, "mitbih", False, scaler="minmax", descriptor_columns=[], spec=SPEC)
    n = {r["split_final"]: r["count"] for r in rows.groupBy("split_final").count().collect()}
    assert n["train"] == 84 and n["val"] + n["test"] == 36
    top = rows.where("split_final = 'train'").select(F.array_max(vector_to_array("features")).alias("m"))
    assert top.agg(F.max("m")).first()[0] == 1.0


def test_incomplete_rows_are_skipped_and_counted(spark, signals):
    odd = spark.createDataFrame(beat_rows([("z", "train", 0, [0.0] * 24)]), canonical_schema())
    both = signals.unionByName(odd)
    (counts,) = as_dicts(P.skipped_rows(both, spec=SPEC))
    assert counts == {"rows": 121, "skipped": 1}
    assert P.preprocessing_stages(scaler=None, spec=SPEC).fit(both).transform(both).count() == 120


def test_unknown_scaler():
    with pytest.raises(ValueError):
        P.preprocessing_stages(scaler="robust")


def test_baselines(spark, dataset, tmp_path):
    rows, _, _ = dataset
    light = {
        "logistic-regression": {"maxIter": 20}, "linear-svc": {"maxIter": 10},
        "random-forest": {"numTrees": 10, "maxDepth": 4}, "gradient-boosted-trees": {"maxIter": 2, "maxDepth": 2},
    }
    results = L.run_baselines(rows, NAMES, overrides=light, splits=["test"])
    table = as_dicts(L.results_table(results))
    assert len(table) == 4 and all(r["macro_f1"] > 0.9 for r in table)
    scores = {r["model"]: r["roc_auc_ovr_macro"] for r in table}
    assert scores["logistic-regression"] > 0.9 and scores["linear-svc"] is None
    for name, fitted in results.items():
        L.save_model(fitted.model, str(tmp_path), "s", name)
        again = L.load_model(str(tmp_path), "s", name)
        assert type(again) is type(fitted.model)
        assert again.transform(rows).select("prediction").collect() == fitted.model.transform(rows).select("prediction").collect()
    forest = results["random-forest"].model
    top = as_dicts(L.feature_importances(rows, forest, P.assembled_feature_names(spec=SPEC), 5).orderBy("rank"))
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0]["importance"] >= top[4]["importance"]
    every = L.feature_importances(rows, forest, P.assembled_feature_names(spec=SPEC), None)
    groups = by_key(L.importance_groups(every, P.MODEL_FEATURE_COLUMNS), "group")
    assert sum(r["importance"] for r in groups.values()) == pytest.approx(1)


def test_fits_side_by_side_give_the_same_models(spark, dataset):
    rows, _, _ = dataset
    light = {"logistic-regression": {"maxIter": 10}, "linear-svc": {"maxIter": 5}}
    one, many = (L.run_baselines(rows, NAMES, list(light), splits=["test"], overrides=light, side_by_side=n) for n in (1, 3))
    for name in light:
        first, second = (x[name].evaluations["test"]["summary"].collect() for x in (one, many))
        assert first == second


@pytest.mark.parametrize("classes", [2, 3])
def test_predictions_from_tables(spark, dataset, classes):
    rows = dataset[0].where(F.col("label") < classes)
    train, test = rows.where("split_final = 'train'"), rows.where("split_final <> 'train'").select("beat_id", "label", "features")
    light = {
        "logistic-regression": {"maxIter": 10}, "linear-svc": {"maxIter": 5},
        "random-forest": {"numTrees": 7, "maxDepth": 4}, "gradient-boosted-trees": {"maxIter": 3, "maxDepth": 3},
    }
    for name, options in light.items():
        model, _ = L.fit_baseline(name, train, classes, **options)
        if name in ("logistic-regression", "linear-svc"):
            again = T.linear_predictions(test, T.coefficient_rows(spark, model), ["beat_id"])
        else:
            nodes = T.node_rows(spark, model).cache()
            how = T.forest_predictions if name == "random-forest" else T.boosted_predictions
            again = how(T.leaves(test, nodes, options["maxDepth"], ["beat_id"]), ["beat_id"])
            if name == "random-forest":
                mine = {r["slot"]: r["importance"] for r in T.importances_from_nodes(nodes).collect()}
                theirs = model.featureImportances.toArray()
                assert mine == pytest.approx({i: x for i, x in enumerate(theirs) if x}, abs=1e-12)
        want = {r["beat_id"]: int(r["prediction"]) for r in model.transform(test).collect()}
        assert {r["beat_id"]: r["prediction"] for r in again.collect()} == want, name


def test_plain_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)], "label int, prediction int")
    (plain,), (summary,) = as_dicts(T.plain_scores(df)), as_dicts(M.summary_metrics(M.confusion_counts(df, NAMES)))
    assert plain["n"] == 5 and plain["macro_f1"] == pytest.approx(summary["macro_f1"], abs=1e-4)
    assert plain["accuracy"] == summary["accuracy"]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_dataset_reads_signals_once_for_each_use(spark, signals, tmp_path):
    signals.write.parquet(str(tmp_path / "signals"))
    stored = spark.read.parquet(str(tmp_path / "signals"))
    for published in (True, False):
        placed = P.assign_splits(stored, published)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert scans(placed) == 1 and "Union" not in plan and "Exchange hash" not in plan and "Sort" not in plan
        rows, _ = P.build_dataset(stored, "mitbih", published, spec=SPEC)
        assert scans(rows) == 1 and rows.count() == 120


def test_registry_settings():
    forest = L.BASELINES["random-forest"].estimator(5)
    assert forest.getNumTrees() == 120 and forest.getMaxDepth() == 12 and forest.getWeightCol() == "class_weight"
    assert L.BASELINES["logistic-regression"].estimator(2).getFamily() == "binomial"
    assert type(L.BASELINES["gradient-boosted-trees"].estimator(3)).__name__ == "OneVsRest"


def test_arms(spark, dataset):
    rows, _, _ = dataset
    train = rows.where("split_final = 'train'").select("beat_id", "label", "features")
    test = rows.where("split_final = 'test'").select("beat_id", "label", "features")
    source = R.fit_source(R.balanced_train(train), 31, 3, hidden=6, max_iter=30)
    weights, biases = R.hidden_part(source)
    assert weights.shape == (6, 31) and biases.shape == (6,)

    # The frozen arm's hidden layer must reproduce the network it came from.
    hidden = R.HiddenLayer("features", "hidden", weights.ravel().tolist(), biases.tolist()).transform(test)
    flat = source.weights.toArray()[6 * 31 + 6 :]
    head, bias = flat[:18].reshape((3, 6), order="F"), flat[18:]
    row = source.transform(hidden).first()
    raw = head @ row["hidden"].toArray() + bias
    shifted = raw - raw.max()
    import numpy as np

    expected = np.exp(shifted) / np.exp(shifted).sum()
    assert row["probability"].toArray() == pytest.approx(expected, abs=1e-9)

    val = rows.where("split_final = 'val'")
    options = {"val": val, "hidden": 6, "rounds": R.Rounds(3, 10)}
    results = R.run_all_arms(R.balanced_train(train), test, NAMES, 31, source, **options)
    table = as_dicts(R.arms_table(results))
    assert {r["arm"] for r in table} == {"scratch", "frozen", "finetune"}
    assert table[0]["macro_f1"] > 0.9
    sizes = {r["arm"]: r["trainable_parameters"] for r in table}
    assert sizes == {"scratch": 32 * 6 + 7 * 3, "finetune": 32 * 6 + 7 * 3, "frozen": 7 * 3}
    for arm, result in results.items():
        history = as_dicts(result.history.orderBy("epoch"))
        assert [h["epoch"] for h in history] == [1, 2, 3] and result.epochs == 3
        assert history[-1]["train_loss"] <= history[0]["train_loss"] + 1e-9
        top = max(h["val_macro_f1"] for h in history)
        assert result.best_epoch == min(h["epoch"] for h in history if h["val_macro_f1"] == top)
        lines = by_key(result.lines, "split")
        assert lines["val"]["macro_f1"] == pytest.approx(top, abs=1e-4) and lines["test"]["arm"] == arm
    with pytest.raises(ValueError):
        R.build_arm("other", 31, 3)
    with pytest.raises(ValueError):
        R.build_arm("frozen", 31, 3)
    curve = R.learning_curve(train, test, NAMES, 31, source, (0.2, 1.0), ("frozen",), hidden=6, rounds=R.Rounds(1, 5))
    sizes = [r["n_train"] for r in curve.orderBy("fraction").collect()]
    assert sizes[0] < sizes[1] == train.count()


def test_rounds_go_on_from_the_last_weights(spark, dataset):
    rows, _, _ = dataset
    train = rows.where("split_final = 'train'").select("label", "features")
    val = rows.where("split_final = 'val'").select("label", "features")
    run = R.run_arm("scratch", train, val, NAMES, 31, val=val, hidden=6, rounds=R.Rounds(3, 4))
    (once,) = as_dicts(R.run_arm("scratch", train, val, NAMES, 31, val=val, hidden=6, rounds=R.Rounds(1, 4)).history)
    losses = [h["train_loss"] for h in as_dicts(run.history.orderBy("epoch"))]
    assert losses[0] == pytest.approx(once["train_loss"], rel=1e-6) and losses == sorted(losses, reverse=True)
    # A history's numbers are those of the metric tables.
    scored = M.narrow_predictions(run.model.transform(val))
    (summary,) = as_dicts(M.summary_metrics(M.confusion_counts(scored, NAMES), decimals=None))
    mine = R.score_round(run.model, val.withColumn("part", F.lit("val")), 3)["val"]
    assert [mine[c] for c in ("macro_f1", "balanced_accuracy", "accuracy")] == pytest.approx(
        [summary[c] for c in ("macro_f1", "balanced_accuracy", "accuracy")]
    )


def test_patience_ends_a_run_and_no_validation_keeps_the_last_round(spark, dataset):
    rows, _, _ = dataset
    train = rows.where("split_final = 'train'").select("label", "features")
    strict = R.Rounds(6, 3, patience=2, least_gain=2.0)
    run = R.run_arm("scratch", train, train, NAMES, 31, val=train, hidden=4, rounds=strict)
    assert run.stopped_early and run.epochs == 3 and run.best_epoch == 1
    run = R.run_arm("scratch", train, train, NAMES, 31, hidden=4, rounds=R.Rounds(2, 2))
    assert run.best_epoch == run.epochs == 2 and set(run.evaluations) == {"test"}
    assert as_dicts(run.history)[0]["val_loss"] is None


def test_kept_layer_is_one_product_a_batch(spark, dataset, tmp_path):
    import numpy as np

    rows, _, _ = dataset
    rng = np.random.default_rng(3)
    weights, biases = rng.normal(size=(6, 31)), rng.normal(size=6)
    layer = R.HiddenLayer("features", "hidden", weights.ravel().tolist(), biases.tolist())
    out = layer.transform(rows.select("features"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and str(weights[0, 0])[:8] not in plan
    for r in out.collect():
        assert r["hidden"].toArray() == pytest.approx(1 / (1 + np.exp(-(weights @ r["features"].toArray() + biases))), abs=1e-9)
    layer.write().overwrite().save(str(tmp_path / "layer"))
    again = R.HiddenLayer.load(str(tmp_path / "layer")).transform(rows.select("features"))
    assert again.collect() == out.collect()
    some = spark.createDataFrame([([0.5] * 31,), (None,)], "x array<double>")
    found = [r[0] for r in some.select(R.sigmoid_layer(weights, biases)("x")).collect()]
    assert len(found[0]) == 6 and found[1] is None


def test_arms_learn_side_by_side_and_stand_in_order(monkeypatch):
    """Two runs wait for each other, which runs one after the other could not do."""
    import threading

    from signalloom.plans import arms as R

    both = threading.Barrier(2, timeout=20)

    def run_arm(arm, *rest, **options):
        if arm != "finetune":
            both.wait()
        return f"{arm} done"

    monkeypatch.setattr(R, "run_arm", run_arm)
    found = R.run_all_arms(None, None, [], 3, None, arms=("scratch", "frozen", "finetune"))
    assert list(found.items()) == [(a, f"{a} done") for a in ("scratch", "frozen", "finetune")]
