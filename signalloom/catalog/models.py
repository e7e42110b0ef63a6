"""Section E and the model-fitting part of G: Spark ML on the event signals.

Models are fitted with the registry's settings on both collections. SQL knows which rows
must be scored, by what, and in which range; how good a model is belongs to the tests.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.catalog.base import (
    EVENT_FEATS,
    NAMES,
    SPEC,
    beats,
    big,
    query,
    r,
    r6,
)
from signalloom.operators.descriptors import MODEL_FEATURE_COLUMNS
from signalloom.operators import experiments as X
from signalloom.operators.experiments import ARMS
from signalloom.operators.metrics import SUMMARY_METRICS
from signalloom.plans import arms as R
from signalloom.plans import features as P
from signalloom.plans import models as L
from signalloom.plans import tables as T
from signalloom.plans.arms import stacked
from signalloom.runtime import materialise, scratch_path
from signalloom.sources.ingest import write_parquet

N_INPUTS = SPEC.n_samples + len(MODEL_FEATURE_COLUMNS)
COLLECTIONS = ("a", "b")


def stored(spark, sf_dir) -> DataFrame:
    """Signals as ingestion leaves them: a Parquet table, made once and read many times."""
    path = write_parquet(beats(spark, sf_dir), scratch_path(spark, "stored"))
    return spark.read.parquet(path)


def dataset(spark, sf_dir, source: str = "a", signals: DataFrame | None = None) -> DataFrame:
    """Model-ready rows of one collection, stored."""
    signals = stored(spark, sf_dir) if signals is None else signals
    rows, _ = P.build_dataset(
        signals, source, True, destination=scratch_path(spark, "model"), spec=SPEC
    )
    return rows


def each_collection(spark, sf_dir, job) -> DataFrame:
    """``job(rows)`` for both collections, stacked under a ``source`` column."""
    signals, out = stored(spark, sf_dir), None
    for source in COLLECTIONS:
        part = job(dataset(spark, sf_dir, source, signals)).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def in_range(summary: DataFrame) -> DataFrame:
    """One boolean instead of the metrics: each lies where it can, or is missing."""
    low = {"mcc": -1.0, "cohen_kappa": -1.0}
    names = [*SUMMARY_METRICS, "roc_auc", "pr_auc", "roc_auc_ovr_macro"]
    found = [n for n in names if n in summary.columns]
    fine = F.lit(True)
    for n in found:
        fine = fine & F.coalesce(F.col(n).between(low.get(n, 0.0), 1.0), F.lit(True))
    return summary.withColumn("in_range", fine).drop(*found)


# --- feature stages ---------------------------------------------------------

_SLOTS = "UNION ALL ".join(
    f"SELECT beat_id, {31 + i} AS slot, CAST({c} AS DOUBLE) AS x FROM ok "
    for i, c in enumerate(MODEL_FEATURE_COLUMNS)
)
_ASSEMBLED = f"""{EVENT_FEATS},
ok AS (SELECT * FROM feats WHERE amp_min IS NOT NULL AND mean_abs_diff IS NOT NULL AND max_abs_diff IS NOT NULL),
slots AS (SELECT beat_id, slot, x FROM long WHERE beat_id IN (SELECT beat_id FROM ok) UNION ALL {_SLOTS}),
fitted AS (SELECT slot, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi
  FROM slots JOIN ok USING (beat_id) WHERE split = 'train' GROUP BY slot)"""


def _transformed(spark, sf_dir, scaler, source_col="features") -> DataFrame:
    signals = beats(spark, sf_dir)
    train = signals.where(F.col("split") == "train")
    model = P.preprocessing_stages(scaler=scaler, spec=SPEC).fit(train)
    values = F.posexplode(vector_to_array(source_col)).alias("slot", "value")
    return model.transform(signals).select("beat_id", values).withColumn("value", r6("value"))


@query(
    "e01_descriptor_stage",
    f"""WITH {EVENT_FEATS} SELECT beat_id, signal_length, {r('amp_mean')} AS amp_mean FROM feats""",
)
def e01(spark, sf_dir):
    described = P.SignalDescriptors("signal", 31, SPEC.sampling_hz).transform(beats(spark, sf_dir))
    return described.select("beat_id", "signal_length", r6("amp_mean").alias("amp_mean"))


@query(
    "e02_array_to_vector",
    f"""WITH {EVENT_FEATS} SELECT beat_id, CAST(slot AS INTEGER) AS slot, {r('x')} AS value FROM long""",
)
def e02(spark, sf_dir):
    vectors = P.ArrayToVector("signal", "v").transform(beats(spark, sf_dir))
    values = F.posexplode(vector_to_array("v")).alias("slot", "value")
    return vectors.select("beat_id", values).withColumn("value", r6("value"))


@query(
    "e03_assembled_features",
    f"WITH {_ASSEMBLED} SELECT beat_id, CAST(slot AS INTEGER) AS slot, {r('x')} AS value FROM slots",
)
def e03(spark, sf_dir):
    return _transformed(spark, sf_dir, None)


@query(
    "e03_skipped_rows",
    f"""WITH {EVENT_FEATS}
SELECT {big('count(*)')} AS rows, {big('sum(CASE WHEN amp_min IS NULL OR mean_abs_diff IS NULL THEN 1 ELSE 0 END)')} AS skipped
FROM feats""",
)
def e03_skipped(spark, sf_dir):
    return P.skipped_rows(beats(spark, sf_dir), spec=SPEC)


@query(
    "e04_standard_scaling",
    f"""WITH {_ASSEMBLED}
SELECT beat_id, CAST(slot AS INTEGER) AS slot,
       {r('CASE WHEN sd > 0 THEN (x - mean) / sd ELSE 0 END')} AS value FROM slots JOIN fitted USING (slot)""",
)
def e04(spark, sf_dir):
    return _transformed(spark, sf_dir, "standard")


@query(
    "e05_minmax_scaling",
    f"""WITH {_ASSEMBLED}
SELECT beat_id, CAST(slot AS INTEGER) AS slot,
       {r('CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.5 END')} AS value FROM slots JOIN fitted USING (slot)""",
)
def e05(spark, sf_dir):
    return _transformed(spark, sf_dir, "minmax")


@query(
    "e06_preprocessing_stages",
    f"WITH {EVENT_FEATS} SELECT beat_id, CAST({SPEC.n_samples} AS INTEGER) AS width FROM feats",
)
def e06(spark, sf_dir):
    signals = beats(spark, sf_dir)
    model = P.preprocessing_stages([], "standard", spec=SPEC).fit(signals)
    return model.transform(signals).select("beat_id", F.size(vector_to_array("features")).alias("width"))


_READY = f"""{EVENT_FEATS},
ours AS (SELECT beat_id, split, label, label_name FROM feats WHERE source = 'a'),
ordered AS (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY md5('42:' || beat_id), beat_id) AS p
  FROM ours WHERE split = 'train'),
placed AS (
  SELECT beat_id, label, label_name, CASE WHEN p < CAST(0.85 AS DOUBLE) THEN 'train' ELSE 'val' END AS split_final FROM ordered
  UNION ALL SELECT beat_id, label, label_name, split FROM ours WHERE split <> 'train'),
counted AS (SELECT label, count(*) AS n FROM placed WHERE split_final = 'train' GROUP BY label),
weights AS (SELECT label, {r('CAST((SELECT sum(n) FROM counted) AS DOUBLE) / ((SELECT count(*) FROM counted) * n)')} AS class_weight
  FROM counted),
ready AS (SELECT p.*, w.class_weight FROM placed p LEFT JOIN weights w ON p.label = w.label
  WHERE beat_id IN (SELECT beat_id FROM feats WHERE amp_min IS NOT NULL AND mean_abs_diff IS NOT NULL))"""


@query(
    "e07_build_dataset",
    f"""WITH {_READY}
SELECT split_final, label, label_name, {big('count(*)')} AS n, max(class_weight) AS class_weight
FROM ready GROUP BY split_final, label, label_name""",
)
def e07(spark, sf_dir):
    rows = dataset(spark, sf_dir)
    return rows.groupBy("split_final", "label", "label_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("class_weight"), 6).alias("class_weight")
    )


_OWN = f"""{EVENT_FEATS},
ours AS (SELECT * FROM feats WHERE source = 'b'),
ordered AS (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY md5('42:' || beat_id), beat_id) AS p FROM ours),
placed AS (SELECT *, CASE WHEN p < CAST(0.7 AS DOUBLE) THEN 'train' WHEN p < CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) THEN 'val' ELSE 'test' END AS split_final FROM ordered),
counted AS (SELECT label, count(*) AS n FROM placed WHERE split_final = 'train' GROUP BY label),
weights AS (SELECT label, {r('CAST((SELECT sum(n) FROM counted) AS DOUBLE) / ((SELECT count(*) FROM counted) * n)')} AS class_weight
  FROM counted)"""


@query(
    "e07_build_dataset_with_own_split",
    f"""WITH {_OWN}
SELECT p.beat_id, p.split_final, p.label, w.class_weight FROM placed p LEFT JOIN weights w ON p.label = w.label
WHERE amp_min IS NOT NULL AND mean_abs_diff IS NOT NULL""",
)
def e07_own(spark, sf_dir):
    """The second collection as one that comes without a split."""
    signals = stored(spark, sf_dir).withColumn("split", F.lit("full"))
    rows, _ = P.build_dataset(signals, "b", False, destination=scratch_path(spark, "model"), spec=SPEC)
    return rows.select("beat_id", "split_final", "label", r6("class_weight").alias("class_weight"))


@query("a17_load_dataset", f"WITH {_READY} SELECT beat_id, split_final, label, class_weight FROM ready")
def a17(spark, sf_dir):
    path = scratch_path(spark, "model")
    P.build_dataset(stored(spark, sf_dir), "a", True, destination=path, spec=SPEC)
    rows = P.load_dataset(spark, path).select("beat_id", "split_final", "label", "class_weight")
    return rows.withColumn("class_weight", r6("class_weight"))


@query("e08_load_stages", f"WITH {_READY} SELECT beat_id, CAST(0 AS DOUBLE) AS difference FROM ready")
def e08(spark, sf_dir):
    path = scratch_path(spark, "model")
    signals = stored(spark, sf_dir)
    rows, _ = P.build_dataset(signals, "a", True, destination=path, spec=SPEC)
    again: PipelineModel = P.load_stages(path)
    fresh = again.transform(signals).select("beat_id", vector_to_array("features").alias("fresh"))
    kept = rows.select("beat_id", vector_to_array("features").alias("kept"))
    gap = F.array_max(F.zip_with("fresh", "kept", lambda a, b: F.abs(a - b)))
    return fresh.join(kept, "beat_id").select("beat_id", F.round(gap, 9).alias("difference"))


# --- classifiers ------------------------------------------------------------

_BOTH = f"""{EVENT_FEATS},
ordered AS (SELECT *, percent_rank() OVER (PARTITION BY source, label ORDER BY md5('42:' || beat_id), beat_id) AS p
  FROM feats WHERE split = 'train' AND source IN ('a', 'b')),
placed AS (
  SELECT source, beat_id, label, CASE WHEN p < CAST(0.85 AS DOUBLE) THEN 'train' ELSE 'val' END AS split_final FROM ordered
  UNION ALL SELECT source, beat_id, label, split FROM feats WHERE split <> 'train' AND source IN ('a', 'b')),
ready AS (SELECT * FROM placed
  WHERE beat_id IN (SELECT beat_id FROM feats WHERE amp_min IS NOT NULL AND mean_abs_diff IS NOT NULL)),
sizes AS (SELECT source, split_final AS split, {big('count(*)')} AS n FROM ready GROUP BY ALL)"""


def _values(name: str, column: str, values) -> str:
    listed = ", ".join(f"({v!r})" for v in values)
    return f"{name}({column}) AS (VALUES {listed})"


_MODELS = _values("models", "model", L.DEFAULT_BASELINES)
_ARMS = _values("arms", "arm", ARMS)


#: Depth of the trees, by classifier.
_DEPTHS = {"random-forest": 12, "gradient-boosted-trees": 5}


def _from_tables(spark, name: str, model, rows: DataFrame) -> DataFrame:
    """(beat_id, prediction) from the model's coefficients or tree nodes as rows."""
    if name not in _DEPTHS:
        return T.linear_predictions(rows, T.coefficient_rows(spark, model), ["beat_id"])
    nodes = materialise(T.node_rows(spark, model), "nodes")
    reached = T.leaves(rows, nodes, _DEPTHS[name], ["beat_id"])
    how = T.forest_predictions if name == "random-forest" else T.boosted_predictions
    return how(reached, ["beat_id"])


def _fit(name: str):
    def scored(frames: DataFrame) -> DataFrame:
        spark = frames.sparkSession
        model, _ = L.fit_baseline(name, frames.where(F.col("split_final") == "train"), len(NAMES))
        test = materialise(frames.where(F.col("split_final") == "test").select("beat_id", "label", "features"), "test")
        again = _from_tables(spark, name, model, test).withColumnRenamed("prediction", "again")
        rows = L.predict(model, test, keep=["beat_id"]).join(again, "beat_id", "left")
        return rows.select("beat_id", "label", F.col("prediction").eqNullSafe(F.col("again")).alias("same"))

    return lambda spark, sf_dir: each_collection(spark, sf_dir, scored)


for _number, _name in enumerate(
    ("logistic-regression", "random-forest", "gradient-boosted-trees", "linear-svc"), start=10
):
    query(
        f"e{_number}_{_name.replace('-', '_')}",
        f"WITH {_BOTH} SELECT source, beat_id, label, true AS same FROM ready WHERE split_final = 'test'",
    )(_fit(_name))


@query(
    "e14_fit_baseline",
    f"""WITH {_BOTH} SELECT source, label, {big('count(*)')} AS n, true AS improved FROM ready
WHERE split_final = 'train' GROUP BY source, label""",
)
def e14(spark, sf_dir):
    def fitted(rows: DataFrame) -> DataFrame:
        train = rows.where(F.col("split_final") == "train")
        model, _ = L.fit_baseline("logistic-regression", train, len(NAMES))
        losses = model.summary.objectiveHistory
        counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn("improved", F.lit(bool(losses[-1] < losses[0])))

    return each_collection(spark, sf_dir, fitted)


def _agrees(summary: DataFrame, predictions: DataFrame) -> DataFrame:
    """Model, split and n of a summary, and whether plain SQL over the predictions gives its scores."""
    plain = T.plain_scores(predictions).first()
    near = lambda a: F.abs(F.col(a) - F.lit(float(plain[a]))) <= 5.1e-5
    same = (F.col("n") == F.lit(plain["n"])) & near("macro_f1") & near("accuracy")
    return summary.select("model", "split", "n", same.alias("same"))


@query(
    "e15_evaluate_baseline",
    f"WITH {_BOTH} SELECT source, 'random-forest' AS model, split, n, true AS same FROM sizes WHERE split = 'test'",
)
def e15(spark, sf_dir):
    def evaluated(rows: DataFrame) -> DataFrame:
        model, _ = L.fit_baseline("random-forest", rows.where(F.col("split_final") == "train"), len(NAMES))
        test = rows.where(F.col("split_final") == "test")
        predictions = materialise(L.predict(model, test), "predictions")
        return _agrees(L.evaluate_baseline(model, test, NAMES, "random-forest", "test")["summary"], predictions)

    return each_collection(spark, sf_dir, evaluated)


@query(
    "e16_run_baselines",
    f"""WITH {_BOTH}, {_MODELS} SELECT source, model, split, n, true AS same FROM sizes, models
WHERE split IN ('val', 'test')""",
)
def e16(spark, sf_dir):
    def every(rows: DataFrame) -> DataFrame:
        results = L.run_baselines(rows, NAMES)
        return stacked(
            _agrees(e["summary"], materialise(L.predict(f.model, rows.where(F.col("split_final") == split)), "predictions"))
            for f in results.values()
            for split, e in f.evaluations.items()
        )

    return each_collection(spark, sf_dir, every)


#: Fewer iterations and trees, where only storing a model is looked at.
_LIGHT = {
    "logistic-regression": {"maxIter": 10}, "linear-svc": {"maxIter": 5},
    "random-forest": {"numTrees": 10, "maxDepth": 5}, "gradient-boosted-trees": {"maxIter": 2, "maxDepth": 3},
}


@query(
    "e17_save_and_e18_load_model",
    f"WITH {_BOTH}, {_MODELS} SELECT source, model, beat_id, true AS same FROM ready, models WHERE split_final = 'test'",
)
def e17(spark, sf_dir):
    """Every kind of classifier, stored and read back, predicts as before."""

    def reloaded(rows: DataFrame) -> DataFrame:
        results = L.run_baselines(rows, NAMES, splits=[], overrides=_LIGHT)
        folder, test = scratch_path(spark, "models"), rows.where(F.col("split_final") == "test")

        def both(name: str, model) -> DataFrame:
            L.save_model(model, folder, "any", name)
            again = L.predict(L.load_model(folder, "any", name), test, keep=["beat_id"])
            again = again.select("beat_id", F.col("prediction").alias("reloaded"))
            joined = L.predict(model, test, keep=["beat_id"]).join(again, "beat_id", "full")
            same = F.col("prediction").eqNullSafe(F.col("reloaded")).alias("same")
            return joined.select(F.lit(name).alias("model"), "beat_id", same)

        return stacked(both(n, f.model) for n, f in results.items())

    return each_collection(spark, sf_dir, reloaded)


@query(
    "e19_results_table",
    f"""WITH {_BOTH}, {_MODELS} SELECT source, model, split, n, true AS in_range, true AS described FROM sizes, models
WHERE split = 'test'""",
)
def e19(spark, sf_dir):
    def table_of(rows: DataFrame) -> DataFrame:
        results = L.run_baselines(rows, NAMES, splits=["test"])
        table = in_range(L.results_table(results)).withColumn("described", F.length("description") > 0)
        return table.drop("fit_seconds", "description")

    return each_collection(spark, sf_dir, table_of)


_FEATURES = _values("features", "feature", P.assembled_feature_names(spec=SPEC))
_GROUPS = _values("groups", '"group"', [*MODEL_FEATURE_COLUMNS, "waveform samples"])


def _importances(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature, importance) as the forest gives them, and as its nodes do; zeros left out there."""
    spark, names = rows.sparkSession, P.assembled_feature_names(spec=SPEC)
    model, _ = L.fit_baseline("random-forest", rows.where(F.col("split_final") == "train"), len(NAMES))
    nodes = materialise(T.node_rows(spark, model), "nodes")
    feature = F.get(F.array(*map(F.lit, names)), F.col("slot")).alias("feature")
    own = materialise(T.importances_from_nodes(nodes).select(feature, F.col("importance").alias("own")), "importances")
    return L.feature_importances(rows, model, names, None), own


@query(
    "e20_feature_importances",
    f"""WITH {_BOTH}, {_FEATURES}
SELECT source, feature, true AS same, true AS ranked FROM (SELECT DISTINCT source FROM ready), features""",
)
def e20(spark, sf_dir):
    def compared(rows: DataFrame) -> DataFrame:
        found, own = _importances(rows)
        both = found.join(own, "feature", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
        higher = F.rank().over(Window.orderBy(F.round("own", 12).desc()))
        ranked = (F.col("rank") >= F.col("place")) | (F.abs(F.col("importance") - F.col("own")) < 1e-12)
        same = F.abs(F.col("importance") - F.col("own")) < 1e-9
        return both.withColumn("place", higher).select("feature", same.alias("same"), ranked.alias("ranked"))

    return each_collection(spark, sf_dir, compared)


@query(
    "e22_importance_groups",
    f"""WITH {_BOTH}, {_GROUPS}
SELECT source, "group", true AS same FROM (SELECT DISTINCT source FROM ready), groups""",
)
def e22(spark, sf_dir):
    def sums(rows: DataFrame) -> DataFrame:
        found, own = _importances(rows)
        groups = L.importance_groups(found, MODEL_FEATURE_COLUMNS)
        is_sample = ~F.col("feature").isin(*MODEL_FEATURE_COLUMNS)
        name = F.when(is_sample, F.lit("waveform samples")).otherwise(F.col("feature"))
        plain = own.groupBy(name.alias("group")).agg(F.sum("own").alias("own"))
        both = groups.join(plain, "group", "left")
        same = F.abs(F.col("importance") - F.coalesce("own", F.lit(0.0))) < 1e-9
        return both.select("group", (same & (F.abs(F.col("share_pct") - F.col("importance") * 100) <= 0.051)).alias("same"))

    return each_collection(spark, sf_dir, sums)


# --- transfer arms ----------------------------------------------------------

FRACTIONS = (0.02, 0.05, 0.10, 0.25, 0.50, 1.00)
SEEDS = (42, 7, 2024)
UNITS = 16
#: Numbers each arm learns: a hidden layer and a head, or the head alone.
_WEIGHTS = f"""CAST(CASE arm WHEN 'frozen' THEN {(UNITS + 1) * len(NAMES)}
  ELSE {(N_INPUTS + 1) * UNITS + (UNITS + 1) * len(NAMES)} END AS BIGINT) AS trainable_parameters"""
_TARGET = f"{_BOTH}, target AS (SELECT split, n FROM sizes WHERE source = 'b' AND split IN ('val', 'test'))"


def arm_inputs(spark, sf_dir) -> dict:
    """Source network of collection ``a``; training, validation and test rows of ``b``."""
    signals = stored(spark, sf_dir)
    parts = {
        source: dataset(spark, sf_dir, source, signals).select("beat_id", "split_final", "label", "features")
        for source in COLLECTIONS
    }
    source_train = parts["a"].where(F.col("split_final") == "train")
    network = R.fit_source(R.balanced_train(source_train), N_INPUTS, len(NAMES), UNITS)
    split = {s: parts["b"].where(F.col("split_final") == s) for s in ("train", "val", "test")}
    return {"source": network, "label_names": NAMES, "n_inputs": N_INPUTS, "hidden": UNITS, **split}


def balanced(inputs: dict) -> dict:
    """The inputs with oversampled training rows, made once for all arms."""
    return {**inputs, "train": materialise(R.balanced_train(inputs["train"]), "balanced")}


def arm_lines(lines: DataFrame) -> DataFrame:
    """Lines without what differs from run to run; the best round is one of those run."""
    fine = F.col("best_epoch").between(1, F.col("epochs"))
    return in_range(lines).withColumn("in_range", F.col("in_range") & fine).drop("seconds", "epochs", "best_epoch")


@query(
    "g01_predict",
    f"""WITH {_BOTH} SELECT beat_id, label, CAST(1 AS DOUBLE) AS total, true AS likeliest FROM ready
WHERE source = 'b' AND split_final = 'test'""",
)
def g01(spark, sf_dir):
    inputs = arm_inputs(spark, sf_dir)
    scored = L.predict(inputs["source"], inputs["test"], keep=["beat_id"])
    total = F.round(F.aggregate("probability", F.lit(0.0), lambda acc, x: acc + x), 6)
    likeliest = F.get("probability", F.col("prediction")) == F.array_max("probability")
    return scored.select("beat_id", "label", total.alias("total"), likeliest.alias("likeliest"))


@query(
    "g02_build_arm",
    f"""WITH {_BOTH} SELECT beat_id, CAST({UNITS} AS INTEGER) AS units, true AS in_range, true AS same FROM ready
WHERE source = 'b' AND split_final = 'test'""",
)
def g02(spark, sf_dir):
    """The kept layer's outputs, against the same sums taken one by one in the JVM."""
    inputs = arm_inputs(spark, sf_dir)
    network = inputs["source"]
    model = R.build_arm("frozen", N_INPUTS, len(NAMES), network).fit(inputs["train"])
    weights, biases = R.hidden_part(network)
    slots = [
        F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b"))
        for w, b in zip(weights.tolist(), biases.tolist())
    ]
    hidden, x = vector_to_array("hidden"), vector_to_array("features")
    rows = model.transform(inputs["test"]).select("beat_id", hidden.alias("h"), x.alias("x"))

    def unit(s):
        total = F.aggregate(F.zip_with("x", s["w"], lambda a, w: a * w), s["b"], lambda acc, v: acc + v)
        return 1.0 / (1.0 + F.exp(-total))

    plain = rows.withColumn("plain", F.transform(F.array(*slots), unit))
    gap = F.array_max(F.zip_with("h", "plain", lambda a, b: F.abs(a - b)))
    inside = F.forall("h", lambda v: v.between(0.0, 1.0))
    return plain.select("beat_id", F.size("h").alias("units"), inside.alias("in_range"), (gap < 1e-9).alias("same"))


@query(
    "g03_run_arm",
    f"""WITH {_TARGET}, arms(arm) AS (VALUES ('finetune'))
SELECT arm, split, n, {_WEIGHTS}, true AS in_range FROM target, arms""",
)
def g03(spark, sf_dir):
    inputs = balanced(arm_inputs(spark, sf_dir))
    return arm_lines(R.run_arm("finetune", **inputs, save_to=scratch_path(spark, "arms")).lines)


@query("g04_run_all_arms", f"WITH {_TARGET}, {_ARMS} SELECT arm, split, n, {_WEIGHTS}, true AS in_range FROM target, arms")
def g04(spark, sf_dir):
    results = R.run_all_arms(**balanced(arm_inputs(spark, sf_dir)))
    return arm_lines(stacked(r.lines for r in results.values()))


@query(
    "g05_arms_table",
    f"""WITH {_TARGET}, {_ARMS}
SELECT arm, split, n, {_WEIGHTS}, true AS in_range, true AS described FROM target, arms WHERE split = 'test'""",
)
def g05(spark, sf_dir):
    results = R.run_all_arms(**balanced(arm_inputs(spark, sf_dir)))
    table = arm_lines(R.arms_table(results)).withColumn("described", F.length("description") > 0)
    return table.drop("description")


@query(
    "g07_learning_curve",
    f"""WITH {_TARGET}, {_ARMS}, {_values("fractions", "fraction", FRACTIONS)},
train AS (SELECT label, count(*) AS n FROM ready WHERE source = 'b' AND split_final = 'train' GROUP BY label),
used AS (SELECT fraction, {big('sum(CASE WHEN fraction = 1 THEN train.n ELSE least(train.n, greatest(2, round_even(train.n * CAST(fraction AS DOUBLE), 0))) END)')} AS n_train
  FROM fractions CROSS JOIN train GROUP BY fraction)
SELECT CAST(fraction AS DOUBLE) AS fraction, n_train, arm, split, n, {_WEIGHTS}, true AS in_range FROM target, arms, used""",
)
def g07(spark, sf_dir):
    rounds = R.Rounds(rounds=3, iterations=15)
    curve = R.learning_curve(**arm_inputs(spark, sf_dir), fractions=FRACTIONS, rounds=rounds)
    return arm_lines(curve).withColumn("n_train", F.col("n_train").cast("long"))


@query(
    "g09_repeat_arms",
    f"""WITH {_TARGET}, {_ARMS}, {_values("seeds", "seed", SEEDS)}
SELECT CAST(seed AS INTEGER) AS seed, arm, split, n, {_WEIGHTS}, true AS in_range FROM target, arms, seeds""",
)
def g09(spark, sf_dir):
    return arm_lines(R.repeat_arms(**balanced(arm_inputs(spark, sf_dir)), seeds=SEEDS))


_EPOCHS = "epochs(epoch) AS (VALUES (1), (2), (3), (4), (5))"


@query(
    "g12_arm_histories",
    f"""WITH {_ARMS}, {_EPOCHS}, metrics(metric) AS (VALUES ('train_loss'), ('val_loss'), ('val_macro_f1'),
  ('val_balanced_accuracy'), ('val_accuracy'))
SELECT arm, CAST(epoch AS INTEGER) AS epoch, metric, true AS in_range, true AS learned
FROM arms, epochs, metrics WHERE (SELECT count(*) FROM events) > 0""",
)
def g12_arms(spark, sf_dir):
    """Real histories in long form; the training loss of a round is never above that of the first one."""
    results = R.run_all_arms(**balanced(arm_inputs(spark, sf_dir)))
    long = X.history_to_long(R.arms_history(results).drop("seconds"), ["arm"])
    is_loss = F.col("metric").endswith("loss")
    fine = F.col("value").isNotNull() & (F.col("value") >= 0) & (is_loss | (F.col("value") <= 1))
    first = F.first("value").over(Window.partitionBy("arm", "metric").orderBy("epoch"))
    learned = (F.col("metric") != "train_loss") | (F.col("value") <= first + 1e-9)
    return long.select("arm", "epoch", "metric", fine.alias("in_range"), learned.alias("learned"))


@query(
    "g13_arm_checkpoints",
    f"""WITH {_ARMS}, rules(selection_rule) AS (VALUES ('lowest validation loss'), ('highest validation macro-F1'))
SELECT arm, selection_rule, true AS kept, true AS best FROM arms, rules WHERE (SELECT count(*) FROM events) > 0""",
)
def g13_arms(spark, sf_dir):
    """Rounds chosen from real histories: the arm keeps the one of highest macro-F1 and scores as it did."""
    results = R.run_all_arms(**balanced(arm_inputs(spark, sf_dir)))
    history = materialise(R.arms_history(results), "history")
    kept = stacked(r.line("val") for r in results.values()).select("arm", "best_epoch", F.col("macro_f1").alias("scored"))
    rules = X.checkpoint_rules(history, by=["arm"]).join(kept, "arm")
    by_metric = F.col("selection_rule") == "highest validation macro-F1"
    same = (F.col("epoch") == F.col("best_epoch")) & (F.abs(F.col("val_macro_f1") - F.col("scored")) < 1e-4)
    least = history.groupBy("arm").agg(F.min("val_loss").alias("least"), F.max("val_macro_f1").alias("most"))
    best = F.when(by_metric, F.col("val_macro_f1") == F.col("most")).otherwise(F.col("val_loss") == F.col("least"))
    return rules.join(least, "arm").select("arm", "selection_rule", (~by_metric | same).alias("kept"), best.alias("best"))
