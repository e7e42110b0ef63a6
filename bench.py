"""Time the main jobs on one machine; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of threads. Signals are
made from ``lineitem`` once, as stored input; each line then times one job the way
a user would run it: from stored input to a finished result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.catalog import base
from signalloom.catalog.metrics import predictions, two_class
from signalloom.operators import balance as B
from signalloom.operators import metrics as M
from signalloom.operators import profile as P
from signalloom.operators import splits as S
from signalloom.operators.descriptors import add_descriptors
from signalloom.plans import features as PF
from signalloom.plans import models as PM
from signalloom.runtime import scratch_path
from signalloom.sources import ingest as I
from signalloom.sources.views import LINE_SPEC
from signalloom.spec import RAW_LABEL

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
LABELS = ["A", "N", "R"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # The default packs these small inputs into fewer splits than there are threads.
        .config("spark.sql.files.minPartitionNum", CPUS)
        .config("spark.sql.files.openCostInBytes", "262144")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}

    def timed(name, job):
        started = time.monotonic()
        result = job()
        if isinstance(result, DataFrame):
            run(result)
        seconds[name] = round(time.monotonic() - started, 3)
        print(f"{name:32s} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
        return result

    # The first job of a session pays for starting it; let that be an untimed one.
    run(spark.read.parquet(f"{SF_DIR}/events.parquet").groupBy("event_type").count())

    folder = scratch_path(spark, "bench")
    timed(
        "grid_signals_from_lineitem",
        lambda: base.lines(spark, SF_DIR).write.parquet(f"{folder}/signals"),
    )
    # Input matrices, as a user would find them.
    files = {"lines": I.RawFile("lines", "lines", "full", "lines.csv")}
    wide = [F.get("signal", F.lit(i)).alias(c) for i, c in enumerate(LINE_SPEC.sample_columns)]
    spark.read.parquet(f"{folder}/signals").select(
        *wide, F.col("label").cast("double").alias(RAW_LABEL)
    ).write.csv(f"{folder}/lines.csv", header=False)

    # Ingestion.
    timed("ingest_csv_to_parquet", lambda: I.ingest_all(spark, files, folder, f"{folder}/t", LINE_SPEC) and None)
    signals = I.load_table(spark, f"{folder}/t")
    timed("round_trip", lambda: I.round_trip_counts(I.load_raw_files(spark, files, folder, spec=LINE_SPEC), signals))

    # Profiling: every report of the profiling script.
    timed("descriptors", lambda: add_descriptors(signals, spec=LINE_SPEC))
    timed("overview", lambda: P.dataset_overview(signals))
    distribution = P.class_distribution(signals, spec=LINE_SPEC)
    timed("class_distribution", lambda: distribution)
    timed("imbalance", lambda: P.imbalance_summary(distribution))
    timed("quality", lambda: P.quality_report(signals, spec=LINE_SPEC))
    timed("duplicates", lambda: P.duplicate_report(signals))
    timed("padding", lambda: P.padding_report(signals, spec=LINE_SPEC))
    timed("feature_summary", lambda: P.feature_summary(signals, spec=LINE_SPEC))
    timed("correlation", lambda: P.feature_correlation(signals, spec=LINE_SPEC))
    timed("rank_correlation", lambda: P.feature_correlation(signals, method="spearman", spec=LINE_SPEC))
    timed("waveform_profile", lambda: P.waveform_profile(signals, spec=LINE_SPEC))
    timed("mean_waveform", lambda: P.mean_waveform(signals, spec=LINE_SPEC))
    timed("sample_signals", lambda: P.sample_signals(signals, spec=LINE_SPEC))
    timed("length_histogram", lambda: P.length_histogram(signals, spec=LINE_SPEC))

    # Splits and balance.
    timed("stratified_split", lambda: S.stratified_split(signals))
    timed("subsample", lambda: S.stratified_subsample(signals, 0.1))
    timed("oversample", lambda: B.resample(signals, "oversample"))

    # Metrics on a prediction per event.
    timed("summary_metrics", lambda: M.summary_metrics(M.confusion_counts(predictions(spark, SF_DIR), base.NAMES)))
    timed("binary_curves", lambda: M.binary_curves(two_class(spark, SF_DIR)))
    narrow = M.narrow_predictions(predictions(spark, SF_DIR))
    timed("evaluate", lambda: M.evaluate(narrow, base.NAMES)["summary"])
    timed("one_vs_rest_auc", lambda: M.one_vs_rest_auc(predictions(spark, SF_DIR), len(base.NAMES)))

    # Features and classifiers, with the registry's full settings.
    timed(
        "build_features",
        lambda: PF.build_dataset(signals, "lines", False, destination=f"{folder}/m", spec=LINE_SPEC) and None,
    )
    rows = PF.load_dataset(spark, f"{folder}/m")
    for name in PM.DEFAULT_BASELINES:
        timed(f"fit_and_score_{name}", lambda: PM.run_baselines(rows, LABELS, [name]) and None)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "signals": signals.count(),
                "samples_per_signal": LINE_SPEC.n_samples,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
