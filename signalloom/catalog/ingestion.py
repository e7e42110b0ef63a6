"""Section A: sources, sinks and ingestion, on matrices written from the event signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.catalog.base import (
    EVENT_LONG,
    EVENT_ROWS,
    NAMES,
    SPEC,
    beats,
    big,
    query,
    r,
    r6,
    rounded_doubles,
    table,
)
from signalloom.catalog.metrics import PER_CLASS_LINES, SCORED, predictions
from signalloom.catalog.profiles import DISTRIBUTION
from signalloom.catalog.splits import HOLDOUT
from signalloom.operators import metrics as M
from signalloom.operators import profile as P
from signalloom.operators.splits import holdout_validation
from signalloom.runtime import scratch_path
from signalloom.sources import ingest as I
from signalloom.sources.reports import save_evaluation, save_table
from signalloom.spec import (
    RAW_LABEL,
    canonical_schema,
    conform,
    describe_labels,
    raw_schema,
    schema_violations,
)

FILES = {
    f"{source}_{split}": I.RawFile(f"{source}_{split}", source, split, f"source={source}/split={split}")
    for source in ("a", "b")
    for split in ("train", "test")
}


def write_matrices(spark: SparkSession, sf_dir: str) -> str:
    """Write the event signals as head-less CSV matrices, one folder per source and split."""
    base = scratch_path(spark, "matrices")
    wide = [F.get("signal", F.lit(i)).alias(c) for i, c in enumerate(SPEC.sample_columns)]
    matrix = beats(spark, sf_dir).select(
        *wide, F.col("label").cast("double").alias(RAW_LABEL), "source", "split"
    )
    matrix.write.partitionBy("source", "split").csv(base, header=False)
    return base


def samples_of(df: DataFrame, *keep: str) -> DataFrame:
    """Long form for comparing arrays value by value."""
    return df.select(*keep, F.posexplode("signal").alias("t", "x")).withColumn("x", r6("x"))


_WIDE = ", ".join(f"{r(f'max(CASE WHEN slot = {i} THEN x END)')} AS s{i:03d}" for i in range(31))


@query(
    "a01_read_raw_csv",
    f"""WITH {EVENT_LONG}
SELECT {_WIDE}, CAST(label AS DOUBLE) AS label_raw FROM long WHERE source = 'a' AND split = 'train'
GROUP BY beat_id, label""",
)
def a01(spark, sf_dir):
    base = write_matrices(spark, sf_dir)
    return rounded_doubles(I.read_raw_csv(spark, f"{base}/{FILES['a_train'].path}", SPEC))


_COLUMNS_SQL = " UNION ALL ".join(
    f"SELECT 's{i:03d}' AS name, {big('count(*)')} AS n_values, {r(f'sum(CASE WHEN slot = {i} THEN x END)')} AS total "
    f"FROM long WHERE slot = {i}"
    for i in range(31)
)


@query(
    "a02_raw_schema",
    f"""WITH {EVENT_LONG} {_COLUMNS_SQL}
UNION ALL SELECT 'label_raw', {big('count(*)')}, {r('sum(label)')} FROM long WHERE slot = 0""",
)
def a02(spark, sf_dir):
    base = write_matrices(spark, sf_dir)
    paths = [f"{base}/{f.path}" for f in FILES.values()]
    raw = spark.read.csv(paths, schema=raw_schema(SPEC), header=False, mode="FAILFAST")
    lines = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in raw.columns]
    )
    per_column = raw.select(F.inline(lines)).groupBy("name")
    return per_column.agg(F.count("value").alias("n_values"), r6(F.sum("value")).alias("total"))


@query(
    "a03_schema_violations",
    f"""WITH {EVENT_LONG},
lengths AS (SELECT beat_id, label, count(*) AS n, sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END) AS filled
  FROM long GROUP BY ALL)
SELECT 'wrong_length' AS violation, {big('count(*)')} AS n FROM lengths WHERE filled > 12 AND label IN (0, 1)
UNION ALL SELECT 'null_label', {big('count(*)')} FROM lengths WHERE label NOT IN (0, 1)""",
)
def a03(spark, sf_dir):
    filled = F.size(F.filter("signal", lambda x: x != 0.0))
    damaged = beats(spark, sf_dir).withColumns(
        {
            "signal": F.when(filled > 12, F.slice("signal", 1, 30)).otherwise(F.col("signal")),
            "label": F.when(F.col("label").isin(0, 1), F.col("label")),
        }
    )
    broken = schema_violations(conform(damaged), SPEC)
    return broken.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a04_to_canonical",
    f"""WITH {EVENT_LONG}
SELECT source, split, label, label_name, CAST(slot AS INTEGER) AS t, {r('x')} AS x FROM long
WHERE source = 'a' AND split = 'train'""",
)
def a04(spark, sf_dir):
    f = FILES["a_train"]
    raw = I.read_raw_csv(spark, f"{write_matrices(spark, sf_dir)}/{f.path}", SPEC)
    canonical = I.to_canonical(raw, f.source, f.split, f.key, SPEC)
    return samples_of(canonical, "source", "split", "label", "label_name")


@query(
    "a05_load_raw_file",
    f"""WITH {EVENT_ROWS}
SELECT label, label_name, {big('count(*)')} AS n, {big('count(*)')} AS n_ids FROM rows
WHERE source = 'b' AND split = 'test' GROUP BY label, label_name""",
)
def a05(spark, sf_dir):
    loaded = I.load_raw_file(spark, FILES["b_test"], write_matrices(spark, sf_dir), SPEC)
    return loaded.groupBy("label", "label_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("beat_id").alias("n_ids")
    )


_COUNTS = f"SELECT source, split, label, {big('count(*)')} AS n FROM rows"


@query(
    "a06_load_collection",
    f"WITH {EVENT_ROWS} {_COUNTS} WHERE source = 'a' GROUP BY source, split, label",
)
def a06(spark, sf_dir):
    base = write_matrices(spark, sf_dir)
    loaded = I.load_raw_files(spark, FILES, base, source="a", spec=SPEC)
    return loaded.groupBy("source", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("a06_load_all", f"WITH {EVENT_ROWS} {_COUNTS} GROUP BY source, split, label")
def a06_all(spark, sf_dir):
    loaded = I.load_raw_files(spark, FILES, write_matrices(spark, sf_dir), spec=SPEC)
    return loaded.groupBy("source", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("a07_write_parquet", f"WITH {EVENT_ROWS} {_COUNTS} GROUP BY source, split, label")
def a07(spark, sf_dir):
    path = I.write_parquet(beats(spark, sf_dir), scratch_path(spark, "stored"))
    # The folder names carry the partition values.
    folder = F.regexp_extract(F.input_file_name(), "source=([^/]+)/split=([^/]+)/", 1)
    split = F.regexp_extract(F.input_file_name(), "source=([^/]+)/split=([^/]+)/", 2)
    stored = spark.read.parquet(path).select("label", folder.alias("source"), split.alias("split"))
    return stored.groupBy("source", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a08_read_parquet",
    f"SELECT event_type, {big('count(*)')} AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY event_type",
)
def a08(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = I.read_parquet(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "a09_ingest_all",
    f"""WITH {EVENT_LONG}
SELECT source, split, label, label_name, CAST(slot AS INTEGER) AS t, {r('x')} AS x FROM long""",
)
def a09(spark, sf_dir):
    stored = I.ingest_all(
        spark, FILES, write_matrices(spark, sf_dir), scratch_path(spark, "stored"), SPEC
    )
    return samples_of(stored, "source", "split", "label", "label_name")


@query(
    "a10_load_filtered",
    f"WITH {EVENT_ROWS} SELECT beat_id, label FROM rows WHERE source = 'b' AND split = 'train'",
)
def a10(spark, sf_dir):
    path = I.write_parquet(beats(spark, sf_dir), scratch_path(spark, "stored"))
    return I.load_signals(spark, path, FILES, source="b", split="train", spec=SPEC).select(
        "beat_id", "label"
    )


@query(
    "a10_load_falls_back_to_raw",
    f"WITH {EVENT_ROWS} {_COUNTS} WHERE split = 'test' GROUP BY source, split, label",
)
def a10_raw(spark, sf_dir):
    base = write_matrices(spark, sf_dir)
    loaded = I.load_signals(spark, f"{base}/absent", FILES, base, split="test", spec=SPEC)
    return loaded.groupBy("source", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a11_describe_labels",
    f"""WITH {EVENT_ROWS}
SELECT beat_id, source, label_name, concat('daily ', label_name, ' amounts') AS description FROM rows""",
)
def a11(spark, sf_dir):
    rows = beats(spark, sf_dir).select("beat_id", "source", "label_name")
    return describe_labels(rows, SPEC)


@query(
    "a12_round_trip",
    f"""WITH {EVENT_ROWS}
SELECT source, split, label, {big('count(*)')} AS n_before, {big('count(*)')} AS n_after
FROM rows GROUP BY source, split, label""",
)
def a12(spark, sf_dir):
    base = write_matrices(spark, sf_dir)
    before = I.load_raw_files(spark, FILES, base, spec=SPEC)
    after = I.ingest_all(spark, FILES, base, scratch_path(spark, "stored"), SPEC)
    return I.round_trip_counts(before, after)


@query(
    "a13_raw_label_histogram",
    f"""WITH {EVENT_ROWS}
SELECT CAST(label AS DOUBLE) AS label_raw, {big('count(*)')} AS n FROM rows
WHERE source = 'a' AND split = 'train' GROUP BY label""",
)
def a13(spark, sf_dir):
    base = write_matrices(spark, sf_dir)
    return I.raw_label_histogram(I.read_raw_csv(spark, f"{base}/{FILES['a_train'].path}", SPEC))


@query(
    "a14_storage_footprint",
    f"""WITH {EVENT_ROWS}
SELECT source, name, true AS stored, true AS smaller FROM (SELECT DISTINCT source FROM rows), (VALUES ('csv'), ('parquet')) t(name)""",
)
def a14(spark, sf_dir):
    """Files of either kind for each collection, and that the columnar ones take less."""
    base = write_matrices(spark, sf_dir)
    stored = I.write_parquet(beats(spark, sf_dir), scratch_path(spark, "stored"))
    paths = {f"{s}/{n}": f"{p}/source={s}" for s in ("a", "b") for n, p in (("csv", base), ("parquet", stored))}
    found = I.storage_footprint(spark, paths)
    source, name = (F.get(F.split("name", "/"), F.lit(k)) for k in (0, 1))
    lines = found.select(source.alias("source"), name.alias("name"), "files", "bytes")
    most = F.max("bytes").over(Window.partitionBy("source"))
    smaller = F.when(F.col("name") == "csv", F.col("bytes") == most).otherwise(F.col("bytes") < most)
    has_files = (F.col("files") > 0) & (F.col("bytes") > 0)
    return lines.select("source", "name", has_files.alias("stored"), smaller.alias("smaller"))


@query(
    "a04_stable_ids",
    f"""WITH {EVENT_ROWS}
SELECT label, {big('count(*)')} AS n, {big('count(*)')} AS n_ids, {big('count(*)')} AS n_same FROM rows
WHERE source = 'a' AND split = 'train' GROUP BY label""",
)
def a04_ids(spark, sf_dir):
    """Ids of one matrix, read in its own parts and dealt out anew."""
    f = FILES["a_train"]
    raw = I.read_raw_csv(spark, f"{write_matrices(spark, sf_dir)}/{f.path}", SPEC)
    first, second = (I.to_canonical(x, f.source, f.split, f.key, SPEC) for x in (raw, raw.repartition(13)))
    other = second.select("beat_id", F.hash("signal", "label").alias("content"))
    both = first.withColumn("content", F.hash("signal", "label")).join(other, ["beat_id", "content"], "left_semi")
    same = both.groupBy("label").agg(F.count(F.lit(1)).alias("n_same"))
    counts = first.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("beat_id").alias("n_ids"))
    return counts.join(same, "label")


@query("a15_save_table", f"WITH {DISTRIBUTION} SELECT * FROM dist")
def a15(spark, sf_dir):
    report = P.class_distribution(beats(spark, sf_dir), spec=None)
    path = save_table(report, scratch_path(spark, "reports"), "class_distribution")
    return spark.read.csv(path, schema=report.schema, header=True, mode="FAILFAST")


@query("a15_save_json", f"WITH {DISTRIBUTION} SELECT * FROM dist")
def a15_json(spark, sf_dir):
    report = P.class_distribution(beats(spark, sf_dir), spec=None)
    path = save_table(report, scratch_path(spark, "reports"), "class_distribution", "json")
    return spark.read.json(path, schema=report.schema, mode="FAILFAST")


@query("a16_save_evaluation", f"WITH {SCORED} {PER_CLASS_LINES}")
def a16(spark, sf_dir):
    evaluation = M.evaluate(M.narrow_predictions(predictions(spark, sf_dir)), NAMES, "hash")
    written = save_evaluation(evaluation, scratch_path(spark, "reports"), "events_hash_test")
    schema = evaluation["per_class"].schema
    return spark.read.csv(written["per_class"], schema=schema, header=True, mode="FAILFAST")


@query(
    "a18_training_matrix",
    f"""WITH {HOLDOUT}
SELECT split_final, f.label, CAST(slot AS INTEGER) AS t, {r('CAST(x AS FLOAT)')} AS x
FROM final f JOIN long l ON f.beat_id = l.beat_id""",
)
def a18(spark, sf_dir):
    matrix = I.training_matrix(holdout_validation(beats(spark, sf_dir)), spec=SPEC)
    stored = I.write_parquet(matrix, scratch_path(spark, "matrix"), ["split_final"])
    long = spark.read.parquet(stored).select(
        "split_final", "label", F.posexplode("samples").alias("t", "x")
    )
    return long.withColumn("x", r6(F.col("x").cast("double")))


__all__ = ["FILES", "canonical_schema", "write_matrices"]


_ODD = """CASE CAST(user_id AS BIGINT) % 6 WHEN 0 THEN CAST(1.7 AS DOUBLE) WHEN 1 THEN CAST('nan' AS DOUBLE)
  WHEN 2 THEN CAST('inf' AS DOUBLE) WHEN 3 THEN CAST(3000000000 AS DOUBLE) WHEN 4 THEN NULL ELSE CAST(user_id % 5 AS DOUBLE) END"""


def _odd_labels(spark, sf_dir):
    kind = F.col("user_id").cast("long") % 6
    odd = [F.lit(1.7), F.lit(float("nan")), F.lit(float("inf")), F.lit(3e9), F.lit(None).cast("double")]
    label = F.when(F.lit(False), F.lit(0.0))
    for k, value in enumerate(odd):
        label = label.when(kind == k, value)
    label = label.otherwise((F.col("user_id") % 5).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", label.alias(I.RAW_LABEL))


@query(
    "a04_odd_labels",
    f"""WITH raw AS (SELECT event_id, {_ODD} AS x FROM events)
SELECT event_id, CAST(CASE WHEN x BETWEEN 0 AND 4 AND x = floor(x) THEN x END AS INTEGER) AS label FROM raw""",
)
def a04_odd(spark, sf_dir):
    return _odd_labels(spark, sf_dir).select("event_id", I.label_code(F.col(I.RAW_LABEL)).alias("label"))


@query(
    "a13_label_problems",
    f"""WITH raw AS (SELECT CAST(user_id AS BIGINT) % 6 AS k, count(*) AS n FROM events GROUP BY 1),
checks("check", k) AS (VALUES ('non_integer_label', 0), ('nan_label', 1), ('infinite_label', 2), ('label_out_of_range', 3), ('null_label', 4))
SELECT "check", CAST(coalesce(n, 0) AS BIGINT) AS n_rows FROM checks LEFT JOIN raw USING (k)""",
)
def a13_problems(spark, sf_dir):
    return I.label_problems(_odd_labels(spark, sf_dir))
