import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_rows import by_key
from signalloom.functions.ordering import hash_order
from signalloom.operators import balance as B
from signalloom.operators import ranking as R
from signalloom.operators import splits as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 3000 rows in one class, a class of one row, NULL labels, the rest spread."""
    i = F.col("id")
    label = (
        F.when(i < 1000, 0).when(i == 1000, 1).when(i < 1020, F.lit(None)).otherwise(2 + i % 5)
    )
    return spark.range(3000).select(i.cast("string").alias("beat_id"), label.cast("int").alias("label")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_order_equals_a_plain_window(spark, skewed, digits):
    marked = R.take_in_hash_order(
        skewed, ["label"], ["beat_id"], 5, lambda n: [F.lit(0), F.lit(7), n / 2, n, n * 2], digits
    )
    w = Window.partitionBy("label").orderBy(hash_order(5, "beat_id"), "beat_id")
    n = F.count("*").over(Window.partitionBy("label"))
    rn = F.row_number().over(w)
    plain = skewed.select(
        "beat_id", "label", n.alias("__n"), F.lit(False).alias("__in_0"), (rn <= 7).alias("__in_1"),
        (rn <= (n / 2).cast("long")).alias("__in_2"), F.lit(True).alias("__in_3"), F.lit(True).alias("__in_4"),
    )
    assert rows(marked.select(*plain.columns)) == rows(plain)


def test_split_equals_percent_rank_and_ignores_partitioning(spark, skewed):
    got = S.stratified_split(skewed.repartition(8))
    again = S.stratified_split(skewed.repartition(1))
    w = Window.partitionBy("label").orderBy(hash_order(42, "beat_id"), "beat_id")
    p = F.percent_rank().over(w)
    plain = skewed.select(
        "beat_id", "label", F.when(p < 0.7, "train").when(p < 0.7 + 0.15, "val").otherwise("test").alias("split_assigned")
    )
    assert rows(got) == rows(again) == rows(plain)
    assert rows(S.stratified_split(skewed, seed=1)) != rows(got)
    assert got.where("label = 1").first()["split_assigned"] == "train"


def test_wide_rows_are_not_shuffled(spark, skewed):
    wide = skewed.withColumn("payload", F.concat_ws("", F.array_repeat("beat_id", 50)))
    plan = S.stratified_split(wide)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_a_side_too_large_to_broadcast_is_joined_by_shuffle(spark, skewed):
    from signalloom.runtime import attach

    side = skewed.groupBy("label").agg(F.count("*").alias("n"))
    small = attach(skewed, side, ["label"])
    large = attach(skewed, side, ["label"], max_rows=2)
    assert rows(small) == rows(large)
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in large._jdf.queryExecution().executedPlan().toString()


def test_split_errors(skewed):
    with pytest.raises(ValueError):
        S.stratified_split(skewed, {"a": 0.5, "b": 0.4})
    with pytest.raises(ValueError):
        S.stratified_subsample(skewed, 0.0)
    with pytest.raises(ValueError):
        S.stratified_subsample(skewed, 1.5)


def test_holdout_keeps_test_and_null_splits(spark, five_classes):
    some = five_classes.withColumn("split", F.when(F.col("beat_id") != "0-1", F.col("split")))
    out = S.holdout_validation(some)
    assert out.count() == 100
    assert out.where("split = 'test'").select("split_final").distinct().collect()[0][0] == "test"
    assert out.where("beat_id = '0-1'").first()["split_final"] is None
    counts = {r[0]: r[1] for r in out.groupBy("split_final").count().collect()}
    assert counts["test"] == 21 and counts["val"] > 5 and counts["train"] + counts["val"] == 78


def test_subsample_floor(spark, five_classes):
    out = S.stratified_subsample(five_classes, 0.1)
    n = {r["label"]: r["n"] for r in B.class_counts(out).collect()}
    assert n == {0: 6, 1: 2, 2: 2, 3: 2, 4: 2}
    assert S.stratified_subsample(five_classes, 1.0).count() == 100


def test_split_tables(spark, five_classes):
    out = S.holdout_validation(five_classes)
    shares = S.split_shares(out, "split_final", ["train", "val", "test"])
    for split in ("train", "val", "test"):
        assert sum(r[split] or 0 for r in shares.collect()) == pytest.approx(100, abs=0.01)
    table = by_key(S.describe_splits(out, ["N", "S", "V", "F", "Q"]), "split")
    assert table["test"]["N"] == 12 and table["train"]["samples"] == 187
    assert sum(f.count() for f in S.split_frames(out).values()) == 100


def test_weights(spark, five_classes):
    w = {r["label"]: r["weight"] for r in B.class_weights(five_classes).collect()}
    assert w[0] == pytest.approx(100 / (5 * 60)) and w[3] == pytest.approx(100 / (5 * 4))
    absent = {r["label"]: r["weight"] for r in B.class_weights(five_classes, labels=range(6)).collect()}
    assert absent[5] == 0.0 and absent[0] == pytest.approx(100 / (6 * 60))
    total = B.add_class_weight(five_classes).agg(F.sum("class_weight")).first()[0]
    assert total == pytest.approx(100)
    given = B.add_class_weight(five_classes, {0: 2.0}).where("label = 0").first()["class_weight"]
    assert given == 2.0
    assert B.add_class_weight(five_classes, {0: 2.0}).where("label = 1").first()["class_weight"] is None


def test_resample_sizes(spark, five_classes, monkeypatch):
    def sizes(df):
        return {r["label"]: r["n"] for r in B.class_counts(df).collect()}

    assert set(sizes(B.resample(five_classes, "undersample")).values()) == {4}
    over = B.resample(five_classes, "oversample")
    assert set(sizes(over).values()) == {60}
    assert over.columns == five_classes.columns
    assert over.select("beat_id").distinct().count() == 100
    monkeypatch.setattr(B, "COPIES_PER_STEP", 4)
    stepped = B.resample(five_classes, "oversample")
    assert rows(stepped.select("beat_id", "label")) == rows(over.select("beat_id", "label"))
    loose = sizes(B.resample(five_classes, "oversample", mode="bernoulli"))
    assert loose[0] == 60 and all(30 <= n <= 60 for n in loose.values())
    assert sizes(B.resample(five_classes, "undersample", mode="bernoulli"))[3] == 4
    with pytest.raises(ValueError):
        B.resample(five_classes, "smote")


def test_resample_with_one_hot_class(spark, skewed):
    labelled = skewed.where("label is not null")
    n = {r["label"]: r["n"] for r in B.class_counts(B.resample(labelled, "oversample")).collect()}
    assert set(n.values()) == {1000}


@pytest.mark.parametrize("limit", [10_000, 7])
def test_running_totals(spark, limit):
    values = spark.range(200).select(
        (F.col("id") % 2).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("v"), F.lit(1).alias("c")
    ).groupBy("g", "v").agg(F.sum("c").alias("c"))
    got = {(r.g, r.v): (r.c_below, r.c_total) for r in R.running_totals(values, ["g"], "v", ["c"], limit).collect()}
    data = [(r.g, r.v, r.c) for r in values.collect()]
    for g, v, _ in data:
        assert got[g, v] == (sum(c for a, b, c in data if a == g and b < v), 100)
    ungrouped = R.running_totals(values.groupBy("v").agg(F.sum("c").alias("c")), [], "v", ["c"], limit)
    top = ungrouped.orderBy(F.col("v").desc()).first()
    assert top.c_below + top.c == 200


def test_weights_count_rows_outside_the_list(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (9,), (None,)], "label int")
    w = {r["label"]: r["weight"] for r in B.class_weights(df, labels=[0, 1]).collect()}
    assert w == {0: pytest.approx(5 / 4), 1: pytest.approx(5 / 2)}


@pytest.mark.parametrize("mode", ["exact", "bernoulli"])
def test_resample_takes_any_number_of_classes(spark, mode):
    df = spark.range(25_000).selectExpr("id as beat_id", "cast(id % 12000 as int) as label")
    under = B.resample(df, "undersample", mode=mode).groupBy("label").count()
    over = B.resample(df, "oversample", mode=mode).groupBy("label").count()
    if mode == "exact":
        assert under.count() == over.count() == 12_000
        assert {r[0] for r in under.select("count").distinct().collect()} == {2}
        assert {r[0] for r in over.select("count").distinct().collect()} == {3}
    else:
        assert abs(under.agg(F.sum("count")).first()[0] - 24_000) < 700
        assert abs(over.agg(F.sum("count")).first()[0] - 36_000) < 1_000
