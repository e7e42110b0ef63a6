import pytest

from signal_rows import as_dicts, by_key
from signalloom.operators import experiments as X

# Published runs, curve and arms, and the tables made from them.
RUNS = [
    (42, "scratch", 0.9857), (42, "frozen", 0.9272), (42, "finetune", 0.9881),
    (7, "scratch", 0.9869), (7, "frozen", 0.9328), (7, "finetune", 0.9818),
    (2024, "scratch", 0.9835), (2024, "frozen", 0.9418), (2024, "finetune", 0.9807),
]
CURVE = [
    (204, 0.7944, 0.7934, 0.8029, -0.001, 0.0085), (510, 0.7571, 0.8222, 0.8993, 0.0651, 0.1422),
    (1018, 0.9252, 0.8676, 0.9248, -0.0576, -0.0004), (2546, 0.9721, 0.8961, 0.9599, -0.076, -0.0122),
]


def test_seed_tables(spark):
    runs = spark.createDataFrame(RUNS, "seed int, arm string, macro_f1 double")
    got = [tuple(r.values())[:7] for r in as_dicts(X.seed_summary(runs))]
    assert got == [
        ("scratch", 0.9854, 0.0017, 0.9835, 0.9869, 3, 0.0),
        ("frozen", 0.9339, 0.0074, 0.9272, 0.9418, 3, -0.0515),
        ("finetune", 0.9835, 0.004, 0.9807, 0.9881, 3, -0.0019),
    ]
    pivot = by_key(X.seed_pivot(runs), "seed")
    assert pivot[2024]["frozen"] == 0.9418
    assert "delta_vs_scratch" not in X.seed_summary(runs.where("arm != 'scratch'")).columns


def test_curve_deltas(spark):
    long = [(n, arm, v) for n, s, z, f, *_ in CURVE for arm, v in (("scratch", s), ("frozen", z), ("finetune", f))]
    table = by_key(X.curve_deltas(spark.createDataFrame(long, "n_train int, arm string, macro_f1 double")), "n_train")
    for n, *_, frozen, finetune in CURVE:
        assert table[n]["frozen - scratch"] == frozen and table[n]["finetune - scratch"] == finetune


def test_transfer_gain(spark):
    arms = spark.createDataFrame([("scratch", 0.9841, 38), ("frozen", 0.9285, 49), ("finetune", 0.9841, 44)], "arm string, macro_f1 double, epochs int")
    gain = by_key(X.transfer_gain(arms, keep=["epochs"]), "arm")
    assert gain["frozen"]["delta_vs_scratch"] == -0.0556
    assert gain["frozen"]["relative_error_reduction"] == pytest.approx(-3.4969, abs=1e-3)
    assert gain["finetune"]["delta_vs_scratch"] == 0.0 and gain["frozen"]["epochs"] == 49
    perfect = arms.selectExpr("arm", "1.0D as macro_f1")
    assert X.transfer_gain(perfect).first()["relative_error_reduction"] is None
    with pytest.raises(KeyError):
        X.transfer_gain(arms.where("arm = 'frozen'"))


def test_histories(spark):
    rows = [("a", 1, 0.9, 0.5, 30.0), ("a", 2, 0.4, 0.7, 30.0), ("a", 3, 0.4, 0.7, 60.0), ("a", 4, 0.8, 0.6, 60.0)]
    history = spark.createDataFrame(rows, "arm string, epoch int, val_loss double, val_macro_f1 double, seconds double")
    rules = by_key(X.checkpoint_rules(history), "selection_rule")
    assert {r["epoch"] for r in rules.values()} == {2}
    (digest,) = as_dicts(X.history_digest(history))
    assert (digest["epochs"], digest["best_epoch"], digest["first_val_macro_f1"], digest["minutes"]) == (4, 2, 0.5, 3.0)
    long = X.history_to_long(history, keep=["arm"])
    assert long.count() == 12 and long.columns == ["epoch", "arm", "metric", "value"]
