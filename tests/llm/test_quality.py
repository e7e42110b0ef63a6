"""Operator 12 against a plain version and on labels it did not see."""

import random
import zlib

import numpy as np
import pytest
from corpus_rows import ODD_ROWS, TEXTS
from pyspark.sql import functions as F

from signalloom.llm import quality
from signalloom.llm.queries import QUERIES


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 150))]
        if bad and k % 8:
            words = [w.upper() + "!!" for w in words]
        elif bad:
            words = [rng.choice(words[:4]) + rng.choice(["", "|"]) for _ in words]
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(not bad)))
    return spark.createDataFrame(docs, TEXTS), spark.createDataFrame(labels, "doc_id long, quality int")


def plain_scores(texts, y, train, tuned, settings=quality.Settings()):
    """Scores by covariances of the rows themselves and solving instead of factors."""
    x = np.array([quality.statistics_of((t or "").encode()) for t in texts])

    def differences(rows, pooled, identity):
        center, scale = x[rows].mean(0), x[rows].std(0)
        scale[scale < 1e-6] = 1
        z = (x - center) / scale
        spread = [np.cov(z[rows & (y == c)].T, bias=True) for c in (0, 1)]
        n = [int((rows & (y == c)).sum()) for c in (0, 1)]
        shared = (spread[0] * n[0] + spread[1] * n[1]) / sum(n)
        out = []
        for c in (0, 1):
            s = (1 - pooled) * spread[c] + pooled * shared
            s = (1 - identity) * s + (identity * np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
            d = z - z[rows & (y == c)].mean(0)
            distance = (d * np.linalg.solve(s, d.T).T).sum(1)
            out.append(np.log(n[c] / sum(n)) - np.linalg.slogdet(s)[1] / 2 - distance / 2)
        return out[1] - out[0]

    best = None
    for pooled in settings.pooled:
        for identity in settings.identity:
            slope, constant, loss = quality.curve(differences(train & ~tuned, pooled, identity)[train & tuned], y[train & tuned].astype(float))
            if slope > 0 and (best is None or loss < best[0] - 1e-12):
                best = (loss, pooled, identity, slope, constant)
    _, pooled, identity, slope, constant = best
    return 1 / (1 + np.exp(-np.clip(slope * np.arcsinh(differences(train, pooled, identity)) + constant, -40, 40)))


def frame(spark, docs, labels):
    tuned = (F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(4)) == 0).alias("tuned")
    return docs.join(labels, "doc_id", "left").select("*", tuned).toPandas().sort_values("doc_id")


def test_scores_equal_plain_ones(spark):
    docs, labels = labelled(spark)
    rows = frame(spark, docs, labels)
    train = np.array([zlib.crc32(str(k).encode()) % 3 != 1 for k in rows.doc_id])
    want = plain_scores(rows.text.tolist(), rows.quality.to_numpy(), train, rows.tuned.to_numpy())
    got = quality.scored(docs, labels).toPandas().sort_values("doc_id")
    assert np.allclose(got.score, want, atol=1e-4)
    assert (got.held_out.to_numpy() == ~train).all()
    held = got[got.held_out]
    assert (held.predicted == rows.quality[got.held_out.to_numpy()].to_numpy()).mean() > 0.97


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark, 300)
    hidden = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (quality.scored(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert np.allclose(first, second)


def test_moments_add_up(spark):
    docs, labels = labelled(spark, 200)
    rows = quality.statistics(docs.repartition(5)).join(labels, "doc_id").withColumn("t", F.col("doc_id") % 3 == 0)
    found = quality.moments(rows, "quality", "t")
    plain = rows.toPandas()
    for (c, t), m in found.items():
        x = np.array(plain[(plain.quality == c) & (plain.t == t)].statistics.tolist())
        assert m.n == len(x) and np.allclose(m.total, x.sum(0)) and np.allclose(m.scatter() / m.n, np.cov(x.T, bias=True))


def test_odd_rows(spark, odd, empty, no_labels):
    extra = odd.withColumn("score", odd.text).withColumn("statistics", odd.text)
    rows = quality.scored(extra, no_labels).collect()
    assert len(rows) == len(ODD_ROWS) and {r.score for r in rows} == {0.5}
    assert quality.scored(empty, no_labels).count() == 0
    docs, labels = labelled(spark, 300)
    more = [*ODD_ROWS, (1, "word " * 400_000), (2, "x" * 3_000_000)]
    both = docs.union(spark.createDataFrame([(None if k is None else 10_000 + k, t) for k, t in more], TEXTS))
    rows = [r for r in quality.scored(both, labels).collect() if r.doc_id is None or r.doc_id >= 10_000]
    assert len(rows) == len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[10_010] == by[10_011] and len(by[10_007]) == 2
    assert by[10_003] == by[10_004]  # NULL and empty


@pytest.mark.parametrize(("label", "score"), [(0, 0.0), (1, 1.0)])
def test_one_class(spark, label, score):
    docs, labels = labelled(spark, 60)
    rows = quality.scored(docs, labels.withColumn("quality", F.lit(label))).collect()
    assert {r.score for r in rows} == {score}


def test_few_labels(spark):
    docs, labels = labelled(spark, 60)
    few = labels.where("doc_id < 14")
    rows = quality.scored(docs, few.union(few)).collect()
    assert len(rows) == 60 and all(0 <= r.score <= 1 for r in rows)


def test_op12_query(spark, folder, documents):
    rows = QUERIES["op12_quality_classifier"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents.doc_id)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) >= 0.9
