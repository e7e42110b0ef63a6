"""Operator 1: every letter sequence counts, whatever the size of the table."""

import collections
import random

import numpy as np

from signalloom.llm import toxicity


def mixed_texts(spark, n=400):
    rng = random.Random(12)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            words += ["zorg" + rng.choice("abcdefgh")] * rng.randint(1, 3)
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    docs.append((n, None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_score_does_not_depend_on_slots(spark):
    docs, labels = mixed_texts(spark)
    wide, narrow = (toxicity.scored(docs, labels, settings=toxicity.Settings(slot_bits=b)).toPandas().sort_values("doc_id") for b in (22, 2))
    assert len(wide) == len(narrow) == 401
    assert np.allclose(wide.score, narrow.score) and np.allclose(wide.log_ratio, narrow.log_ratio)


def key_of(raw):
    return int.from_bytes(raw, "big") | len(raw) << 48


def test_class_models_are_probabilities(spark):
    texts = ["ordinary words repeat", "letters follow letters", "bad bade badly", "words bad"]
    docs = spark.createDataFrame([(t, int(k > 1)) for k, t in enumerate(texts)], "text string, toxic int")
    settings = toxicity.Settings(order=3)
    grams = toxicity.class_counts(docs, "text", "toxic", settings)
    rows = toxicity.class_models(grams, settings).collect()
    p = {r.key: (r.p0, r.p1) for r in rows if not r.key & toxicity.UNSEEN}
    share = {r.key ^ toxicity.UNSEEN: (r.p0, r.p1) for r in rows if r.key & toxicity.UNSEEN}
    assert set(share) == {(k & (1 << 48) - 1) >> 8 | ((k >> 48) - 1) << 48 for k in p}
    letters = collections.defaultdict(list)
    for k in p:
        letters[(k & (1 << 48) - 1) >> 8 | ((k >> 48) - 1) << 48].append(k)
    total = [sum(p[k][c] for k in letters[0]) for c in (0, 1)]
    pooled = sum(r.p for r in toxicity.shared_backoff(grams, settings).collect() if r.gram >> 48 == 1)
    assert np.allclose(total, [1 - share[0][c] * (1 - pooled) for c in (0, 1)])
    assert all(sum(p[k][c] for k in found) <= 1 + 1e-9 for found in letters.values() for c in (0, 1))
    # A letter seen in one class only is likelier there.
    assert p[key_of(b"bad")][1] > p[key_of(b"bad")][0]
    assert p[key_of(b"let")][0] > p[key_of(b"let")][1]


def test_unseen_sequences_back_off(spark):
    texts = ["ordinary words repeat here", "letters follow letters", "zorg zorgs zorga", "azorg"]
    docs = spark.createDataFrame([(t, int(k > 1)) for k, t in enumerate(texts)], "text string, toxic int")
    settings = toxicity.Settings()
    ratios = toxicity.log_ratios(toxicity.class_counts(docs, "text", "toxic", settings), settings)
    words = spark.createDataFrame([(b"xxzorg",), (b"xxword",)], "word binary")
    found = {bytes(r.word): r.score for r in toxicity.word_scores(words, ratios, settings).collect()}
    assert found[b"xxzorg"] > 0.5 > 0 > found[b"xxword"]
    whole = toxicity.word_scores(words, ratios, toxicity.Settings(parts=1)).collect()
    assert {bytes(r.word): r.score for r in whole} == found


def test_repeated_words_weigh(spark):
    docs = spark.createDataFrame([(1, "good zorg"), (2, "good zorg zorg zorg")], "doc_id long, text string")
    scores = spark.createDataFrame([(b"good", -1.0), (b"zorg", 3.0)], "word binary, score double")
    for bits in (22, 0):
        found = toxicity.measures(docs, scores, "doc_id", "text", toxicity.Settings(slot_bits=bits))
        assert {r.doc_id: r.per_letter for r in found.collect()} == {1: 2 / 10, 2: 8 / 20}
