"""Operators 1, 2 and 7: against plain versions and on labels they did not see."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from corpus_rows import ODD_ROWS
from pyspark.sql import functions as F

from signalloom.llm import rules, sharding, toxicity
from signalloom.llm.queries import QUERIES

# --- quality rules ---


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(inside))


def test_counts_of_odd_texts(spark, odd):
    rows = rules.text_statistics(odd.withColumn("words", odd.text), also=["words"]).collect()
    got = sorted(tuple(r[c] for c in rules.BASE_COUNTS) for r in rows)
    assert got == sorted(plain_counts(t) for _, t in ODD_ROWS)


def test_counts_of_random_texts(spark):
    rng = random.Random(2)
    parts = ["a", "b", "c", " ", " ", "\n", "\t", "\x0b", "\r", "\x1c", "\x85", "é", "#", "|"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.choice([3, 30, 200])))) for k in range(200)]
    for r in rules.text_statistics(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert tuple(r[c] for c in rules.BASE_COUNTS) == plain_counts(texts[r.doc_id][1])


def learnable(spark, n=900):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        words = [f"w{rng.randint(0, 10**6)}" + ("#" if bad and k % 2 else "") for _ in range(rng.randint(60, 90))]
        if bad and not k % 2:
            words = [w * 6 for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_cover_both_kinds_of_bad_text(spark):
    docs, labels = learnable(spark)
    seen = labels.where("doc_id % 2 = 0 or doc_id % 5 = 0")
    found, learned = rules.judged(docs, seen)
    assert 2 <= len(learned) <= 4
    text = " ".join(map(str, learned))
    assert "symbols_per_word" in text and "mean_word" in text
    judged = found.join(labels, "doc_id")
    assert judged.where("base_failed").count() == 0
    assert judged.where("kept and quality = 0").count() == 0
    assert judged.where("not kept and quality = 1").count() == 0


def plain_rules(x, bad, prune, settings):
    """Sequential covering over arrays: values by statistic, bad and held-back marks."""
    holds = lambda c: x[c[0]] > c[2] if c[1] else x[c[0]] <= c[2]
    inside = lambda cs: np.logical_and.reduce([holds(c) for c in cs])
    out, left = [], np.ones(len(bad), bool)
    for turn in itertools.count():
        cuts, started = {}, len(out)
        for s in rules.STATISTICS:
            found = set()
            for part in (left, left & bad) if turn else (left,):
                values = np.sort(x[s][part]).tolist()
                found |= {values[math.ceil(k * len(values) / settings.bins) - 1] for k in range(1, settings.bins) if values}
            cuts[s] = sorted(found)
        growing = left & ~prune
        while True:
            now, chosen = growing, []
            for _ in range(settings.max_conditions):
                best = (1e-9, None)
                if not 0 < (now & bad).sum() < now.sum():
                    break
                before = math.log2((now & bad).sum() / now.sum())
                for c in ((s, above, cut) for s in rules.STATISTICS for cut in cuts[s] for above in (False, True)):
                    hit = now & holds(c)
                    if n := (hit & bad).sum():
                        gain = n * (math.log2(n / hit.sum()) - before)
                        best = max(best, (gain, c), key=lambda g: g[0])
                if best[1] is None:
                    break
                chosen.append(best[1])
                now = now & holds(best[1])
            if not chosen or (now & bad).sum() < settings.support:
                break
            held = [left & prune & inside(chosen[:k]) for k in range(1, len(chosen) + 1)]
            counts = [(int((h & bad).sum()), int((h & ~bad).sum())) for h in held]
            worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in counts]
            at = worth.index(max(worth))
            b, g = counts[at]
            if b < settings.support or b < settings.precision * (b + g):
                growing = growing & ~inside(chosen)
                continue
            out.append((chosen[: at + 1], b, g))
            gone = inside(chosen[: at + 1])
            left, growing = left & ~gone, growing & ~gone
        if turn and len(out) == started:
            return out


def noisy_statistics(spark):
    """Good rows, ten rare kinds of bad ones and bad labels without a reason."""
    rng = random.Random(11)
    rows = []
    for key in range(1500):
        x = {s: round(rng.uniform(0.4, 0.6), 6) for s in rules.STATISTICS}
        kind = key % 100
        if kind < 10:
            x[rules.STATISTICS[kind % 7]] = round((0.61 + rng.uniform(0, 0.2)) if kind < 7 else rng.uniform(0.1, 0.39), 6)
        rows.append((key, int(kind < 10 or rng.random() < 0.02), *x.values()))
    return spark.createDataFrame(rows, "key long, bad int, " + ", ".join(f"{s} double" for s in rules.STATISTICS))


def test_rules_equal_plain_covering(spark):
    table = noisy_statistics(spark)
    settings = rules.Settings(max_conditions=2, precision=0.9)
    got = rules.learn(table, "key", "bad", settings)
    prune = F.pmod(F.xxhash64(F.lit(1), F.col("key")), F.lit(3)) == 0
    rows = table.withColumn("prune", prune).toPandas()
    want = plain_rules({s: rows[s].values for s in rules.STATISTICS}, rows.bad.values == 1, rows.prune.values, settings)
    assert [([(c.statistic, c.above, c.threshold) for c in r.conditions], r.bad, r.good) for r in got] == want
    # Each rare kind has its rule, though refused regions of bad labels lie between them.
    assert len({(c.statistic, c.above) for r in got for c in r.conditions}) >= 7


def test_rules_are_plain_expressions(spark):
    docs, labels = learnable(spark, 120)
    plan = rules.text_statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_without_labels(spark, odd, empty, no_labels):
    found, learned = rules.judged(odd, no_labels)
    assert learned == [] and found.count() == len(ODD_ROWS)
    want = {(c[0] < 50 or 100 * c[4] > 50 * c[0]) for _, t in ODD_ROWS for c in [plain_counts(t)]}
    assert {r.base_failed for r in found.collect()} == want
    assert found.where("kept = base_failed").count() == 0
    assert rules.judged(empty, no_labels)[0].count() == 0


def test_op2_query(spark, folder, documents):
    text = dict(zip(documents.doc_id, documents.text))
    rows = QUERIES["op2_quality_rules"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(text)
    for r in rows:
        counts = plain_counts(text[r.doc_id])
        assert tuple(r[c] for c in rules.BASE_COUNTS) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)


# --- toxicity ---


def test_letter_sequences():
    keys, of = toxicity.grams_of([b"ab", b""], 3)
    as_bytes = [(int(k) & (1 << 48) - 1).to_bytes(int(k) >> 48, "big") for k in keys]
    assert as_bytes == [b"\xffa", b"\xffab", b"ab\xfe", b"\xff\xfe"]
    assert of.tolist() == [0, 0, 0, 1]


def test_backoff_is_a_probability(spark):
    words = ["ordinary words repeat", "letters follow letters", "bad bade badly"]
    docs = spark.createDataFrame([(k, w, int(k == 2)) for k, w in enumerate(words)], "doc_id long, text string, toxic int")
    settings = toxicity.Settings(order=4)
    grams = toxicity.class_counts(docs, "text", "toxic", settings)
    seen = collections.Counter()
    for k, text in enumerate(words):
        for w in set(text.split()):
            whole = b"\xff" + w.encode() + b"\xfe"
            for i in range(1, len(whole)):
                seen[whole[max(0, i - 3) : i + 1], k == 2] += 1
    got = {}
    for r in grams.collect():
        raw = (r.gram & (1 << 48) - 1).to_bytes(r.gram >> 48, "big")
        got |= {(raw, False): r.n0, (raw, True): r.n1}
    assert {k: n for k, n in got.items() if n} == dict(seen)
    shared = toxicity.shared_backoff(grams, settings).collect()
    by = collections.defaultdict(float)
    for r in shared:
        raw = (r.gram & (1 << 48) - 1).to_bytes(r.gram >> 48, "big")
        by[raw[:-1]] += r.p
        assert 0 < r.p <= 1
    assert all(total <= 1 + 1e-9 for total in by.values())


def test_unseen_toxic_texts_are_told(spark):
    rng = random.Random(4)
    stems = ["zorg", "quib", "vlax"]
    docs, labels = [], []
    for k in range(1500):
        words = ["".join(rng.choice(["an", "re", "ti", "on", "es", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = k % 7 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["an", "es", "iti", "ore", "u"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    settings = toxicity.Settings(slot_bits=18)
    rows = toxicity.scored(docs, labels, settings=settings).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert set(held.doc_id) == {k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert (held.predicted == held.toxic).mean() > 0.97
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scored(docs, turned, settings=settings).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[rows.doc_id].values, rows.score.values)


def test_toxicity_of_odd_rows(spark, odd, empty, no_labels):
    settings = toxicity.Settings(slot_bits=12)
    rows = toxicity.scored(odd.withColumn("score", odd.text), no_labels, settings=settings).collect()
    assert len(rows) == len(ODD_ROWS) and {r.score for r in rows} == {0.0}
    assert toxicity.scored(empty, no_labels, settings=settings).count() == 0


def test_op1_query(spark, folder, documents):
    rows = QUERIES["op1_toxicity"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(documents.doc_id) and len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


# --- sharding ---


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_permutation_and_its_inverse(spark, n):
    p = sharding.Permutation(n, 3)
    rows = spark.range(n).select("id", p.forward(F.col("id")).alias("to")).withColumn("back", p.backward(F.col("to"))).collect()
    assert sorted(r.to for r in rows) == list(range(n))
    assert all(r.id == r.back for r in rows)


def test_seeds_shuffle_differently(spark):
    n = 500
    orders = {tuple(r[0] for r in spark.range(n).select(sharding.Permutation(n, s).forward(F.col("id"))).collect()) for s in range(4)}
    assert len(orders) == 4
    assert all(sum(a == k for k, a in enumerate(o)) < 20 for o in orders)


def shard_rows(df):
    return sorted((r.shard, r.slot, r.doc_id or -1, r.size, r.text_crc32) for r in df.collect())


def check_shards(rows, shards, n):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_shards_of_odd_rows(spark, odd, empty):
    out = sharding.shards_of(odd.withColumn("key", odd.text).withColumn("size", odd.text), 4)
    check_shards(out.collect(), 4, len(ODD_ROWS))
    raw = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD_ROWS)
    assert sorted((r.size, r.text_crc32) for r in out.collect()) == raw
    assert shard_rows(sharding.shards_of(odd.repartition(5), 4)) == shard_rows(sharding.shards_of(odd.coalesce(1), 4))
    assert sharding.shards_of(empty, 4).count() == 0


def test_rows_are_found_from_their_slot(spark, odd):
    n = len(ODD_ROWS)
    out = sharding.shards_of(odd, 4)
    row = sharding.row_of(F.col("shard"), F.col("slot"), sharding.Permutation(n, 0), 4)
    assert out.where(row != F.col("row_number")).count() == 0


def test_op7_query(spark, folder, documents):
    df = QUERIES["op7_sharding"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = df.collect()
    check_shards(rows, 16, len(documents))
    want = {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in zip(documents.doc_id, documents.text)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want
