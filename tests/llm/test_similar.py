"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from signalloom.llm import simhash, similar


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """The index of the first text that links connect every text with."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or both >= 0.8 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def near_texts(rng, groups=60, copies=4):
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 40, 200, 400]))]
        texts.append(" ".join(words))
        texts += [edited(rng, words, rng.randint(1, max(1, len(words) // 30))) for _ in range(copies)]
    return texts


def test_stage_finds_all_pairs_of_brute_force(spark):
    texts = near_texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, None).toPandas()
    assert sorted(kept.doc_id) == sorted(set(brute_groups(texts)))


def test_large_band_is_settled_in_rounds(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    texts = [edited(rng, words, rng.randint(1, 5)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in similar.groups(docs).collect()}
    first = {}
    for k in sorted(roots):
        first.setdefault(roots[k], k)
    assert [first[roots[k]] for k in sorted(roots)] == brute_groups(texts)


def test_stage_on_a_whole_table(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder).toPandas()
    rows = documents.sort_values("doc_id")
    want = {k for k, first in zip(rows.doc_id, brute_groups(rows.text.tolist())) if k == rows.doc_id.iloc[first]}
    assert set(kept.doc_id) == want and len(kept) == len(want)


def test_planes_count_unequal_pairs_of_bits(spark):
    rng = np.random.default_rng(5)
    a, b = (similar.smallest(rng.integers(0, 1 << 64, 300, dtype=np.uint64)) for _ in range(2))
    b[::3] = a[::3]
    row = dict(zip(similar.PLANES, similar.planes(a))) | {f"other_{c}": v for c, v in zip(similar.PLANES, similar.planes(b))}
    found = spark.createDataFrame([row]).select(similar.unequal().alias("n")).first().n
    two = np.uint64(3 << 40)
    assert found == int(((a & two) != (b & two)).sum()) > 40


def test_fingerprints_are_linked_as_in_op5(spark, monkeypatch):
    """SimHash buckets link near copies before smallest hashes are looked at."""
    radii = []
    monkeypatch.setattr(similar, "bucket_links", lambda values, radius: radii.append(radius) or simhash.bucket_links(values, radius))
    monkeypatch.setattr(similar, "links_in_bands", lambda met, *rest: met.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{k}" for k in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in similar.groups(docs).collect()}
    assert radii and roots[0] == roots[1] != roots[2]


def test_texts_below_the_similarity_make_no_table_of_pairs(spark, monkeypatch):
    """Texts that are alike by half give a row a band and no row a pair, in parts too."""
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    texts = [edited(rng, words, 9) for _ in range(60)]
    texts += [edited(rng, texts[0].split(), 1), edited(rng, texts[1].split(), 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {}
    settle = similar.settle

    def counted(df, name, outlives=False):
        out = settle(df, name, outlives)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "settle", counted)
    monkeypatch.setattr(similar, "PART", 8)
    monkeypatch.setattr(similar, "PART_BYTES", 8_000)
    roots = {r.doc_id: r.root for r in similar.groups(docs).collect()}
    first = {}
    for k in sorted(roots):
        first.setdefault(roots[k], k)
    assert [first[roots[k]] for k in sorted(roots)] == brute_groups(texts)
    assert sizes["pairs"] <= 4 * len(texts) and sizes["confirmed"] <= similar.BANDS * len(texts)
    assert "likely" not in sizes
