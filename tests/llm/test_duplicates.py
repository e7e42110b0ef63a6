"""Operators 3, 5 and 6 against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from signalloom.llm import components, imatch, repeats, simhash
from signalloom.llm.queries import QUERIES
from corpus_rows import ODD_ROWS, TEXTS

# --- repeats ---


def without_repeats(rows, window=50):
    """(key, text) to (n_bytes, n_removed, n_spans, kept) by looking at every window."""
    order = lambda key: (key is not None, key or 0)
    first = {}
    for key, text in sorted(rows, key=lambda r: order(r[0])):
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            first.setdefault(raw[i : i + window], key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if order(first[raw[i : i + window]]) < order(key):
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((key, text, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept))
    return out


def found(df):
    return [
        (r.doc_id, r.text, len((r.text or "").encode()), sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect()
    ]


def overlapping_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(3)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 390)
            text += rng.choice(base)[a : a + rng.randint(1, 120)] + rng.choice(["", "x", "é"])
        rows.append((i * 7 % 61, text))
    return rows


@pytest.mark.parametrize("seed", [2, 3])
def test_repeats_in_small_slices(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 97)
    rows = overlapping_texts(seed)
    got = found(repeats.without_repeats(spark.createDataFrame(rows, TEXTS).repartition(3), slice_bytes=1500, bucket_bytes=9000))
    assert sorted(got) == sorted(without_repeats(rows))


def test_repeats_with_odd_rows(spark, odd, empty):
    extra = odd.selectExpr("*", "'x' as kept", "1 as slice", "2 as payload")
    out = repeats.without_repeats(extra)
    assert out.columns == ["doc_id", "text", "slice", "payload", "kept", "spans"]
    assert sorted(map(repr, found(out))) == sorted(map(repr, without_repeats(ODD_ROWS)))
    assert repeats.without_repeats(empty).count() == 0
    cut = repeats.without_repeats(spark.createDataFrame([(1, "é" * 40), (2, "aé" + "é" * 40)], TEXTS), decoded=True)
    assert {r.doc_id: r.kept for r in cut.collect()} == {1: "é" * 40, 2: "a"}


def test_entries_survive_their_bytes():
    raw = np.frombuffer(b"the quick brown fox jumps over the lazy dog and runs away " * 30, np.uint8)
    starts, docs = np.array([0, 700, len(raw)]), np.array([np.iinfo(np.int64).min, 1 << 40])
    (entries,) = repeats.runs_of(raw, starts, docs, 50, 24)
    back = repeats.from_bytes(repeats.to_bytes(entries))
    assert (np.sort(back, order="at") == np.sort(entries, order="at")).all()


def test_op3_query(spark, folder, documents):
    got = {tuple(r) for r in QUERIES["op3_suffix_dedup"](spark, folder).collect()}
    want = without_repeats(list(zip(documents.doc_id, documents.text)))
    assert got == {(k, n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, _, n, gone, spans, kept in want}


# --- SimHash ---


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    """{index: indices of its group} by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_groups(spark, odd, empty):
    rows = simhash.near_duplicates(odd.withColumn("fingerprint", odd.text)).drop("root").collect()
    prints = [plain_fingerprint(t) for _, t in ODD_ROWS]
    roots = plain_groups(prints)
    want = []
    for (key, _), p, root in zip(ODD_ROWS, prints, roots):
        keys = [k for (k, _), r in zip(ODD_ROWS, roots) if r == root and k is not None]
        want.append((key, f"{p:016x}", min(keys, default=None)))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert simhash.near_duplicates(empty).count() == 0


def chains(rng, n):
    values = set()
    while len(values) < n:
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            values.add(v)
            for _ in range(rng.randint(1, 6)):
                v ^= 1 << rng.randrange(64)
    return sorted(values)


@pytest.mark.parametrize("part", [7, 16_384])
def test_buckets_lose_no_link(spark, part):
    values = chains(random.Random(part), 600)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.bucket_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 4, part)
    roots = {r.node: r.root for r in components.components(links).collect()}
    mine = [roots.get(v, v) for v in signed]
    want = plain_groups(values)
    pairs = set(zip(want, mine))
    assert len(pairs) == len(set(want)) == len(set(mine))


def test_distances_in_bit_planes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    values[1::2] = values[::2] ^ (np.uint64(1) << rng.integers(0, 64, 250, dtype=np.uint64))
    i, j = np.triu_indices(500, 1)
    for radius in (0, 1, 3, 30, 34):
        want = np.bitwise_count(values[i] ^ values[j]) <= radius
        assert (simhash.links_in_pairs(values, i, j, radius) == want).all()


def test_large_buckets_give_the_same_groups():
    values = chains(random.Random(9), 700)
    forest = simhash.Forest()
    forest.add(simhash.links_in_bucket(np.array(values, np.uint64), 4))
    mine = [forest.root(k) for k in range(len(values))]
    want = plain_groups(values)
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(n)}, 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op5_query(spark, folder, documents):
    prints = [plain_fingerprint(t) for t in documents.text]
    roots = plain_groups(prints)
    first = {}
    for key, root in zip(documents.doc_id, roots):
        first[root] = min(first.get(root, key), key)
    want = {(key, f"{p:016x}", first[root]) for key, p, root in zip(documents.doc_id, prints, roots)}
    assert {tuple(r)[:3] for r in QUERIES["op5_simhash"](spark, folder).collect()} == want


# --- I-Match ---


def test_document_frequencies_and_band(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {}
    for text in documents.text:
        for term in imatch.terms_of(text.encode()):
            want[term] = want.get(term, 0) + 1
    got = {bytes(r.term): r.n for r in imatch.document_frequencies(docs).collect()}
    assert got == want
    band = imatch.Band(low=0.02, high=0.1)
    got = {bytes(r.term): r.n for r in imatch.lexicon(docs, band).collect()}
    assert got == {t: n for t, n in want.items() if 4 <= n <= 20}


def test_a_large_lexicon_is_joined_with_the_same_result(spark, odd, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("doc_id < 150")
    for rows, band in ((docs, {"low": 0.02, "high": 0.1}), (odd, {"low": 0.1, "high": 0.5})):
        small = imatch.fingerprints_with_edits(rows, imatch.Band(**band))
        large = imatch.fingerprints_with_edits(rows, imatch.Band(**band, most=1))
        assert "lexicon" not in "".join(large.columns) and large.columns == small.columns
        text = lambda df: sorted(map(str, df.collect()))
        assert text(large) == text(small)


def test_edits_and_neighbours(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 2)
    assert imatch.fingerprints_with_edits(odd.withColumn("bucket", odd.text)).count() == len(ODD_ROWS)
    alone = [(k, t) for k, t in ODD_ROWS if k != 7]
    got = {r.doc_id: r for r in imatch.fingerprints_with_edits(spark.createDataFrame(alone, TEXTS)).collect()}
    order = sorted(alone, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        want = imatch.edited(text or "", following or "")
        assert got[key].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[key].n_chars == len(text or "")
        assert 0 <= got[key].near_edited <= 1 and 0 <= got[key].near_next <= 1
    assert got[10].fingerprint == got[11].fingerprint
    assert got[11].near_next == 1.0
    assert imatch.fingerprints_with_edits(empty).count() == 0


def test_likeness():
    terms = [f"t{k}".encode() for k in range(400)]
    printer = imatch.Printer(terms)
    rng = random.Random(3)
    a = rng.sample(terms, 60)
    b = a[:50] + rng.sample(terms, 10)
    c = rng.sample(terms, 60)
    pa, pb, pc = (printer.fingerprint(b" ".join(x)) for x in (a, b, c))
    assert imatch.likeness(pa, pa) == 1.0
    assert imatch.likeness(pa, pb) > 0.3 > imatch.likeness(pa, pc)
    assert printer.fingerprint(b" ".join(reversed(a + a))) == pa
    assert imatch.likeness(printer.fingerprint(b"unknown"), printer.fingerprint(b"strange")) == 0.0


def test_op6_query(spark, folder, documents):
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, folder).collect()}
    rows = sorted(zip(documents.doc_id, documents.text), reverse=True)
    prints = {}
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(imatch.edited(text, following).encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_edited == imatch.likeness(r.fingerprint, r.edited_fingerprint)
    for (key, _), (below, _) in zip(rows, rows[1:] + rows[:1]):
        assert got[key].near_next == imatch.likeness(got[key].fingerprint, got[below].fingerprint)
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
