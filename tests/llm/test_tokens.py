"""Operators 4, 8, 9 and 10 against the tokenizers library and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from signalloom.llm import bpe, editing, packing, tokenfile
from signalloom.llm.queries import QUERIES
from signalloom.llm.tokenizing import PieceSplitter, default_tokenizer, library_encoder
from corpus_rows import ODD_ROWS

PARTS = [" ", "  ", "\n", "a", "bc", "é", ".", "'s", "<|endoftext|>", "<|endo", "ftext|>", "12", "\t", "🎉", "x y", "\x1c", "　", "½", "٣"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def some_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 4, 40, 200]))) for _ in range(n)]


def test_both_encoders_equal_the_library(library):
    own, encoder = bpe.codec(default_tokenizer())
    texts = [*some_texts(400), *(t or "" for _, t in ODD_ROWS), "ab" * 40_000]
    for text, a, b in zip(texts, encoder.encode(texts), library_encoder(default_tokenizer()).encode(texts)):
        want = ids_of(library, text)
        assert a.tolist() == b.tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_memory_that_overflows_changes_nothing(library):
    own, _ = bpe.codec(default_tokenizer())
    words = lambda ws: [np.array(own.encode_word(w.encode()), "<u2").tobytes() for w in ws]
    from signalloom.llm.tokenizing import TextEncoder

    encoder = TextEncoder(list(own.specials), words, lambda ps: [own.encode_text(p) for p in ps], "<u2", remembered=3)
    for batch in (some_texts(20, 2), some_texts(20, 3), some_texts(20, 2)):
        assert [x.tolist() for x in encoder.encode(batch)] == [ids_of(library, t) for t in batch]


def test_new_pieces_of_a_batch_are_cut_together(library, monkeypatch):
    from signalloom.llm import tokenizing

    calls = []

    class Counted:
        def findall(self, text):
            calls.append(text)
            return tokenizing.regex.findall(tokenizing.PRE_TOKENS, text)

    monkeypatch.setattr(tokenizing, "WORDS", Counted())
    monkeypatch.setattr(tokenizing, "_ENCODERS", {})
    parts = ["it's", "x1.", "naïve,", "a\nb", "12-34", "жук!", "(z)"]
    texts = [" ".join(f"{p}{i}{p}" for p in parts for i in range(300)), "one", "", *some_texts(30, 11)]
    found = library_encoder(default_tokenizer()).encode(texts)
    assert [x.tolist() for x in found] == [ids_of(library, t) for t in texts]
    # One call for the plain pieces behind a space; the others stand first or hold white space.
    assert len(calls) < 400 < len(texts[0].split(" "))


def test_a_word_is_remembered_once_with_any_marks(library, monkeypatch):
    from signalloom.llm import tokenizing

    monkeypatch.setattr(tokenizing, "_ENCODERS", {})
    marks = ["", ".", ",", "...", "'", "?!", "<|"]
    words = [w + m for w in ["word", "été", "Łódź"] for m in marks]
    odd = ["ªx", "µg.", "don't,", "x1.", "×", "ɐ!", "q\n\nq", "q\r\nq", "q\n\x1cq", "\nq", "q\n", "q \nq", "q<|endoftext|>", "q\n<|endoftext|>q"]
    texts = ["A " + " ".join(words), "A " + "\n".join(words), "\n".join(odd), *odd, *(f"A {x} A" for x in odd), *some_texts(200, 12)]
    encoder = library_encoder(default_tokenizer())
    assert [x.tolist() for x in encoder.encode(texts)] == [ids_of(library, t) for t in texts]
    encoder = tokenizing._ENCODERS.clear() or library_encoder(default_tokenizer())
    encoder.encode(texts[:2])
    assert set(encoder.inner.young) == {"word", "été", "Łódź"}
    assert set(encoder.first.young) == {"A", *("\n" + w for w in ("word", "été", "Łódź"))} - {"\nword"} | {"\nword"}
    assert set(encoder.words.young) == {"A", *marks[1:]}


def test_pieces_join_to_the_text():
    split = PieceSplitter(["<|endoftext|>"])
    for text in some_texts(200):
        assert " ".join(split(text)) == text


def test_round_trip(spark, odd, empty, library):
    rows = bpe.round_trip(odd.withColumn("ids_sha256", odd.text), default_tokenizer()).collect()
    want = []
    for key, text in ODD_ROWS:
        ids = np.array(ids_of(library, text), "<u4")
        want.append((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert bpe.round_trip(empty, default_tokenizer()).count() == 0
    arrays = bpe.encode(odd, default_tokenizer())
    back = bpe.decode(arrays, default_tokenizer())
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in ODD_ROWS)


def test_edits_equal_encoding_anew(library):
    rng, encoder = random.Random(5), library_encoder(default_tokenizer())
    for text in some_texts(120, 7):
        ((pieces, counts),) = encoder.counts([text])
        tree = editing.TokenTree(pieces, counts, encoder)
        for _ in range(8):
            start, length = rng.randint(-2, len(text) + 3), rng.choice([0, 0, 1, 2, 5, 40])
            new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3])))
            a = min(max(start, 0), len(text))
            text = text[:a] + new + text[a + length :]
            assert tree.edit(start, length, new) == len(ids_of(library, text))
            assert tree.text == text


def test_an_edit_encodes_its_surroundings_only():
    encoder = library_encoder(default_tokenizer())
    text = "some words " * 5000
    ((pieces, counts),) = encoder.counts([text])
    tree = editing.TokenTree(pieces, counts, encoder)
    tree.edit(30_000, 4, "new")
    assert tree.encoded_again < 60


def test_edited_counts(spark, odd, library):
    rows = editing.edited_counts(odd.withColumn("edits", editing.sample_edits()), default_tokenizer()).collect()
    assert len(rows) == len(ODD_ROWS)
    by = {}
    for key, text in ODD_ROWS:
        by.setdefault(key, []).append(len(ids_of(library, text)))
    for r in rows:
        assert r.n_tokens in by[r.doc_id] and r.n_edits == 3
    bare = odd.selectExpr("doc_id", "text", "cast(null as array<struct<start: bigint, length: bigint, text: string>>) as edits")
    assert all(r.n_tokens == r.edited_tokens and not r.n_edits for r in editing.edited_counts(bare, default_tokenizer()).collect())


def test_op8_query(spark, folder, documents, library):
    got = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, folder).collect()}
    for key, text in zip(documents.doc_id, documents.text):
        n = len(text)
        once = text[: n // 4] + text[:20] + text[n // 4 :]
        twice = once[: n // 2] + once[n // 2 + min(n // 50, 400) :]
        at = min(3 * n // 4, len(twice))
        last = twice[:at] + text[:10] * 2 + twice[at + 10 :]
        assert (got[key].n_tokens, got[key].edited_tokens) == (len(ids_of(library, text)), len(ids_of(library, last)))


def test_token_files(spark, odd, empty, library, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "BUCKET_ROWS", 3)
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 300)
    rows = tokenfile.written_and_read(odd, default_tokenizer()).orderBy("start").collect()
    start, left = 0, [(k, np.array([*ids_of(library, t), 0], "<u4")) for k, t in ODD_ROWS]
    for r in rows:
        assert r.start == start
        match = next(x for x in left if x[0] == r.doc_id and (len(x[1]), zlib.crc32(x[1].tobytes())) == (r.n_tokens, r.ids_crc32))
        left = [x for x in left if x is not match]
        start += r.n_tokens
    assert not left
    assert [r.doc_id for r in rows] == sorted((k for k, _ in ODD_ROWS), key=lambda k: (k is not None, k or 0))
    assert tokenfile.written_and_read(empty, default_tokenizer()).count() == 0
    folder = str(tmp_path / "files")
    tokenfile.write(odd, folder, default_tokenizer())
    found = {r.doc_id: r.ids for r in tokenfile.lookup(spark, folder, [6, 9, 4711]).collect()}
    assert found == {6: [*ids_of(library, "one"), 0], 9: [*ids_of(library, dict(ODD_ROWS)[9]), 0]}
    many = tokenfile.lookup(spark, folder, [7, 10]).collect()
    want = [(k, [*ids_of(library, t), 0]) for k, t in ODD_ROWS if k in (7, 10)]
    assert sorted((r.doc_id, r.ids) for r in many) == sorted(want)
    assert len({(r.doc_id, r.order, r.turn) for r in many}) == 4
    assert tokenfile.lookup(spark, folder, [4711]).count() == tokenfile.lookup(spark, folder, []).count() == 0
    table = tokenfile.shard_table(spark, folder).collect()
    assert len(table) > 3 and all(r["first"] <= r["last"] for r in table)


def test_key_index_is_minimal_and_perfect():
    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 20_000)
    turns = np.zeros(len(keys), np.uint32)
    index = tokenfile.KeyIndex.build(keys, turns)
    assert sorted(index.find(keys, turns)) == list(range(len(keys)))
    others = index.find(keys + 1, turns)
    assert (others >= 0).mean() < 0.001
    assert index.sizes.sum() < 6 * len(keys)


def test_op10_query(spark, folder, documents, library):
    got = [tuple(r) for r in QUERIES["op10_token_files"](spark, folder).orderBy("doc_id").collect()]
    want, start = [], 0
    for key, text in sorted(zip(documents.doc_id, documents.text)):
        ids = np.array([*ids_of(library, text), 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


# --- packing ---


def check_packing(rows, texts, library, size):
    by_row, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_row.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    want = {}
    for key, text in texts:
        ids = np.array([*ids_of(library, text), 0], "<u4")
        head = len(ids) % size or size
        cuts = [0, *range(head, len(ids) + 1, size)]
        want.setdefault(key, []).extend((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert {k: sorted(v) for k, v in by_row.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, odd, empty, library, size, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 4)
    rows = packing.pack(odd, default_tokenizer(), size).collect()
    n = check_packing(rows, ODD_ROWS, library, size)
    assert n == -(-sum(r.length for r in rows) // size)
    assert packing.pack(empty, default_tokenizer(), size).count() == 0


def fewest(lengths, size):
    """Exact smallest number of bins, by trying all."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_patterns_are_close_to_the_fewest():
    rng, extra = random.Random(4), 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        found = packing.patterns(counts, 20)
        used = {}
        for p in found:
            assert sum(length * n for length, n in p.pieces) <= 20
            for length, n in p.pieces:
                used[length] = used.get(length, 0) + n * p.times
        assert used == counts
        extra += found[-1].first + found[-1].times - fewest(lengths, 20)
    assert extra <= 2


def test_completion_is_undominated():
    rng = random.Random(6)
    for _ in range(100):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(1, 60)
        chosen = packing.complete(room, sorted(counts, reverse=True), counts)
        left = room - sum(chosen)
        assert left >= 0 and all(chosen.count(x) <= n for x, n in counts.items())
        assert all(x > left or chosen.count(x) == n for x, n in counts.items())
        reach = {0}
        for x, n in counts.items():
            reach = {r + x * k for r in reach for k in range(n + 1) if r + x * k <= room}
        assert sum(chosen) == max(reach)


def test_op4_query(spark, folder, documents, library):
    rows = QUERIES["op4_packing"](spark, folder).collect()
    n = check_packing(rows, list(zip(documents.doc_id, documents.text)), library, 2048)
    assert n == -(-sum(r.length for r in rows) // 2048)
