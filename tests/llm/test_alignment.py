"""Operator 13 against aligning whole texts."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from corpus_rows import ODD_ROWS, TEXTS
from tokenizers import Tokenizer

from signalloom.llm import alignment
from signalloom.llm.batches import portions
from signalloom.llm.bpe import byte_letters
from signalloom.llm.queries import QUERIES
from signalloom.llm.tokenizing import default_tokenizer

A, B = default_tokenizer(), alignment.default_pieces()
PARTS = [" ", "  ", "   ", "\n", " \n ", "a", "bc", "é", ".", "'s", "<|endoftext|>", "<s>", "<0x41>", "12", "\t", "🎉", "x y", "\x1c", "　", "½", "٣", "\x00", "and", " the", "tion"]


@pytest.fixture(scope="module")
def plain():
    """Whole texts by the libraries themselves."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()

    def aligned(text):
        """[(ids of A, ids of B)] of the groups, [] if there are no tokens."""
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        out, i, j = [], 0, 0
        for end in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
            m, n = i, j
            while m < len(ids_a) and ends_a[m] <= end:
                m += 1
            while n < len(ids_b) and ends_b[n] <= end:
                n += 1
            out.append((ids_a[i:m], ids_b[j:n]))
            i, j = m, n
        return out

    return aligned


def plain_report(plain, rows):
    found = [(key, plain(text)) for key, text in rows]
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for key, groups in found:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        links = [(a[-1], b[-1]) for a, b in groups]
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sizes = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links))
        out.append((key, *sizes, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 30, 150])))) for k in range(n)]


def test_pieces_of_texts(plain):
    maker = alignment.aligner(A, B)
    texts = [t for _, t in random_rows(400, 1)] + [t for _, t in ODD_ROWS] + [" ", "  ", " a", "a ", "a▁b", "▁", "a" * 50_000]
    for text, found in zip(texts, maker.align(texts)):
        groups = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain(text))
        assert (found.groups.decode() if found else "") == groups, repr(text[:80])


@pytest.mark.parametrize("rows", [3, 1024])
def test_report_of_random_texts(spark, plain, rows, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", rows)
    monkeypatch.setattr(alignment, "PAIRS", 50)
    texts = [*random_rows(150, 2), *ODD_ROWS, (900, "word " * 40_000), (901, "a▁b"), (902, "word " * 40_000)]
    df = spark.createDataFrame(texts, TEXTS).repartition(4).selectExpr("*", "1 as block", "'x' as links", "text as n_a")
    assert rows_of(alignment.report(df, A, B)) == plain_report(plain, texts)


def test_no_rows_and_no_tokens(spark, empty):
    assert alignment.report(empty, A, B).count() == 0
    df = spark.createDataFrame([(1, None), (1, ""), (None, "▁")], TEXTS)
    assert {tuple(r)[1:] for r in alignment.report(df, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_memory_that_overflows_changes_nothing():
    small, large = alignment.Aligner(A, B, remembered=3), alignment.aligner(A, B)
    for seed in (5, 6, 5):
        texts = [t for _, t in random_rows(30, seed)]
        assert small.align(texts) == large.align(texts)


def test_groups(spark, plain):
    got = {r.doc_id: r.groups for r in alignment.groups(spark.createDataFrame([(1, "Some words"), (2, None)], TEXTS), A, B).collect()}
    assert got == {1: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain("Some words")), 2: ""}


def test_op13_query(spark, folder, documents, plain):
    out = QUERIES["op13_tokenizer_alignment"](spark, folder)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(out) == plain_report(plain, list(zip(documents.doc_id.tolist(), documents.text)))


def test_same_bytes():
    maker = alignment.aligner(A, B)
    known = np.flatnonzero(maker.same >= 0)
    assert len(known) > 10_000
    assert all(maker.a_bytes[i] == maker.b_bytes[maker.same[i]] for i in known)
    by_text = {raw: i for i, raw in enumerate(maker.a_bytes)}
    assert not maker.model.is_byte(int(maker.same[by_text[b"a"]])) and maker.model.is_byte(int(maker.same[by_text[b"\n"]]))
    assert maker.model.id_to_piece(int(maker.same[by_text[b" the"]])) == "\u2581the"


def small_model(folder, **options):
    """A vocabulary of 400 pieces whose pieces may hold letters, marks and line ends together."""
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["the", "end.", "of,", "word.x", "two", "a-b", "it's"]) for _ in range(9)) for _ in range(300)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=str(folder / "small"), vocab_size=400, model_type="bpe", byte_fallback=True,
        remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2, **options,
    )
    return str(folder / "small.model")


LINES = ["the", " end.", " of,", "\n", "\nThe", "word.x", " a-b", "it's", "end.\n", " ", "é!", " ½,", "3.0\n", "\n- ", "\t", "(a)", "'", "\r\n", " ###"]


def random_lines(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LINES) for _ in range(rng.choice([1, 2, 3, 30]))) for _ in range(n)]


def test_words_marks_and_line_ends(plain):
    maker, texts = alignment.aligner(A, B), random_lines(600, 8)
    assert maker.by_lines and maker.by_marks
    for text, found in zip(texts, maker.align(texts)):
        assert found.groups.decode() == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain(text)), repr(text)
        assert (found.n_a, found.n_b) == tuple(sum(len(g[side]) for g in plain(text)) for side in (0, 1))


def test_marks_and_line_ends_make_no_new_words():
    maker = alignment.Aligner(A, B)
    words, marks = ["lorem", "éta", "Dolor", "sit"], ["", ".", ",", "!!", ".###", ")"]
    maker.align([" ".join(w + m + e for w in words for m in marks for e in ("", "\nand"))])
    assert len(maker.memory.young) == len(words) + len(marks) - 1 + len({"\n", "and"})


@pytest.mark.parametrize(
    "options",
    [{"split_by_unicode_script": False, "normalization_rule_name": "identity"}, {"normalization_rule_name": "nmt_nfkc"}],
    ids=["marks in words", "line ends are spaces"],
)
def test_vocabularies_that_forbid_cuts(tmp_path, options):
    path = small_model(tmp_path, **options)
    maker, texts = alignment.Aligner(A, path), random_lines(300, 9)
    assert not maker.by_marks
    model = maker.model
    for text, found in zip(texts, maker.align(texts)):
        raw = [alignment.piece_bytes(model.id_to_piece(i), model.is_byte(i)) for i in model.encode(text)]
        assert (found is not None) == (b"".join(raw) == (" " + text).encode()), repr(text)
        if found:
            assert [int(i) for g in found.groups.decode().split(";") for i in g.split("|")[1].split(",")] == model.encode(text)


def test_blocks_and_their_row_groups_stay_small(spark):
    """What a task holds of blocks does not grow with the documents that are dealt to it."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(["the", "of", "a", "in"], k=100_000))) for k in range(48)], TEXTS)
    few = spark.range(4000, 12_000).selectExpr("id as doc_id", "repeat('some words ', 100) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = alignment.blocks(docs.union(few).coalesce(1), A, B)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    rows = made.selectExpr("octet_length(links) as n", "size(keys) as documents", "inline(arrays_zip(keys, n_links))").collect()
    assert len(rows) == 8048 and {r.keys for r in rows} == {*range(48), *range(4000, 12_000)}
    assert all(r.n <= 1 << 19 for r in rows)
    groups = [g for f in made.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.total_byte_size for g in groups) > 20 << 20
    assert max(g.total_byte_size for g in groups) <= 32 * (1 << 19)


def test_texts_are_aligned_in_small_portions():
    sizes = [10, None, 300, 5, 5, 5, 5, 0, 200, 1]
    batch = pa.RecordBatch.from_pydict({"k": list(range(10)), "t": pa.array([None if n is None else "é" * (n // 2) + "a" * (n % 2) for n in sizes])})
    found = [x.column(0).to_pylist() for x in portions([batch, batch.slice(0, 0), batch.slice(3, 2)], 1, 3, 20)]
    assert found == [[0, 1], [2], [3, 4, 5], [6, 7], [8], [9], [3, 4]]


def test_memory_is_bounded_by_its_bytes(monkeypatch):
    """Long strings of many tokens fill it before their number does."""
    rng = random.Random(11)
    texts = [[" ".join("".join(rng.choices("零一二三四五六七八九", k=rng.choice([1, 20, 40, 80]))) for _ in range(10)) for _ in range(3)] for _ in range(30)]
    expected = list(map(alignment.aligner(A, B).align, texts))
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 50_000)
    maker = alignment.Aligner(A, B)
    for batch, found in zip(texts, expected):
        assert maker.align(batch) == found
        assert maker.align(batch[:1]) == found[:1]
        held = [sum(alignment.OBJECTS + len(x) + len(y[0]) + len(y[1]) for x, y in kept.items()) for kept in (maker.memory.young, maker.memory.old)]
        assert maker.memory.held == held[0] <= 50_000
        assert held[1] <= 100_000
    assert maker.memory.old and len(maker.memory.young) < 200


def test_steps_behind_the_alignment_hold_no_strings(monkeypatch):
    maker = alignment.Aligner(A, B)
    texts = ["Some words, and others.", "Some more"]
    found = maker.align(texts)
    monkeypatch.setattr(alignment, "_ALIGNERS", {(A, B): maker})
    assert maker.memory.young
    alignment.no_more_texts()
    assert not maker.memory.young and not maker.memory.old
    assert maker.align(texts) == found
