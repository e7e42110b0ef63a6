"""Alignment of the tokens of two vocabularies over the same bytes (operator 13).

Vocabulary A is a byte-level tokenizer file, B a sentencepiece model. Both begin a token at
every space that follows a character other than white space, so texts are cut there. Where no
token of B holds a letter and a mark behind it, or a line end and anything else, they are also cut between
words, marks and line ends. Each different string is encoded and aligned once by each worker, and Arrow puts
those of a text in a row. Where one token of A covers
the same bytes as one of B, the pair is known from A's id alone: such groups are counted in
a vector as long as the vocabulary. Only pairs from other groups are counted by shuffle.

Documents travel in *blocks*: a row with the links of some dozens of documents and a list of
its different pairs. Counts come back as one number for each pair of a block, so neither the
pair table nor the links of the corpus is ever in one place.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import as_array, give_back, portions, slices
from signalloom.llm.bpe import byte_letters
from signalloom.llm.tables import ARROW_ROWS, held_at, settle
from signalloom.llm.tokenizing import LETTERS, WORD_AND_MARKS, Memory, TextEncoder, library_encoder

#: Documents, and bytes of links, after which a block is closed; a longer document has one of its own.
#: A row of a block stays below half a region of a JVM's heap, so that it is no allocation of its own there.
BLOCK_ROWS, BLOCK_BYTES = 1024, 3 << 17
#: The writer of blocks looks at its buffers after two rows and closes a row group at so many compressed bytes,
#: or rows: a reader holds a row group as it was before.
BLOCK_FILES = {"parquet.block.size": 8 << 20, "parquet.block.row.count.limit": 32, "parquet.page.size.row.check.min": 2}
#: Documents, and bytes of text, that are aligned together; a longer document is aligned by itself.
ALIGNED_ROWS, ALIGNED_BYTES = 256, 1 << 20
#: Different strings of one generation of a worker's memory, and the bytes they take.
REMEMBERED, REMEMBERED_BYTES = 200_000, 72 << 20
#: Bytes of a remembered string's objects besides its letters, groups and links.
OBJECTS = 300
#: Different pairs that a task counts before it hands them on.
PAIRS = 1 << 20


def default_pieces() -> str:
    """Path of the public sentencepiece vocabulary the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- vocabularies ---


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    """The bytes a sentencepiece piece stands for."""
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


def a_strings(path: str) -> list[bytes]:
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    strings = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s in strings]


def same_bytes(a: list[bytes], b: list[bytes], byte_ids: set[int]) -> np.ndarray:
    """For every id of A the id of B with the same bytes, -1 if there is none.

    Of several ids of B the first one stands here that is not a single byte's own id, which the
    model uses only where it has no piece; a link to another one is counted with the other pairs.
    """
    first: dict[bytes, int] = {}
    for i, raw in enumerate(b):
        if raw and (raw not in first or first[raw] in byte_ids):
            first[raw] = i
    return np.array([first.get(raw, -1) for raw in a], np.int64)


# --- pieces ---


class Aligned(NamedTuple):
    """A text: its groups as text, its links as numbers, and how many tokens it has."""

    groups: bytes
    links: bytes
    n_a: int
    n_b: int


#: What is remembered of a string: the fields of a text's alignment, the last group with its semicolon.
Known = tuple[bytes, bytes, int, int]
NOTHING: Known = (b"", b"", 0, 0)


class Strings(Memory):
    """A memory of alignments whose generations are bounded by their bytes as well."""

    held = 0

    def learn(self, found: dict[str, Known | None]) -> None:
        super().learn(found)
        self.held += sum(OBJECTS + len(x) + (len(y[0]) + len(y[1]) if y else 0) for x, y in found.items())

    def unknown(self, wanted: set[str]) -> set[str]:
        missing = wanted.difference(self.young)
        if self.old:
            again = {x: self.old[x] for x in missing if x in self.old}
            self.learn(again)
            missing = missing.difference(again)
        return missing

    def end_batch(self) -> None:
        for x in self.long:
            y = self.young.get(x)
            self.held -= OBJECTS + len(x) + (len(y[0]) + len(y[1]) if y else 0)
        super().end_batch()
        if not self.young:
            self.held = 0
        elif self.held > REMEMBERED_BYTES:
            self.young, self.old, self.held = {}, self.young, 0


class Aligner:
    """Aligns texts; a link is the number ``id of A * size of B + id of B``."""

    #: A space that follows a character other than white space.
    cut = re.compile(r"(?<=\S) ").split
    #: A space that does not, behind the first character.
    unclear = re.compile(r"\s ").search
    #: A line end beside white space.
    ragged = re.compile(r"\n(?:\s|(?<=\s\n))").search
    #: What A takes as one pre-token.
    one_word = re.compile(rf" ?[{LETTERS}]+|[!-/:-@\[-`{{-~]+|\n").fullmatch
    letter_and_mark = re.compile(rf"[{LETTERS}][!-/:-@\[-`{{-~]").search

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.model.get_piece_size()
        self.b_bytes = [piece_bytes(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(n)]
        self.space = self.model.piece_to_id("▁")
        self.a_bytes = a_strings(path_a)
        self.encoder: TextEncoder = library_encoder(path_a, plain=True, remembered=remembered // 10)
        # B adds a space to every string. One that has none before it is encoded behind a line end; these ids are not its own.
        self.lead = self.model.encode("\n")
        unseen = self.model.is_byte, self.model.is_control, self.model.is_unknown
        pieces = [self.model.id_to_piece(i) for i in range(n) if not any(kind(i) for kind in unseen)]
        self.by_lines = b"".join([self.b_bytes[i] for i in self.lead]) == b" \n" and not any("\n" in p and p != "\n" for p in pieces)
        self.by_marks = self.by_lines and not any(map(self.letter_and_mark, pieces))
        self.size_b = n
        self.dtype = "<u4" if len(self.a_bytes) * n <= 1 << 32 else "<u8"
        self.same = same_bytes(self.a_bytes, self.b_bytes, {i for i in range(n) if self.model.is_byte(i)})
        self.memory = Strings(remembered)
        self.size_of = [np.array([len(x) for x in raw], np.int64) for raw in (self.a_bytes, self.b_bytes)]
        # How an id is written: by side, and by whether it is the last one of its group.
        ids = [range(len(self.a_bytes)), range(len(self.a_bytes)), range(n), range(n)]
        self.written = [b"%d%c" % (i, mark) for of, mark in zip(ids, b",|,;") for i in of]
        self.width = np.array([len(x) for x in self.written], np.int64)

    def _spelled(self, raw: list[bytes], flat: np.ndarray, n: np.ndarray, strings: list[bytes], size_of: np.ndarray) -> np.ndarray:
        """Which pieces the strings of their ids spell; ``flat`` has the ids of all pieces, ``n`` of each."""
        sizes = np.bincount(np.repeat(np.arange(len(n)), n), weights=size_of[flat], minlength=len(n))
        fine = sizes == np.fromiter(map(len, raw), np.int64, len(raw))
        parts = [strings[i] for i in flat.tolist()]
        if not fine.all() or b"".join(parts) != b"".join(raw):
            ends = np.cumsum(n).tolist()
            fine = np.array([b"".join(parts[a:b]) == r for r, a, b in zip(raw, [0, *ends], ends)], bool)
        return fine

    def _aligned(self, raw: list[bytes], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[Known | None]:
        """All strings in one pass over their joined bytes; None where tokens are not the string's bytes."""
        fine = self._spelled(raw, a, n_a, self.a_bytes, self.size_of[0]) & self._spelled(raw, b, n_b, self.b_bytes, self.size_of[1])
        out: list[Known | None] = [None] * len(raw)
        spelled = np.flatnonzero(fine).tolist()
        if not spelled:
            return out
        a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
        ends_a, ends_b = np.cumsum(self.size_of[0][a]), np.cumsum(self.size_of[1][b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = (a[last_a] * self.size_b + b[last_b]).astype(self.dtype).tobytes()
        # A token's place in the written groups: after all tokens of the other side in groups before.
        of_a, of_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, last_b + 1)[of_a]] = a + len(self.a_bytes) * (ends_a == ends[of_a])
        order[np.arange(len(b)) + last_a[of_b] + 1] = 2 * len(self.a_bytes) + b + self.size_b * (ends_b == ends[of_b])
        text = b"".join([self.written[i] for i in order.tolist()])
        # Where each piece ends: in groups, in tokens of either side, in the text.
        upto = np.searchsorted(ends, np.cumsum([len(raw[k]) for k in spelled])) + 1
        upto_a, upto_b = last_a[upto - 1] + 1, last_b[upto - 1] + 1
        upto_text = np.cumsum(self.width[order])[upto_a + upto_b - 1]
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        ends_text = [0, *upto_text.tolist()]
        ends_links = [0, *(upto * np.dtype(self.dtype).itemsize).tolist()]
        found = zip(
            [text[i:j] for i, j in zip(ends_text, ends_text[1:])], [links[i:j] for i, j in zip(ends_links, ends_links[1:])],
            n_a.tolist(), n_b.tolist(),
        )
        if len(spelled) == len(raw):
            return list(found)
        for k, x in zip(spelled, found):
            out[k] = x
        return out

    def learn(self, strings: set[str]) -> None:
        """Align strings that are not remembered, with the space they begin with; those without one stand inside a text."""
        fresh = self.memory.unknown(strings)
        if not fresh:
            return
        words = [x for x in fresh if self.one_word(x)]
        others = fresh.difference(words)
        spaced = [x for x in others if x[0] == " "]
        bare = [x for x in others if x[0] != " "]
        packed = self.encoder.encode_words(words) + self.encoder.parts([x[1:] for x in spaced]) + self.encoder.parts(bare, "")
        a = np.frombuffer(b"".join(packed), self.encoder.dtype).astype(np.int64)
        n_a = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(self.encoder.dtype).itemsize
        ordered = words + spaced + bare
        ids = self.model.encode([x[1:] if x[0] == " " else "\n" + x for x in ordered], num_threads=1)
        for k, x in enumerate(ordered):
            if x[0] != " ":
                ids[k] = ids[k][len(self.lead) :]
            elif x == " ":  # the model adds no space to an empty string
                ids[k] = [self.space]
        n_b = np.fromiter(map(len, ids), np.int64, len(ids))
        b = np.fromiter(chain.from_iterable(ids), np.int64, int(n_b.sum()))
        self.memory.learn(dict(zip(ordered, self._aligned([x.encode() for x in ordered], a, n_a, b, n_b))))

    def _look_up(self, names: pa.Array, line: np.ndarray) -> tuple[list[Known | None], list[np.ndarray]]:
        """What is known of the strings of all names, and where in it those of each name are.

        A name is a piece without its space or, if it is a ``line``, a line end and what follows it up to a space.
        Latin words and the marks behind them are strings of their own.
        """
        lines = pa.array(line)
        body = pc.if_else(lines, pc.utf8_ltrim(names, "\n"), names)
        plain = pc.and_(pc.match_substring_regex(body, WORD_AND_MARKS), pc.invert(pc.starts_with(body, "\n")))
        plain = pc.and_(plain, self.by_marks)
        none = pa.scalar("", names.type)
        marks = pc.if_else(plain, pc.utf8_ltrim(body, LETTERS), none).dictionary_encode()
        stems = pc.if_else(plain, pc.ascii_rtrim(body, string.punctuation), body)
        space = pc.if_else(lines, none, pa.scalar(" ", names.type))
        stems = pc.binary_join_element_wise(space, stems, none).dictionary_encode()
        own = [x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (stems, marks)]
        wanted = ["\n", *own[0], *own[1]]
        if not line.any():
            wanted[0] = ""
        self.learn(set(wanted) - {""})
        known = self.memory.young
        places = [line.astype(np.int64), 2 + stems.indices.to_numpy(), 2 + len(own[0]) + marks.indices.to_numpy()]
        return [NOTHING, *[known[x] if x else NOTHING for x in wanted]], places

    def align(self, batch: list[str | None]) -> list[Aligned | None]:
        """The alignment of every text; None for NULL and empty ones and those the tokens do not spell."""
        even, pieces, order, sizes = [], [], ([], []), []
        for k, text in enumerate(batch):
            if not text:
                continue
            if text[0] == " " or self.unclear(text):
                cut = self.cut(text)
            elif "\n" not in text:
                cut = None
            elif self.by_lines and text[0] != "\n" and not self.ragged(text):
                cut, text = None, text.replace("\n", " \n")
            else:
                cut = text.split(" ")
            order[cut is not None].append(k)
            if cut is None:
                even.append(text)
            else:
                pieces += cut
                sizes.append(len(cut))
        out: list[Aligned | None] = [None] * len(batch)
        if not even and not pieces:
            return out
        split = pc.split_pattern(pa.array(even, pa.large_string()), " ")
        numbered = [split.flatten().dictionary_encode(), pa.array(pieces, pa.large_string()).dictionary_encode()]
        n = len(numbered[0].dictionary)
        names = pa.concat_arrays([x.dictionary for x in numbered])
        which = np.concatenate([numbered[0].indices.to_numpy().astype(np.int64), numbered[1].indices.to_numpy() + n])
        edges = np.append(0, np.cumsum([*pc.list_value_length(split).to_pylist(), *sizes]))
        line = pc.starts_with(names, "\n").to_numpy(zero_copy_only=False)
        line[n:] = False  # there a line end at the beginning has a space before it
        found, places = self._look_up(names, line)

        bad = np.array([x is None for x in found])
        *raw, n_a, n_b = zip(*[x or NOTHING for x in found])
        nothing, rows = pa.scalar(b"", pa.large_binary()), pa.array(which)
        ends, held = [], []
        for x in raw:
            strings = pa.array(x, pa.large_binary())
            joined = pc.binary_join_element_wise(*[strings.take(pa.array(p)) for p in places], nothing).take(rows)
            ends.append(np.frombuffer(joined.buffers()[1], np.int64)[edges].tolist())
            held.append(memoryview(joined.buffers()[2] or b""))
        for x in (n_a, n_b, bad):
            of_names = sum(np.array(x, np.int64)[p] for p in places)
            ends.append(np.append(0, np.cumsum(of_names[which]))[edges])
        texts, links = held
        for t, k in enumerate(chain(*order)):
            g, x, a, b, wrong = ((e[t], e[t + 1]) for e in ends)
            if wrong[0] == wrong[1]:
                out[k] = Aligned(bytes(texts[g[0] : g[1] - 1]), bytes(links[x[0] : x[1]]), int(a[1] - a[0]), int(b[1] - b[0]))
        self.memory.end_batch()
        return out

    def forget(self) -> None:
        """Drop what is remembered of strings."""
        if self.memory.young or self.memory.old:
            self.memory = Strings(self.memory.size)
            give_back()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker and pair of files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def no_more_texts() -> None:
    """Steps behind the alignment run in the same workers and need no strings."""
    for maker in _ALIGNERS.values():
        maker.forget()


class Pairs(NamedTuple):
    """What steps behind the alignment know of a link; goes to every task."""

    same: np.ndarray
    size_b: int
    dtype: str

    def split(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs are an id of A and the id of B with the same bytes."""
        a, b = np.divmod(pairs.astype(np.int64), self.size_b)
        return self.same[a] == b


def pairs_of(maker: Aligner) -> Pairs:
    return Pairs(maker.same.astype(np.int32), maker.size_b, maker.dtype)


# --- Spark ---


def groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups): the aligned groups of every text, ``a1,a2|b1;a3|b2,b3``.

    Groups end where a token of A and one of B both end; A sees a space before the text, as B
    adds one. NULL and empty texts, and texts whose tokens do not spell the text (such as
    those with U+2581), have ''.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in slices(batches):
            found = aligner(path_a, path_b).align(batch.column(1).to_pylist())
            texts = [x.groups.decode() if x else "" for x in found]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "groups": pa.array(texts, pa.string())})

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, groups string")


def blocks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of many documents: block, keys, n_a, n_b, sha, n_links (arrays), links, pairs, times (bytes).

    ``links`` are those of all documents in order; ``pairs`` the different ones and ``times``
    their numbers. The table is written, so that block numbers stay what they are. Texts come in
    small batches and row groups are small, so that memory does not depend on how the input is dealt out.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = TaskContext.get().partitionId() << 32, 0
        keys, found, size, key_type = [], [], 0, None

        def give() -> pa.RecordBatch:
            nonlocal number, size
            links = b"".join([x.links for x in found])
            pairs, times = np.unique(np.frombuffer(links, maker.dtype), return_counts=True)
            row = {
                "block": pa.array([own | number], pa.int64()),
                "keys": pa.array([keys], pa.list_(key_type)),
                "n_a": pa.array([[x.n_a for x in found]], pa.list_(pa.int64())),
                "n_b": pa.array([[x.n_b for x in found]], pa.list_(pa.int64())),
                "sha": pa.array([[hashlib.sha256(x.groups).hexdigest() if x.groups else "" for x in found]], pa.list_(pa.string())),
                "n_links": pa.array([[len(x.links) // width for x in found]], pa.list_(pa.int64())),
                "links": [links], "pairs": [pairs.tobytes()], "times": [times.astype("<u8").tobytes()],
            }
            number, size = number + 1, 0
            keys.clear(), found.clear()
            return pa.RecordBatch.from_pydict({k: as_array(v) for k, v in row.items()})

        maker = aligner(path_a, path_b)
        width = np.dtype(maker.dtype).itemsize
        nothing = Aligned(b"", b"", 0, 0)
        for batch in portions(batches, 1, ALIGNED_ROWS, ALIGNED_BYTES):
            key_type = batch.column(0).type
            for k, x in zip(batch.column(0).to_pylist(), maker.align(batch.column(1).to_pylist())):
                keys.append(k)
                found.append(x or nothing)
                size += len(found[-1].links)
                if len(keys) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield give()
            give_back()
        if keys:
            yield give()

    schema = (
        f"block long, keys array<{kind}>, n_a array<long>, n_b array<long>, sha array<string>, n_links array<long>,"
        " links binary, pairs binary, times binary"
    )
    with held_at(docs.sparkSession, {ARROW_ROWS: ALIGNED_ROWS}):
        return settle(docs.select(key, text).mapInArrow(run, schema), "blocks", options=BLOCK_FILES)


def pair_counts(made: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, same, n): links of every pair in the corpus; ``same`` if its tokens have the same bytes.

    Same-byte pairs are summed in a vector by A's id and leave a task as at most one row for
    each id; other pairs are summed in the task as far as memory allows and then by shuffle.
    """

    known = pairs_of(aligner(path_a, path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_more_texts()
        vector, waiting, size = np.zeros(len(known.same), np.int64), [], 0

        def rows(pairs: np.ndarray, same: bool, n: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(pairs.astype(np.int64)), pa.array(np.full(len(pairs), same)), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["pair", "same", "n"])

        def summed() -> pa.RecordBatch:
            pairs, times = (np.concatenate(x) for x in zip(*waiting))
            different, at = np.unique(pairs, return_inverse=True)
            waiting.clear()
            return rows(different, False, np.bincount(at, weights=times))

        for batch in batches:
            for raw, often in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, times = np.frombuffer(raw, known.dtype), np.frombuffer(often, "<u8")
                same = known.split(pairs)
                np.add.at(vector, (pairs[same] // known.size_b).astype(np.int64), times[same].astype(np.int64))
                waiting.append((pairs[~same], times[~same]))
                size += int((~same).sum())
                if size > PAIRS:
                    yield summed()
                    size = 0
        if waiting:
            yield summed()
        used = np.flatnonzero(vector)
        if len(used):
            yield rows(used * known.size_b + known.same[used], True, vector[used])

    counted = made.select("pairs", "times").mapInArrow(run, "pair long, same boolean, n long")
    return counted.groupBy("pair", "same").agg(F.sum("n").alias("n"))


def report(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How every text's tokens align: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a token of A and a token of B that end at the same byte: the last ones of each
    group. The count of a pair of ids is the number of its links in all texts; ``count_sum`` adds it up over
    the text's links, and ``n_best`` counts the links whose pair has the highest count of all pairs with
    its id of B. Texts without tokens (see :func:`groups`) have zeros and ''. Rows that
    repeat a key are rows of their own; other columns are not looked at.

    The driver sees two vectors as long as the vocabularies: the counts of same-byte pairs
    and the highest count for each id of B.
    """
    made = blocks(docs, path_a, path_b, key, text)
    counts = settle(pair_counts(made, path_a, path_b), "pairs")
    kind, pairing = dict(docs.dtypes)[key], pairs_of(aligner(path_a, path_b))
    size_b = pairing.size_b
    top = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(size_b, np.int64)
    best[top.column("b").to_numpy()] = top.column("n").to_numpy()
    same = counts.where("same").select((F.col("pair") / size_b).cast("long").alias("a"), "n").toArrow()
    known = np.zeros(len(pairing.same), np.int64)
    known[same.column("a").to_numpy()] = same.column("n").to_numpy()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_more_texts()
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = np.frombuffer(raw, pairing.dtype)
                pairs = pairs[~pairing.split(pairs)].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(pairs), block)), "pair": pa.array(pairs)})

    wanted = made.select("block", "pairs").mapInArrow(asked, "block long, pair long")
    answers = wanted.join(counts.where("not same").select("pair", "n").hint("shuffle_hash"), "pair")

    def lines(left: pa.Table, right: pa.Table) -> pa.Table:
        no_more_texts()
        order = np.argsort(right.column("pair").to_numpy())
        pairs, n = right.column("pair").to_numpy()[order], right.column("n").to_numpy()[order]
        out = []
        for row in left.to_pylist():
            links = np.frombuffer(row["links"], pairing.dtype).astype(np.int64)
            a, b = np.divmod(links, size_b)
            count = np.where(pairing.same[a] == b, known[a], 0)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
                count = np.where(pairs[at] == links, n[at], count)
            ends = np.cumsum(np.array(row["n_links"], np.int64))
            upto = [np.append(0, np.cumsum(x)) for x in (count, count == best[b])]
            total, highest = (x[ends] - x[ends - np.array(row["n_links"], np.int64)] for x in upto)
            longs = [row["n_a"], row["n_b"], row["n_links"], row["n_links"], highest, total]
            arrays = [pa.array(row["keys"], left.schema.field("keys").type.value_type), *(pa.array(x, pa.int64()) for x in longs)]
            out.append(pa.Table.from_arrays([*arrays, pa.array(row["sha"], pa.string())], names=names))
        return pa.concat_tables(out) if out else schema_table

    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string"
    schema_table = docs.sparkSession.createDataFrame([], schema).toArrow()
    bodies = made.drop("pairs", "times").groupBy("block")
    return bodies.cogroup(answers.groupBy("block")).applyInArrow(lines, schema)
