"""Token ids of whole texts, piece by piece.

A byte-level tokenizer never joins characters across a space that a non-space follows:
such a space always opens the next pre-token. Texts are cut there, each different piece
is encoded once, and its ids are kept for the next time it occurs. The result equals
encoding the whole text at once.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pre-token pattern of this family of vocabularies.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = regex.compile(PRE_TOKENS)
#: Different pieces, and different words, of one generation of a worker's memory: some 60 MB each.
REMEMBERED = 400_000
#: Finds a character after the Cyrillic letters.
NOT_PLAIN = re.compile("[^\0-\u052f]").search
#: Latin letters without a doubt.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c not in "\xaa\xba")
#: A piece of one word and marks behind it, which are two pre-tokens.
WORD_AND_MARKS = r"\A\n?[A-Za-zÀ-ÖØ-öø-ɏµ]+[!-/:-@\[-`{-~]*\z"
#: Longer pieces (in characters) are not remembered.
LONG_PIECE = 64


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def special_strings(path: str) -> dict[str, int]:
    """Added strings of a tokenizer file that are single ids wherever they stand."""
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file).get("added_tokens", [])}


class PieceSplitter:
    """Cuts a text before every space that a non-space follows.

    A space before an added string is no place to cut: what stands before the string
    ends there for the tokenizer, and a run of spaces at an end stays together.
    """

    def __init__(self, specials: Iterable[str]):
        self.specials = list(specials)
        stop = "".join(f"(?!{re.escape(s)})" for s in self.specials)
        self.cut = re.compile(rf" (?=\S){stop}")
        self.unclear = re.compile(r" (?=\s|\Z)")
        self.ragged = re.compile(r"\n(?:\s|(?<=\s\n))").search

    def careful(self, text: str) -> bool:
        """Whether some space of the text may be no place to cut."""
        return any(s in text for s in self.specials) or self.unclear.search(text) is not None

    def lines(self, text: str) -> str:
        """A text that needs no care, with a space to cut at before every line end between other
        characters than white space: there a pre-token ends, and the line end is one."""
        return text.replace("\n", " \n") if "\n" in text and not self.ragged(text) else text

    def __call__(self, text: str) -> list[str]:
        """Pieces without the space they begin with (the first one begins with none)."""
        return self.cut.split(text) if self.careful(text) else text.split(" ")


class Memory:
    """Remembers what was used lately: two generations, of which the older one is dropped
    when the younger one is full. Long strings are forgotten after their batch."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def unknown(self, wanted: set[str]) -> set[str]:
        """What of ``wanted`` is not remembered; what is becomes young again."""
        missing = wanted.difference(self.young)
        if self.old:
            again = {x for x in missing if x in self.old}
            self.young.update((x, self.old[x]) for x in again)
            missing -= again
        return missing

    def learn(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.long += [x for x in found if len(x) > LONG_PIECE]

    def end_batch(self) -> None:
        for x in self.long:
            self.young.pop(x, None)
        self.long = []
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


class TextEncoder:
    """Ids of texts, in three steps: pieces, then the words of new pieces, then new words.

    ``encode_words`` packs the ids of pre-tokens, ``encode_pieces`` gives those of whole pieces. Only pieces of
    Latin, Greek and Cyrillic letters are cut into words here, where every Unicode version
    agrees on what a letter is; any other piece is left to ``encode_pieces``.
    """

    def __init__(
        self,
        specials: list[str],
        encode_words: Callable[[list[str]], list[bytes]],
        encode_pieces: Callable[[list[str]], list[list[int]]],
        dtype: str,
        remembered: int = REMEMBERED,
    ):
        self.split = PieceSplitter(specials)
        self.marked = re.compile("|".join(map(re.escape, specials))).search if specials else None
        self.encode_words = encode_words
        self.encode_pieces = encode_pieces
        self.dtype = dtype
        self.words, self.inner, self.first = (Memory(remembered) for _ in range(3))

    def _new(self, unknown: set[str], lead: str) -> dict[str, bytes]:
        """Packed ids of pieces that are not remembered, each behind ``lead``.

        Pieces behind a space are cut into words in one go: every piece opens with a word
        that begins with a space, and holds no other such word unless it holds a space.
        """
        whole = " ".join(unknown)
        other = {p for p in unknown if NOT_PLAIN(p)} if NOT_PLAIN(whole) else set()
        if self.marked and self.marked(whole):
            other.update(p for p in unknown if self.marked(p))
        apart = [p for p in unknown if not lead or not p or " " in p or p[0].isspace()]
        rest = unknown.difference(other, apart)
        together = list(rest)
        words = WORDS.findall(lead + lead.join(together)) if together else []
        opens = [i for i, w in enumerate(words) if w[0] == " "]
        for piece in apart:
            if piece not in other:
                together.append(piece)
                opens.append(len(words))
                words += WORDS.findall(lead + piece)
        fresh = list(self.words.unknown(set(words)))
        self.words.learn(dict(zip(fresh, self.encode_words(fresh))))
        packed = list(map(self.words.young.__getitem__, words))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed))))
        edges = [*ends[opens].tolist(), int(ends[-1])]
        raw = b"".join(packed)
        learned = {p: raw[a:b] for p, a, b in zip(together, edges, edges[1:])}
        foreign = list(other)
        for piece, ids in zip(foreign, self.encode_pieces([lead + p for p in foreign])):
            learned[piece] = np.array(ids, dtype=self.dtype).tobytes()
        self.words.end_batch()
        return learned

    def _learn(self, memory: Memory, pieces: set[str], lead: str) -> None:
        memory.learn(self._new(memory.unknown(pieces), lead))

    def _cut(self, batch: list[str]) -> tuple[list[str], list[list[str]]]:
        """First pieces, all known afterwards, and other pieces of every text."""
        cut = [self.split(text) for text in batch]
        heads = [pieces.pop(0) for pieces in cut]
        self._learn(self.first, set(heads), "")
        return heads, cut

    def _look_up(
        self, memory: Memory, lead: str, names: pa.Array, wanted: np.ndarray, known: list[bytes], places: np.ndarray
    ) -> None:
        """Add the packed ids of the wanted names, each behind ``lead``, to ``known`` and say in ``places`` where.

        A name that is a word and marks is not remembered whole: the ids of its word and of its marks
        follow one another, so it has two places. Without a lead all names begin with a line end.
        """
        plain = wanted & pc.match_substring_regex(names, WORD_AND_MARKS).to_numpy(zero_copy_only=False)
        for special in self.split.specials:
            plain &= ~pc.match_substring(names, special).to_numpy(zero_copy_only=False)
        several = wanted & ~plain
        whole = names.filter(pa.array(plain))
        words = pc.ascii_rtrim(whole, string.punctuation).dictionary_encode()
        marks = pc.utf8_ltrim(whole, "\n" + LETTERS).dictionary_encode()
        stems, tails, others = (
            x.to_numpy(zero_copy_only=False).tolist() for x in (words.dictionary, marks.dictionary, names.filter(pa.array(several)))
        )

        found = list(map(memory.young.get, stems))
        new = [k for k, ids in enumerate(found) if ids is None]
        fresh = list(memory.unknown({stems[k] for k in new}))
        if lead:
            learned = self.encode_words([lead + w for w in fresh])
        else:
            opening = self.encode_words(["\n"])[0]
            learned = [opening + ids for ids in self.encode_words([w[1:] for w in fresh])]
        memory.learn(dict(zip(fresh, learned)))
        for k in new:
            found[k] = memory.young[stems[k]]
        self._learn(memory, set(others), lead)
        fresh = list(self.words.unknown(set(tails) - {""}))
        self.words.learn(dict(zip(fresh, self.encode_words(fresh))))
        ends = [self.words.young[t] if t else b"" for t in tails]
        self.words.end_batch()

        places[plain, 0] = len(known) + words.indices.to_numpy()
        known += found
        places[several, 0] = len(known) + np.arange(len(others))
        known += map(memory.young.__getitem__, others)
        places[plain, 1] = len(known) + marks.indices.to_numpy()
        known += ends

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of every text. Arrow cuts the texts, numbers the different pieces and takes marks off words,
        so that memory is asked once for each word; numpy puts their ids in a row."""
        careful = [self.split.careful(text) for text in batch]
        order = np.argsort(careful, kind="stable").tolist()
        cut = [self.split.lines(t) for t, c in zip(batch, careful) if not c]
        simple = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        others = [self.split.cut.split(t) for t, c in zip(batch, careful) if c]
        pieces = pa.concat_arrays([simple.flatten(), pa.array(list(chain.from_iterable(others)), pa.large_string())])
        numbered = pieces.dictionary_encode()
        names = numbered.dictionary
        which = numbered.indices.to_numpy().astype(np.int64)
        sizes = np.append(np.diff(simple.offsets.to_numpy()), np.fromiter(map(len, others), np.int64, len(others)))
        edges = np.append(0, np.cumsum(sizes))
        heads = names.take(pa.array(which[edges[:-1]])).to_pylist()
        which[edges[:-1]] = len(names) + np.arange(len(heads))
        inner = np.bincount(which, minlength=len(names))[: len(names)] > 0

        line = pc.starts_with(names, "\n").to_numpy(zero_copy_only=False)
        known, places = [b""], np.zeros((len(names) + len(heads), 2), np.int64)
        self._look_up(self.inner, " ", names, inner & ~line, known, places[: len(names)])
        self._look_up(self.first, "", names, inner & line, known, places[: len(names)])
        self._learn(self.first, set(heads), "")
        places[len(names) :, 0] = len(known) + np.arange(len(heads))
        known += map(self.first.young.__getitem__, heads)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.dtype).itemsize
        parts = places[which].ravel()
        begins, taken = (np.cumsum(lengths) - lengths)[parts], lengths[parts]
        ends = np.append(0, np.cumsum(taken))
        where = np.repeat(begins - ends[:-1], taken)
        where += np.arange(len(where))
        ids = np.frombuffer(b"".join(known), dtype=self.dtype)[where]
        ends = ends[2 * edges]
        out: list[np.ndarray] = [ids] * len(batch)
        for text, a, b in zip(order, ends[:-1].tolist(), ends[1:].tolist()):
            out[text] = ids[a:b]
        self.inner.end_batch()
        self.first.end_batch()
        return out

    def parts(self, batch: list[str], lead: str = " ") -> list[bytes]:
        """Packed ids of different pieces, without the space that each begins with, or that have no ``lead``."""
        memory = self.inner if lead else self.first
        self._learn(memory, set(batch), lead)
        out = list(map(memory.young.__getitem__, batch))
        memory.end_batch()
        return out

    def counts(self, batch: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """Pieces of every text, joined they are the text, and the number of ids of each."""
        heads, cut = self._cut(batch)
        self._learn(self.inner, set().union(*cut), " ")
        first, inner = self.first.young, self.inner.young.__getitem__
        size = np.dtype(self.dtype).itemsize
        out = []
        for h, p in zip(heads, cut):
            sizes = np.fromiter(map(len, map(inner, p)), np.int64, len(p))
            out.append(([h, *[" " + x for x in p]], np.append(len(first[h]), sizes) // size))
        self.inner.end_batch()
        self.first.end_batch()
        return out


def id_dtype(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte.

    Bytes that print are written as themselves; the others take the letters
    from U+0100 on, in ascending order.
    """
    printing = {b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)}
    silent = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(0x100 + i): b for i, b in enumerate(silent)}


class ModelWords:
    """Gives pre-tokens to the merges of the tokenizers library, past its search for pre-tokens."""

    def __init__(self, tokenizer, dtype: str):
        self.merges = tokenizer.model.tokenize
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.dtype = np.dtype(dtype)

    def __call__(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        merges, seam = self.merges, b"\xff"  # no byte of UTF-8
        spelled = seam.join([w.encode() for w in words]).decode("latin-1").translate(self.letters)
        ids: list[int] = []
        ends = [0]
        for word in spelled.split(self.letters[seam[0]]) if words else []:
            ids += [token.id for token in merges(word)]
            ends.append(len(ids) * self.dtype.itemsize)
        raw = np.array(ids, dtype=self.dtype).tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[str, TextEncoder] = {}


def library_encoder(path: str, plain: bool = False, remembered: int = REMEMBERED) -> TextEncoder:
    """The tokenizers library behind the piece memory; one per worker and file.

    ``plain`` takes the strings of special ids in a text for ordinary text.
    """
    name = f"{path}:plain" if plain else path
    if name not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = plain
        dtype = id_dtype(tokenizer.get_vocab_size(with_added_tokens=True))
        specials = [] if plain else list(special_strings(path))

        def singly(pieces: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

        _ENCODERS[name] = TextEncoder(specials, ModelWords(tokenizer, dtype), singly, dtype, remembered)
    return _ENCODERS[name]
