"""Byte pair encoding by a queue of merges over a linked list of symbols (operator 9)."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalloom.llm.batches import map_batches, texts
from signalloom.llm.tokenizing import WORDS, TextEncoder, byte_letters, id_dtype


class BytePairCodec:
    """Vocabulary and merges of a tokenizer file, with its own encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocabulary.items() if s not in self.specials}
        self.strings |= {i: s.encode() for s, i in self.specials.items()}
        self.size = max(self.strings) + 1
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocabulary[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        joined = "|".join(re.escape(s) for s in self.specials)
        self.parts = re.compile(f"({joined})") if joined else None

    def encode_word(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        Symbols form a doubly linked list over their first byte. A queue entry is stale
        when its left symbol is gone or no longer forms that pair with its neighbour.
        """
        symbols = [self.byte_ids[b] for b in word]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = []
        for i in range(n - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in merges:
                queue.append((merges[pair][0], i, *pair))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merges[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    pair = (symbols[a], symbols[b])
                    if pair in merges:
                        heapq.heappush(queue, (merges[pair][0], a, *pair))
        return [s for s in symbols if s >= 0]

    def encode_text(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                for word in WORDS.findall(part):
                    out += self.encode_word(word.encode())
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", errors="replace")


_CODECS: dict[str, tuple[BytePairCodec, TextEncoder]] = {}


def codec(path: str) -> tuple[BytePairCodec, TextEncoder]:
    if path not in _CODECS:
        own = BytePairCodec(path)
        dtype = id_dtype(own.size)
        encoder = TextEncoder(
            list(own.specials),
            lambda words: [np.array(own.encode_word(w.encode()), dtype=dtype).tobytes() for w in words],
            lambda pieces: [own.encode_text(p) for p in pieces],
            dtype,
        )
        _CODECS[path] = own, encoder
    return _CODECS[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text as an array: key, ids. NULL texts are empty; rows stay as they are."""

    def run(batch):
        _, encoder = codec(path)
        ids = encoder.encode(texts(batch.column(1)))
        return {key: batch.column(0), "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))}

    kind = dict(docs.dtypes)[key]
    return map_batches(docs, [key, text], run, f"`{key}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of arrays of ids: key, text. A NULL array gives an empty text."""

    def run(batch):
        own, _ = codec(path)
        return {key: batch.column(0), "text": [own.decode(i or []) for i in batch.column(1).to_pylist()]}

    kind = dict(rows.dtypes)[key]
    return map_batches(rows, [key, ids], run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text and keep digests: key, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle. NULL and empty texts have no token; rows that repeat a key
    or a text give a row each; other columns are not looked at.
    """

    def run(batch):
        own, encoder = codec(path)
        n, ids_sha, text_sha = [], [], []
        for ids in encoder.encode(texts(batch.column(1))):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids.tolist()).encode()).hexdigest())
        return {key: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, [key, text], run, schema)
