"""Token id files with a minimal perfect hash index (operator 10).

A corpus is a folder of *shard* files, each holding documents that follow one another:

    magic "TKSHARD1" | header: 9 little-endian int64
      order      place of the shard among all shards
      keys       number of documents
      tokens     number of ids
      width      bytes of an id (2 or 4)
      levels     levels of the index
      words      64-bit words of the index
      first      smallest key
      last       largest key
      fence      bytes from here to the end of the payload
    levels x int64   bits of each level
    words  x uint64  the levels' bit sets, one after another
    words  x uint32  ones before each word
    keys   x uint32  fingerprint of the document in each slot
    keys   x uint64  where its ids begin | length in ids, in each slot (two arrays)
    keys   x int64   keys, and keys x uint32 their turns, in document order
    tokens x id      the payload

``_shards`` beside the files is a table of their order, name and keys. Looking a key up reads
there which shards can hold it, and in each hashes it level by level to a bit that is set, counts the ones before it,
and reads the slot: a constant number of reads, however many documents the shard has.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.batches import slices, texts
from signalloom.llm.ranges import bucket_limits, buckets_of
from signalloom.llm.tables import CLEANUP, settle
from signalloom.llm.tokenizing import library_encoder
from signalloom.runtime import scratch_path

MAGIC = b"TKSHARD1"
HEADER = struct.Struct("<9q")
#: Bytes of ids after which a shard is closed; a longer document has a shard of its own.
SHARD_BYTES = 4 << 20
#: Documents of one bucket of keys.
BUCKET_ROWS = 2_000
#: Bits of a level for every key that reaches it.
ROOM = 2
MAX_LEVELS = 64
#: Name of the table of shards; Spark does not read names that begin so with the files.
TABLE = "_shards"
NULL_KEY = np.iinfo(np.int64).min


# --- the index ---


def _hash(keys: np.ndarray, turns: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of (key, turn); turn tells rows of one key apart."""
    x = keys.view(np.uint64) ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for add in (turns.astype(np.uint64), np.uint64(seed)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + add
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class KeyIndex:
    """A minimal perfect hash: every key that was given has a slot of its own in 0 .. n - 1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, before: np.ndarray, marks: np.ndarray):
        self.sizes, self.words, self.before, self.marks = sizes, words, before, marks

    @classmethod
    def build(cls, keys: np.ndarray, turns: np.ndarray) -> KeyIndex:
        """Level by level: keys that hit a bit alone settle there, the others go on."""
        sizes, levels, left = [], [], np.arange(len(keys))
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("two rows have the same key and turn")
            size = -(-ROOM * len(left) // 64) * 64
            at = (_hash(keys[left], turns[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.uint32)
        index = cls(np.array(sizes, np.int64), words, np.cumsum(ones, dtype=np.uint32) - ones, np.zeros(len(keys), np.uint32))
        index.marks[index._slots(keys, turns)] = index.fingerprints(keys, turns)
        return index

    @staticmethod
    def fingerprints(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return (_hash(keys, turns, MAX_LEVELS) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
        slots, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = (_hash(keys[left], turns[left], level) % np.uint64(size)).astype(np.int64) + base
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> shift & np.uint64(1)).astype(bool)
            under = self.words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            slots[left[hit]] = (self.before[word] + np.bitwise_count(under))[hit]
            left, base = left[~hit], base + size
        return slots

    def find(self, keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where the fingerprint shows that a key was not given."""
        slots = self._slots(keys, turns)
        known = slots >= 0
        known[known] = self.marks[slots[known]] == self.fingerprints(keys[known], turns[known])
        return np.where(known, slots, -1)


# --- a shard ---


def shard_bytes(order: int, keys: np.ndarray, turns: np.ndarray, ids: list[np.ndarray], width: int) -> bytes:
    lengths = np.array([len(x) for x in ids], np.uint64)
    begin = np.cumsum(lengths) - lengths
    index = KeyIndex.build(keys, turns)
    slots = index.find(keys, turns)
    by_slot = np.empty((2, len(keys)), np.uint64)
    by_slot[:, slots] = begin, lengths
    parts = [
        index.sizes.astype("<i8"), index.words.astype("<u8"), index.before.astype("<u4"), index.marks.astype("<u4"),
        by_slot.astype("<u8"), keys.astype("<i8"), turns.astype("<u4"), *(x.astype(f"<u{width}") for x in ids),
    ]
    body = b"".join(p.tobytes() for p in parts)
    first, last = (int(keys[0]), int(keys[-1])) if len(keys) else (0, 0)
    head = (order, len(keys), int(lengths.sum()), width, len(index.sizes), len(index.words), first, last, len(body))
    return MAGIC + HEADER.pack(*head) + body


class Shard:
    """A shard file in memory; arrays are views of its bytes."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.order, n, self.tokens, width, levels, words, self.first, self.last, fence = HEADER.unpack_from(raw, len(MAGIC))
        at = len(MAGIC) + HEADER.size
        if len(raw) < at + fence:
            raise ValueError("a token shard is cut short")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.index = KeyIndex(take("<i8", levels), take("<u8", words), take("<u4", words), take("<u4", n))
        self.begin, self.length = take("<u8", n), take("<u8", n)
        self.keys, self.turns = take("<i8", n), take("<u4", n)
        self.payload = take(f"<u{width}", self.tokens)

    @staticmethod
    def head(raw: bytes) -> tuple[int, ...]:
        """The numbers of the header, in their order."""
        return HEADER.unpack_from(raw, len(MAGIC))

    def holds(self, key: int, turn: int) -> bool:
        """Whether key and turn stand among the sorted keys."""
        at = int(np.searchsorted(self.keys, key)) + turn
        return at < len(self.keys) and self.keys[at] == key

    def find(self, keys: np.ndarray, turns: np.ndarray | None = None) -> list[np.ndarray | None]:
        """Ids of each key (and turn, 0 if not given), None for keys that are not here."""
        turns = np.zeros(len(keys), np.uint32) if turns is None else turns
        out: list[np.ndarray | None] = []
        for slot in self.index.find(np.asarray(keys, np.int64), np.asarray(turns, np.uint32)).tolist():
            if slot < 0:
                out.append(None)
            else:
                begin = int(self.begin[slot])
                out.append(self.payload[begin : begin + int(self.length[slot])])
        return out


# --- Spark ---


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode every text, add ``end_id`` and write shard files below ``folder``, ordered by key.

    Files are written by Spark, so the folder may be in any store it reaches. Tasks hold
    one shard at a time. NULL and empty texts are the end id alone; a NULL key comes first;
    rows that share a key are told apart by a turn. Other columns are not written.
    """
    limits = bucket_limits(docs, key, BUCKET_ROWS)

    def encoded(batches):
        for batch in slices(batches):
            ids = [x.tobytes() for x in library_encoder(path).encode(texts(batch.column(1)))]
            crc = np.array([zlib.crc32(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(buckets_of(batch.column(0), limits, crc)),
                    "key": batch.column(0).cast(pa.int64()),
                    "crc": pa.array(crc),
                    "ids": pa.array(ids, pa.binary()),
                }
            )

    def shards(batches):
        width = np.dtype(library_encoder(path).dtype).itemsize
        now, made, keys, ids, size = None, 0, [], [], 0

        def give():
            known = np.array([NULL_KEY if k is None else k for k in keys], np.int64)
            same = np.concatenate([[False], known[1:] == known[:-1]])
            run = np.arange(len(known))
            turns = (run - np.maximum.accumulate(np.where(same, 0, run))).astype(np.uint32)
            # The bucket goes first: shards of one bucket follow one another in its task.
            raw = shard_bytes(now << 32 | made, known, turns, ids, width)
            return pa.RecordBatch.from_pydict({"raw": pa.array([raw], pa.binary())})

        for batch in slices(batches, 256):
            for bucket, k, x in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if keys and (bucket != now or size >= SHARD_BYTES):
                    yield give()
                    made = made + 1 if bucket == now else 0
                    keys, ids, size = [], [], 0
                now = bucket
                keys.append(k)
                ids.append(np.append(np.frombuffer(x, f"<u{width}"), end_id).astype(f"<u{width}"))
                size += len(x)
        if keys:
            yield give()

    rows = docs.select(key, text).mapInArrow(encoded, "bucket long, key long, crc long, ids binary")
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "crc")
    files = ordered.mapInArrow(shards, "raw binary").select(F.col("raw").cast("string").alias("value"))
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A text file of one line is the line's bytes and a line end, which the format ignores.
        files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def _shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for raw in batch.column(0):
            if len(raw.as_py()) > 1:  # an empty task leaves an empty file
                yield Shard(raw.as_py())


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Every document of the files through their index: key, turn, order, place, n_tokens, ids_crc32.

    ``order`` and ``place`` are the shard and the place in it; a key the index does not find
    stops the job.
    """

    def run(batches):
        for shard in _shards_in(batches):
            found = shard.find(shard.keys, shard.turns)
            if any(x is None for x in found):
                raise ValueError("the index of a shard does not hold its own keys")
            lengths = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    key: pa.array(shard.keys, mask=shard.keys == NULL_KEY),
                    "turn": pa.array(shard.turns.astype(np.int64)),
                    "order": pa.array(np.full(len(found), shard.order, np.int64)),
                    "place": pa.array(np.cumsum(lengths) - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                }
            )

    schema = f"`{key}` long, turn long, `order` long, place long, n_tokens long, ids_crc32 long"
    return _files(spark, folder).mapInArrow(run, schema)


def shard_table(spark: SparkSession, folder: str) -> DataFrame:
    """(order, file, first, last) of every shard, written beside the files by the first call."""
    place = f"{folder}/{TABLE}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 1")
        size = len(MAGIC) + HEADER.size

        def run(batches):
            for batch in batches:
                heads = [Shard.head(x) for x in batch.column(1).to_pylist()]
                columns = {"order": [h[0] for h in heads], "file": batch.column(0).to_pylist()}
                yield pa.RecordBatch.from_pydict(columns | {"first": [h[6] for h in heads], "last": [h[7] for h in heads]})

        heads = files.select("path", F.substring("content", 1, size).alias("head"))
        heads.mapInArrow(run, "`order` long, file string, first long, last long").write.mode("overwrite").parquet(place)
    return spark.read.schema("`order` long, file string, first long, last long").parquet(place)


def lookup(spark: SparkSession, folder: str, keys: list[int], key: str = "doc_id") -> DataFrame:
    """(key, order, turn, ids) of all documents of each of a list of keys that the files hold.

    Only the shards whose keys enclose one of ``keys`` are read; a key that repeats has a row
    for each shard and turn. An unknown key has none.
    """
    wanted = np.array(sorted(set(keys)), np.int64)
    schema = f"`{key}` long, `order` long, turn long, ids array<int>"
    inside = F.exists(F.lit(wanted.tolist()), lambda k: k.between(F.col("first"), F.col("last"))) if len(wanted) else F.lit(False)
    files = [r.file for r in shard_table(spark, folder).where(inside).select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for shard in _shards_in(batches):
            turn, left = 0, wanted[(wanted >= shard.first) & (wanted <= shard.last)]
            while len(left):
                found = shard.find(left, np.full(len(left), turn, np.uint32))
                # A fingerprint may agree by chance, about once in four billion: the key decides.
                hits = [(int(k), x.tolist()) for k, x in zip(left, found) if x is not None and shard.holds(int(k), turn)]
                same = {"order": pa.array([shard.order] * len(hits), pa.int64()), "turn": pa.array([turn] * len(hits), pa.int64())}
                ids = pa.array([x for _, x in hits], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({key: pa.array([k for k, _ in hits], pa.int64()), **same, "ids": ids})
                turn, left = turn + 1, np.array([k for k, _ in hits], np.int64)

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema)


def written_and_read(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files, read them back and place every document among all ids.

    Gives key, start (ids of all documents before it), n_tokens (with the end id), ids_crc32.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    write(docs, folder, path, key, text)
    rows = settle(read(spark, folder, key), "documents")
    sizes = rows.groupBy("order").agg(F.sum("n_tokens").alias("n"))
    # One row per shard, counted up by bucket first: never all shards in one task.
    bucket = F.shiftright("order", 32)
    whole = sizes.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = sizes.join(whole, "bucket").select("order", (F.col("ahead") + F.col("inside")).alias("base"))
    return rows.join(starts, "order").select(key, (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
