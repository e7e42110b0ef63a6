"""SimHash near-duplicates with bit-sliced distances (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import map_batches, raw_texts
from signalloom.llm.components import Forest, components
from signalloom.runtime import materialise

SEED = 42
BITS = 64
#: Fingerprints of one bucket that a task compares; larger buckets are cut and their parts paired.
PART = 16_384
#: Buckets up to this size are compared as blocks of pairs.
FEW = 48
#: Pairs in a block.
PAIRS = 1 << 16


# --- fingerprints ---


def fingerprint(raw: bytes, width: int = 4) -> int:
    """Majority bits of the hashes of all ``width``-word shingles, repeats included.

    A-Z are lower-cased and words end at ASCII white space. Fewer words than a shingle
    has are one shingle; no word gives zero. A bit is 1 only if set in over half the hashes.
    """
    return majority(shingles(raw, width))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Hashes of all ``width``-word shingles in their order, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as one number."""
    hashes = hashes.astype(">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), PAIRS):
        bits = np.unpackbits(hashes[start : start + PAIRS].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, also: Sequence[str] = ()
) -> DataFrame:
    """(key, columns ``also``, fingerprint as a signed long) of every row; NULL texts count as empty."""

    def run(batch):
        found = np.array([fingerprint(raw, width) for raw in raw_texts(batch.column(1))], dtype=np.uint64)
        return dict(zip([key, *also], [batch.column(0), *batch.columns[2:]])) | {"fingerprint": found.view(np.int64)}

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *also)), "fingerprint long"])
    return map_batches(docs, [key, text, *also], run, schema)


# --- distances ---


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: bit k of every value stands in row k. Padded with zeros to whole words."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(planes: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """One bit per column: set where at most ``radius`` of the planes have a 1.

    Two planes at a time go through a carry-save adder into counters whose bits are words
    themselves, so one operation updates 64 distances. The block is abandoned (None) as
    soon as every distance exceeds the radius.
    """
    digits = radius.bit_length() + 1
    counter: list = []
    over = None
    for step, (x, y) in enumerate(zip(planes, planes)):
        if not counter:
            counter = [np.zeros_like(x) for _ in range(digits)]
            over = np.zeros_like(x)
        ones = counter[0]
        half = x ^ y
        carry = (x & y) | (ones & half)
        counter[0] = ones ^ half
        for k in range(1, digits):
            carry, counter[k] = counter[k] & carry, counter[k] ^ carry
        over |= carry
        if step % 4 == 3:
            far = _exceeds(counter, over, radius)
            if not np.any(~far):
                return None
    return ~_exceeds(counter, over, radius)


def _exceeds(counter: list, over: np.ndarray, radius: int) -> np.ndarray:
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def flags(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


@cache
def _pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def links_in_pairs(values: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the given pairs are within the radius, block by block."""
    out = np.zeros(len(i), dtype=bool)
    for start in range(0, len(i), PAIRS):
        a, b = i[start : start + PAIRS], j[start : start + PAIRS]
        found = near(iter(bit_planes(values[a] ^ values[b])), radius)
        if found is not None:
            out[start : start + len(a)] = flags(found, len(a))
    return out


def links_in_bucket(values: np.ndarray, radius: int, queries: int = 64) -> list[tuple[int, int]]:
    """A spanning forest of the links between the values of one large bucket.

    Values not yet reached stand in bit planes; those just reached are compared with all
    of them at once. A value leaves the planes when it is reached, so a group of near
    copies costs little more than its size.
    """
    links: list[tuple[int, int]] = []
    waiting = np.arange(len(values))
    planes = bit_planes(values)
    gone = np.zeros(len(waiting), dtype=bool)
    reached: list[int] = []
    while True:
        if not reached:
            rest = np.flatnonzero(~gone)
            if not len(rest):
                return links
            gone[rest[0]] = True
            reached.append(int(waiting[rest[0]]))
        if 2 * np.count_nonzero(gone) > len(gone):
            waiting = waiting[~gone]
            if not len(waiting):
                return links
            planes, gone = bit_planes(values[waiting]), np.zeros(len(waiting), dtype=bool)
        batch, reached = reached[:queries], reached[queries:]
        asked = values[batch]
        rows = (planes[b][None, :] ^ np.where(asked >> np.uint64(b) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None] for b in range(BITS))
        found = near(rows, radius)
        if found is None:
            continue
        hits = flags(found, len(waiting))
        hits &= ~gone
        new = np.flatnonzero(hits.any(axis=0))
        by = hits[:, new].argmax(axis=0)
        links += [(int(batch[q]), int(waiting[w])) for q, w in zip(by, new)]
        gone[new] = True
        reached += waiting[new].tolist()


# --- buckets ---


def block_masks(radius: int, spare: int = 2) -> list[int]:
    """Masks of ``spare`` of ``radius + spare`` blocks of bits.

    Differing bits fall into at most ``radius`` blocks, so two values within the radius
    agree on all bits of at least one mask.
    """
    edges = [round(BITS * k / (radius + spare)) for k in range(radius + spare + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, spare)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_links(values: DataFrame, radius: int, part: int = PART) -> DataFrame:
    """Links (a, b) of different fingerprints that connect all within the radius.

    ``values`` has one row per different fingerprint. Candidates meet in buckets of equal
    bits. A bucket of more than ``part`` is dealt into parts and every two parts meet in
    a task of their own, so no task holds more than two parts.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(block_masks(radius))])
    keyed = values.select("fingerprint", F.explode(masks).alias("key")).select("key.mask", "key.bits", "fingerprint")
    large = keyed.groupBy("mask", "bits").count().where(F.col("count") > part)
    large = materialise(large.select("mask", "bits", F.ceil(F.col("count") / part).cast("int").alias("parts")), "buckets")
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    if large.isEmpty():
        dealt = keyed.select("mask", "bits", "fingerprint", one.getItem(0).alias("meet"))
    else:
        own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
        dealt = keyed.join(large, ["mask", "bits"], "left").select("mask", "bits", "fingerprint", F.explode(F.when(F.col("parts").isNull(), one).otherwise(meets)).alias("meet"))
    groups = dealt.groupBy("mask", "bits", "meet").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)

    def run(batches):
        forest = Forest()
        for batch in batches:
            members = batch.column(0)
            lists = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in members]
            few = [x for x in lists if len(x) <= FEW]
            if few:
                values, base, i, j = np.concatenate(few), 0, [], []
                for x in few:
                    a, b = _pairs_of(len(x))
                    i.append(a + base)
                    j.append(b + base)
                    base += len(x)
                i, j = np.concatenate(i), np.concatenate(j)
                hit = links_in_pairs(values, i, j, radius)
                signed = values.view(np.int64)
                forest.add(zip(signed[i[hit]].tolist(), signed[j[hit]].tolist()))
            for x in lists:
                if len(x) > FEW:
                    signed = x.view(np.int64).tolist()
                    forest.add((signed[a], signed[b]) for a, b in links_in_bucket(x, radius))
            yield from _drain(forest)
            if len(forest.parent) > 1_000_000:
                forest = Forest()

    return groups.select("members").mapInArrow(run, "a long, b long")


def _drain(forest: Forest) -> Iterator[pa.RecordBatch]:
    if forest.links:
        a, b = zip(*forest.links)
        forest.links = []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, also: Sequence[str] = ()
) -> DataFrame:
    """Every row with its fingerprint and group: key, columns ``also``, fingerprint (16 hex
    digits), component_id, root.

    Fingerprints are linked when at most ``radius`` bits differ; a group is what links
    connect, named by its smallest key. Equal fingerprints are compared once. Texts
    without a word have fingerprint zero and are linked like any other. Rows that repeat
    give a row each. A NULL key never names a group unless the group has no other. Where
    rows share a key, two groups may share their smallest one; ``root`` (a fingerprint, as a
    signed long) tells them apart.
    Other columns are not looked at.
    """
    prints = materialise(fingerprints(docs, key, text, width, also), "fingerprints")
    different = prints.groupBy("fingerprint").agg(F.min(key).alias("first"))
    links = bucket_links(different.select("fingerprint"), radius)
    roots = components(links)
    group = different.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first"
    )
    named = group.groupBy("root").agg(F.min("first").alias("component_id"))
    named = group.join(named, "root").select("fingerprint", "component_id", "root")
    return prints.join(named, "fingerprint").select(
        key, *also, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "root"
    )
