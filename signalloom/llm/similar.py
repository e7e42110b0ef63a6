"""Groups of texts of like shingles: SimHash groups, completed beyond their radius, exact Jaccard.

Texts are first linked as operator 5 does it: buckets of equal bits, distances in bit planes,
components by star contraction. What the fingerprints link is confirmed by the shingle sets.

A similarity of 0.8 is some ten bits of a 64-bit fingerprint, with a tail beyond twenty. No
blocks of equal bits find candidates at such a radius: they would be three bits wide. Texts
of different SimHash groups therefore also meet where the smallest hashes of their shingles
agree (bands). There a task compares fingerprints at the wide radius, then the sets. It
gives links between groups and never a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import map_batches, raw_texts, slices
from signalloom.llm.components import Forest, components
from signalloom.llm.simhash import SEED, bucket_links, majority, shingles
from signalloom.llm.tables import settle

#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: at 0.8 all but 1.4e-7.
BANDS, ROWS = 30, 4
#: Distance of fingerprints up to which the sets are compared; over five sd from what 0.8 gives even for tiny texts.
RADIUS = 28
#: Of ``BANDS * ROWS`` smallest hashes, those a pair may have unequal in two bits; 0.8 gives 18, and more than
#: this with a probability of some 1e-8.
UNEQUAL = 45
#: Two bits of every smallest hash, as bit planes: a long holds one bit of half the hashes.
PLANES = ["low0", "high0", "low1", "high1"]
#: Bits that fingerprints linked in buckets of equal bits differ in at most.
LINKED = 4
#: Rows of a band, and bytes of their sets, that a task compares; larger bands are cut and their parts paired.
PART, PART_BYTES = 8_192, 8 << 20
#: Pairs looked at together.
PAIRS = 1 << 19

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of ``BANDS * ROWS`` orders."""
    return np.array([((hashes ^ x) * t).min() for x, t in zip(_FLIP, _TIMES)], np.uint64)


def bands(least: np.ndarray) -> list[int]:
    """A hash of every band's smallest hashes, told apart by the band's number."""
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def planes(least: np.ndarray) -> list[int]:
    """Bits 40 and 41 of the smallest hashes, half of the hashes after the other."""
    out = []
    for half in least.reshape(2, -1):
        for bit in (40, 41):
            ones = (half >> np.uint64(bit)) & np.uint64(1)
            out.append(int((ones << np.arange(len(half), dtype=np.uint64)).sum()))
    return out


def unequal(one: str = "", other: str = "other_") -> Column:
    """How many smallest hashes of two rows differ in the two bits of their planes."""
    differ = [F.col(f"{one}{c}").bitwiseXOR(F.col(f"{other}{c}")) for c in PLANES]
    return F.bit_count(differ[0].bitwiseOR(differ[1])) + F.bit_count(differ[2].bitwiseOR(differ[3]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def described(docs: DataFrame, key: str, text: str, width: int, also: Sequence[str]) -> DataFrame:
    """Every row with node (a hash of its words), fingerprint of its different shingles, and bands."""

    def run(batch):
        found = []
        for raw in raw_texts(batch.column(1)):
            hashes = np.unique(shingles(raw, width))
            node = xxhash.xxh64_intdigest(b" ".join(raw.lower().split()), SEED) - (1 << 63)
            least = smallest(hashes) if len(hashes) else None
            kept = ([], 0, 0, 0, 0) if least is None else (bands(least), *planes(least))
            found.append((node, majority(hashes) - (1 << 63), len(hashes), *kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * len(PLANES))
        names = ["node", "fingerprint", "size", "bands", *PLANES]
        carried = dict(zip([key, text, *also], batch.columns))
        return carried | {n: pa.array(c, kind) for n, c, kind in zip(names, zip(*found), kinds)}

    kinds = dict(docs.dtypes)
    own = "node long, fingerprint long, size long, bands array<long>, " + ", ".join(f"{c} long" for c in PLANES)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, text, *also)), own])
    return map_batches(docs, [key, text, *also], run, schema)


def confirmed(pairs: DataFrame, rows: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose shingle sets are at least ``similarity`` alike."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    whole = settle(rows.select("node", text).join(asked, "node", "left_semi").groupBy("node").agg(F.first(text).alias("text")), "asked")
    joined = pairs.join(whole.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    joined = joined.join(whole.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        for batch in slices(batches, 256):
            sets: dict[bytes, np.ndarray] = {}

            def of(raw):
                if raw not in sets:
                    sets[raw] = np.unique(shingles(raw, width))
                return sets[raw]

            texts = zip(raw_texts(batch.column(2)), raw_texts(batch.column(3)))
            alike = pa.array([jaccard(of(x), of(y)) >= similarity for x, y in texts], pa.bool_())
            yield batch.select(["a", "b"]).filter(alike)

    return settle(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "confirmed")


def linked(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are within ``LINKED`` bits.

    Those too unlike by size or by smallest hashes are left out before texts are joined.
    """
    first = settle(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
    links = settle(bucket_links(first.select("fingerprint"), LINKED).distinct(), "near")
    pairs = links.join(first.select(F.col("fingerprint").alias("a"), F.col("first").alias("one")), "a")
    pairs = pairs.join(first.select(F.col("fingerprint").alias("b"), F.col("first").alias("two")), "b").select("one", "two")
    equal = nodes.join(first, "fingerprint").where("node != first").select(F.col("first").alias("one"), F.col("node").alias("two"))
    pairs = pairs.union(equal).select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()
    known = ["size", *PLANES]
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), *known), "a")
    pairs = pairs.join(nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"other_{c}") for c in known]), "b")
    alike = F.least("size", "other_size") >= F.lit(similarity - 1e-9) * F.greatest("size", "other_size")
    return settle(pairs.where(alike & (unequal() <= UNEQUAL)).select("a", "b"), "pairs")


def dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of one band side by side in a partition, larger bands in parts of which every two meet.

    Adds ``own`` (a row's part) and ``x``, ``y`` (the parts that meet here).
    """
    large = rows.groupBy("band").agg(F.ceil(F.sum(weight) / most).cast("int").alias("parts")).where("parts > 1")
    large = settle(large, "large")
    if large.isEmpty():
        met = rows.select("*", *[F.lit(0).alias(c) for c in ("own", "x", "y")])
    else:
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        parted = rows.join(large, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        parted = parted.withColumn("own", own).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = parted.select("*", F.least("own", "z").alias("x"), F.greatest("own", "z").alias("y")).drop("parts", "z")
    return met.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")


class Bucket:
    """Rows that meet: those of a band, or of two parts of a large one."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.rows = pa.Table.from_batches(parts).combine_chunks()
        self.band, self.x, self.y = (self.rows.column(c)[0].as_py() for c in ("band", "x", "y"))
        self.bands = self.rows.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy()

    def candidates(self, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of rows of different groups that may be alike, a block at a time.

        A pair that shares several bands comes up in the first of them only.
        """
        root, size, own = self["root"], self["size"], self["own"]
        kinds, counts = np.unique(root, return_counts=True)
        if len(kinds) < 2:
            return
        main, place = root == kinds[counts.argmax()], np.arange(len(root))
        prints = self["fingerprint"].view(np.uint64)
        plane = [self[c].view(np.uint64) for c in PLANES]
        side = np.flatnonzero(~main)
        for start in range(0, len(side), step := max(1, PAIRS // len(root))):
            i = side[start : start + step, None]
            near = (root[i] != root) & (main | (place > i))
            if self.x != self.y:
                near &= own[i] != own
            near &= np.bitwise_count(prints[i] ^ prints) <= RADIUS
            i, j = np.nonzero(near)
            i += start
            i = side[i]
            # A set cannot be more alike another than the smaller one's size is to the larger one's.
            fits = np.minimum(size[i], size[j]) >= (similarity - 1e-9) * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            low0, high0, low1, high1 = (p[i] ^ p[j] for p in plane)
            fits = np.bitwise_count(low0 | high0).astype(int) + np.bitwise_count(low1 | high1) <= UNEQUAL
            i, j = i[fits], j[fits]
            shared = self.bands[i] == self.bands[j]
            fits = self.bands[i, shared.argmax(axis=1)] == self.band
            if fits.any():
                yield i[fits], j[fits]


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Buckets of more than one row, in the order they come in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("band", "x", "y")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(k[a] for k in keys)
            if key != last:
                if sum(p.num_rows for p in held) > 1:
                    yield Bucket(held)
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if sum(p.num_rows for p in held) > 1:
        yield Bucket(held)


def asking(met: DataFrame, similarity: float) -> DataFrame:
    """Of the rows that meet those whose sets must be compared with one of another group."""

    def run(batches):
        for bucket in buckets(batches):
            asked = np.zeros(bucket.rows.num_rows, bool)
            for i, j in bucket.candidates(similarity):
                asked[i] = asked[j] = True
            if asked.any():
                yield from bucket.rows.filter(pa.array(asked)).drop_columns(["own", "x", "y"]).to_batches()

    wanted = met.drop("own", "x", "y")
    return settle(dealt(met, F.lit(1), PART).select(*wanted.columns, "own", "x", "y").mapInArrow(run, wanted.schema), "asking")


def sets_of(rows: DataFrame, asked: DataFrame, text: str, width: int) -> DataFrame:
    """(node, set: its different shingles as sorted 64-bit hashes) of the nodes asked for."""

    def run(batch):
        found = [np.unique(shingles(raw, width)).astype("<u8").tobytes() for raw in raw_texts(batch.column(1))]
        return {"node": batch.column(0), "set": pa.array(found, pa.binary())}

    whole = rows.select("node", text).join(asked.select("node").distinct(), "node", "left_semi")
    whole = whole.groupBy("node").agg(F.first(text).alias(text))
    return settle(map_batches(whole, ["node", text], run, "node long, set binary"), "sets")


def links_in_bands(met: DataFrame, rows: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of nodes alike that connect the groups which meet in bands.

    A bucket gives a spanning forest of its links; rows already connected are not compared.
    """
    asked = asking(met, similarity)
    whole = asked.join(sets_of(rows, asked, text, width), "node")

    def run(batches):
        for bucket in buckets(batches):
            forest, node, root = Forest(), bucket["node"].tolist(), bucket["root"].tolist()
            column = bucket.rows.column("set").combine_chunks()
            kept: dict[int, np.ndarray] = {}

            def of(k):
                if k not in kept:
                    kept[k] = np.frombuffer(column[k].as_buffer(), "<u8")
                return kept[k]

            found = []
            for i, j in bucket.candidates(similarity):
                for a, b in zip(i.tolist(), j.tolist()):
                    if forest.root(root[a]) != forest.root(root[b]) and jaccard(of(a), of(b)) >= similarity:
                        forest.add([(root[a], root[b])])
                        found.append((node[a], node[b]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return settle(dealt(whole, 8 * F.col("size"), PART_BYTES).mapInArrow(run, "a long, b long"), "confirmed")


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, also: Sequence[str] = ()
) -> DataFrame:
    """Every row with its group: key, columns ``also``, root (of the group, a long).

    Texts are linked when the Jaccard similarity of their sets of ``width``-word shingles is
    at least ``similarity``; a group is what links connect. Words are cut and lower-cased
    as for :func:`simhash.fingerprint`; texts of the same words are one node, those without a
    word too. SimHash links come first. Texts that their groups keep apart meet in bands; a large
    group of near copies costs a few links a text.
    """
    rows = settle(described(docs, key, text, width, also), "described")
    known = ["node", "fingerprint", "size", "bands", *PLANES]
    nodes = settle(rows.select(*known).dropDuplicates(["node"]), "nodes")
    links = confirmed(linked(nodes, similarity), rows, text, width, similarity)
    roots = settle(components(links), "roots")
    rooted = nodes.select("node", "bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = settle(rooted.select("node", "root", F.explode("bands").alias("band")), "bands")
    # A band of one group has nothing to add.
    several = met.groupBy("band").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("band")
    met = settle(met.join(several, "band"), "open")
    met = settle(met.join(nodes, "node"), "meeting")
    links = links.union(links_in_bands(met, rows, text, width, similarity))
    roots = settle(components(links), "roots")
    rows = rows.select(key, *also, "node")
    return rows.join(roots, "node", "left").select(key, *also, F.coalesce("root", "node").alias("root"))
