"""Document fingerprints from terms of a middle document frequency (operator 6).

A term belongs to the *lexicon* if the share of documents that have it lies in a band: rarer
terms are noise, commoner ones say nothing. A fingerprint hashes the sorted distinct lexicon
terms of a text, once for each of several random subsets of the lexicon. Subsets come in
rates: each rate keeps a quarter of the terms of the one before, and a text uses the two
rates that leave it about one or two terms in a subset, whatever its length. The share of
subsets in which two texts agree is their likeness.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import raw_texts, slices, texts
from signalloom.llm.ranges import bucket_limits, buckets_of
from signalloom.llm.tables import settle

#: Marks that end a word as white space does.
MARKS = b".,;:!?\"()[]{}"
_PLAIN = bytes.maketrans(MARKS, b" " * len(MARKS))
#: Different terms counted together before they are handed on.
COUNTED = 300_000
#: Documents of one bucket of keys.
BUCKET_ROWS = 2_000


@dataclass(frozen=True)
class Band:
    """Shares of documents between which a term is in the lexicon.

    A term of the lexicon is in ``low`` of all documents, so the lexicon has at most
    (mean number of different terms of a document) / ``low`` terms, however many documents
    there are. Up to ``most`` terms go to every task; a larger lexicon stays a table that the
    terms of the documents are joined to, with the same fingerprints.
    """

    low: float = 0.004
    high: float = 0.1
    most: int = 400_000
    subsets: int = 24
    rates: int = 7


def terms_of(raw: bytes) -> set[bytes]:
    return set(raw.lower().translate(_PLAIN).split())


def untold(found: set[bytes]) -> str:
    """The fingerprint of a text that has these terms, none of them in the lexicon."""
    return "none:" + xxhash.xxh64_hexdigest(b"\0".join(sorted(found)))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many rows each term occurs; counted in the tasks before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def give():
            terms = pa.array(list(counts), pa.binary())
            return pa.RecordBatch.from_pydict({"term": terms, "n": pa.array(list(counts.values()), pa.int64())})

        for batch in slices(batches):
            for raw in raw_texts(batch.column(0)):
                counts.update(terms_of(raw))
            if len(counts) > COUNTED:
                yield give()
                counts.clear()
        if counts:
            yield give()

    return docs.select(text).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, band: Band = Band(), text: str = "text") -> DataFrame:
    """(term, n): the terms of the band and the number of documents that have them."""
    n = docs.count()
    counted = document_frequencies(docs, text)
    return settle(counted.where(F.col("n").between(max(band.low * n, 2), max(band.high * n, 2))), "lexicon")


@dataclass
class Printer:
    """Fingerprints with a given lexicon; of a text's lexicon terms alone, it needs no list of them."""

    terms: list[bytes]
    band: Band = field(default_factory=Band)

    def __post_init__(self):
        self.terms = sorted(self.terms)
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.ids, self.draws = self.drawn(self.terms)

    def drawn(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit id of each term, and a 32-bit draw for each subset."""
        size = 4 * self.band.subsets
        raw = np.frombuffer(b"".join(hashlib.shake_128(t).digest(size + 8) for t in terms), np.uint8).reshape(len(terms), size + 8)
        return raw[:, size:].copy().view("<u8")[:, 0], raw[:, :size].copy().view("<u4")

    def __getstate__(self):
        return self.terms, self.band

    def __setstate__(self, state):
        self.terms, self.band = state
        self.__post_init__()

    def fingerprint(self, raw: bytes) -> str:
        """``rate`` and two groups of four hex digits a subset; "0000" where a subset has no term.

        A text without a term of the lexicon is told by all its terms instead.
        """
        found = terms_of(raw)
        mine = sorted(self.place[t] for t in found if t in self.place)
        return self.printed(self.ids[mine], self.draws[mine]) if mine else untold(found)

    def of_terms(self, mine: list[bytes]) -> str:
        """The fingerprint of a text from its different lexicon terms, of which there is one."""
        return self.printed(*self.drawn(sorted(mine)))

    def printed(self, ids: np.ndarray, draws: np.ndarray) -> str:
        rate = min(max(round(math.log(len(ids) / 1.5, 4)), 0), self.band.rates - 2)
        parts = [f"{rate}:"]
        for k in (rate, rate + 1):
            inside = draws < (1 << 32) // 4**k if k else np.ones_like(draws, bool)
            for s in range(self.band.subsets):
                chosen = ids[inside[:, s]]
                parts.append(f"{xxhash.xxh32_intdigest(chosen.tobytes(), s) % 0xFFFF + 1:04x}" if len(chosen) else "0000")
        return "".join(parts)


def likeness(a: str, b: str, subsets: int = Band.subsets) -> float:
    """Share of subsets, of those in which either text has a term, in which both agree.

    Texts are compared at the rates they both used; without one their lengths differ so
    much that they are unlike.
    """
    if a == b:
        return 1.0
    head_a, _, tail_a = a.partition(":")
    head_b, _, tail_b = b.partition(":")
    if "none" in (head_a, head_b):
        return 0.0
    best = 0.0
    rate_a, rate_b = int(head_a), int(head_b)
    for rate in {rate_a, rate_a + 1} & {rate_b, rate_b + 1}:
        at_a, at_b = (4 * subsets * (rate - r) for r in (rate_a, rate_b))
        pairs = [(tail_a[at_a + k : at_a + k + 4], tail_b[at_b + k : at_b + k + 4]) for k in range(0, 4 * subsets, 4)]
        either = sum(x != "0000" or y != "0000" for x, y in pairs)
        if either:
            best = max(best, sum(x == y != "0000" for x, y in pairs) / either)
    return best


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many first ones of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints_with_edits(docs: DataFrame, band: Band = Band(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    Gives key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is the one before in key order; the first one follows the
    last. NULL texts are empty, a NULL key comes last, rows that share a key are ordered by
    the checksum of their text. Rows are dealt to ranges of keys; each range also gets the
    first row of the one that follows, so no order is kept in one task.
    """
    words = lexicon(docs, band, text)
    small = words.count() <= band.most
    printer = Printer([bytes(t) for t in words.toArrow().column("term").to_pylist()] if small else [], band)
    limits = bucket_limits(docs, key, BUCKET_ROWS)

    def placed(batches):
        for batch in slices(batches):
            crc = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = {"bucket": pa.array(buckets_of(batch.column(0), limits, crc)), "key": batch.column(0).cast(pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {"crc": pa.array(crc)})

    narrow = docs.select(key, F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc")).mapInArrow(placed, "bucket long, key long, crc long")
    tops = narrow.groupBy("bucket").agg(F.max(F.struct(F.coalesce("key", F.lit(np.iinfo(np.int64).min)).alias("key"), "crc")).alias("top"))
    # One row per range of keys.
    top = {r["bucket"]: (r["top"]["key"], r["top"]["crc"]) for r in tops.collect()}
    order = sorted(top)
    follows = {top[b]: order[(k + 1) % len(order)] for k, b in enumerate(order)}

    def dealt(batches):
        for batch in slices(batches):
            raw = raw_texts(batch.column(1))
            crc = np.array([zlib.crc32(x) for x in raw], np.int64)
            bucket = buckets_of(batch.column(0), limits, crc)
            yield rows(bucket, batch, crc, False)
            keys = batch.column(0).cast(pa.int64()).to_pylist()
            first = [(i, follows.get((np.iinfo(np.int64).min if k is None else k, int(c)))) for i, (k, c) in enumerate(zip(keys, crc))]
            first = [(i, b) for i, b in first if b is not None]
            if first:
                at = pa.array([i for i, _ in first])
                yield rows(np.array([b for _, b in first]), batch.take(at), crc[[i for i, _ in first]], True)

    def rows(bucket, batch, crc, after):
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket, pa.int64()), "after": pa.array([after] * batch.num_rows), "key": batch.column(0).cast(pa.int64()),
                "crc": pa.array(crc), "text": batch.column(1),
            }
        )

    def compared(batches):
        held = None  # bucket, key, text, fingerprint, of the row whose next one is awaited
        for batch in slices(batches):
            out = []
            for bucket, after, k, text_now in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), texts(batch.column(4))):
                if after and held is None:
                    continue  # a further equal row that follows the range
                print_now = printer.fingerprint(text_now.encode())
                if held is not None and held[0] == bucket:
                    _, key_was, text_was, print_was = held
                    changed = edited(text_was, text_now).encode()
                    print_edited = printer.fingerprint(changed)
                    out.append(
                        (key_was, len(text_was), hashlib.sha256(changed).hexdigest(), print_was, print_edited,
                         likeness(print_was, print_edited, band.subsets), likeness(print_was, print_now, band.subsets))
                    )
                held = None if after else (bucket, k, text_now, print_now)
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=OUTPUT)

    def spread(batches):
        """Three rows for each text (its own, its edited and its next one) with their different terms."""
        held, place = None, 0
        for batch in slices(batches, 64):
            for bucket, after, k, text_now in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), texts(batch.column(4))):
                if after and held is None:
                    continue
                if held is not None and held[0] == bucket:
                    _, key_was, text_was = held
                    changed = edited(text_was, text_now).encode()
                    found = [terms_of(x) for x in (text_was.encode(), changed, text_now.encode())]
                    same = {"bucket": bucket, "place": place, "key": key_was, "n_chars": len(text_was)}
                    same["edited_sha256"] = hashlib.sha256(changed).hexdigest()
                    out = [same | {"which": w, "untold": untold(f), "terms": list(f)} for w, f in enumerate(found)]
                    yield pa.RecordBatch.from_pylist(out, schema=SPREAD)
                    place += 1
                held = None if after else (bucket, k, text_now)

    moved = docs.select(key, text).mapInArrow(dealt, "bucket long, after boolean, key long, crc long, text string")
    moved = moved.repartition("bucket").sortWithinPartitions("bucket", "after", F.col("key").desc_nulls_last(), F.col("crc").desc())
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not small:
        kinds = "bucket long, place long, key long, n_chars long, edited_sha256 string, which int, untold string, terms array<binary>"
        return joined(settle(moved.mapInArrow(spread, kinds), "terms"), words, printer, schema).withColumnRenamed("key", key)
    return moved.mapInArrow(compared, schema).withColumnRenamed("key", key)


def joined(rows: DataFrame, words: DataFrame, printer: Printer, schema: str) -> DataFrame:
    """Fingerprints of rows of terms by a join with the lexicon.

    A term of the lexicon is dealt to parts by the row it comes from, so that one which a
    tenth of the documents have is no single task's; terms outside leave at the join.
    """
    place = ["bucket", "place", "which"]
    deal = F.pmod(F.xxhash64("bucket", "place"), F.lit(DEALT)).cast("int")
    each = rows.select(*place, deal.alias("deal"), F.explode("terms").alias("term"))
    dealt = words.select("term", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    mine = each.join(dealt.hint("shuffle_hash"), ["term", "deal"]).groupBy(*place).agg(F.collect_list("term").alias("mine"))
    whole = rows.drop("terms").join(mine, place, "left")

    def printed(batches):
        for batch in slices(batches):
            found = [u if m is None else printer.of_terms(m) for m, u in zip(*(batch.column(c).to_pylist() for c in ("mine", "untold")))]
            yield batch.drop_columns(["mine", "untold"]).append_column("fingerprint", pa.array(found, pa.string()))

    one = whole.mapInArrow(printed, "bucket long, place long, which int, key long, n_chars long, edited_sha256 string, fingerprint string")
    same = ["bucket", "place", "key", "n_chars", "edited_sha256"]
    three = [F.max(F.when(F.col("which") == w, F.col("fingerprint"))).alias(f"f{w}") for w in range(3)]

    def compared(batches):
        for batch in slices(batches):
            own, changed, after = (batch.column(f"f{w}").to_pylist() for w in range(3))
            near = [pa.array([likeness(a, b, printer.band.subsets) for a, b in zip(own, x)], pa.float64()) for x in (changed, after)]
            columns = [batch.column(c) for c in ("key", "n_chars", "edited_sha256", "f0", "f1")]
            yield pa.RecordBatch.from_arrays([*columns, *near], names=OUTPUT)

    return one.groupBy(*same).agg(*three).mapInArrow(compared, schema)


#: Parts to which the rows of a common term are dealt.
DEALT = 64
SPREAD = pa.schema(
    [("bucket", pa.int64()), ("place", pa.int64()), ("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
     ("which", pa.int32()), ("untold", pa.string()), ("terms", pa.list_(pa.binary()))]
)
OUTPUT = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
