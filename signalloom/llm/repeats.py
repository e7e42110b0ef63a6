"""Repeated byte windows by a depth-limited radix sort of suffixes (operator 3).

A suffix matters only to the depth of the window. Sorting runs from the most significant
digit, and a suffix leaves as soon as its group holds one document:

1. The digit of a *run*: windows that follow one another and share their anchor, the
   ``ANCHOR`` bytes of smallest hash inside them. Equal windows have equal anchors, so
   suffixes are sorted by anchor instead of by first byte, which needs one entry for
   every ten or so bytes of text.
2. The digit of all bytes of the run. Equal runs in a smaller document settle every
   window of the run at once. Runs of different bytes go on only if they agree beyond the
   anchor: a window holds half of what it has besides the anchor on one side of it.
3. The single windows of the runs that go on, to full depth.

Groups that remain equal after the last digit are exactly the repeated windows. Digits
are fingerprints of the bytes (96 bits to full depth). Text is read in slices of whole
documents; a slice sends every digit once, for its smallest document, so a passage found
in a third of all documents is one entry per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.batches import slices
from signalloom.llm.tables import settle

ANCHOR = 24
#: Text bytes of a slice; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Window starts looked at together in a slice; bounds memory for very long documents.
BLOCK = 1 << 20
#: Bytes of entries that meet in one task.
BUCKET_BYTES = 8 << 20
ENTRY = np.dtype(
    [("digit", "<u4"), ("left", "<u2"), ("right", "<u2"), ("rest", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("run", "u1")]
)
SPAN = np.dtype([("at", "<u4"), ("run", "u1")])

_RNG = np.random.default_rng(20240229)
_LETTERS = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(0, 1 << 63, dtype=np.uint64)) * 4 + 3 & (1 << 64) - 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
MAX_WINDOW = 255


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all ``width`` consecutive values, by doubling."""
    out, done, block, size = None, 0, values, 1
    while True:
        if width & size:
            if out is None:
                out = block
            else:
                tail = block[done : len(out)]
                out = out[: len(tail)] * _power(size) + tail
            done += size
        if 2 * size > width:
            n = len(values) - width + 1
            return out[: max(n, 0)]
        block = block[:-size] * _power(size) + block[size:]
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def first_least(keys: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive keys, the place of the first smallest one."""
    place = np.arange(len(keys), dtype=np.uint32)
    least, span = keys, 1

    def step(shift):
        nonlocal least, place
        a, b = least[:-shift], least[shift:]
        later = b < a
        least = np.where(later, b, a)
        place = np.where(later, place[shift:], place[:-shift])

    while 2 * span <= width:
        step(span)
        span *= 2
    if width > span:
        step(width - span)
    return place


def runs_of(raw: np.ndarray, starts: np.ndarray, docs: np.ndarray, window: int, anchor: int) -> Iterator[np.ndarray]:
    """Entries of the runs of a slice. ``starts``: where documents begin, and the end."""
    ends_at = starts[1:]
    for low in range(0, max(len(raw) - window + 1, 0), BLOCK):
        part = _LETTERS[raw[low : low + BLOCK + window - 1]]
        whole = grams(part, window)
        half = (window - anchor + 1) // 2
        hashes = mixed(grams(part, anchor))
        beyond = mixed(grams(part, anchor + half)) >> np.uint64(48)
        place = first_least(hashes, window - anchor + 1)[: len(whole)]
        at = np.arange(low, low + len(whole))
        doc = np.searchsorted(ends_at, at, side="right")
        inside = at + window <= ends_at[doc]
        opens = inside.copy()
        opens[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        begin = np.flatnonzero(opens)
        if not len(begin):
            continue
        stop = np.minimum(np.append(begin[1:], len(whole)), ends_at[doc[begin]] - window + 1 - low)
        run = stop - begin
        out = np.empty(len(begin), ENTRY)
        key, spot = hashes[place[begin]], place[begin].astype(np.int64)
        out["digit"] = key >> np.uint64(32)
        # Where the block has no room on a side, its windows reach farther on the other.
        out["right"] = np.where(spot < len(beyond), beyond[np.minimum(spot, len(beyond) - 1)], 0)
        out["left"] = np.where(spot >= half, beyond[np.clip(spot - half, 0, len(beyond) - 1)], 0)
        out["rest"] = mixed(whole[begin] * _MIX + (whole[stop - 1] ^ run.astype(np.uint64)))
        out["doc"], out["at"], out["run"] = docs[doc[begin]], begin + low, run
        yield out


def windows_of(raw: np.ndarray, spans: np.ndarray, starts: np.ndarray, docs: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Entries of the single windows of runs."""
    step = max(1, BLOCK // (4 * window))
    for low in range(0, len(spans), step):
        part = spans[low : low + step]
        run = part["run"].astype(np.int64)
        begin = np.repeat(part["at"].astype(np.int64), run)
        at = begin + np.arange(len(begin)) - np.repeat(np.cumsum(run) - run, run)
        half = np.zeros(len(at), np.uint64)
        for k in range(window):
            whole = half * _BASE + _LETTERS[raw[at + k]]
            half = whole
            if k == window // 2:
                first = mixed(half)
        out = np.zeros(len(at), ENTRY)
        out["digit"], out["rest"] = first >> np.uint64(32), mixed(half)
        out["doc"] = docs[np.searchsorted(starts[1:], at, side="right")]
        out["at"], out["run"] = at, 1
        yield out


def settled_in_slice(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries to send, spans repeated from a smaller document of the same slice)."""
    order = np.lexsort((entries["doc"], entries["rest"], entries["digit"]))
    entries = entries[order]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["digit"][1:] != entries["digit"][:-1]) | (entries["rest"][1:] != entries["rest"][:-1])
    least = entries["doc"][new][np.cumsum(new) - 1]
    later = entries["doc"] > least
    return entries[~later], spans_of(entries[later])


def spans_of(entries: np.ndarray) -> np.ndarray:
    out = np.empty(len(entries), SPAN)
    out["at"], out["run"] = entries["at"], entries["run"]
    return out


def sort_by_digits(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, open) masks: equal to an entry of a smaller document in both digits;
    equal to other bytes in the first digit and beyond it on one side."""
    repeated, left = np.zeros(len(entries), bool), np.zeros(len(entries), bool)
    order = np.argsort(entries["digit"], kind="stable")
    digit, doc = entries["digit"][order], entries["doc"][order]
    new = np.ones(len(order), bool)
    new[1:] = digit[1:] != digit[:-1]
    heads = np.flatnonzero(new)
    if not len(heads):
        return repeated, left
    alone = np.minimum.reduceat(doc, heads) == np.maximum.reduceat(doc, heads)
    order = order[~alone[np.cumsum(new) - 1]]
    order = order[np.lexsort((entries["doc"][order], entries["rest"][order], entries["digit"][order]))]
    digit, rest, doc = entries["digit"][order], entries["rest"][order], entries["doc"][order]
    group, same = np.ones(len(order), bool), np.ones(len(order), bool)
    group[1:] = digit[1:] != digit[:-1]
    same[1:] = group[1:] | (rest[1:] != rest[:-1])
    least = doc[same][np.cumsum(same) - 1]
    repeated[order] = doc > least
    firsts = order[doc == least]
    left[firsts] = _differ_beside(entries[firsts], "right") | _differ_beside(entries[firsts], "left")
    return repeated, left


def _differ_beside(entries: np.ndarray, side: str) -> np.ndarray:
    """Which entries share their digit and what is beside it with an entry of other bytes."""
    key = entries["digit"].astype(np.uint64) << np.uint64(16) | entries[side]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    heads = np.flatnonzero(new)
    out = np.zeros(len(order), bool)
    if len(heads):
        rest = entries["rest"][order]
        out[order] = (np.minimum.reduceat(rest, heads) != np.maximum.reduceat(rest, heads))[np.cumsum(new) - 1]
    return out


# --- entries as bytes ---


def _narrow(values: np.ndarray) -> bytes:
    """Counts in the fewest of 0, 1, 2, 4 or 8 bytes that hold them all, after their width."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (0, 1, 2, 4, 8) if top < 1 << 8 * w)
    if not width:
        return b"\0"
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    if not width:
        return np.zeros(n, np.uint64), at + 1
    return np.frombuffer(raw, f"<u{width}", n, at + 1).astype(np.uint64), at + 1 + n * width


def to_bytes(entries: np.ndarray) -> bytes:
    """Entries column by column, by place: places and documents ascend, so their steps are small."""
    entries = entries[np.argsort(entries["at"], kind="stable")]
    new = np.append(True, entries["doc"][1:] != entries["doc"][:-1])
    heads = np.flatnonzero(new)
    docs = entries["doc"][heads].view(np.uint64) if len(heads) else np.zeros(0, np.uint64)
    at = entries["at"].astype(np.uint64)
    steps = lambda x: np.diff(x, prepend=x[:1])
    return b"".join(
        [
            np.array([len(entries), len(heads)], "<u4").tobytes(), at[:1].tobytes(), docs[:1].tobytes(),
            _narrow(steps(at)), _narrow(steps(docs)), _narrow(np.diff(np.append(heads, len(entries)))),
            _narrow(entries["run"]), _narrow(entries["left"]), _narrow(entries["right"]),
            entries["digit"].tobytes(), entries["rest"].tobytes(),
        ]
    )


def from_bytes(raw: bytes) -> np.ndarray:
    n, k = np.frombuffer(raw, "<u4", 2).tolist()
    first_at, first_doc = np.frombuffer(raw, "<u8", 2, 8)
    at, pos = _wide(raw, 24, n)
    docs, pos = _wide(raw, pos, k)
    counts, pos = _wide(raw, pos, k)
    out = np.empty(n, ENTRY)
    for name in ("run", "left", "right"):
        out[name], pos = _wide(raw, pos, n)
    out["at"] = np.cumsum(at) + first_at
    out["doc"] = np.repeat((np.cumsum(docs) + first_doc).view(np.int64), counts.astype(np.int64))
    out["digit"] = np.frombuffer(raw, "<u4", n, pos)
    out["rest"] = np.frombuffer(raw, "<u8", n, pos + 4 * n)
    return out


# --- Spark ---


def packed(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def slice_table(docs: DataFrame, key: str, text: str, slice_bytes: int) -> DataFrame:
    """(slice, payload): whole rows of some documents, ordered by key, as one Arrow stream."""

    def run(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def give():
            table = pa.Table.from_batches(held)
            order = pc.sort_indices(table, sort_keys=[(key, "ascending")], null_placement="at_start")
            rows = table.take(order).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict(
                {"slice": pa.array([part << 32 | made], pa.int64()), "payload": pa.array([packed(rows)], pa.binary())}
            )

        for batch in slices(batches, 64):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
            if size >= slice_bytes:
                yield give()
                made, held, size = made + 1, [], 0
        if held and sum(b.num_rows for b in held):
            yield give()

    return settle(docs.mapInArrow(run, "slice long, payload binary"), "slices")


class Slice:
    """A slice unpacked: rows, bytes of all texts, where each begins, and keys to compare."""

    def __init__(self, payload: bytes, key: str, text: str):
        self.rows = pa.ipc.open_stream(payload).read_next_batch()
        column = self.rows.column(self.rows.schema.get_field_index(text)).cast(pa.large_binary())
        self.texts = [b"" if x is None else x for x in column.to_pylist()]
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        self.starts = np.append(0, np.cumsum([len(t) for t in self.texts], dtype=np.int64))
        keys = self.rows.column(self.rows.schema.get_field_index(key)).cast(pa.int64())
        self.keys = pc.fill_null(keys, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _dealt(number: int, chunks: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, slice, blob) of a slice's entries; what is settled goes to bucket -1 - k."""
    found = list(chunks)
    if not found:
        return
    send, spans = settled_in_slice(np.concatenate(found))
    # The digit fills 32 bits; the bucket is drawn from it by multiplication, keeping groups whole.
    bucket = (send["digit"].astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    send, bucket = send[order], bucket[order].astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else [], len(bucket)).astype(int)
    rows = [(int(bucket[a]), to_bytes(send[a:b])) for a, b in zip(cuts, cuts[1:])]
    if len(spans):
        rows.append((-1 - number % buckets, spans.tobytes()))
    for low in range(0, len(rows), 256):
        part = rows[low : low + 256]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([b for b, _ in part], pa.int64()),
                "slice": pa.array([number] * len(part), pa.int64()),
                "blob": pa.array([x for _, x in part], pa.binary()),
            }
        )


def _met(table: pa.Table) -> pa.Table:
    """Sort the entries of one bucket; rows (slice, kind, blob) with kind repeated or open."""
    bucket, numbers, blobs = (table.column(c).to_pylist() for c in ("bucket", "slice", "blob"))
    out: list[tuple[int, str, bytes]] = []
    if bucket and bucket[0] < 0:
        out = [(n, "repeated", b) for n, b in zip(numbers, blobs)]
    elif bucket:
        parts = [from_bytes(b) for b in blobs]
        entries = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        for kind, mask in zip(("repeated", "open"), sort_by_digits(entries)):
            chosen, which = spans_of(entries[mask]), of[mask]
            cuts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.array([], int)
            for a, b in zip(cuts, np.append(cuts[1:], len(which))):
                out.append((numbers[which[a]], kind, chosen[a:b].tobytes()))
    return pa.table(
        {
            "slice": pa.array([n for n, _, _ in out], pa.int64()),
            "kind": pa.array([k for _, k, _ in out], pa.string()),
            "blob": pa.array([b for _, _, b in out], pa.binary()),
        }
    )


def _meet(dealt: DataFrame, name: str) -> DataFrame:
    return settle(dealt.groupBy("bucket").applyInArrow(_met, "slice long, kind string, blob binary"), name)


def _with_spans(table: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    grouped = spans.groupBy("slice").agg(F.collect_list("blob").alias("blobs"))
    return table.join(grouped.hint("shuffle_hash"), "slice", how)


def _spans(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or []), SPAN)


def removed_bytes(size: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Mask of the bytes that the windows beginning at the spans cover."""
    change = np.zeros(size + 1, np.int32)
    at = spans["at"].astype(np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + spans["run"] + (window - 1), -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = 50,
    anchor: int = ANCHOR,
    slice_bytes: int = SLICE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    decoded: bool = False,
) -> DataFrame:
    """Find every ``window``-byte string of a text that also starts in a document of smaller key.

    Adds to the rows: ``kept`` (binary, the bytes outside such strings) and ``spans``
    (array of start and length of the maximal removed runs, in bytes). Strings are judged
    on the input and never cross documents. A NULL text counts as empty; a NULL key comes
    before all others. ``decoded`` gives ``kept`` as a string, without the characters of
    which a byte went. Rows that share a key are one another's equals: neither removes
    from the other. Texts shorter than the window stay whole.
    """
    if not anchor <= window <= MAX_WINDOW:
        raise ValueError(f"the window must have {anchor} to {MAX_WINDOW} bytes")
    fields = [f for f in docs.schema.fields if f.name not in ("kept", "spans")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    table = slice_table(docs, key, text, slice_bytes)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, total * 2 * ENTRY.itemsize // ((window - anchor + 2) * bucket_bytes))

    def runs(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Slice(payload, key, text)
                yield from _dealt(number, runs_of(s.raw, s.starts, s.keys, window, anchor), buckets)

    first = _meet(table.mapInArrow(runs, "bucket long, slice long, blob binary"), "runs")

    def singles(batches):
        for batch in batches:
            for number, payload, blobs in zip(*(c.to_pylist() for c in batch.columns)):
                s = Slice(payload, key, text)
                yield from _dealt(number, windows_of(s.raw, _spans(blobs), s.starts, s.keys, window), buckets)

    left = _with_spans(table, first.where("kind = 'open'"), "inner").select("slice", "payload", "blobs")
    second = _meet(left.mapInArrow(singles, "bucket long, slice long, blob binary"), "windows")

    def give(batches):
        for batch in batches:
            for payload, blobs in zip(*(c.to_pylist() for c in batch.columns)):
                s = Slice(payload, key, text)
                yield kept_rows(s, removed_bytes(len(s.raw), _spans(blobs), window), decoded)

    spans = first.where("kind = 'repeated'").union(second.where("kind = 'repeated'"))
    schema = T.StructType([*fields, T.StructField("kept", T.StringType() if decoded else T.BinaryType()), T.StructField("spans", SPANS)])
    return _with_spans(table, spans, "left").select("payload", "blobs").mapInArrow(give, schema)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def kept_rows(s: Slice, gone: np.ndarray, decoded: bool) -> pa.RecordBatch:
    kept, spans = [], []
    for a, b in zip(s.starts, s.starts[1:]):
        mask = gone[a:b]
        if mask.any():
            kept.append(s.raw[a:b][~mask].tobytes())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(edges[::2], edges[1::2])])
        else:
            kept.append(s.raw[a:b].tobytes())
            spans.append([])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    column = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if decoded else pa.array(kept, pa.binary())
    columns = [*s.rows.columns, column, pa.array(spans, kind)]
    return pa.RecordBatch.from_arrays(columns, names=[*s.rows.schema.names, "kept", "spans"])
