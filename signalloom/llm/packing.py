"""Packing documents into sequences by bin completion (operator 4).

Only the lengths of pieces matter to a packing, and there are at most as many lengths as
a sequence has tokens. The search therefore runs on the table of lengths and counts, which
does not grow with the corpus, and gives *patterns*: fillings with the number of sequences
that use them. Spark then counts pieces of one length through and reads from the patterns
where each piece goes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.batches import map_batches, texts
from signalloom.llm.tables import settle
from signalloom.llm.tokenizing import library_encoder

#: Nodes of the search tree looked at for one filling before the best one found is taken.
NODES = 4_000
#: Pieces of one length that one task counts through.
RANKED_TOGETHER = 50_000


# --- the search ---


def best_fit(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Greedy filling: again and again the longest piece that still fits."""
    out: list[int] = []
    for length in lengths:
        if length <= room:
            take = min(room // length, counts[length])
            out += [length] * take
            room -= take * length
    return out


def complete(room: int, lengths: list[int], counts: dict[int, int], nodes: int = NODES) -> list[int]:
    """The filling of ``room`` that wastes least, by branch and bound.

    Fillings are enumerated from long to short pieces, each as often as it may still go.
    A filling into which some left-over piece would still fit is dominated and never
    stands: the greedy rest of every branch closes it. The best-fit filling is the first
    incumbent. A branch ends when the pieces it may still use cannot bring its waste below
    the incumbent's, and the search when nothing is wasted or ``nodes`` are spent.
    """
    usable = [x for x in lengths if x <= room]
    best = best_fit(room, usable, counts)
    waste = room - sum(best)
    if not waste or not usable:
        return best
    suffix = [0] * (len(usable) + 1)
    for k in reversed(range(len(usable))):
        suffix[k] = min(suffix[k + 1] + usable[k] * counts[usable[k]], 1 << 40)
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    while stack and waste and nodes > 0:
        nodes -= 1
        k, left, chosen = stack.pop()
        while k < len(usable) and usable[k] > left:
            k += 1
        if left < waste:
            waste, best = left, [x for length, n in chosen for x in [length] * n]
        if k == len(usable) or left - suffix[k] >= waste:
            continue
        length = usable[k]
        for n in range(min(left // length, counts[length]) + 1):
            stack.append((k + 1, left - n * length, (*chosen, (length, n)) if n else chosen))
    return best


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, from number ``first``, filled with ``pieces`` (length, how many)."""

    first: int
    times: int
    pieces: tuple[tuple[int, int], ...]


def fewest_sequences(counts: dict[int, int], size: int) -> int:
    """A bound from below: tokens, or pieces longer than half a sequence."""
    total = sum(length * n for length, n in counts.items())
    halves = sum(n for length, n in counts.items() if 2 * length > size)
    return max(-(-total // size), halves)


def patterns(counts: dict[int, int], size: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that place every piece of the counted lengths, each length at most ``size``.

    The longest length left opens a sequence and the best completion found fills it; the
    pattern repeats for as long as the counts last, so it uses up a length nearly every
    time. If the bound from below is missed, the search runs once more with more nodes and
    the better result stays.
    """
    bound = fewest_sequences(counts, size)
    best: list[Pattern] | None = None
    for effort in (nodes, 16 * nodes):
        left = {length: n for length, n in counts.items() if n}
        found: list[Pattern] = []
        first = 0
        while left:
            lengths = sorted(left, reverse=True)
            top = lengths[0]
            left[top] -= 1
            chosen = [top, *complete(size - top, lengths, left, effort)]
            left[top] += 1
            used = {length: chosen.count(length) for length in chosen}
            times = min(left[length] // n for length, n in used.items())
            for length, n in used.items():
                left[length] -= n * times
                if not left[length]:
                    del left[length]
            found.append(Pattern(first, times, tuple(sorted(used.items(), reverse=True))))
            first += times
        if best is None or first < best[-1].first + best[-1].times:
            best = found
        if not best or best[-1].first + best[-1].times == bound:
            break
    return best or []


# --- Spark ---


def pieces(docs: DataFrame, path: str, size: int, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every text, add ``end_id`` and cut: key, piece, start, length, ids_crc32.

    A document of more than ``size`` tokens is cut so that only its first piece is shorter.
    NULL and empty texts are the end id alone.
    """

    def run(batch):
        which, number, start, length, crc = [], [], [], [], []
        for row, ids in enumerate(library_encoder(path).encode(texts(batch.column(1)))):
            whole = np.append(ids, end_id).astype("<u4")
            edges = [0, *range(len(whole) % size or size, len(whole) + 1, size)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                which.append(row)
                number.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(whole[a:b].tobytes()))
        columns = {key: batch.column(0).take(pa.array(which, pa.int64())), "piece": pa.array(number, pa.int32())}
        return columns | {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc))}

    schema = f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long"
    return map_batches(docs, [key, text], run, schema)


def ranked(rows: DataFrame, group: str, order: list[str], together: int = RANKED_TOGETHER) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each group, without bringing a large group into one task.

    Rows are dealt to parts by a hash of ``order``; the parts of a group are counted first,
    and a row's rank is its place in its part after all rows of the parts before. Rows that
    agree in ``order`` are equal, so their ranks may change places.
    """
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // together)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = rows.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    rows = rows.withColumn("rank", place - 1).join(sizes, [group, "__part"])
    return rows.withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def places(found: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, first offset), by rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    for p in found:
        offset = 0
        for length, n in p.pieces:
            rank = taken.get(length, 0)
            rows.setdefault(length, []).append((rank, p.first, n, offset))
            taken[length] = rank + n * p.times
            offset += n * length
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(
    docs: DataFrame, path: str, size: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0, nodes: int = NODES
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. Texts are
    encoded once, without a shuffle; only the narrow rows of pieces move. Rows that repeat a
    key are packed like any other. An empty table gives an empty one.
    """
    cut = settle(pieces(docs, path, size, key, text, end_id), "pieces")
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length = places(patterns(counted, size, nodes))

    def run(batches):
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for each in np.unique(length):
                mine = np.flatnonzero(length == each)
                table = by_length[int(each)]
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                turn = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + turn // row[:, 2]
                offset[mine] = row[:, 3] + turn % row[:, 2] * each
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    rows = ranked(cut, "length", [key, "piece", "ids_crc32"])
    kept = [f"`{n}` {t}" for n, t in cut.dtypes]
    return rows.select(*cut.columns, F.col("rank").cast("long")).mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))
