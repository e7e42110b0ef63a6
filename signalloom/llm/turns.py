"""Repair of conversation structure by block tables (operator 11).

A conversation is well formed when its roles are an optional system turn and then pairs of
user and assistant, or when it is empty. What an edit may do next depends only on the last
role kept, so a conversation is a walk of four costs, one for each such state. Costs matter only up to
a constant and differences are small, so there are few different cost vectors; a table says
for each of them and each block of ``BLOCK`` rows which vector comes out and what to add
(the method of the Four Russians). Blocks are opened only to trace the cheapest edits: backward,
to mark the states that some cheapest way passes, then forward by the least letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.rules import SPACES

#: States: nothing yet, after the system turn, after a user, after an assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the user or assistant turn that fits each state.
FITS = (USER, USER, ASSISTANT, USER)
#: What edits cost, and what a cut-off row costs that stays.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Symbols of rows: 0 must go, 1 + 2 * role + cut off, and NO_ROW to fill the last block.
MUST_GO, NO_ROW, SYMBOLS = 0, 9, 10
#: Codes of role initials in symbols.
ROLES = "uas"
OTHER = 3
BLOCK = 4
#: Cost of a state that no cheapest way passes.
FAR = 1 << 20
#: Bytes of text handed on together.
BATCH_BYTES = 4 << 20


# --- costs ---


def symbol_of(code: int, cut: bool) -> int:
    return 1 + 2 * code + cut


def edits_of(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of what may be done with a row, in order of the letters."""
    if symbol == NO_ROW:
        return [("", state, 0)]
    out = [("D", state, DELETE)]
    if symbol != MUST_GO:
        code, cut = divmod(symbol - 1, 2)
        kept = {0: USER if state != USER else None, 1: ASSISTANT if state == USER else None, 2: SYSTEM if state == EMPTY else None}.get(code)
        if kept is not None:
            out.append(("K", kept, CUT_OFF * cut))
        out.append(("R", FITS[state], REROLE + CUT_OFF * cut))
    return out


def closed(costs: list[int]) -> list[int]:
    """Costs when turns may also be inserted."""
    for _ in range(2):
        for state, after in enumerate(FITS):
            costs[after] = min(costs[after], costs[state] + INSERT)
    return costs


def normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs above the least one, and that one; states that cannot be on a cheapest way are far.

    After an assistant turn everything is possible that is possible at the begin but to keep a
    system turn, which may be deleted instead, and everything that is possible after one.
    """
    if costs[EMPTY] > costs[ASSISTANT] + DELETE:
        costs[EMPTY] = FAR
    if costs[SYSTEM] > costs[ASSISTANT]:
        costs[SYSTEM] = FAR
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


START = normal(closed([0, FAR, FAR, FAR]))[0]


def after_row(costs: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    out = [FAR] * 4
    for state, cost in enumerate(costs):
        for _, to, more in edits_of(symbol, state):
            out[to] = min(out[to], cost + more)
    return normal(closed(out))


class BlockTables:
    """Cost vectors that occur, and what rows and blocks of rows make of each."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, number = [START], {START: 0}
        steps: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                after, more = after_row(vector, symbol)
                if after not in number:
                    number[after] = len(self.vectors)
                    self.vectors.append(after)
                row.append((number[after], more))
            steps.append(row)
        self.steps = steps
        one = np.array(steps, np.int32)
        to, more = np.arange(len(steps), dtype=np.int32)[:, None], np.zeros((len(steps), 1), np.int32)
        for _ in range(block):
            more = (more[:, :, None] + one[to, :, 1]).reshape(len(steps), -1)
            to = one[to, :, 0].reshape(len(steps), -1)
        self.to, self.more = to.tolist(), more.tolist()
        self.places = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.mask_before = lru_cache(1 << 16)(self._mask_before)
        self.edits_in = lru_cache(1 << 16)(self._edits_in)

    def _opened(self, vector: int, code: int) -> list[tuple[int, int, int]]:
        """(vector before, symbol, vector after, cost added) of each row of a block."""
        out = []
        for place in self.places.tolist():
            symbol = code // place % SYMBOLS
            to, more = self.steps[vector][symbol]
            out.append((vector, symbol, to, more))
            vector = to
        return out

    def _insertable(self, vector: int, mask: int) -> int:
        """Marked states, and those from which a cheapest way inserts its way to one."""
        costs = self.vectors[vector]
        for _ in range(2):
            for state, to in enumerate(FITS):
                if mask >> to & 1 and costs[state] + INSERT == costs[to] < FAR:
                    mask |= 1 << state
        return mask

    def _masks(self, vector: int, code: int, mask: int) -> list[int]:
        """Marked states before each row of a block, and after the last one."""
        out = [mask]
        for before, symbol, to, more in reversed(self._opened(vector, code)):
            mask = 0
            for state, cost in enumerate(self.vectors[before]):
                if cost < FAR and any(out[-1] >> s & 1 and cost + c == self.vectors[to][s] + more for _, s, c in edits_of(symbol, state)):
                    mask |= 1 << state
            out.append(self._insertable(before, mask))
        return out[::-1]

    def _mask_before(self, vector: int, code: int, mask: int) -> int:
        return self._masks(vector, code, mask)[0]

    def _edits_in(self, vector: int, code: int, mask: int, state: int) -> tuple[str, int]:
        """The least letters from ``state`` through a block, and the state after it."""
        masks, letters = self._masks(vector, code, mask), []
        for (before, symbol, to, more), here, after in zip(self._opened(vector, code), masks, masks[1:]):
            costs, then = self.vectors[before], self.vectors[to]
            while True:
                inserted = here >> FITS[state] & 1 and costs[state] + INSERT == costs[FITS[state]]
                found = [e for e in edits_of(symbol, state) if after >> e[1] & 1 and costs[state] + e[2] == then[e[1]] + more]
                if inserted and not (found and found[0][0] == "D"):
                    letters.append("I")
                    state = FITS[state]
                    continue
                letter, state, _ = found[0]
                letters.append(letter)
                break
        return "".join(letters), state

    def cheapest(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """(cost, letters of the edits in order) of the cheapest repair, of equal ones the least letters."""
        rows = np.frombuffer(bytes(symbols), np.uint8)
        rows = np.append(rows, np.full(-len(rows) % self.block, NO_ROW, np.uint8)).reshape(-1, self.block)
        codes = (rows @ self.places).tolist()
        vectors, cost = [0], 0
        for code in codes:
            cost += self.more[vectors[-1]][code]
            vectors.append(self.to[vectors[-1]][code])
        last = self.vectors[vectors[-1]]
        least = min(last[EMPTY], last[ASSISTANT])
        ends = sum(1 << s for s in (EMPTY, ASSISTANT) if last[s] == least)
        masks = [self._insertable(vectors[-1], ends)]
        for vector, code in zip(reversed(vectors[:-1]), reversed(codes)):
            masks.append(self.mask_before(vector, code, masks[-1]))
        masks.reverse()
        state, out = EMPTY, []
        for vector, code, mask in zip(vectors, codes, masks[1:]):
            letters, state = self.edits_in(vector, code, mask, state)
            out.append(letters)
        while not ends >> state & 1:
            out.append("I")
            state = FITS[state]
        return cost + least, "".join(out)


@lru_cache(1)
def tables() -> BlockTables:
    return BlockTables()


# --- Spark ---


def _present(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _marked(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), _present(role).alias("role"),
        F.sha2(_present(text), 256).alias("mark"), _present(text).alias("text"),
    )


def audited(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults and the cheapest repair of every conversation that has rows.

    Gives conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit: one letter an
    edit, in order: Keep, Rerole, Delete, Insert. Rows stand by turn, NULL first; rows of one
    turn by role and a hash of their text. NULL roles and texts are one space, a NULL
    conversation is one like any other. Texts are told apart by SHA-256.

    Equal rows of a turn are counted before they move, and earlier copies are found by
    (conversation, role, text), so neither needs a conversation in one task. The last step holds a byte for each row of one
    conversation, as its result has a letter for each; texts do not come there.
    """
    kind = dict(rows.dtypes)[conv]
    base = _marked(rows, conv, turn, role, text)
    seen = F.rtrim("text", F.lit(SPACES))
    blank = F.length(seen) == 0
    code = F.lit(OTHER)
    for k, letter in enumerate(ROLES):
        code = F.when(F.substring("role", 1, 1) == letter, F.lit(k)).otherwise(code)
    rows = base.select("conv", "turn", "role", "mark", blank.alias("blank"), (~F.right(seen, F.lit(1)).isin(*".!?")).alias("cut"), code.alias("code"))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = F.expr("min(struct(turn is not null as known, turn)) over (partition by conv, role, mark)")
    counted = counted.withColumn("again", place > earliest)
    ordered = counted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "mark")
    schema = f"`{conv}` {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return ordered.select("conv", "turn", "code", "blank", "cut", "again", "n").mapInArrow(_audits(conv, schema), schema)


class _Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, key):
        self.key = key
        self.symbols = bytearray()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.code = None

    def add(self, turn, code: int, blank: bool, cut: bool, again: bool, n: int) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
            self.turns += 1
        legal = self.code is None or (self.code, code) in ((2, 0), (0, 1), (1, 0))
        self.illegal += (not legal) + n - 1
        self.code = code
        if blank:
            self.blank += n
            self.symbols += bytes([MUST_GO]) * n
            return
        copies = n if again else n - 1
        self.duplicate += copies
        if not again:
            self.truncated += cut
            self.symbols.append(symbol_of(code, cut))
        self.symbols += bytes([MUST_GO]) * copies

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        cost, audit = tables().cheapest(self.symbols)
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _audits(conv: str, schema: str):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, kind = None, [], None

        def give() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[conv, *names])

        for batch in batches:
            kind = batch.column(0).type
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(key)
                now.add(*row)
            if sum(len(r[-1]) for r in done) > BATCH_BYTES or len(done) >= 1024:
                yield give()
        if now is not None:
            done.append(now.result())
        if done:
            yield give()

    return run


def repaired(
    rows: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The turns of every conversation after its edits: conv, place (from 0), role, text, edit.

    ``audits`` is what :func:`audited` gave for the same rows. Kept rows are as they were (NULL
    as one space), reroled ones have another role, inserted ones no text. A conversation with nothing left
    has no row. Rows of a conversation follow one another in order. Texts stream through
    one sort; a task holds the letters of one conversation and a few texts.
    """
    kind = dict(rows.dtypes)[conv]
    own = _marked(rows, conv, turn, role, text).withColumn("is_row", F.lit(True))
    first = audits.select(F.col(conv).alias("conv"), F.lit(False).alias("is_row"), F.col("audit").alias("text"))
    both = own.unionByName(first, allowMissingColumns=True).repartition("conv")
    ordered = both.sortWithinPartitions("conv", "is_row", "turn", "role", "mark").select("conv", "is_row", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = place = at = size = 0
        key, audit, kind = None, "", None

        def put(what: str, role: str, text: str) -> None:
            nonlocal place, size
            out.append((key, place, role, text, what))
            place, size = place + 1, size + len(text)

        def fitting(what: str, text: str) -> None:
            nonlocal state
            state = FITS[state]
            put(what, "user" if state == USER else "assistant", text)

        def inserted() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                fitting("I", "")
                at += 1

        def give() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out))
            out.clear()
            size = 0
            arrays = [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])]
            return pa.RecordBatch.from_arrays(arrays, names=[conv, "place", "role", "text", "edit"])

        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, 256):
                for k, is_row, role, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    if not is_row:
                        inserted()  # what is left of the conversation before
                        key, audit, at, state, place = k, text, 0, EMPTY, 0
                        continue
                    inserted()
                    letter, at = audit[at], at + 1
                    if letter == "R":
                        fitting("R", text)
                    elif letter == "K":
                        state = SYSTEM if role[:1] == "s" else FITS[state]
                        put("K", role, text)
                    if size > BATCH_BYTES:
                        yield give()
                if out:
                    yield give()
        inserted()
        if out:
            yield give()

    return ordered.mapInArrow(run, f"`{conv}` {kind}, place long, role string, text string, edit string")


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of ``role:text`` lines, of turns as :func:`repaired` gives them."""
    kind = dict(turns.dtypes)[conv]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, digest, kind = [], [], None, None

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(found, pa.string())], names=[conv, "repaired_sha256"])
            keys.clear(), found.clear()
            return made

        for batch in batches:
            kind = batch.column(0).type
            for k, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    if digest is not None:
                        found.append(digest.hexdigest())
                    keys.append(k)
                    digest = hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if len(found) >= 1024:
                last = keys.pop()
                yield give()
                keys.append(last)
        if digest is not None:
            found.append(digest.hexdigest())
            yield give()

    return turns.select(conv, "place", "role", "text").mapInArrow(run, f"`{conv}` {kind}, repaired_sha256 string")


def sample_damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with one of five kinds of damage in a quarter of them, by a hash of their place."""
    which = F.crc32(F.concat_ws(":", _present(conv), _present(turn))) % 20
    changed = F.when(which == 1, F.lit("")).when(which == 2, F.translate(_present(text), ".!?", "")).otherwise(_present(text))
    copies = F.array_repeat(F.lit(0), F.when(which == 0, 0).when(which == 3, 2).otherwise(1))
    renamed = F.when(which == 4, F.lit("user")).otherwise(_present(role))
    return rows.select(conv, turn, renamed.alias(role), changed.alias(text), F.explode(copies).alias("__copy")).drop("__copy")


def checked(rows: DataFrame, audits: DataFrame, found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A line for every conversation of ``rows``, those without a damaged row included."""
    ids = rows.select(F.col(conv).alias("conv")).distinct()
    counts = [c for c in audits.columns if c not in (conv, "audit")]
    first = audits.withColumnRenamed(conv, "a")
    second = found.withColumnRenamed(conv, "b")
    joined = ids.join(first, F.col("conv").eqNullSafe(F.col("a")), "left").join(second, F.col("conv").eqNullSafe(F.col("b")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("conv").alias(conv), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
