"""Operator 11 against trying all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from signalloom.llm import turns
from signalloom.llm.queries import QUERIES

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def plain_cheapest(rows):
    """(cost, letters) over rows of (initial, must go, cut off), by comparing whole strings."""
    n, memo = len(rows), {}

    def best(i, last, inserts):
        """``last``: initials kept so far that matter: '', 's', 'u' or 'a'."""
        at = (i, last, inserts)
        if at in memo:
            return memo[at]
        options = []
        fits = "a" if last == "u" else "u"
        if i == n and last in ("", "a"):
            options.append((0, ""))
        if inserts:
            cost, rest = best(i, fits, inserts - 1)
            options.append((cost + 3, "I" + rest))
        if i < n:
            initial, gone, cut = rows[i]
            moves = [("D", last, 4)]
            if not gone:
                moves.append(("R", fits, 3 + 3 * cut))
                if initial == fits or (initial == "s" and last == ""):
                    moves.append(("K", initial, 3 * cut))
            for letter, to, cost in moves:
                more, rest = best(i + 1, to, 3)
                options.append((cost + more, letter + rest))
        memo[at] = min(options, default=(10**9, ""))
        return memo[at]

    return best(0, "", 3)


def plain_repair(rows):
    """The line of one conversation from its damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    known = sorted({t for t, _, _ in rows if t is not None})
    faults, seen, symbols = collections.Counter(), set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_cheapest(symbols)
    lines, last, left = [], "", list(rows)
    for letter in audit:
        fits = "a" if last == "u" else "u"
        if letter != "I":
            _, role, text = left.pop(0)
        if letter == "K":
            last = role[:1]
            lines.append(f"{role}:{text}")
        elif letter in "RI":
            last = fits
            lines.append({"u": "user", "a": "assistant"}[fits] + ":" + (text if letter == "R" else ""))
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    gaps = known[-1] - known[0] + 1 - len(known) if known else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        which = zlib.crc32(place.encode()) % 20
        if which == 0:
            continue
        text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
        out += [(conv, turn, "user" if which == 4 else role, text)] * (2 if which == 3 else 1)
    return out


def plain_report(rows, damaged):
    by = collections.defaultdict(list)
    for conv, *row in damaged:
        by[conv].append(tuple(row))
    return {c: plain_repair(by[c]) if c in by else (0, 0, 0, 0, 0, 0, "", EMPTY_SHA) for c in {r[0] for r in rows}}


def report(rows, damaged):
    audits = turns.audited(damaged)
    found = turns.checked(rows, audits, turns.digests(turns.repaired(damaged, audits)))
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def test_there_are_few_cost_vectors():
    tables = turns.tables()
    assert len(tables.vectors) < 100
    assert all(min(v) == 0 and all(c < 20 or c == turns.FAR for c in v) for v in tables.vectors)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_cheapest_edits_equal_all_edits(block):
    tables, rng = turns.BlockTables(block), random.Random(block)
    for n in [0, 1, 2, 3, 4, 5, 8, 13] * 60:
        rows = [(rng.choice("uuaas?"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(n)]
        symbols = bytes(turns.MUST_GO if gone else turns.symbol_of("uas?".index(i), cut) for i, gone, cut in rows)
        assert tables.cheapest(symbols) == plain_cheapest(rows), rows


def random_turns(rng, conversations=150):
    rows = []
    texts = ["Good.", "Why? ", "cut off", "", " \t\n", "\x1c", "é!", "Good.\x0b", "a. b"]
    for c in range(conversations):
        for k in range(rng.choice([1, 2, 4, 7, 12])):
            turn = None if rng.random() < 0.05 else k * rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c else None, turn, role, rng.choice([*texts, None, f"Answer {rng.randint(0, 99)}."])))
    return rows


def test_random_conversations(spark):
    rows = random_turns(random.Random(3))
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    found = report(df, turns.sample_damage(df.selectExpr("*", "1 as audit", "2 as place", "'x' as conv")))
    assert found == plain_report(rows, plain_damage(rows))


def test_undamaged_rows_with_copies(spark):
    rows = random_turns(random.Random(4), 40) * 3
    df = spark.createDataFrame(rows, TURNS)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert report(df, df) == plain_report(rows, clean)


def test_long_conversation_and_text(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No!", "maybe", f"{k}."])) for k in range(700)]
    rows += [(2, 0, "user", "word " * 300_000), (2, 1, "assistant", "x" * 2_000_000 + "."), (2, 2, "user", "word " * 300_000)]
    df = spark.createDataFrame(rows, TURNS)
    import sys

    sys.setrecursionlimit(20_000)
    assert report(df, df) == plain_report(rows, rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert report(empty, turns.sample_damage(empty)) == {}


def test_repaired_turns(spark):
    rows = [(5, 0, "system", "Be kind."), (5, 1, "assistant", "Hello."), (5, 2, "user", "Hm."), (5, 3, "tool", "Result.")]
    df = spark.createDataFrame(rows, TURNS)
    audits = turns.audited(df)
    found = [(r.place, r.role, r.text, r.edit) for r in turns.repaired(df, audits).orderBy("place").collect()]
    assert audits.first().audit == "KIKKR" and audits.first().cost == 6
    assert found == [(0, "system", "Be kind.", "K"), (1, "user", "", "I"), (2, "assistant", "Hello.", "K"), (3, "user", "Hm.", "K"), (4, "assistant", "Result.", "R")]


def test_op11_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op11_conversation_repair"](spark, folder)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert got == plain_report(rows, plain_damage(rows))
    assert sum(g[-2].count("D") + g[-2].count("I") + g[-2].count("R") for g in got.values()) > 5
