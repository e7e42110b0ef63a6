"""Learned decision lists for text quality (operator 2). DataFrame functions only.

Statistics of whole texts are Spark expressions. Sequential covering learns from labelled
statistics: a rule grows by the threshold that gains most, is pruned on rows held back,
and takes its rows out before the next rule grows. Every step is one aggregate over a
narrow table of bin numbers; only counts by statistic and bin come to the driver. Bins are
cut anew in the rows that the rules so far leave, until such a round finds no further rule.
The list is applied as one ordered CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.tables import settle

#: ASCII white space, the only characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics the rules may use.
STATISTICS = ["n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "mark_share"]


# --- statistics ---


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _equal_neighbour(item: Column, k: Column, items: Column, part) -> Column:
    before, after = F.get(items, k - 1), F.get(items, k + 1)
    return (part(item) == part(before)) | (part(item) == part(after))


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """Counts of every whole text: key, columns to carry along, the base counts, and the
    statistics of the rules.

    Words are runs of characters other than ASCII white space. ``n_dup_lines`` counts
    lines with a word that equal an earlier line. ``n_repeat_words`` counts the words
    inside 3-word windows found twice or more: windows are sorted by half a hash with
    their place in the other half; those that meet another are compared by their words.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    carried = [f"__also{k}" for k in range(len(also))]
    rows = docs.select(F.col(key).alias("key"), *[F.col(c).alias(a) for c, a in zip(also, carried)], raw.alias("t"))
    rows = rows.select(
        "key", *carried,
        F.char_length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), ".,;:!?|"))).cast("long").alias("n_marks"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("words"),
    )
    words = F.col("words")
    half = F.lit(0xFFFFFFFF)
    places = F.sequence(F.lit(0), F.size("words") - 3)

    def packed(i):
        hashed = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(hashed, 32).bitwiseOR(i.cast("long"))

    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("windows", F.when(F.size("words") >= 3, F.sort_array(F.transform(places, packed))).otherwise(none))
    met = F.filter("windows", lambda x, k: _equal_neighbour(x, k, F.col("windows"), lambda y: F.shiftright(y, 32)))

    def spelled(x):
        i = x.bitwiseAND(half).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))

    rows = rows.withColumn("spelled", F.sort_array(F.transform(met, spelled)))
    again = F.filter("spelled", lambda x, k: _equal_neighbour(x, k, F.col("spelled"), lambda y: y["g"]))
    rows = rows.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("again"), k + 1) - i, F.lit(3))))
    rows = rows.select(
        "key", *carried, "word_chars", "n_symbols", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_line = F.greatest(F.col("n_lines"), F.lit(1))
    return rows.select(
        F.col("key").alias(key), *[F.col(a).alias(c) for c, a in zip(also, carried)], *BASE_COUNTS,
        per_word("word_chars").alias("mean_word"), per_word("n_symbols").alias("symbols_per_word"),
        (F.col("n_dup_lines") / per_line).alias("dup_line_share"), per_word("n_repeat_words").alias("repeat_share"),
        (F.col("n_words") / per_line).alias("words_per_line"), per_word("n_marks").alias("mark_share"),
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Too few words, or too many of them inside repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


# --- decision lists ---


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions hold. The counts are those of the rows it was pruned on."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        held = self.conditions[0].column()
        for c in self.conditions[1:]:
            held = held & c.column()
        return held

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} ({self.bad} bad, {self.good} good)"


def verdict(rules: list[Rule], keep: Column) -> Column:
    """The list as one conditional: the first rule that holds rejects, the rest is ``keep``."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return keep if out is None else out.otherwise(keep)


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    max_conditions: int = 3
    #: A rule that is less often right on the rows held back is not taken.
    precision: float = 0.97
    #: Fewest bad rows that a rule must catch, of those it grows on and of those held back.
    support: int = 3


def learn(labelled: DataFrame, key: str, bad: str, settings: Settings = Settings()) -> list[Rule]:
    """Learn rules that reject rows whose ``bad`` is true, from statistics and labels.

    All labelled rows count. A third of them, chosen by a hash of the key, prunes. Labels
    that are NULL say nothing; without a bad or a good row the list is empty. Where a rule is
    refused, the rows it grew on are set aside and growing goes on among the others, until no
    region with ``support`` bad rows is left.
    """
    prune = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(3)) == 0
    marked = labelled.where(F.col(bad).isNotNull()).select(*STATISTICS, F.col(bad).cast("int").alias("bad"), prune.alias("prune"))
    marked = settle(marked, "labelled")
    rules: list[Rule] = []
    fine = False
    while True:
        found = _cover(marked.where(verdict(rules, F.lit(True))), settings, fine)
        if fine and not found:
            return rules
        rules, fine = rules + found, True


def _cover(rows: DataFrame, settings: Settings, fine: bool) -> list[Rule]:
    """Rules for rows that no rule holds for yet. Thresholds are quantiles of the rows; in a
    ``fine`` round, where bad rows have become rare, also those of the bad ones."""
    shares = [k / settings.bins for k in range(1, settings.bins)]
    among = {"": F.lit(True), "__bad": F.col("bad") == 1} if fine else {"": F.lit(True)}
    wanted = [F.percentile_approx(F.when(only, F.col(s)), shares, 10_000).alias(s + a) for s in STATISTICS for a, only in among.items()]
    quantiles = rows.agg(*wanted).first().asDict()
    cuts = {s: sorted({x for a in among for x in quantiles[s + a] or []}) for s in STATISTICS}
    cuts = {s: v for s, v in cuts.items() if v}
    if not cuts:
        return []
    # One comparison a statistic: its place among the cuts.
    level = lambda s: F.size(F.filter(F.lit(cuts[s]), lambda c: F.col(s) > c))
    # Rows that fall into the same bins are alike: one row with counts stands for them.
    table = rows.select(*[level(s).alias(s) for s in cuts], "bad", "prune").groupBy(*cuts, "prune")
    table = settle(table.agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")), "bins")

    def holds(c: tuple[str, bool, int]) -> Column:
        statistic, above, k = c
        return F.col(statistic) > k if above else F.col(statistic) <= k

    def inside(conditions: list) -> Column:
        held = holds(conditions[0])
        for c in conditions[1:]:
            held = held & holds(c)
        return held

    rules: list[Rule] = []
    rest, growing = table, table.where("not prune")
    while True:
        grown, caught = _grow(growing, list(cuts), {s: len(v) for s, v in cuts.items()}, holds, settings)
        if caught < settings.support:
            return rules
        kept, (b, g) = _prune(rest.where("prune"), grown, holds)
        if b < settings.support or b < settings.precision * (b + g):
            growing = growing.where(~inside(grown))
            continue
        rules.append(Rule(tuple(Condition(s, above, float(cuts[s][k])) for s, above, k in kept), b, g))
        rest, growing = rest.where(~inside(kept)), growing.where(~inside(kept))


def _grow(rows: DataFrame, statistics: list[str], levels: dict[str, int], holds, settings: Settings) -> tuple[list, int]:
    """Add the condition of largest information gain until no good row is left inside; also the bad rows inside."""
    chosen: list = []
    inside = 0
    for _ in range(settings.max_conditions):
        pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("k")) for s in statistics]))
        found = rows.select(pairs.alias("p"), "bad", "good").groupBy("p.s", "p.k").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in found.collect():
            by.setdefault(r["s"], {})[r["k"]] = (r["b"], r["g"])
        if not by:
            break
        total_b, total_g = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
        if not total_b or not total_g:
            break
        before = math.log2(total_b / (total_b + total_g))
        best, best_gain = None, 1e-9
        for s in statistics:
            low_b = low_g = 0
            for k in range(levels[s]):
                b, g = by.get(s, {}).get(k, (0, 0))
                low_b, low_g = low_b + b, low_g + g
                for above, b_in, g_in in ((False, low_b, low_g), (True, total_b - low_b, total_g - low_g)):
                    if b_in:
                        gain = b_in * (math.log2(b_in / (b_in + g_in)) - before)
                        if gain > best_gain:
                            best, best_gain, best_b = (s, above, k), gain, b_in
        if best is None:
            break
        chosen.append(best)
        inside = best_b
        rows = rows.where(holds(best))
    return chosen, inside


def _prune(rows: DataFrame, grown: list, holds) -> tuple[list, tuple[int, int]]:
    """Drop conditions from the end while (bad - good) / (bad + good) does not fall."""
    inside = [holds(grown[0])]
    for c in grown[1:]:
        inside.append(inside[-1] & holds(c))
    sums = [F.coalesce(F.sum(F.when(x, F.col(c))), F.lit(0)) for x in inside for c in ("bad", "good")]
    found = tuple(rows.agg(*[s.alias(f"c{k}") for k, s in enumerate(sums)]).first())
    counted = [(found[2 * k], found[2 * k + 1]) for k in range(len(grown))]
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in counted]
    best = max(range(len(grown)), key=lambda k: (worth[k], -k))
    return grown[: best + 1], counted[best]


# --- the operator ---


def judged(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality",
    settings: Settings = Settings(), also: Sequence[str] = (),
) -> tuple[DataFrame, list[Rule]]:
    """(key, columns ``also``, base counts, base_failed, kept) of every row, and the rules learned.

    ``good`` is 1 for labelled rows to keep and 0 for those to reject. NULL texts have no
    words and fail the base rule, as do short ones. Rows that repeat a key are judged each
    by its own text. Other columns are not looked at.
    """
    counted = settle(text_statistics(docs, key, text, also), "statistics")
    marks = labels.groupBy(key).agg((F.min(good) == 0).alias("bad")).where(F.col(key).isNotNull())
    rules = learn(counted.join(marks, key).where(~base_failed()), key, "bad", settings)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules, F.lit(True)))
    out = counted.withColumn("base_failed", base_failed()).withColumn("kept", kept)
    return out.select(key, *also, *BASE_COUNTS, "base_failed", "kept"), rules
