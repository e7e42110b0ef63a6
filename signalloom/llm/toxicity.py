"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Both classes have a model of how the letters of a word follow one another: discounted counts
of the class, interpolated into a Kneser-Ney model that both share, of discounted counts and
continuation counts of ever shorter histories. A sequence that neither class has seen is
judged after shorter histories. The log-likelihood ratio of a text per letter weighs every word by its
number in the text. A logistic curve, fitted on labelled rows the counts never saw, makes the score of it
and of three measures of the text's different words (``MEASURES``).

Counts cover all labelled training rows and stay distributed, and so do the log-ratios of all
letter sequences: they are joined by shuffle with the different words of the texts. Word scores
go to every task while they are few enough for it, and are joined by shuffle if not.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import raw_texts, slices
from signalloom.llm.tables import phase, settle

#: What is not a letter, figure or part of one separates words.
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(_MARKS, b" " * len(_MARKS))
#: Bytes that never occur in UTF-8 stand for the begin and the end of a word.
BEGIN, END = 0xFF, 0xFE
#: Marks the key of a history for the letters never seen after it.
UNSEEN = 1 << 52
#: Words whose scores one worker remembers.
REMEMBERED = 600_000
#: Different words counted together before they are handed on.
COUNTED = 200_000


@dataclass(frozen=True)
class Settings:
    #: Letters (bytes) of a sequence: a history of five and what follows. At most 6.
    order: int = 6
    discount: float = 0.75
    #: Occurrences of the pooled model in the model of either class.
    prior: float = 3.0
    #: Different words, as a power of two, whose scores every task holds; more are joined by shuffle.
    slot_bits: int = 22
    #: Parts in which the different words meet the log-ratios, one after the other.
    parts: int = 4
    #: Precision of the prior of the curve's standardised weights.
    curve_prior: float = 2.0
    #: Labelled rows the logistic curve is fitted on, chosen by a hash of the key.
    calibration_rows: int = 100_000
    folds: int = 5


def weights_of(raw: bytes) -> dict[bytes, int]:
    """The words of a text with their numbers."""
    return Counter(words_of(raw))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_PLAIN).split()


# --- letter sequences as numbers: their length, then their bytes ---


def grams_of(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, word it is in) for every letter of every word and every word's end.

    A sequence is the letter after as much history as the word has, begin included.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(bytes([BEGIN]) + w + bytes([END]) for w in words), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    of = np.repeat(np.arange(len(words)), lengths + 2)
    place = np.arange(len(raw)) - starts[of]
    key, size = np.zeros(len(raw), np.uint64), np.minimum(place + 1, order)
    for back in range(order):
        use = place >= back
        key[use] |= raw[np.flatnonzero(use) - back] << np.uint64(8 * back)
    key |= size.astype(np.uint64) << np.uint64(48)
    real = place > 0
    return key[real].view(np.int64), of[real]


def _length(key: Column) -> Column:
    return F.shiftright(key, 48)


def _bytes(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << 48) - 1))


def _history(key: Column) -> Column:
    """All but the last letter."""
    return F.shiftright(_bytes(key), 8).bitwiseOR(F.shiftleft((_length(key) - 1).cast("long"), 48))


def _suffix(key: Column, gone: int) -> Column:
    """All but the first ``gone`` letters; NULL if none is left. Keys are not nested, or plans would explode."""
    left = _length(key) - gone
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (8 * left).cast("int")) - 1
    return F.when(left > 0, key.bitwiseAND(mask).bitwiseOR(F.shiftleft(left.cast("long"), 48)))


def _shorter(key: Column) -> Column:
    """All but the first letter, of two letters or more."""
    return _suffix(key, 1)


# --- counts ---


def class_counts(labelled: DataFrame, text: str, toxic: str, settings: Settings) -> DataFrame:
    """(gram, n0, n1): how often each letter sequence occurs in either class.

    A document counts each of its words once, so one that repeats itself weighs no more.
    """

    def run(batches):
        counts = (Counter(), Counter())

        def give():
            words = list({*counts[0], *counts[1]})
            columns = [pa.array(words, pa.binary())] + [pa.array([c[w] for w in words], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n0", "n1"])

        for batch in slices(batches):
            for raw, t in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                counts[1 if t else 0].update(set(words_of(raw)))
            if sum(map(len, counts)) > COUNTED:
                yield give()
        if sum(map(len, counts)):
            yield give()

    def letters(batches):
        for batch in slices(batches, 50_000):
            if not batch.num_rows:
                continue
            gram, of = grams_of(batch.column(0).to_pylist(), settings.order)
            seen, at = np.unique(gram, return_inverse=True)
            sums = [np.bincount(at, weights=batch.column(k).to_numpy()[of], minlength=len(seen)).astype(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, sums)], names=["gram", "n0", "n1"])

    words = labelled.select(text, toxic).mapInArrow(run, "word binary, n0 long, n1 long")
    words = words.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = words.mapInArrow(letters, "gram long, n0 long, n1 long")
    return settle(grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")


def suffix_counts(grams: DataFrame, settings: Settings) -> DataFrame:
    """(gram, n0, n1): counts of every letter sequence of any length, from those after whole histories."""
    every = [_suffix(F.col("gram"), k) for k in range(settings.order)]
    suffixes = grams.select(F.explode(F.array(*every)).alias("gram"), "n0", "n1").where("gram is not null")
    return settle(suffixes.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "suffixes")


def _begins(key: Column) -> Column:
    """Whether a sequence starts with the begin of its word."""
    first = F.call_function("shiftright", _bytes(key), (8 * (_length(key) - 1)).cast("int"))
    return first == BEGIN


def _shared(suffixes: DataFrame, settings: Settings) -> list[DataFrame]:
    """(gram, p) by length: the Kneser-Ney probability of every sequence, pooled over the classes.

    A sequence counts by how many different letters come before it. Those of full length or
    from the begin of a word, which nothing comes before, count by how often they occur.
    """
    d, levels = settings.discount, []
    before = suffixes.where(_length(F.col("gram")) > 1).groupBy(_shorter(F.col("gram")).alias("gram")).agg(F.count("*").alias("kinds_before"))
    seen = F.col("n0") + F.col("n1")
    often = F.when((_length(F.col("gram")) == settings.order) | _begins(F.col("gram")), seen).otherwise(F.coalesce("kinds_before", seen))
    counts = settle(suffixes.join(before, "gram", "left").select("gram", _history(F.col("gram")).alias("history"), often.alias("n")), "continuations")
    total = settle(counts.groupBy("history").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "histories")
    counts = settle(counts.join(total, "history"), "counted")
    own = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
    spare = d * F.col("kinds") / F.col("total")
    for length in range(1, settings.order + 1):
        level = counts.where(_length(F.col("gram")) == length)
        if length == 1:
            level = level.select("gram", (own + spare / 257).alias("p"))
        else:
            shorter = levels[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
            level = level.withColumn("shorter", _shorter(F.col("gram"))).join(shorter, "shorter").select("gram", (own + spare * F.col("q")).alias("p"))
        levels.append(settle(level, f"backoff{length}"))
    return levels


def shared_backoff(grams: DataFrame, settings: Settings) -> DataFrame:
    """(gram, p): the pooled Kneser-Ney probability of all sequences below full length."""
    levels = _shared(suffix_counts(grams, settings), settings)[:-1]
    return levels[0] if len(levels) == 1 else reduce(DataFrame.union, levels)


def class_models(grams: DataFrame, settings: Settings) -> DataFrame:
    """(key, p0, p1): each class's probability of a sequence's last letter after the rest.

    A class discounts its own counts and gives what that frees, and ``prior`` occurrences more,
    to the pooled probability of the same sequence, so its letters after a history sum to
    one. A row with the key of a history and ``UNSEEN`` holds what each class gives a letter that
    neither has seen there, as a share of the pooled probability.
    """
    with phase(grams.sparkSession):
        return _class_models(grams, settings)


def _class_models(grams: DataFrame, settings: Settings) -> DataFrame:
    d, prior = settings.discount, settings.prior
    suffixes = suffix_counts(grams, settings)
    shared = reduce(DataFrame.union, _shared(suffixes, settings))
    rows = suffixes.withColumn("history", _history(F.col("gram")))
    sums = [F.sum(f"n{c}").alias(f"total{c}") for c in "01"] + [F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"kinds{c}") for c in "01"]
    history = settle(rows.groupBy("history").agg(*sums), "class_histories")
    spare = [(d * F.col(f"kinds{c}") + prior) / (F.col(f"total{c}") + prior) for c in "01"]
    own = [F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / (F.col(f"total{c}") + prior) for c in "01"]
    seen = rows.join(history, "history").join(shared, "gram")
    seen = seen.select(F.col("gram").alias("key"), *[(own[c] + spare[c] * F.col("p")).alias(f"p{c}") for c in (0, 1)])
    unseen = history.select(F.col("history").bitwiseOR(F.lit(UNSEEN)).alias("key"), *[spare[c].alias(f"p{c}") for c in (0, 1)])
    return settle(seen.union(unseen), "models", outlives=True)


def log_ratios(grams: DataFrame, settings: Settings) -> DataFrame:
    """(key, ratio): log of the toxic over the ordinary probability, for all of ``class_models``."""
    return class_models(grams, settings).select("key", F.log(F.col("p1") / F.col("p0")).alias("ratio"))


# --- scoring ---


def different_words(docs: DataFrame, text: str) -> DataFrame:
    """(word): every word of the texts once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in slices(batches):
            for raw in raw_texts(batch.column(0)):
                seen.update(words_of(raw))
            if len(seen) > COUNTED:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary())})

    return docs.select(text).mapInArrow(run, "word binary").distinct()


def word_scores(words: DataFrame, ratios: DataFrame, settings: Settings) -> DataFrame:
    """(word, score): sum of the log-ratios of each word's letters, joined by shuffle with all of them.

    A word has some ten letters, so words meet the log-ratios part by part: the shuffle files of
    one part go before the next one's come.
    """

    def letters(batches):
        for batch in slices(batches, 50_000):
            if batch.num_rows:
                gram, of = grams_of(batch.column(0).to_pylist(), settings.order)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(gram)], names=["word", "gram"])

    with phase(words.sparkSession):
        # Letters are cut twice: ten rows a word are cheaper to make than to keep.
        different = settle(words, "different")
        grams = different.mapInArrow(letters, "word binary, gram long")
        ratio = settled_ratios(settle(grams.select("gram").distinct(), "asked"), ratios, settings)
        scores = []
        for part in range(settings.parts):
            mine = different.where(F.pmod(F.xxhash64("word"), F.lit(settings.parts)) == part)
            met = mine.mapInArrow(letters, "word binary, gram long").join(ratio, "gram")
            scores.append(settle(met.groupBy("word").agg(F.sum("ratio").alias("score")), "words", outlives=True))
        return reduce(DataFrame.union, scores)


def settled_ratios(grams: DataFrame, ratios: DataFrame, settings: Settings) -> DataFrame:
    """(gram, ratio) of every sequence; one never seen backs off.

    Where its history was seen, both classes give it their share of the same pooled
    probability; where not, it is judged after the next shorter history. 0 with no counts at all.
    Sequences that are settled leave; each length of what both classes know is read once.
    """
    size = _length(F.col("key").bitwiseAND(F.lit(UNSEEN - 1)))
    is_history = F.col("key").bitwiseAND(F.lit(UNSEEN)) != 0
    found: list[DataFrame] = []
    # Sequences from the begin of a word are shorter; they join the others at their own length.
    rest, waiting = None, grams
    for length in range(settings.order, 0, -1):
        here = waiting.where(_length(F.col("gram")) == length)
        short = here.select("gram", F.col("gram").alias("tail"))
        if rest is not None:
            cut = rest.select("gram", _shorter(F.col("tail")).alias("tail"))
            short = short.union(cut)
        known = ratios.where(~is_history & (size == length)).select(F.col("key").alias("tail"), F.col("ratio").alias("known"))
        after = ratios.where(is_history & (size == length - 1)).select(F.col("key").alias("history"), F.col("ratio").alias("unknown"))
        asked = short.withColumn("history", _history(F.col("tail")).bitwiseOR(F.lit(UNSEEN)))
        # The histories first: what is known has one.
        told = asked.join(after, "history", "left").join(known, "tail", "left")
        level = settle(told.select("gram", "tail", F.coalesce("known", "unknown").alias("ratio")), f"length{length}")
        found.append(level.where("ratio is not null").select("gram", "ratio"))
        rest = level.where("ratio is null")
    nothing = rest.select("gram", F.lit(0.0).alias("ratio"))
    return reduce(DataFrame.union, [*found, nothing])


def _word_hash(words: list[bytes]) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for a binary value, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


class WordTable:
    """Scores of all words by a 64-bit hash, for as many as every task may hold."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]

    def get(self, words: list[bytes]) -> list[float]:
        return self.scores[np.searchsorted(self.hashes, _word_hash(words))].tolist()


_SCORES: dict[str, dict[bytes, float]] = {}


#: Log-ratios above these make a word an expression of the toxic class.
CLEAR, STRONG = 1.0, 1.5
MEASURES = ["per_letter", "clear", "highest", "strong"]


def measures(
    docs: DataFrame, scores: DataFrame, key: str, text: str, settings: Settings, also: Sequence[str] = ()
) -> DataFrame:
    """(key, per_letter, clear, highest, strong) of the words of every whole text.

    ``per_letter`` is the log-ratio of the text, repeated words included, by its length in
    letters; the others look at different words: ``clear`` is what they have above ``CLEAR``, by their number, ``highest`` the highest word's, and
    ``strong`` the sum of what they have above ``STRONG``. Up to 2^``slot_bits``
    scores go to every task; more are joined by shuffle, with the same result.
    """
    if scores.count() > 1 << settings.slot_bits:
        return shuffled_measures(docs, scores, key, text, also)
    rows = scores.select(F.xxhash64("word").alias("hash"), "score").toArrow()
    table = WordTable(rows.column("hash").to_numpy().view(np.uint64), rows.column("score").to_numpy())
    shared, name = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches):
        if name not in _SCORES:
            _SCORES.clear()
            _SCORES[name] = {}
        known = _SCORES[name]
        for batch in slices(batches):
            cut = [weights_of(raw) for raw in raw_texts(batch.column(1))]
            fresh = list(set().union(*cut).difference(known))
            known.update(zip(fresh, shared.value.get(fresh)))
            rows = []
            for words in cut:
                if words:
                    v = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                    n = np.fromiter(words.values(), np.float64, len(words))
                    letters = sum((len(w) + 1) * c for w, c in words.items())
                    rows.append(((v * n).sum() / letters, np.maximum(v - CLEAR, 0).mean(), v.max(), np.maximum(v - STRONG, 0).sum()))
                else:
                    rows.append((0.0, 0.0, 0.0, 0.0))
            columns = {n: pa.array(c, pa.float64()) for n, c in zip(MEASURES, zip(*rows))}
            carried = dict(zip([key, *also], [batch.column(0), *batch.columns[2:]]))
            yield pa.RecordBatch.from_pydict(carried | columns)
            if len(known) > REMEMBERED:
                known.clear()

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *also)), *(f"{n} double" for n in MEASURES)])
    return docs.select(key, text, *also).mapInArrow(run, schema)


def shuffled_measures(docs: DataFrame, scores: DataFrame, key: str, text: str, also: Sequence[str] = ()) -> DataFrame:
    """The same measures where no task can hold all scores: every text's words are joined with them."""
    rows = settle(docs.select(key, text, *also).withColumn("__row", F.monotonically_increasing_id()), "rows")

    def run(batches):
        for batch in slices(batches):
            for row, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                words = weights_of(raw)
                columns = [pa.array([row] * len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["__row", "word", "n"])

    words = rows.select("__row", text).mapInArrow(run, "__row long, word binary, n long").join(scores, "word")
    v, n, above = F.col("score"), F.col("n"), lambda limit: F.greatest(F.col("score") - limit, F.lit(0.0))
    found = words.groupBy("__row").agg(
        (F.sum(v * n) / F.sum((F.octet_length("word") + 1) * n)).alias("per_letter"),
        F.avg(above(CLEAR)).alias("clear"), F.max(v).alias("highest"), F.sum(above(STRONG)).alias("strong"),
    )
    return rows.join(found, "__row", "left").select(key, *also, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])


def features() -> list[Column]:
    """The measures on a scale on which they differ by factors."""
    return [F.signum(F.col(n)) * F.log1p(20 * F.abs(F.col(n))) for n in MEASURES]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50, prior: float = 0.0) -> np.ndarray:
    """Weights of a logistic curve by Newton steps; the last one is the constant."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-12
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    # A prior of constant weight decides where few rows are known and fades where there are many.
    penalty = max(ridge * len(z) / 10, prior) * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * center / scale).sum())


def fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds


def scored(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
    settings: Settings = Settings(), also: Sequence[str] = (),
) -> DataFrame:
    """Toxicity of every whole text: key, columns ``also``, held_out, score (0 to 1), predicted,
    log_ratio.

    Rows of fold 0 (crc32 of the key as text) are held out: their labels are not used. The
    last fold fits the curve, the others the counts. Labels, language, source and key never
    enter a score. A NULL or empty text scores by the curve's constant. With no row of one
    class to learn from, all scores are the share of toxic rows; with no labels, 0. Rows
    that repeat a key are scored each by its own text; a NULL key is not held out.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(key).agg(F.max(toxic).alias("__toxic"))
    which = fold(key, settings.folds)
    # Both tables grow with the corpus: a shuffle join at every size.
    training = docs.select(key, text).join(marks.where(~which.isin(0, settings.folds - 1)).hint("merge"), key)
    with phase(docs.sparkSession):
        ratios = log_ratios(class_counts(training, text, "__toxic", settings), settings)
        scores = word_scores(different_words(docs, text), ratios, settings)
        found = settle(measures(docs, scores, key, text, settings, also), "measures", outlives=True)
    x = features()
    fit = found.join(marks.where(which == settings.folds - 1), key).select(*[c.alias(f"x{k}") for k, c in enumerate(x)], F.col("__toxic").cast("double").alias("y"), F.xxhash64(key).alias("h"))
    sample = fit.orderBy("h", "x0").limit(settings.calibration_rows).toArrow()
    y = sample.column("y").to_numpy()
    if len(y) and 0 < y.sum() < len(y):
        w = logistic(np.column_stack([sample.column(f"x{k}").to_numpy() for k in range(len(x))]), y, prior=settings.curve_prior)
        line = F.lit(float(w[-1]))
        for weight, c in zip(w, x):
            line = line + F.lit(float(weight)) * c
        score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    out = found.withColumn("score", score)
    held = F.coalesce(which == 0, F.lit(False))
    return out.select(key, *also, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("per_letter").alias("log_ratio"))
