"""Quality by a regularised quadratic discriminant (operator 12).

Every text becomes a row of ``STATISTICS``, transformed so that classes look like normal
distributions. Of labelled rows only sums and sums of products are taken, by class and fold, so
fitting sees every one of them and brings a few hundred numbers to the driver. A class has its mean and a
covariance shrunk towards the pooled one and towards a multiple of the identity; the
inverse of its Cholesky factor goes to the tasks, which turn a batch of rows into Mahalanobis distances by
one matrix product a class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.batches import raw_texts, slices
from signalloom.llm.tables import settle
from signalloom.llm.toxicity import fold, logistic

STATISTICS = [
    "words", "word_length", "word_spread", "different_share", "vocabulary", "commonest_share", "repeated_pair_share", "repeated_line_share",
    "line_length", "capital_share", "letter_share", "digit_share", "symbol_share", "end_share", "shout_share", "mark_share",
    "capital_word_share", "echo_share",
]
#: Added to a share before its logarithm is taken.
LEAST_SHARE = 1e-3


def _sum_of(characters: str) -> list[int]:
    return [ord(c) for c in characters]


_SYMBOLS, _ENDS, _MARKS = (_sum_of(c) for c in ("#*$%&|<>", ".!?", ",;:'\"()-"))


@dataclass(frozen=True)
class Settings:
    #: Tried shares of the pooled covariance, and of the identity, in a class's covariance.
    pooled: tuple[float, ...] = (0.1, 0.3, 0.6, 0.9)
    identity: tuple[float, ...] = (0.01, 0.05, 0.2)
    folds: int = 3
    held_out: int = 1
    #: One training row in so many chooses among them and fits the curve.
    tuning: int = 4
    #: At most so many of those rows, chosen by a hash of the key.
    tuning_rows: int = 100_000


# --- statistics ---


def statistics_of(raw: bytes) -> list[float]:
    """``STATISTICS`` of one text; words are what stands between ASCII white space."""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, m = max(len(raw), 1), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    often = Counter(words)
    pairs = max(len(words) - 1, 1)
    repeated = len(words) - 1 - len(set(zip(words, words[1:]))) if words else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of_lines = max(len(lines), 1)
    shares = [
        max(often.values(), default=0) / m, repeated / pairs, (len(lines) - len(set(lines))) / of_lines,
        seen[65:91].sum() / n, (seen[97:123].sum() + seen[128:].sum()) / n, seen[48:58].sum() / n, seen[_SYMBOLS].sum() / n,
        seen[_ENDS].sum() / m, seen[33] / m, seen[_MARKS].sum() / n, sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
    ]
    common, pair, line, *rest = np.log(np.array(shares) + LEAST_SHARE).tolist()
    return [
        np.log1p(len(words)), np.log1p(lengths.mean()), np.log(lengths.std() + 0.5), np.log(len(often) / m + LEAST_SHARE),
        np.log1p(len(often)) - 0.9 * np.log1p(len(words)), common, pair, line, np.log1p(len(words) / of_lines), *rest,
    ]


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """(key, columns ``also``, statistics: array) of every whole text; NULL texts are empty."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                rows = np.array([statistics_of(raw) for raw in raw_texts(batch.column(1))])
                found = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
                columns = [batch.column(0), *batch.columns[2:], found]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *also, "statistics"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *also)), "statistics array<double>"])
    return docs.select(key, text, *also).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# --- moments ---


@dataclass
class Moments:
    """Number, sum and sum of products of rows; moments of two sets of rows add up."""

    n: float
    total: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.products + other.products)

    @classmethod
    def none(cls, size: int) -> Moments:
        return cls(0.0, np.zeros(size), np.zeros((size, size)))

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def scatter(self) -> np.ndarray:
        return self.products - np.outer(self.total, self.total) / self.n

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n], self.total, self.products.ravel()])

    @classmethod
    def of_flat(cls, values: np.ndarray) -> Moments:
        size = round((len(values) - 1.75) ** 0.5 - 0.5)
        return cls(values[0], values[1 : size + 1], values[size + 1 :].reshape(size, size))


def moments(rows: DataFrame, good: str, tuned: str) -> dict[tuple[int, bool], Moments]:
    """By class and fold, of the ``statistics`` of all rows. A task gives one vector for each."""

    def run(batches):
        sums: dict[tuple[int, bool], Moments] = {}
        for batch in batches:
            x = _matrix(batch.column(0))
            y, t = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), bool)
            for c in (0, 1):
                for part in (False, True):
                    mine = x[(y == c) & (t == part)]
                    if len(mine):
                        sums[c, part] = sums.get((c, part), Moments.none(x.shape[1])) + Moments(len(mine), mine.sum(axis=0), mine.T @ mine)
        for (c, part), found in sums.items():
            yield pa.RecordBatch.from_pydict({"y": pa.array([c], pa.int32()), "t": [part], "v": pa.array([found.flat()], pa.list_(pa.float64()))})

    parts = rows.select("statistics", F.col(good).cast("int"), tuned).mapInArrow(run, "y int, t boolean, v array<double>")
    summed = parts.select("y", "t", F.posexplode("v").alias("at", "x")).groupBy("y", "t", "at").agg(F.sum("x").alias("x"))
    found: dict[tuple[int, bool], dict[int, float]] = {}
    for r in summed.collect():
        found.setdefault((r["y"], r["t"]), {})[r["at"]] = r["x"]
    return {k: Moments.of_flat(np.array([v[i] for i in range(len(v))])) for k, v in found.items()}


# --- the discriminant ---


@dataclass(frozen=True)
class Discriminant:
    """Two normal distributions over standardised statistics, by their cached inverse Cholesky factors."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whitening: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    @classmethod
    def fit(cls, bad: Moments, good: Moments, pooled: float, identity: float) -> Discriminant:
        """Class covariance: (1 - identity) * ((1 - pooled) * own + pooled * both) + identity * mean variance."""
        both = bad + good
        center, scale = both.mean, np.sqrt(np.maximum(np.diag(both.scatter()) / both.n, 0))
        # What does not vary, but for rounding, keeps its own scale.
        scale = np.where(scale > 1e-6 * (1 + np.abs(center)), scale, 1.0)
        shared = (bad.scatter() + good.scatter()) / both.n
        means, whitening, constants = [], [], []
        for m in (bad, good):
            spread = (1 - pooled) * m.scatter() / m.n + pooled * shared
            spread = spread / np.outer(scale, scale)
            size = len(spread)
            spread = (1 - identity) * spread + (identity * np.trace(spread) / size + 1e-6) * np.eye(size)
            factor = np.linalg.cholesky((spread + spread.T) / 2)
            means.append((m.mean - center) / scale)
            whitening.append(np.linalg.inv(factor).T)
            constants.append(float(np.log(m.n / both.n) - np.log(np.diag(factor)).sum()))
        return cls(center, scale, tuple(means), tuple(whitening), tuple(constants))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of the good class above that of the bad one, priors included."""
        z = (x - self.center) / self.scale
        bad, good = (
            c - (((z - m) @ w) ** 2).sum(axis=1) / 2 for m, w, c in zip(self.means, self.whitening, self.constants)
        )
        return good - bad


@dataclass(frozen=True)
class Classifier:
    """A discriminant and the curve from its difference to a score; without one, a constant."""

    discriminant: Discriminant | None
    slope: float = 1.0
    constant: float = 0.0
    share: float = 0.5

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.discriminant is None:
            return np.full(len(x), self.share), np.zeros(len(x))
        found = self.discriminant.difference(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(found) + self.constant, -40, 40))), found


def curve(difference: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(slope, constant, mean log loss) of a logistic curve over the difference's inverse hyperbolic sine."""
    x = np.arcsinh(difference)
    slope, constant = logistic(x[:, None], y)
    p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + constant, -40, 40))), 1e-9, 1 - 1e-9)
    return float(slope), float(constant), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(sums: dict[tuple[int, bool], Moments], x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Classifier:
    """Choose the shrinkage and the curve on tuning rows (x, y), then fit on all training rows.

    With one class only the score is a constant: 1 if only good rows are known, 0 if only bad
    ones, 0.5 with no label. Where tuning or fitting rows lack a class, the strongest shrinkage
    stands with the plain curve.
    """
    known = [sums.get((c, False)) or sums.get((c, True)) for c in (0, 1)]
    if None in known:
        return Classifier(None, share=0.5 if known == [None, None] else float(known[1] is not None))
    whole = [sum((sums[c, t] for t in (False, True) if (c, t) in sums), Moments.none(len(STATISTICS))) for c in (0, 1)]
    best = (np.inf, settings.pooled[-1], settings.identity[-1], 1.0, 0.0)
    if (0, False) in sums and (1, False) in sums and 0 < y.sum() < len(y):
        for pooled in settings.pooled:
            for identity in settings.identity:
                found = Discriminant.fit(sums[0, False], sums[1, False], pooled, identity).difference(x)
                slope, constant, loss = curve(found, y)
                if slope > 0:
                    best = min(best, (loss, pooled, identity, slope, constant))
    return Classifier(Discriminant.fit(*whole, best[1], best[2]), best[3], best[4])


# --- the operator ---


def trained(rows: DataFrame, labels: DataFrame, key: str, good: str, settings: Settings = Settings()) -> Classifier:
    """The classifier of labelled ``rows`` (key, statistics), those of the held-out fold left out."""
    marks = labels.where(F.col(key).isNotNull() & F.col(good).isNotNull()).groupBy(key).agg((F.min(good) > 0).cast("int").alias("__good"))
    marks = marks.where(fold(key, settings.folds) != settings.held_out)
    tuned = F.pmod(F.xxhash64(F.lit(12), key), F.lit(settings.tuning)) == 0
    # Both tables grow with the corpus: a shuffle join at every size.
    known = settle(rows.select(key, "statistics").join(marks.hint("merge"), key).withColumn("__tuned", tuned), "labelled")
    sample = known.where("__tuned").orderBy(F.xxhash64(F.lit(13), key), "statistics").limit(settings.tuning_rows).select("statistics", "__good").toArrow()
    y = sample.column("__good").to_numpy().astype(np.float64)
    x = _matrix(sample.column("statistics").combine_chunks()) if len(y) else np.zeros((0, len(STATISTICS)))
    return fit(moments(known, "__good", "__tuned"), x, y, settings)


def scored(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality",
    settings: Settings = Settings(), also: Sequence[str] = (),
) -> DataFrame:
    """Quality of every whole text: key, columns ``also``, held_out, score (0 to 1), predicted, log_density_difference.

    Rows of the held-out fold (crc32 of the key as text) teach nothing. A key labelled twice counts by
    its lowest label. Labels, language, source and key never enter a score. NULL and empty texts
    have statistics of zero words and are scored like any other; rows that repeat a key are
    scored each by its own text; a NULL key is not held out and has no label.
    """
    rows = settle(statistics(docs, key, text, also), "statistics")
    found = trained(rows, labels, key, good, settings)

    def run(batches):
        for batch in slices(batches, 8192):
            if batch.num_rows:
                score, difference = found.scores(_matrix(batch.column(batch.num_columns - 1)))
                columns = [*batch.columns[:-1], pa.array(score), pa.array(difference)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *also, "score", "log_density_difference"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *also)), "score double, log_density_difference double"])
    out = rows.mapInArrow(run, schema)
    held = F.coalesce(fold(key, settings.folds) == settings.held_out, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int")
    return out.select(key, *also, held.alias("held_out"), "score", predicted.alias("predicted"), "log_density_difference")
