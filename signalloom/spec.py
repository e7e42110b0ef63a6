"""What a signal table looks like: sample count, clock, and class names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.runtime import literal_table


@dataclass(frozen=True)
class Collection:
    """A family of files sharing one label code list.

    ``labels`` is ordered: its order is the order in which classes are reported.
    """

    name: str
    labels: Mapping[int, str]
    descriptions: Mapping[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.labels.values())


@dataclass(frozen=True)
class SignalSpec:
    """Shape of a signal table; every default below can be replaced by the user."""

    n_samples: int
    sampling_hz: float
    collections: Mapping[str, Collection]

    @property
    def sample_columns(self) -> list[str]:
        return [f"s{i:03d}" for i in range(self.n_samples)]

    def collection(self, source: str) -> Collection:
        if source not in self.collections:
            raise KeyError(f"unknown source {source!r}, known are {sorted(self.collections)}")
        return self.collections[source]


# Shape of the public heartbeat matrices and their class lists.
HEARTBEAT = SignalSpec(
    n_samples=187,
    sampling_hz=125.0,
    collections={
        "mitbih": Collection(
            "mitbih",
            {0: "N", 1: "S", 2: "V", 3: "F", 4: "Q"},
            {
                "N": "Normal beat (normal, left/right bundle branch block, atrial escape, nodal escape)",
                "S": "Supraventricular ectopic beat (atrial premature, aberrant atrial, nodal, supraventricular)",
                "V": "Ventricular ectopic beat (premature ventricular contraction, ventricular escape)",
                "F": "Fusion beat (fusion of ventricular and normal)",
                "Q": "Unknown / unclassifiable beat (paced, fusion of paced and normal, unclassified)",
            },
        ),
        "ptbdb": Collection(
            "ptbdb",
            {0: "normal", 1: "abnormal"},
            {
                "normal": "Healthy control recording",
                "abnormal": "Recording from a patient diagnosed with myocardial infarction",
            },
        ),
    },
)


RAW_LABEL = "label_raw"


def raw_schema(spec: SignalSpec = HEARTBEAT) -> T.StructType:
    """Schema of a head-less matrix file: the samples, then the label."""
    names = [*spec.sample_columns, RAW_LABEL]
    return T.StructType([T.StructField(name, T.DoubleType(), True) for name in names])


def canonical_schema() -> T.StructType:
    """One row per signal; what every operator reads."""
    text, code = T.StringType(), T.IntegerType()
    columns = {"beat_id": text, "source": text, "split": text, "label": code, "label_name": text}
    fields = [T.StructField(name, kind) for name, kind in columns.items()]
    return T.StructType([*fields, T.StructField("signal", T.ArrayType(T.DoubleType()))])


def conform(df: DataFrame) -> DataFrame:
    """Select and cast ``df`` to the canonical schema; fails when a column is missing."""
    return df.to(canonical_schema())


def schema_violations(df: DataFrame, spec: SignalSpec = HEARTBEAT) -> DataFrame:
    """Rows that break the canonical contract, with the first broken rule as ``violation``.

    A row is fine when no canonical column is NULL and the signal has the
    declared number of samples.
    """
    rule = F.lit(None).cast("string")
    checks: list[tuple[str, Column]] = [
        (f"null_{name}", F.col(name).isNull()) for name in canonical_schema().names
    ]
    checks.append(("wrong_length", F.col("signal").isNotNull() & (F.size("signal") != spec.n_samples)))
    for name, broken in reversed(checks):
        rule = F.when(broken, F.lit(name)).otherwise(rule)
    return df.withColumn("violation", rule).where(F.col("violation").isNotNull())


def label_name_map(source: str, spec: SignalSpec = HEARTBEAT) -> dict[int, str]:
    return dict(spec.collection(source).labels)


def label_name_expr(source: str, label: Column, spec: SignalSpec = HEARTBEAT) -> Column:
    """Class name of a label code, NULL for a code that is not in the list."""
    pairs = [F.lit(x) for item in spec.collection(source).labels.items() for x in item]
    return F.create_map(*pairs)[label]


def label_dimension(spark: SparkSession, spec: SignalSpec = HEARTBEAT) -> DataFrame:
    """The label list as a table: source, label, label_name, description, label_order."""
    rows = [
        (source, code, name, coll.descriptions.get(name, ""), order)
        for source, coll in spec.collections.items()
        for order, (code, name) in enumerate(coll.labels.items())
    ]
    columns = ["source", "label", "label_name", "description", "label_order"]
    schema = "source string, label int, label_name string, description string, label_order int"
    values = dict(zip(columns, map(list, zip(*rows)))) if rows else {c: [] for c in columns}
    return literal_table(spark, values, schema)


def describe_labels(df: DataFrame, spec: SignalSpec = HEARTBEAT) -> DataFrame:
    """Add ``description`` by (source, label_name); empty text when there is none.

    The dimension is built from the spec, so its size is known and small: it is
    safe to send to every executor.
    """
    dim = label_dimension(df.sparkSession, spec).select("source", "label_name", "description")
    return df.join(F.broadcast(dim), ["source", "label_name"], "left").withColumn(
        "description", F.coalesce("description", F.lit(""))
    )


def ordered_labels(
    source: str, present: Iterable[str] | None = None, spec: SignalSpec = HEARTBEAT
) -> list[str]:
    """Class names in report order, restricted to those in ``present`` when given."""
    keep = None if present is None else set(present)
    return [n for n in spec.collection(source).names if keep is None or n in keep]


def with_label_order(df: DataFrame, spec: SignalSpec = HEARTBEAT) -> DataFrame:
    """Add ``label_order`` so that a report can be sorted in class order."""
    dim = label_dimension(df.sparkSession, spec).select("source", "label_name", "label_order")
    return df.join(F.broadcast(dim), ["source", "label_name"], "left")
