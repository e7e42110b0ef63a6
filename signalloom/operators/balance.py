"""Class counts, weights and resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.ranking import take_in_hash_order
from signalloom.runtime import attach

#: Copies of one row that a single explode may produce.
COPIES_PER_STEP = 4096


def class_counts(
    df: DataFrame,
    label_col: str = "label",
    by: Sequence[str] = (),
    labels: Sequence[int] | None = None,
) -> DataFrame:
    """Rows per label. With ``labels``, one row for each of them, 0 when absent."""
    counts = df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        return counts
    # At most one entry per label reaches each map, so the collected list is short.
    wanted = F.col(label_col).isin(list(labels))
    found = F.map_from_entries(
        F.collect_list(F.when(wanted, F.struct(F.col(label_col), F.col("n"))))
    )
    dense = counts.groupBy(*by).agg(found.alias("__found"))
    return dense.select(
        *by, "__found", F.explode(F.array(*[F.lit(x) for x in labels])).alias(label_col)
    ).select(
        *by, label_col, F.coalesce(F.try_element_at("__found", F.col(label_col)), F.lit(0)).alias("n")
    )


def class_weights(
    df: DataFrame, label_col: str = "label", labels: Sequence[int] | None = None
) -> DataFrame:
    """Balanced weights ``n / (k * n_c)``: label, n, weight.

    Without ``labels``, k is the number of classes found. With it, k is their
    number and an absent class has weight 0. n counts all rows, also those whose
    label is missing or not in the list.
    """
    found = class_counts(df, label_col)
    totals = found.agg(F.sum("n").alias("every"), F.count(F.lit(1)).alias("k")).first()
    counts = found if labels is None else class_counts(df, label_col, labels=labels)
    k = totals["k"] if labels is None else len(labels)
    weight = F.lit(float(totals["every"] or 0)) / (F.lit(k) * F.col("n"))
    return counts.withColumn("weight", F.when(F.col("n") > 0, weight).otherwise(F.lit(0.0)))


def add_class_weight(
    df: DataFrame,
    weights: Mapping[int, float] | DataFrame | None = None,
    label_col: str = "label",
    output_col: str = "class_weight",
) -> DataFrame:
    """Attach each row's class weight; NULL for a label that has none.

    ``weights`` may be a mapping, a (label, weight) table such as the weights of
    the training split, or absent, in which case ``df`` itself is measured.
    """
    if isinstance(weights, Mapping):
        pairs = [F.lit(x) for item in weights.items() for x in (item[0], float(item[1]))]
        return df.withColumn(output_col, F.create_map(*pairs)[F.col(label_col)])
    table = class_weights(df, label_col) if weights is None else weights
    side = table.select(label_col, F.col("weight").alias(output_col))
    return attach(df, side, [label_col])


def resample(
    df: DataFrame,
    strategy: str = "undersample",
    label_col: str = "label",
    seed: int = 42,
    mode: str = "exact",
    key_cols: Sequence[str] = ("beat_id",),
) -> DataFrame:
    """Bring every class to the size of the smallest or of the largest one.

    ``mode="bernoulli"`` draws each row on its own, so sizes are met on average.
    ``mode="exact"`` cuts a hash order and meets them to the row. Rows without a
    label take no part. Only a training split should be resampled.
    """
    if strategy not in ("undersample", "oversample"):
        raise ValueError(f"unknown strategy {strategy!r}, use 'undersample' or 'oversample'")
    if mode not in ("exact", "bernoulli"):
        raise ValueError(f"unknown mode {mode!r}, use 'exact' or 'bernoulli'")
    labelled = df.where(F.col(label_col).isNotNull())
    sizes = class_counts(labelled, label_col).withColumnRenamed("n", "__size")
    ends = sizes.agg(F.min("__size").alias("least"), F.max("__size").alias("most")).first()
    if ends["least"] is None:
        return df
    target = ends["least"] if strategy == "undersample" else ends["most"]
    largest_factor = -(-target // ends["least"])
    size = F.col("__size")

    if mode == "bernoulli":
        # A class of any number of others: its size comes by a join, not as a map.
        rows = attach(labelled, sizes, [label_col])
        if strategy == "undersample":
            return rows.where(F.rand(seed) < F.lit(target) / size).drop("__size")
        factor = F.ceil(F.lit(target) / size)
        copied = _replicate(rows, factor, largest_factor, key_cols)
        return copied.where(F.rand(seed) < F.lit(target) / (factor * size)).drop("__size")

    if strategy == "undersample":
        marked = take_in_hash_order(
            labelled, [label_col], key_cols, seed, lambda n: [F.lit(target)]
        )
        return marked.where("__in_0").drop("__n", "__in_0")
    # Every row is kept target // n times; the first target % n rows once more.
    marked = take_in_hash_order(
        labelled, [label_col], key_cols, seed, lambda n: [F.lit(target) % n]
    )
    whole = F.floor(F.lit(target) / F.col("__n")).cast("long")
    copies = whole + F.col("__in_0").cast("long")
    return _replicate(marked, copies, largest_factor, key_cols).drop("__n", "__in_0")


def _replicate(
    df: DataFrame, copies: Column, largest: int, key_cols: Sequence[str]
) -> DataFrame:
    """Repeat each row ``copies`` times, which is at least once.

    A rare class may need millions of copies of one row. Those are made in two
    steps, with a redistribution in between, so that no task has to make them all.
    """
    if largest <= COPIES_PER_STEP:
        repeated = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        return repeated.drop("__copy")
    step = F.lit(COPIES_PER_STEP)
    last_chunk = F.floor((F.col("__left") - 1) / step).cast("int")
    chunks = (
        df.withColumn("__left", copies.cast("long"))
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0), last_chunk)))
        .withColumn("__left", F.least(step, F.col("__left") - F.col("__chunk") * step))
        .repartition(*key_cols, "__chunk")
    )
    repeated = chunks.withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__left").cast("int")))
    )
    return repeated.drop("__left", "__chunk", "__copy")


def resample_comparison(
    df: DataFrame,
    label_col: str = "label",
    seed: int = 42,
    mode: str = "exact",
    key_cols: Sequence[str] = ("beat_id",),
) -> DataFrame:
    """Rows per class before and after under- and oversampling, side by side."""
    by = [label_col, "label_name"]
    versions = {
        "original": df,
        "undersampled": resample(df, "undersample", label_col, seed, mode, key_cols),
        "oversampled": resample(df, "oversample", label_col, seed, mode, key_cols),
    }
    table = None
    for name, frame in versions.items():
        counted = frame.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        table = counted if table is None else table.join(counted, by, "left")
    return table.orderBy(label_col)
