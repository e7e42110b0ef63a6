"""Section C: profiling reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.catalog.base import (
    EVENT_FEATS,
    EVENT_HZ,
    EVENT_LONG,
    EVENT_ROWS,
    LINE_FEATS,
    SPEC,
    beats,
    big,
    lines,
    query,
    r,
    rounded,
    share,
    table,
)
from signalloom.operators import profile as P
from signalloom.operators import sketches as S
from signalloom.operators.descriptors import FEATURE_COLUMNS, add_descriptors
from signalloom.runtime import materialise
from signalloom.sources.views import EVENT_CLASSES, LINE_SPEC


@query(
    "c01_dataset_overview",
    f"""WITH {EVENT_ROWS},
g AS (SELECT source, split, count(*) AS n, count(DISTINCT label) AS k FROM rows GROUP BY ALL)
SELECT source, split, {big('n')} AS n_beats, {big('k')} AS n_classes,
       {share('n', 'SELECT sum(n) FROM g', 2)} AS pct_of_total FROM g""",
)
def c01(spark, sf_dir):
    return P.dataset_overview(beats(spark, sf_dir))


DISTRIBUTION = f"""{EVENT_ROWS},
g AS (SELECT source, split, label, label_name, count(*) AS n FROM rows GROUP BY ALL),
dist AS (SELECT source, split, label, label_name, {big('n')} AS n_beats,
           {share('n', 'sum(n) OVER (PARTITION BY source, split)', 3)} AS pct FROM g)"""


@query(
    "c02_class_distribution",
    f"""WITH {DISTRIBUTION}
SELECT *, concat('daily ', label_name, ' amounts') AS description FROM dist""",
)
def c02(spark, sf_dir):
    return P.class_distribution(beats(spark, sf_dir), spec=SPEC)


@query(
    "c02_class_distribution_of_quality",
    f"""WITH g AS (SELECT toxic, quality, count(*) AS n FROM labels GROUP BY ALL)
SELECT toxic, quality AS label, CAST(quality AS VARCHAR) AS label_name, {big('n')} AS n_beats,
       {share('n', 'sum(n) OVER (PARTITION BY toxic)', 3)} AS pct FROM g""",
)
def c02_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        "toxic", F.col("quality").alias("label"), F.col("quality").cast("string").alias("label_name")
    )
    return P.class_distribution(rows, by=["toxic"])


@query(
    "c03_imbalance_summary",
    f"""WITH {EVENT_ROWS},
g AS (SELECT source, label_name, count(*) AS n FROM rows GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label_name) AS most,
        row_number() OVER (PARTITION BY source ORDER BY n, label_name) AS least,
        sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS k FROM g)
SELECT a.source, {big('a.total')} AS n_beats, {big('a.k')} AS n_classes,
       a.label_name AS majority_class, {share('a.n', 'a.total', 2)} AS majority_pct,
       b.label_name AS minority_class, {share('b.n', 'b.total', 2)} AS minority_pct,
       {r('CAST(a.n AS DOUBLE) / b.n', 1)} AS imbalance_ratio
FROM o a JOIN o b ON a.source = b.source AND a.most = 1 AND b.least = 1""",
)
def c03(spark, sf_dir):
    return P.imbalance_summary(P.class_distribution(beats(spark, sf_dir), spec=None))


@query(
    "c03_imbalance_of_documents",
    f"""WITH g AS (SELECT source, lang AS label_name, count(*) AS n FROM documents GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label_name) AS most,
        row_number() OVER (PARTITION BY source ORDER BY n, label_name) AS least,
        sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS k FROM g)
SELECT a.source, {big('a.total')} AS n_beats, {big('a.k')} AS n_classes,
       a.label_name AS majority_class, {share('a.n', 'a.total', 2)} AS majority_pct,
       b.label_name AS minority_class, {share('b.n', 'b.total', 2)} AS minority_pct,
       {r('CAST(a.n AS DOUBLE) / b.n', 1)} AS imbalance_ratio
FROM o a JOIN o b ON a.source = b.source AND a.most = 1 AND b.least = 1""",
)
def c03_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "source", F.col("lang").alias("label"), F.col("lang").alias("label_name")
    )
    return P.imbalance_summary(P.class_distribution(rows, by=["source"], spec=None))


def _quality_sql(prefix: str, facts: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    checks = {
        "rows_total": "1",
        "null_signal": "0",
        "wrong_length": f"CASE WHEN n <> {{n}} THEN 1 ELSE 0 END",
        "null_label": "CASE WHEN label IS NULL THEN 1 ELSE 0 END",
        "contains_null_sample": "CASE WHEN nulls > 0 THEN 1 ELSE 0 END",
        "contains_nan_sample": "CASE WHEN nans > 0 THEN 1 ELSE 0 END",
        "below_zero": "CASE WHEN lo < 0 THEN 1 ELSE 0 END",
        "above_one": "CASE WHEN hi > 1 THEN 1 ELSE 0 END",
        "all_zero_beat": "CASE WHEN hi = 0 THEN 1 ELSE 0 END",
        "max_not_one": "CASE WHEN abs(hi - 1) > 1e-9 THEN 1 ELSE 0 END",
        "min_not_zero": "CASE WHEN abs(lo) > 1e-9 THEN 1 ELSE 0 END",
    }
    group = f"GROUP BY {by}" if by else ""
    body = " UNION ALL ".join(
        f"SELECT {head}'{name}' AS \"check\", {big(f'sum({case})')} AS n_beats, "
        f"{share(f'sum({case})', 'count(*)', 4)} AS pct FROM facts {group}"
        for name, case in checks.items()
    )
    return f"WITH {prefix}facts AS ({facts}) {body}"


_FACTS = """SELECT beat_id, source, label, count(*) AS n, min(x) AS lo, max(x) AS hi,
  sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS nulls, sum(CASE WHEN isnan(x) THEN 1 ELSE 0 END) AS nans
  FROM long GROUP BY ALL"""


@query("c04_quality_report", _quality_sql(EVENT_LONG + ",\n", _FACTS).replace("{n}", "31"))
def c04(spark, sf_dir):
    return P.quality_report(beats(spark, sf_dir), spec=SPEC)


@query(
    "c04_quality_report_of_embeddings",
    _quality_sql(
        "",
        """SELECT label, len(embedding) AS n, list_min(embedding) AS lo, list_max(embedding) AS hi,
  0 AS nulls, 0 AS nans FROM embeddings""",
        by="label",
    ).replace("{n}", "64"),
)
def c04_embeddings(spark, sf_dir):
    from signalloom.spec import SignalSpec

    rows = table(spark, sf_dir, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("signal")
    )
    return P.quality_report(rows, by=["label"], spec=SignalSpec(64, 1.0, {}))


@query(
    "c05_duplicate_report",
    f"""WITH g AS (
  SELECT source AS origin, text, count(*) AS n, count(DISTINCT lang) AS labels,
         count(DISTINCT n_chars % 2) AS splits FROM documents GROUP BY ALL)
SELECT origin AS source, {big('sum(n)')} AS n_beats, {big('count(*)')} AS n_unique_waveforms,
       {big('sum(n - 1)')} AS n_duplicated_beats,
       {big('sum(CASE WHEN labels > 1 THEN 1 ELSE 0 END)')} AS n_waveforms_with_conflicting_labels,
       {big('sum(CASE WHEN splits > 1 THEN 1 ELSE 0 END)')} AS n_waveforms_in_both_splits,
       {share('sum(n - 1)', 'sum(n)', 3)} AS pct_duplicated
FROM g GROUP BY origin""",
)
def c05(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "source",
        F.col("lang").alias("label"),
        (F.col("n_chars") % 2).alias("split"),
        F.sha2("text", 256).alias("text_hash"),
    )
    return P.duplicate_report(rows, by=["source"], fingerprint_col="text_hash")


@query(
    "c05_duplicates_across_sources",
    f"""WITH g AS (
  SELECT text, count(*) AS n, count(DISTINCT lang) AS labels,
         count(DISTINCT source) AS splits FROM documents GROUP BY ALL)
SELECT {big('sum(n)')} AS n_beats, {big('count(*)')} AS n_unique_waveforms,
       {big('sum(n - 1)')} AS n_duplicated_beats,
       {big('sum(CASE WHEN labels > 1 THEN 1 ELSE 0 END)')} AS n_waveforms_with_conflicting_labels,
       {big('sum(CASE WHEN splits > 1 THEN 1 ELSE 0 END)')} AS n_waveforms_in_both_splits,
       {share('sum(n - 1)', 'sum(n)', 3)} AS pct_duplicated FROM g""",
)
def c05_across(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("label"), F.col("source").alias("split"), F.sha2("text", 256).alias("h")
    )
    return P.duplicate_report(rows, by=[], fingerprint_col="h")


def _padding_sql(feats: str, n: int, hz: str) -> str:
    return f"""WITH {feats},
last AS (SELECT f.*, l.x AS tail FROM feats f
  LEFT JOIN long l ON f.beat_id = l.beat_id AND l.slot = f.signal_length - 1)
SELECT source, label_name, {big('count(*)')} AS n_beats, min(signal_length) AS min_length,
       quantile_disc(signal_length, 0.5) AS median_length, max(signal_length) AS max_length,
       {r('avg(signal_length)', 1)} AS mean_length, {r(f'avg(signal_length) / {hz}', 4)} AS mean_duration_s,
       {share(f'sum(CASE WHEN signal_length = {n} THEN 1 ELSE 0 END)', 'count(*)', 2)} AS pct_unpadded,
       {share('sum(CASE WHEN tail < 0.01 THEN 1 ELSE 0 END)', 'count(*)', 2)} AS pct_ambiguous_tail
FROM last GROUP BY source, label_name"""


@query("c06_padding_report", _padding_sql(EVENT_FEATS, 31, EVENT_HZ))
def c06(spark, sf_dir):
    return P.padding_report(beats(spark, sf_dir), spec=SPEC)


@query("c06_padding_report_of_lines", _padding_sql(LINE_FEATS, 84, 'CAST(12 AS DOUBLE)'))
def c06_lines(spark, sf_dir):
    return P.padding_report(lines(spark, sf_dir), spec=LINE_SPEC)


def _summary_sql(feature: str) -> str:
    q = ", ".join(
        f"{r(f'quantile_disc(x, {p})', 4)} AS q{int(p * 100):02d}" for p in P.DEFAULT_QUANTILES
    )
    return f"""SELECT source, label_name, '{feature}' AS feature, {big('count(*)')} AS n,
  {r('avg(x)', 4)} AS mean, {r('stddev_samp(x)', 4)} AS std, {r('min(x)', 4)} AS min, {q},
  {r('max(x)', 4)} AS max
FROM (SELECT source, label_name, CAST({feature} AS DOUBLE) AS x FROM feats) GROUP BY source, label_name"""


SUMMARY = (
    f"{EVENT_FEATS},\nsummary AS ("
    + "\nUNION ALL ".join(_summary_sql(f) for f in FEATURE_COLUMNS)
    + ")"
)


@query("c07_feature_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def c07(spark, sf_dir):
    return P.feature_summary(beats(spark, sf_dir), spec=SPEC)


@query(
    "c07_summary_from_sketches",
    f"""WITH {SUMMARY}
SELECT source, label_name, feature, n, mean, min, max, true AS within FROM summary""",
)
def c07_sketches(spark, sf_dir):
    """Stored sketches of every split, merged; each quantile's rank is counted in the signals themselves."""
    by = ["source", "label_name"]
    signals = beats(spark, sf_dir)
    stored = materialise(S.profile_sketches(signals, [*by, "split"], spec=SPEC), "sketches")
    summary = materialise(S.sketch_summary(S.merged_sketches(stored, by), by, decimals=9), "summary")
    quantiles = F.array(*[F.struct(F.lit(q).alias("q"), F.col(P.quantile_name(q)).alias("v")) for q in P.DEFAULT_QUANTILES])
    wanted = summary.select(*by, "feature", F.inline(quantiles))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in FEATURE_COLUMNS])
    cells = add_descriptors(signals, spec=SPEC).select(*by, F.inline(pairs)).where("x is not null")
    # Five lines for each group and descriptor.
    x, v = F.col("x"), F.col("v")
    slack = F.abs(v) * 1e-9 + 1e-8
    places = cells.join(F.broadcast(wanted), [*by, "feature"]).groupBy(*by, "feature", "q").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(x < v - slack).alias("below"), F.count_if(x <= v + slack).alias("upto")
    )
    inside = (F.col("below") / F.col("rows") <= F.col("q") + S.RANK_ERROR) & (F.col("upto") / F.col("rows") >= F.col("q") - S.RANK_ERROR)
    kept = places.groupBy(*by, "feature").agg(F.min(inside).alias("within"))
    lines = summary.select(*by, "feature", "n", *[F.round(c, 4).alias(c) for c in ("mean", "min", "max")])
    return lines.join(kept, [*by, "feature"], "left").withColumn("within", F.coalesce("within", F.lit(True)))


_COLUMNS = [*FEATURE_COLUMNS, "label"]
_COMPLETE = (
    "complete AS (SELECT beat_id, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _COLUMNS)
    + " FROM feats WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _COLUMNS)
    + ")"
)


def _pairs_sql(source: str, digits: int | None = 3) -> str:
    """Every pair of columns from a long form, by one self-join on the row."""
    unpivot = " UNION ALL ".join(
        f"SELECT beat_id, '{c}' AS feature, {c} AS v FROM {source}" for c in _COLUMNS
    )
    return f"""tall AS ({unpivot}),
pairs AS (
  SELECT a.feature, b.feature AS other,
         CASE WHEN a.feature = b.feature THEN 1 WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN {r('corr(a.v, b.v)', digits) if digits else 'corr(a.v, b.v)'} END AS r
  FROM tall a JOIN tall b ON a.beat_id = b.beat_id GROUP BY a.feature, b.feature)"""


@query(
    "c08_feature_correlation",
    f"WITH {EVENT_FEATS},\n{_COMPLETE},\n{_pairs_sql('complete')} SELECT * FROM pairs",
)
def c08(spark, sf_dir):
    return P.feature_correlation(beats(spark, sf_dir), spec=SPEC)


_RANKED = (
    "ranked AS (SELECT beat_id, "
    + ", ".join(
        f"rank() OVER (ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2.0 AS {c}"
        for c in _COLUMNS
    )
    + " FROM complete)"
)


@query(
    "c08_rank_correlation",
    f"WITH {EVENT_FEATS},\n{_COMPLETE},\n{_RANKED},\n{_pairs_sql('ranked')} SELECT * FROM pairs",
)
def c08_rank(spark, sf_dir):
    described = add_descriptors(beats(spark, sf_dir), spec=SPEC)
    # Ranks see the last digit, which depends on the order of additions: cut it off.
    steady = described.withColumns(
        {c: F.round(F.col(c).cast("double"), 9) for c in FEATURE_COLUMNS}
    )
    return P.feature_correlation(steady, method="spearman", spec=SPEC)


def _profile_sql(where: str) -> str:
    q = ", ".join(f"{r(f'quantile_disc(x, {p})')} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"""points AS (SELECT l.label_name, l.slot, l.x FROM long l JOIN lengths k ON l.beat_id = k.beat_id
  WHERE {where}),
profile AS (
  SELECT label_name, CAST(slot AS INTEGER) AS t, {r(f'slot / {EVENT_HZ}')} AS time_s, {big('count(*)')} AS n,
         {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std, {q}
  FROM points GROUP BY label_name, slot)"""


@query(
    "c09_waveform_profile",
    f"""WITH {EVENT_FEATS},
{_profile_sql('l.slot < k.signal_length')},
best AS (SELECT label_name, max(n) AS top FROM profile GROUP BY label_name)
SELECT profile.* FROM profile JOIN best USING (label_name) WHERE n >= top * 0.05""",
)
def c09(spark, sf_dir):
    profile = P.waveform_profile(beats(spark, sf_dir), spec=SPEC)
    return rounded(profile, "time_s", "mean", "std", "q25", "q50", "q75")


@query(
    "c10_mean_waveform",
    f"""WITH {EVENT_LONG}
SELECT label_name, CAST(slot AS INTEGER) AS t, {r(f'slot / {EVENT_HZ}')} AS time_s, {r('avg(x)')} AS mean,
       {r('stddev_samp(x)')} AS std, {big('count(*)')} AS n FROM long GROUP BY label_name, slot""",
)
def c10(spark, sf_dir):
    return rounded(P.mean_waveform(beats(spark, sf_dir), spec=SPEC), "time_s", "mean", "std")


@query(
    "c11_sample_signals",
    f"""WITH {EVENT_FEATS},
picked AS (SELECT beat_id, label_name, signal_length, CAST(row_number() OVER (
    PARTITION BY label_name ORDER BY md5('42:' || beat_id), beat_id) AS INTEGER) AS rank FROM feats),
sums AS (SELECT beat_id, sum(x) AS s FROM long GROUP BY beat_id)
SELECT p.beat_id, label_name, signal_length, rank, {r('s')} AS sample_sum
FROM picked p JOIN sums USING (beat_id) WHERE rank <= 6""",
)
def c11(spark, sf_dir):
    picked = P.sample_signals(beats(spark, sf_dir), n_per_group=6, spec=SPEC)
    total = F.aggregate("signal", F.lit(0.0), lambda acc, x: acc + x)
    return picked.withColumn("sample_sum", F.round(total, 6)).drop("signal")


@query(
    "c12_length_histogram",
    f"""WITH {EVENT_FEATS},
bins AS (SELECT label_name, CAST(signal_length // 5 * 5 AS INTEGER) AS bin_start, count(*) AS n
  FROM feats GROUP BY ALL)
SELECT label_name, bin_start, CAST(bin_start + 5 AS INTEGER) AS bin_end, {big('n')} AS n_beats,
       {share('n', 'sum(n) OVER (PARTITION BY label_name)', 3)} AS pct FROM bins""",
)
def c12(spark, sf_dir):
    return P.length_histogram(beats(spark, sf_dir), bin_width=5, spec=SPEC)


_ORDER = " ".join(f"WHEN '{n}' THEN {c}" for c, n in EVENT_CLASSES.items())


@query(
    "c13_class_order",
    f"""WITH {EVENT_ROWS}
SELECT source, label_name, {big('count(*)')} AS n_beats,
       CAST(CASE label_name {_ORDER} END AS INTEGER) AS label_order FROM rows GROUP BY ALL""",
)
def c13(spark, sf_dir):
    present = beats(spark, sf_dir).groupBy("source", "label_name").agg(
        F.count(F.lit(1)).alias("n_beats")
    )
    return P.in_class_order(present, SPEC)


@query(
    "c14_collection_comparison",
    f"""WITH {EVENT_FEATS}
SELECT source, {big('count(*)')} AS n_beats, {big('count(DISTINCT label)')} AS n_classes,
       {r('avg(signal_length)', 1)} AS mean_length, {r(f'avg(signal_length) / {EVENT_HZ}', 3)} AS mean_duration_s,
       {r('avg(amp_mean)', 4)} AS mean_amplitude, {r('avg(mean_abs_diff)', 5)} AS mean_abs_diff
FROM feats GROUP BY source""",
)
def c14(spark, sf_dir):
    return P.collection_comparison(beats(spark, sf_dir), SPEC)


@query(
    "c15_label_correlation",
    f"""WITH {EVENT_FEATS},\n{_COMPLETE},\n{_pairs_sql('complete', None)}
SELECT feature, {r('r', 3)} AS r_with_label FROM pairs WHERE other = 'label' AND feature <> 'label'
ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 8""",
)
def c15(spark, sf_dir):
    return P.label_correlation(P.feature_correlation(beats(spark, sf_dir), spec=SPEC, decimals=None), 8)


@query(
    "c16_split_comparison",
    f"""WITH {DISTRIBUTION},
wide AS (SELECT source, label_name, max(CASE WHEN split = 'train' THEN pct END) AS train,
           max(CASE WHEN split = 'test' THEN pct END) AS test FROM dist GROUP BY ALL)
SELECT *, {r('coalesce(test, 0) - coalesce(train, 0)', 3)} AS difference FROM wide""",
)
def c16(spark, sf_dir):
    return P.split_comparison(P.class_distribution(beats(spark, sf_dir), spec=None))


@query(
    "c17_class_totals",
    f"""WITH {EVENT_ROWS},
g AS (SELECT source, label_name, count(*) AS n FROM rows GROUP BY ALL)
SELECT source, label_name, {big('n')} AS n_beats,
       {share('n', 'sum(n) OVER (PARTITION BY source)', 3)} AS pct FROM g""",
)
def c17(spark, sf_dir):
    return P.class_totals(P.class_distribution(beats(spark, sf_dir), spec=None))


@query(
    "c18_feature_boxes",
    f"""WITH {SUMMARY}
SELECT source, label_name, feature, q05 AS whisker_low, q25 AS q1, q50 AS median, q75 AS q3,
       q95 AS whisker_high FROM summary WHERE feature IN ('amp_mean', 'amp_std', 'mean_abs_diff')""",
)
def c18(spark, sf_dir):
    summary = P.feature_summary(beats(spark, sf_dir), spec=SPEC)
    return P.feature_boxes(summary, ["amp_mean", "amp_std", "mean_abs_diff"])
