"""The pipeline against plain versions of its stages."""

import corpus_pipeline
from corpus_rows import ODD_ROWS
from pyspark.sql import functions as F
from test_duplicates import without_repeats
from test_similar import brute_groups

import __spark_entry__
from signalloom.llm.queries import QUERIES
from signalloom.llm.tables import settle


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert {*QUERIES, "pipeline"} <= set(names)


def test_stages_on_a_whole_table(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = {r.doc_id: r.kept for r in QUERIES["op2_quality_rules"](spark, folder).collect()}
    one = settle(corpus_pipeline.quality_rules(spark, docs, folder), "one")
    assert one.columns == docs.columns and one.schema == docs.schema
    kept = one.toPandas()
    assert set(kept.doc_id) == {k for k, good in verdicts.items() if good}
    assert kept.sort_values("doc_id").text.tolist() == documents[documents.doc_id.isin(kept.doc_id)].sort_values("doc_id").text.tolist()

    two = settle(corpus_pipeline.toxic_texts(spark, one, folder), "two")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    gone = one.join(two.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
    assert two.columns == docs.columns
    assert gone.where("toxic = 0").count() <= 1

    three = settle(corpus_pipeline.near_duplicates(spark, two, folder), "three")
    rows = two.toPandas()
    first = {}
    for key, root in zip(rows.doc_id, brute_groups(rows.text.tolist())):
        first[root] = min(first.get(root, key), key)
    assert sorted(three.toPandas().doc_id) == sorted(first.values())

    four = settle(corpus_pipeline.repeated_passages(spark, three, folder), "four").toPandas()
    rows = three.toPandas()
    want = {k: kept.decode("utf-8", "ignore") for k, _, _, _, _, kept in without_repeats(list(zip(rows.doc_id, rows.text)))}
    assert dict(zip(four.doc_id, four.text)) == want
    assert all(n == len(t) for n, t in zip(four.n_chars, four.text))


def test_stages_with_odd_rows(spark, odd, empty, folder, tmp_path):
    extra = odd.withColumn("kept", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    for docs in (extra, empty.withColumn("kept", F.lit(1)).withColumn("fingerprint", F.lit("x"))):
        for name, stage in corpus_pipeline.STAGES:
            out = settle(stage(spark, docs, folder), name)
            assert name == "best_fit_packing" or out.columns == docs.columns, name
            assert out.count() <= docs.count() or name == "best_fit_packing"
    once = corpus_pipeline.near_duplicates(spark, odd, folder).collect()
    texts = [t or "" for _, t in ODD_ROWS]
    assert len(once) == len(set(brute_groups(texts)))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sizes.where("n > 2048").count() == 0 and sizes.count() > 0
