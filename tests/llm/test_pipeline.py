"""The pipeline stage by stage: columns, what goes and what stays."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prioscope.llm import mixing, packing, queries


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"]


def test_stages_keep_columns_and_pass_on_what_they_kept(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.dtypes == first.dtypes
            assert out.select("doc_id").distinct().count() == out.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            seen.append(out.count())
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out
    assert seen[0] > seen[1] >= seen[2] >= seen[3] == seen[4]
    assert seen[1] == seen[2]  # lines go, documents stay


def test_run_gives_the_packed_documents(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [c for c, _ in found.dtypes] == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    tokens = found.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tokens.filter("n > 4096 or (n < 4096 and n & (n - 1) != 0)").count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_an_empty_table(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("false")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == 0 and out.columns == docs.columns


def test_sequences_follow_the_schedule_after_files_of_unequal_size(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices("abcdefgh ", k=9_000 if k < 1500 else 30)), "hot" if k < 1500 else f"s{k % 3}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        corpus_pipeline.mixed(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
        stored = spark.read.parquet(f"{tmp_path}/mixed")
        place = {r.doc_id: r.position for r in mixing.mixed(docs).collect()}
        read = [place[r.doc_id] for r in stored.collect()]
        assert read != sorted(read)  # the scan does not keep the order
        tasks: dict[int, list[int]] = {}
        for r in corpus_pipeline.packed(spark, stored, "").collect():
            tasks.setdefault(r.sequence_id >> 33, []).append(place[r.doc_id])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    spans = [(min(v), max(v)) for _, v in sorted(tasks.items())]
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
