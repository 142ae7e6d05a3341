import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from healthloom.llm import digest_index, entry, mixing, quality

from test_nearcopies import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(stages[name][1].columns == columns for name in list(stages)[:-1])


def test_each_stage_keeps_what_its_operator_says(spark, stages):
    before, after = stages["quality"]
    judged = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged.filter("keep").collect()}
    before, after = stages["exact_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.id for r in digest_index.DigestIndex(before).groups().filter("kept").collect()}
    before, after = stages["near_dedup"]
    kept = brute_groups([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(kept.values()))
    before, after = stages["mix"]
    want = mixing.mix(before).agg(F.sum("taken")).first()[0]
    assert after.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    before, after = stages["pack"]
    assert after.filter("piece = 0").count() == before.count()


def test_run_and_registration(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["empty", "repeated"])
def test_odd_tables(spark, name, request, tmp_path):
    """Nulls, repeated rows and clashing columns, and no rows at all, go through all stages."""
    table = request.getfixturevalue(name)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for stage, run in corpus_pipeline.STAGES:
        path = str(tmp_path / stage)
        run(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs.columns, spark.read.parquet(path)
        assert stage == "pack" or docs.columns == before
        counts[stage] = docs.count()
    if name == "empty":
        assert set(counts.values()) == {0}
    else:
        assert (counts["quality"], counts["exact_dedup"], counts["near_dedup"]) == (7, 3, 3)
        assert counts["mix"] == counts["pack"] > 0
