"""The pipeline's stages and the queries with SQL, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import common, decontaminate, minhash, mixing, quality
from quillmark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_stages(spark, tmp_path):
    extras = ("size", "leaks", "copies", "target", "rate", "__row", "__leaks", "__copies", "__k", "row", "score", "class_id", "shard_id", "x")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in extras})
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("source", F.lit(None).cast("string")))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        own = [c for c in extras if name != "shards" or c != "shard_id"]
        if name != "shards":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.select([F.bool_and(F.col(c) == F.concat(F.lit(c), F.col("doc_id"))).alias(c) for c in own]).first().asDict() == dict.fromkeys(own, True)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    before, after = seen["quality_filter"]
    scored = quality.score_quality(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert ids(after) == ids(scored.where("predicted = 1"))
    before, after = seen["near_dedup"]
    assert ids(after) == sorted({r[0] for r in minhash.near_duplicates(before).where("kept").select("doc_id").collect()})
    before, after = seen["decontamination"]
    leaks = decontaminate.find_leaks(before, spark.read.parquet(f"{DIR}/benchmark.parquet"))
    assert ids(after) == ids(leaks.where("size(leaks) = 0"))
    before, after = seen["mixture"]
    assert after.count() == mixing.mix_sources(before).agg(F.sum("copies")).first()[0]
    before, after = seen["shards"]
    assert ids(after) == ids(before) and after.where("NOT oversized AND shard_bytes > 1048576").count() == 0


def test_decisions_by_row(spark, monkeypatch):
    text = {k: " ".join(f"{k}{i * i % 97}" for i in range(60)) for k in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["a"] + " more"), (None, text["b"] + " more"), (None, text["c"]), (None, text["c"]), (3, text["d"]), (3, text["d"]), (4, None), (4, " "), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, f"r{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, mark string")
    got = sorted((r["doc_id"] or 0, (r["text"] or " ").split(" ")[0][:1]) for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect())
    assert got == [(0, ""), (0, ""), (0, "c"), (1, "a"), (1, "b"), (3, "d"), (4, "")]

    def judged(docs, labels, carry=()):
        return docs.select("doc_id", *carry, F.coalesce(F.col("text").startswith("b"), F.lit(False)).alias("bad")).withColumn("predicted", F.when(F.col("bad"), 0).otherwise(1))

    monkeypatch.setattr(quality, "score_quality", judged)
    assert sorted(r["mark"] for r in corpus_pipeline.quality_filter(spark, docs, DIR).collect()) == sorted(f"r{n}" for n in range(len(rows)) if n not in (1, 3))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _spark, real=common.shared_dir: (real(_spark), str(tmp_path))[1])
    before = common.made()
    out = corpus_pipeline.run(spark, DIR)
    left = sorted(p.name for p in tmp_path.glob("quillmark-*"))
    inputs = {f.split("/")[-2] for f in out.inputFiles()}
    assert set(left) == {i for i in inputs if i.startswith("quillmark-")} and 1 <= len(left) <= 2, left
    assert out.count() > 0 and common.made() - before == len(left)
