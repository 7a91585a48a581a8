"""The pipeline: stages in order, each on all that the one before kept."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    sizes, now, ids = [docs.count()], docs, None
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, before, SF).cache()
        sizes.append(now.count())
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        if name in ("toxicity", "near_duplicates"):
            assert now.join(before, "doc_id", "left_anti").count() == 0
        if name == "repeated_passages":
            ids = {r[0] for r in now.select("doc_id").collect()}
            assert now.count() == before.count() and now.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0]
        if name == "source_mix":
            assert {r[0] for r in now.select("doc_id").collect()} <= ids and now.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert {"doc_id", "piece", "sequence_id", "offset", "length", "ids_crc32"} <= set(out.columns)
    assert np.issubdtype(out["ids_crc32"].dtype, np.integer) and zlib.crc32(b"") == 0 and len(out)
