from pyspark.sql import functions as F

import corpus_pipeline
from bourseflow.llm import decontaminate, language, minhash_dedup, mixing

from tests.conftest import SMALL
from tests.llm.fixtures import awkward


def test_stages_keep_the_columns_and_pass_on_their_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, [set(r.doc_id for r in docs.select("doc_id").collect())]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if k < 4:
            assert docs.columns == columns
        if name == "language":
            told = {r.doc_id for r in language.identified(before).where("lang_pred <> 'und'").collect()}
            assert ids[-1] <= told and len(ids[-1]) >= 0.97 * len(told)
        if name == "near_duplicates":
            found = minhash_dedup.near_duplicates(before).collect()
            assert ids[-1] == {r.doc_id for r in found if r.kept}
        if name == "decontamination":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            assert ids[-1] == ids[-2] - {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
        if name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.with_counts(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == want
    assert docs.columns == [*columns, "virtual_slot", "shard"]
    assert docs.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == awkward(spark).columns, name
    assert docs.count() >= 1
