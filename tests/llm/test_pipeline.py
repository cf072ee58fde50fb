"""The pipeline on the smallest tables: each stage against what it must keep."""

import corpus_pipeline
from notegraph.llm import dedup, quality, simhash
from notegraph.llm.common import cut, labels


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, cut(stage(spark, docs, sf), name)
        seen.append(docs)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "quality":
            want = {r.doc_id for r in quality.verdicts(before, labels(spark, sf)).where("kept").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want
        if name == "exact_dedup":
            want = {r.doc_id for r in dedup.exact_groups(before).where("kept").collect()}
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want)
        if name == "near_dedup":
            want = {r.component_id for r in simhash.similar_groups(before).collect()}
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want)
        if name == "mix":
            n = docs.groupBy("doc_id").count().collect()
            assert {r[1] for r in n} <= {1, 2} and {r.doc_id for r in n} <= {r.doc_id for r in before.select("doc_id").collect()}
            assert docs.count() > before.count()
    packed = seen[-1].groupBy("sequence_id").sum("length").collect()
    assert all(r[1] == 1024 or r[1] & (r[1] - 1) == 0 for r in packed)
    assert seen[-1].groupBy().sum("length").first()[0] > 0


def test_registered_with_all_stages(spark, sf):
    import __spark_entry__ as e

    names = e.queries()
    assert {"pipeline"} <= set(names) and len([n for n in names if n.startswith("op") and n[2].isdigit()]) == 13
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
