"""The pipeline beside its stages one after the other; their operators have plain loops or SQL of their own."""

from collections import Counter

import corpus_pipeline
from tests.llm.data import documents, table, with_extras
from vicinal.llm import decontam, jaccard, mixing, quality, shards


def test_stages_keep_the_columns_and_pass_rows_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == first.columns
        assert 0 < kept.count() <= docs.count()
        docs = kept.persist()
    ids = [r.doc_id for r in docs.collect()]
    assert len(set(ids)) == len(ids)
    groups = {r.doc_id: r.class_id for r in jaccard.join_report(quality.quality_filter(first)).collect()}
    assert all(groups[i] == i for i in ids)
    assert decontam.leak_report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0


def test_run_is_the_stages_in_order(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = decontam.decontaminate(jaccard.keep_one(quality.quality_filter(docs)), bench)
    copies = Counter(r.doc_id for r in mixing.mix(kept).collect())
    assert Counter(r.doc_id for r in found) == copies
    shard = {r.doc_id: r.shard for r in shards.assign(docs).collect()}
    assert all(r.shard == shard[r.doc_id] for r in found)
    assert set(found[0].asDict()) == {*docs.columns, "shard"}


def test_awkward_and_empty_tables(spark, sf_dir):
    docs = with_extras(table(spark, documents()).drop("n_chars")).drop("shard")
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        twice, once = (Counter(r.doc_id for r in df.collect()) for df in (stage(spark, docs.unionAll(docs), sf_dir), kept))
        if name == "near duplicates":
            assert twice == once
        elif name != "source mix":  # whose copies follow from the targets
            assert twice == {d: 2 * n for d, n in once.items()}
        else:
            assert set(twice) <= {r[0] for r in documents()}
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == len(documents())
