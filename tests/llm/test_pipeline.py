"""Every stage against a brute-force version on a small fixture, and the whole on given tables."""

import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from gleanery.llm import common, toxicity
from gleanery.llm.common import table
from tests.llm.test_repeats import brute_bytes
from tests.llm.test_simhash import brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, results = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        results.append(docs)
    return results


def test_columns(spark, stages):
    documents = table(spark, SF, "documents")
    assert all(s.dtypes == documents.dtypes for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]


def test_rejected_documents_are_those_above_the_threshold(spark, stages):
    scores = toxicity.report(spark, SF).collect()
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r in scores if not r.predicted}


def test_one_document_per_near_duplicate_group(stages):
    prints = {r.doc_id: brute_print(r.text) for r in stages[0].collect()}
    kept, groups = {r.doc_id for r in stages[1].collect()}, []
    for i in sorted(prints):
        near = [g for g in groups if any((prints[i] ^ prints[j]).bit_count() <= 2 for j in g)]
        groups = [g for g in groups if g not in near] + [[i, *(j for g in near for j in g)]]
    assert kept == {min(g) for g in groups}


def test_substrings_mix_and_tokens(stages):
    before, after = stages[1].collect(), {r.doc_id: r for r in stages[2].collect()}
    removed = {r[0]: r[2] for r in brute_bytes([(r.doc_id, r.text) for r in before], 50)}
    assert len(after) == len(before)
    for r in before:
        cut = len(r.text.encode()) - len(after[r.doc_id].text.encode())
        assert removed[r.doc_id] <= cut <= removed[r.doc_id] + 12 and after[r.doc_id].n_chars == len(after[r.doc_id].text)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in after.items()}
    drawn = [r.doc_id for r in stages[3].collect()]
    assert max(map(drawn.count, set(drawn))) <= 2
    assert abs(sum(words[i] for i in drawn) - 1.5 * sum(words.values())) <= 0.02 * sum(words.values())
    assert sorted(drawn) == sorted(r.doc_id for r in stages[4].collect())


def test_run_gives_what_the_stages_give(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, found.collect())) == sorted(map(str, stages[-1].collect()))


def test_large_shards_are_stored_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "ROW_GROUP_BYTES", 1 << 18)
    text = "array_join(transform(sequence(1, 80), i -> hex(xxhash64(id, i))), ' ')"
    docs = spark.range(4000).selectExpr("id as doc_id", f"{text} as text", "'x' as lang", "'s' as source", "1 as n_chars")
    try:
        for name, stage in corpus_pipeline.STAGES[3:]:
            path, before = tmp_path / name, docs
            stage(spark, docs, SF).write.parquet(str(path))
            docs = spark.read.parquet(str(path))
            files = [pq.ParquetFile(p).metadata for p in path.glob("*.parquet")]
            groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
            sizes = [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups]
            assert sum(sizes) > 4 * common.ROW_GROUP_BYTES and max(sizes) <= 2 * common.ROW_GROUP_BYTES
        assert docs.count() == before.count() > 4000
    finally:
        spark.conf.unset("parquet.block.size")
