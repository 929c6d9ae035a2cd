import zlib

import pytest

import corpus_pipeline as P
from tamis.llm import decontaminate, token_store
from tamis.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_are_those_asked_for():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]


def test_each_stage_filters_and_keeps_columns(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == stages[0].columns
        assert 0 < after.count() <= before.count() and after.exceptAll(before).isEmpty()


def test_no_contamination_is_left(spark, stages):
    found = decontaminate.find_contamination(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert found.filter(decontaminate.contaminated()).isEmpty()


def test_tokens_stand_for_the_last_documents(stages):
    encoder = token_store.ChunkEncoder(token_store.public_file(P.TOKENIZER), P.END_ID)
    at = 0
    found = {r.doc_id: r for r in stages[5].collect()}
    for r in stages[4].orderBy("doc_id").collect():
        ids = encoder.encode([r.text])[0]
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert len(found) == stages[4].count()
