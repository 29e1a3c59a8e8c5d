"""Each stage of the pipeline against a plain version, on what the stage before kept."""

import corpus_pipeline
import pytest

from tests.llm import plain
from tidemark.llm import packing, pii, quality
from tidemark.session import materialize

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF), f"test-{name.replace(' ', '-')}"))
    return found


def test_stages_keep_columns(results):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "personal data", "packing"]
    for frame in results[1:-1]:
        assert frame.dtypes == results[0].dtypes


def test_quality_stage(spark, results):
    model = quality.train(results[0], spark.read.parquet(f"{SF}/labels.parquet"))
    expected = [tuple(r) for r in results[0].collect() if quality.score_text(model, r.text or "") >= quality.THRESHOLD]
    assert rows_of(results[1]) == sorted(expected, key=str) and 0 < len(expected) < results[0].count()


def test_exact_stage(results):
    last = {}
    for r in results[1].collect():
        if r.text not in last or r.doc_id > last[r.text].doc_id:
            last[r.text] = r
    assert rows_of(results[2]) == sorted(map(tuple, last.values()), key=str)


def test_near_stage(results):
    rows = results[2].collect()
    best, sizes = plain.components([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    expected = [tuple(r) for i, r in enumerate(rows) if best[i] == i or not sizes[i]]
    assert rows_of(results[3]) == sorted(expected, key=str) and len(expected) < len(rows)


def test_personal_data_stage(results):
    before, after = ({r.doc_id: r for r in f.collect()} for f in (results[3], results[4]))
    assert set(before) == set(after)
    tagger = pii.train(pii.sample_texts(results[3]))
    for d, r in before.items():
        base = pii.base_spans(r.text)
        assert after[d].text == pii.redact_text(r.text, pii.all_spans(base, pii.tag_texts(tagger, [r.text])[0]))
        assert after[d].n_chars == len(after[d].text)
        assert not any(r.text[a:b] in after[d].text for k, a, b in base if k == "email")


def test_packing_stage(results):
    tok = plain.tokenizer("byte_bpe_50k.json")
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in results[4].collect())
    pieces = results[5].collect()
    assert sum(r.length for r in pieces) == total and {r.doc_id for r in pieces} == {r.doc_id for r in results[4].collect()}
    assert results[5].columns == packing.OUT.names


def test_stages_take_odd_rows(spark, made, nothing):
    """Nulls, repeated rows and clashing names go through; an empty table stays empty."""
    for frame, some in ((made, True), (nothing, False)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            found = stage(spark, frame, SF)
            assert (found.count() > 0) == some
