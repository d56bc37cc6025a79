"""The pipeline's stages, each against what it must have done to its own input."""

import re

import corpus_pipeline
import pytest
from test_pii import plain as base_spans
from test_simhash import classes
from test_simhash import plain as simhash_of

from tabulon.llm import packing, tokens


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, docs, out = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "simhash near-dedup", "pii", "mixing", "packing"]
    columns = stages[0][1].columns
    assert all(after.columns == columns for _, _, after in stages[:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    clean = [k for k, y in labels.items() if not y]
    assert kept <= {r.doc_id for r in before.collect()} and sum(k in kept for k in clean) >= 0.97 * len(clean)


def test_dedup_keeps_one_of_each_group(stages):
    _, before, after = stages[1]
    want = classes([(r.doc_id, simhash_of(r.text)) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want.values()))


def test_pii_is_masked(stages):
    _, before, after = stages[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        spans = [(a, b) for _, a, b in base_spans(texts[r.doc_id])]
        assert all(texts[r.doc_id][a:b] not in r.text for a, b in spans) and r.n_chars == len(r.text)
        assert spans or r.text == texts[r.doc_id] or "[" in r.text


def test_mix_draws_whole_or_cut_documents(stages):
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    words = lambda t: re.findall(r"[^ \t-\r]+", t)
    seen = {}
    for r in after.collect():
        seen.setdefault(r.doc_id, []).append(r.text)
        assert r.text == texts[r.doc_id] or words(texts[r.doc_id])[: len(words(r.text))] == words(r.text)
    assert max(map(len, seen.values())) == 2
    total = sum(len(words(t)) for v in seen.values() for t in v)
    assert abs(total - 1.5 * sum(len(words(t)) for t in texts.values())) < 30


def test_packing_holds_every_id(stages):
    _, before, after = stages[4]
    e = tokens.encoder()
    want = sum(len(e.whole(r.text)) + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r.length for r in rows) == want
    assert want / (packing.WINDOW * len({r.sequence_id for r in rows})) > 0.97


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got.collect()) == key(stages[4][2].collect())
