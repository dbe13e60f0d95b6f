"""The corpus pipeline: every stage against brute force over what the stage before it kept."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from test_packing import check
from test_secret_spans import brute as secret_spans
from test_simhash import brute_roots
from touchline.llm.simhash import fingerprint
from touchline.llm.toxicity import THRESHOLD, score, train


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage, each written and read again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, seen[-1], sf).write.parquet(path)
        seen.append(spark.read.parquet(path))
    return seen


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes


def test_toxic_rows_go(spark, sf, stages):
    docs = stages[0]
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = score(docs, model, keep={c: docs[c] for c in docs.columns})
    assert rows(stages[1]) == rows(scores.where(scores.score < THRESHOLD).drop("score"))
    assert stages[1].count() > 0.8 * docs.count()


def test_one_of_each_group_of_copies_stays(stages):
    groups = {}
    for r in stages[1].collect():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r.text or ""), []).append(r)
    assert rows(stages[2]) == sorted((tuple(min(g, key=lambda r: (-len(r.text or ""), r.doc_id))) for g in groups.values()), key=repr)


def test_one_of_each_group_of_near_copies_stays(stages):
    before = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    roots = brute_roots(np.array([fingerprint(r.text or "") for r in before], np.uint64))
    assert rows(stages[3]) == sorted((tuple(r) for i, r in enumerate(before) if roots[i] == i), key=repr)


def test_secrets_are_masked_and_clean_rows_are_as_they_were(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in before.items():
        text, at, want = r.text, 0, ""
        for a, _, b in secret_spans(text)[1]:
            if b > at:
                want += text[at:a] + cp.MARK if a >= at else ""
                at = b
        want = want + text[at:]
        assert after[i].text == want and after[i].n_chars == (r.n_chars if want == text else len(want))
        assert not secret_spans(after[i].text)[0]


def test_every_document_left_is_packed(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[4].collect()}
    total = sum(r.length for r in packed)
    assert check(packed, 4096) <= -(-total // 4096) + 2


def test_run_applies_all_stages(spark, sf, stages):
    got = entry.queries()["pipeline"](spark, sf)
    want = stages[5]
    assert got.columns == want.columns
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in want.collect())


def test_an_empty_table_passes_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_null_and_repeated_rows_pass_through(spark, sf, frame, tmp_path):
    docs = frame([(1, None), (None, "text of its own here"), (2, ""), (2, ""), (3, "password=abcdefgh1 and words"), (3, "password=abcdefgh1 and words")])
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i == 3:
            assert {r.doc_id: r.text for r in docs.collect()}[3] == f"{cp.MARK} and words"
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 3]
