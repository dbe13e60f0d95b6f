"""Columns whose names have dots, look like the library's own or like its results change nothing."""

import pytest
from public_tokenizers import path

import corpus_pipeline
from touchline.llm.exact_dedup import drop_exact_copies, exact_dedup
from touchline.llm.licenses import license_report
from touchline.llm.packing import pack_documents
from touchline.llm.secret_spans import redact
from touchline.llm.sharding import shard_documents, write_shards
from touchline.llm.simhash import drop_near_copies, simhash_report
from touchline.llm.suffix_dedup import remove_repeats
from touchline.llm.toxicity import drop_toxic

NAMES = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, _row long, _touchline_row int, shard int, slot int, kept string, _score double, _c0 int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six", "one two three four five six", "secret=abcdefgh12", None, ""]
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, 5, 6, "k", 0.5, 7) for i, t in enumerate(texts)], NAMES)


def test_rows_keep_their_columns(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for out in (drop_exact_copies(docs), drop_near_copies(docs), redact(docs), drop_toxic(docs, labels)):
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {(2, 3, 4, 5, 6, "k", 0.5, 7)}
    assert drop_exact_copies(docs).count() == 3


def test_reports_ignore_them(docs):
    for report in (exact_dedup, simhash_report, shard_documents, remove_repeats, license_report):
        assert report(docs).columns and report(docs).count() in (0, 5)
    assert pack_documents(docs, path("word_bpe_49k.json")).count() == 5


def test_shards_are_written_under_free_names(spark, docs, tmp_path):
    folder = str(tmp_path / "shards")
    write_shards(docs, "doc_id", 3, folder)
    back = spark.read.parquet(folder)
    assert set(back.columns) == {*docs.columns, "_shard", "_slot"} and back.count() == 5


def test_pipeline_stages_take_them(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
