"""Toxicity: held-out accuracy, what scores may depend on, and edge cases."""

import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from touchline.llm import toxicity as tox
from touchline.llm.toxicity import Settings, drop_toxic, score, toxicity_report, train, windows

BAD = ["vilegit", "snorkwit", "grublout", "dunderclod"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Made-up prose of which a seventh holds bad words."""
    rng = random.Random(0)
    stems = ["th", "on", "er", "ing", "at", "re", "ble", "and", "st", "ou"]
    lexicon = ["".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(900)]
    docs, labels = [], []
    for i in range(1200):
        words = rng.choices(lexicon, k=rng.randint(30, 200))
        bad = i % 7 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = toxicity_report(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 3 == 1}
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.02
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()


def test_held_out_labels_are_never_learnt(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(tox.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(docs, labels) == train(docs, flipped)


def test_scores_depend_on_the_text_alone(labelled, frame):
    docs, labels = labelled
    model = train(docs, labels)
    clean = "on the and st " * 30
    rows = [(1, clean), (2, f"{clean} vilegit snorkwit {clean}"), (3, ""), (4, None), (None, clean), (1, clean), (5, clean * 900 + "grublout dunderclod")]
    docs = frame(rows)
    got = score(docs, model, keep={"doc_id": docs.doc_id, "spans": docs.spans}).collect()
    by = {r.doc_id: r.score for r in got}
    assert by[2] > 0.7 and by[5] > 0.7 and by[1] < 0.3 and by[3] == by[4] < 0.3
    assert len({r.score for r in got if r.doc_id in (1, None)}) == 1 and len(got) == len(rows)
    assert drop_toxic(labelled[0], labels).columns == ["doc_id", "text"]


def test_without_both_classes(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity_report(frame([(1, "x"), (None, None)]), none).collect()] == [0.0, 0.0]
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 0), (2, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity_report(frame([(1, "x"), (2, None), (9, "y"), (4, "z")]), odd).collect()
    assert {(r.score, r.predicted) for r in out} == {(0.0, 0)}
    assert toxicity_report(frame([]), none).count() == 0


def test_windows_cover_the_whole_text():
    text = " ".join(f"w{i}" for i in range(1001))
    assert b"".join(windows(text, 12)).split() == text.encode().split()
    assert windows("", 12) == [b"  "] and len(windows("x" * 100_000, 12)) == 1
    assert tox._train([b"ab", b"cd"], 100) == b"abcd"
    assert Settings().row_bytes and tox._without_copies(["some text " * 30, "some text " * 30, "other words " * 30]) != []


def test_scores_equal_a_plain_version(labelled, frame):
    """Every window compressed with either dictionary by fresh compressors, savings added up by hand."""
    docs, labels = labelled
    model = train(docs, labels)

    def size(window, content):
        settings = zstandard.ZstdCompressionParameters.from_level(
            6, source_size=128, dict_size=len(content), min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(window))

    texts = [r.text for r in docs.where("doc_id < 25").collect()] + ["", "on the", "VILEGIT, grublout!"]
    got = {r.doc_id: r.score for r in score(frame(list(enumerate(texts))), model, keep={"doc_id": F.col("doc_id")}).collect()}
    for i, text in enumerate(texts):
        words, savings = text.lower().split(), []
        for at in range(0, max(1, len(words)), model.settings.window_words):
            window = f" {' '.join(words[at:at + model.settings.window_words])} ".encode() + model.ordinary[-model.settings.tail_bytes:]
            savings.append(max(0, size(window, model.ordinary) - size(window, model.toxic + model.ordinary)))
        z = model.weights[0] + model.weights[1] * min(max(savings), 12) + model.weights[2] * math.log1p(sum(savings))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-12), i
