"""Byte-level BPE against the public library, round trips, appends and edits."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from touchline.llm import byte_bpe
from touchline.llm.byte_bpe import Codec, PrefixTable, Vocabulary, decode_documents, encode_documents

FILE = path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(FILE)


def noise(rng, n):
    return "".join(rng.choice(["the", " ", "ing", "é", "日本", "\n\n", "!!", "a", "'s", "12", "😀", "́", "\x1c", "\xa0", " x"]) for _ in range(n))


def test_equals_the_library(library):
    codec, rng = Codec(FILE, PATTERN), random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000 + "x", " \x85\x1f", *(noise(rng, 200) for _ in range(200))]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_each_prefix_has_the_last_token_of_its_own_encoding(library, vocabulary):
    data = "Thonening überraschungsgefühle naïveté xyzzy".replace(" ", "").encode()
    table = PrefixTable(vocabulary, data)
    for i in range(1, len(data) + 1):
        assert table.last[i - 1] == library._core_bpe.encode_single_piece(data[:i])[-1]


def test_appends_and_edits_equal_a_new_table(vocabulary):
    rng = random.Random(2)
    letters = [w.encode() for w in ("th", "in", "ing", "er", "é", "x", "ation", "ß", "on")]
    table, data = PrefixTable(vocabulary), b""
    for _ in range(60):
        more = b"".join(rng.choices(letters, k=rng.randint(0, 6)))
        table.append(more)
        data += more
    assert table.tokens() == PrefixTable(vocabulary, data).tokens()
    for _ in range(60):
        start = rng.randint(0, len(data))
        end = rng.randint(start, min(len(data), start + 8))
        new = b"".join(rng.choices(letters, k=rng.randint(0, 3)))
        data = data[:start] + new + data[end:]
        table.edit(start, end, new)
        fresh = PrefixTable(vocabulary, data)
        assert table.data == data and table.last == fresh.last


def test_edit_stops_where_nothing_changes(vocabulary):
    looked = []

    class Counting(PrefixTable):
        def _grow(self, data, last):
            for i in super()._grow(data, last):
                looked.append(i)
                yield i

    table = Counting(vocabulary, b"thing" * 2000)
    looked.clear()
    table.edit(10, 11, b"X")
    assert len(looked) < 200 and table.last == PrefixTable(vocabulary, table.data).last


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        PrefixTable(Vocabulary({b"a": 0}), b"ab")


def test_words_kept_are_bounded(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(byte_bpe, "PAIRS_KEPT", 5)
    codec = Codec(FILE, PATTERN)
    text = " ".join(f"thoneing{i} errand{i}" for i in range(50))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text) and len(codec.words) <= 5


def test_whole_table_round_trip(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = encode_documents(docs, FILE, PATTERN, {"doc_id": docs.doc_id}, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    back = decode_documents(out, FILE, "ids", {"doc_id": out.doc_id})
    texts = docs.toPandas().set_index("doc_id").text
    for r in out.collect():
        want = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids)) == (len(want) // 4, want) and r.ids_sha256 == hashlib.sha256(want).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == texts.to_dict()


def test_edge_cases(frame, library):
    docs = frame([(1, None), (None, ""), (2, "same"), (2, "same"), (3, "word " * 40_000)])
    got = encode_documents(docs, FILE, PATTERN, {"doc_id": docs.doc_id, "spans": docs.spans},
                           outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    same, long = (len(library.encode_ordinary(t)) for t in ("same", "word " * 40_000))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 0), (2, same), (2, same), (3, long)]
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in got if not r.n_tokens) and {r.spans for r in got} == {"y"}
    none = frame([])
    assert encode_documents(none, FILE, PATTERN, {"doc_id": none.doc_id}).count() == 0
