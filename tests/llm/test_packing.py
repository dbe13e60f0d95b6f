"""Packing: ids of the public library, nothing lost, few sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from touchline.llm import packing
from touchline.llm.packing import best_fit, complete_bins, fillings, pack, pack_documents

FILE = path("word_bpe_49k.json")


def optimum(lengths, capacity):
    """Fewest bins by trying all partitions."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best


def test_fillings_are_undominated_and_complete():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(1, 12) for _ in range(7))
        sizes, room = sorted(counts, reverse=True), rng.randint(1, 25)
        got = list(filter(None, fillings(sizes, counts, room, 10_000)))
        assert sorted(filter(None, fillings(sizes, counts, room, 3))) == sorted(got)  # batches leave nothing out
        every = set()

        def extend(chosen, i):
            every.add(tuple(sorted(chosen, reverse=True)))
            for j in range(i, len(sizes)):
                if chosen.count(sizes[j]) < counts[sizes[j]] and sum(chosen) + sizes[j] <= room:
                    extend([*chosen, sizes[j]], j)

        extend([], 0)
        assert min(room - sum(c) for c in every) == min(got)[0]
        assert all(w == room - sum(c) and tuple(c) in every for w, c in got)


def test_small_cases_reach_the_optimum():
    rng = random.Random(3)
    better = 0
    for _ in range(40):
        lengths = sorted((rng.randint(15, 60) for _ in range(9)), reverse=True)
        bins = complete_bins(lengths, 100)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 100
        assert len(bins) == optimum(lengths, 100)
        better += len(bins) < len(best_fit(lengths, 100))
    hard = [random.Random(i).randint(20, 60) for i in range(30)]
    assert len(complete_bins(hard, 100)) <= len(best_fit(sorted(hard, reverse=True), 100))
    assert complete_bins([], 100) == [] and complete_bins([100], 100) == [[100]]


def test_a_search_cut_short_keeps_best_fit():
    rng = random.Random(9)
    lengths = [rng.randint(20, 60) for _ in range(200)]
    assert len(complete_bins(lengths, 100, steps=1)) <= len(best_fit(sorted(lengths, reverse=True), 100))


def check(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_whole_table(spark, sf, capacity):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack_documents(docs, FILE, capacity, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(FILE)
    for doc in docs.collect():
        ids = [*tokenizer.encode(doc.text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == doc.doc_id), key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(i, i * capacity) for i in range(-(-len(ids) // capacity))]
        for r in own:
            cut = np.array(ids[r.start:r.start + capacity], "<u4").tobytes()
            assert (r.length, r.ids_crc32, bytes(r.ids)) == (len(cut) // 4, zlib.crc32(cut), cut)
    sequences, total = check(rows, capacity), sum(r.length for r in rows)
    assert sequences <= -(-total // capacity) + 1 + total // capacity // 50


def test_groups_of_many_rows(spark, monkeypatch):
    rng = random.Random(0)
    pieces = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(900)], "doc_id long, length long")
    rows = pack(pieces, 100, group_rows=200).collect()
    assert len(rows) == 900 and check(rows, 100) <= -(-sum(r.length for r in rows) // 100) * 1.05 + 5


def test_edge_cases(frame):
    special = "a<|startoftext|> B <|endoftext|><|ENDOFTEXT|> <|startoftext|"
    strange = "É́\x1c\x85 <|endoftext|> İ ǅ ſtop... ''s don't 1234 x́, ﬁ."
    rows = [(1, None), (None, ""), (2, " \n"), (2, " \n"), (3, strange), (4, "word " * 9000), (5, "x" * 30_000), (6, special), (7, "<|endoftext|>")]
    got = pack_documents(frame(rows), FILE).collect()
    check(got, 4096)
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, a in enumerate(range(0, len(ids), 4096)):
            want[i, n, zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want
    assert [int(x) for x in np.frombuffer(packing.WordIds(FILE).encode(["<|startoftext|><|endoftext|> hello"])[0], "<u4")][:2] == [49406, 49407]
    assert pack_documents(frame([]), FILE).count() == 0


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    words, tokenizer = packing.WordIds(FILE), Tokenizer.from_file(FILE)
    for text in ("one two, three.", "four five six seven.", "One . , .. ,."):
        assert words.encode([text])[0] == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
