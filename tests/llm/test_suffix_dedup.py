"""Repeated passages against all strings of 200 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import touchline.llm.suffix_dedup as sd
from touchline.llm.suffix_dedup import (
    LENGTH, LoserTree, anchors, choose_parts, common_prefix, front_code, front_decode, remove_repeats, repeated_offsets,
)


def brute(texts):
    """Per text: (bytes, removed, runs, digest of the rest)."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if counts[d[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = True
        runs = int((gone[1:] > gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "on", "é", "er", "ing", "a", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (40, 60, 90, 150)]
    texts = []
    for i in range(70):
        parts = [prose(rng, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a:a + rng.randint(100, 600)], prose(rng, rng.randint(0, 30))]
        texts.append(" ".join(parts))
    base = prose(rng, 300)
    words = base.split(" ")
    for _ in range(12):  # near copies
        w = list(words)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += ["The " * 200, "The " * 90 + "end", "x" * 199, "x" * 200, "x" * 700, "", None, "ab" * 150 + prose(rng, 50) + "ab" * 150,
              base, base, "y" * 200 + base, shared[3] + shared[3]]
    return texts


@pytest.mark.parametrize("seed,part_rows,run_rows", [(1, 60_000, 60_000), (2, 40, 60), (3, 15, 30)])
def test_equals_all_strings(spark, frame, monkeypatch, seed, part_rows, run_rows):
    monkeypatch.setattr(sd, "RUN_ROWS", run_rows)
    monkeypatch.setattr(sd, "BLOCK_ROWS", 7)
    monkeypatch.setattr(sd, "CHUNK_ANCHORS", 150 if run_rows < 100 else 500_000)
    texts = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in remove_repeats(frame(list(enumerate(texts))), part_rows=part_rows).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_a_gram_common_to_very_many_contexts(spark, frame, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_ROWS", 5)  # blocks are smaller than parts, as they are at scale
    rng = random.Random(5)
    passage = prose(rng, 70)
    texts = [prose(rng, 60) + passage + prose(rng, 60) for _ in range(60)]
    docs = frame(list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, part_rows=20).collect()}
    assert got == dict(enumerate(brute(texts)))
    found = sd.distinct_texts(docs, "text")
    assert choose_parts(sd.sorted_runs(found, sd.candidate_anchors(found)), 20, 1000)[1]  # parts do begin inside a gram


def test_parts_keep_their_size(frame, monkeypatch):
    """With many more contexts than draws at least, parts grow in number, not in size, and no gram passes for a common one."""
    monkeypatch.setattr(sd, "BLOCK_ROWS", 5)
    rng = random.Random(8)
    for many in (20, 160):
        passages = [prose(rng, 60) for _ in range(many)]
        found = sd.distinct_texts(frame([(2 * i + j, prose(rng, 5) + p + prose(rng, 5)) for i, p in enumerate(passages) for j in (0, 1)]), "text")
        runs = sd.sorted_runs(found, sd.candidate_anchors(found))
        total = runs.where("block >= 0").agg({"many": "count"}).first()[0] * 5
        splits, hot = choose_parts(runs, 40, 10)
        assert len(splits) > 0.4 * total / 40 and not hot


def test_edge_cases(frame):
    long = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(30_000))
    rows = [(1, long), (None, None), (2, ""), (2, ""), (3, "short"), (None, "z" * 300), (4, "é" * 150)]
    got = sorted(remove_repeats(frame(rows), with_kept=True).collect(), key=lambda r: (r.n_bytes, r.n_removed))
    want = sorted(brute([t for _, t in rows]))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert remove_repeats(frame([])).count() == 0


def test_anchors_depend_on_the_string_alone(monkeypatch):
    data = corpus(7)[3].encode() * 3
    monkeypatch.setattr(sd, "SEGMENT", 300)
    chosen = {}
    covered = []
    for h, p, low, high in zip(*(a.tolist() for a in anchors(data))):
        for s in range(low, high + 1):
            covered.append(s)
            assert chosen.setdefault(data[s:s + LENGTH], (p - s, h)) == (p - s, h)
    assert covered == list(range(len(data) - LENGTH + 1))
    assert [len(a) for a in anchors(b"x" * 199)] == [0] * 4


@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_loser_tree_merges_with_shared_prefixes(k):
    rng = random.Random(k)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    runs = [sorted(keys[i::k]) for i in range(k)]
    merged = list(LoserTree([((key, s, i) for key, s in front_decode(*front_code(run))) for i, run in enumerate(runs)]))
    assert [m[0] for m in merged] == sorted(keys)
    assert all(m[1] == common_prefix(a[0], m[0], 0) for a, m in zip(merged, merged[1:]))
    assert list(LoserTree([iter(())])) == []


def test_offsets_of_one_context():
    key = bytes(range(200)) + b"left"
    assert repeated_offsets([(key, 0, 4, 1)]) == [[]] and repeated_offsets([(key, 0, 4, 2)]) == [[(0, 4)]]
