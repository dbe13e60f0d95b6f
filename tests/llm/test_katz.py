"""Katz back-off scores against a plain recursive version; probabilities of a context add up to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from touchline.llm import blocks
from touchline.llm.katz import Settings, discounts, gram_table, score, score_documents, train
from pyspark.sql import functions as F

WORDS = "the cat sat on a mat and the dog ran to the old house by the sea while it rained all day".split()


def texts():
    """A common word before most others, repeats, copies, empty texts, upper case and words only held-out rows have."""
    out = []
    for i in range(140):
        words = [WORDS[(i * 7 + j * j * (i % 5 + 1)) % len(WORDS)] for j in range(i % 23)]
        if i % 3 == 0:
            words += ["THE", WORDS[i % len(WORDS)], "of", "of", "of"]
        out.append((i, " ".join(words) + ("\x0b\n" if i % 4 else "") + (f" odd{i} odd{i}" if i % 9 == 2 else "")))
    return out + [(140, None), (141, ""), (142, " \t\r\n"), (3, texts_copy := "the the the cat"), (143, texts_copy), (None, "cat É é\xa0x")]


def learnt(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def cut(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Plain:
    """Counts in dictionaries, back-off by recursion, weights by summing over all seen words of a context."""

    def __init__(self, rows, order, largest=5):
        self.order, self.counts = order, defaultdict(Counter)
        self.starts = sum(learnt(i) for i, _ in rows)
        for i, text in rows:
            if learnt(i):
                words = ["<s>", *cut(text)]
                for at in range(1, len(words)):
                    for n in range(order):
                        if at - n >= 0:
                            self.counts[n][(*words[at - n:at], words[at])] += 1
        self.rates, self.after = [], []
        for n in range(order):
            seen = [sum(c == r for c in self.counts[n].values()) for r in range(1, largest + 2)]
            self.rates.append(discounts(seen, largest))
            after = defaultdict(dict)
            for gram, c in self.counts[n].items():
                after[gram[:-1]][gram[-1]] = c
            self.after.append(after)
        self.largest = largest

    def kept(self, n, c):
        return c * (self.rates[n][c - 1] if c <= self.largest else 1.0)

    def p(self, context, word):
        n = len(context)
        seen = self.after[n].get(context, {})
        total = sum(seen.values())
        if not total:
            return self.p(context[1:], word) if n else 1.0
        lost = total - sum(self.kept(n, c) for c in seen.values())
        spare = lost <= 1e-12
        if word in seen:
            return self.kept(n, seen[word]) / (total + spare)
        left = (1.0 if spare else lost) / (total + spare)
        if not n:
            return left
        return left / (1 - sum(self.p(context[1:], w) for w in seen)) * self.p(context[1:], word)

    def score(self, text):
        words = ["<s>", *cut(text)]
        return sum(math.log10(self.p(tuple(words[max(0, at - self.order + 1):at]), words[at])) for at in range(1, len(words)))

    def base(self, text):
        c = self.counts[0]
        return sum(math.log10((c[w,] + 1) / (sum(c.values()) + len(c) + 1)) for w in cut(text))


@pytest.mark.parametrize("settings", [Settings(), Settings(order=1, chunk_chars=300), Settings(order=2, chunk_chars=400, part_grams=30, split=15),
                                      Settings(order=3, chunk_chars=500, part_grams=40, split=12)])
def test_equals_the_recursive_version(frame, settings):
    rows, plain = texts(), Plain(texts(), settings.order)
    got = sorted(map(tuple, score_documents(frame(rows).repartition(3), settings=settings).collect()), key=repr)
    n = sum(plain.counts[0].values())
    want = sorted([(i, not learnt(i), len(cut(t)), sum(plain.counts[0][w,] > 0 for w in cut(t)), n, plain.base(t), plain.score(t)) for i, t in rows], key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    assert any(w[1] and w[3] < w[2] for w in want)


def test_probabilities_of_a_context_add_up_to_one():
    plain = Plain(texts(), 3)
    words = [w for w, in plain.counts[0]] + ["never-seen"]
    for context in [(), ("the",), ("<s>",), ("of", "of"), ("the", "cat"), ("never-seen", "the")]:
        assert sum(plain.p(context, w) for w in words) == pytest.approx(1.0, abs=1e-12)


def test_tables_hold_each_gram_once(frame):
    rows = texts()
    model = train(frame(rows), F.lit(True), settings=Settings(chunk_chars=300, part_grams=25, split=10))
    words = {r.id: (r.word, r["count"]) for r in gram_table(model, 1).collect()}
    every = Counter(w for _, t in rows for w in cut(t))
    assert Counter({(bytes(w).decode() or "</s>"): c for w, c in words.values()}) == every
    pairs = {(r.context, r.word): r["count"] for r in gram_table(model, 2).collect()}
    assert sum(pairs.values()) == sum(every.values()) and all(w in words for _, w in pairs)
    assert score(model).count() == len(rows)


def test_discounts():
    assert all(0 < d < 1 for d in discounts([100, 40, 20, 12, 8, 5], 5))
    assert list(discounts([3, 0, 0, 0, 0, 0], 5)) == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]


def test_empty_and_unlearnt(spark, frame):
    assert score_documents(frame([]).limit(0)).count() == 0
    held = [i for i in range(50) if not learnt(i)][:2]
    got = score_documents(frame([(i, "a b") for i in held])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(3, 0, 0, 0.0, 0.0)}


def test_packing_round_trip():
    import numpy as np
    for values in ([], [0, -1, 1 << 62, 5], list(range(-300, 300))):
        assert blocks.unpack(blocks.pack(np.array(values, np.int64))).tolist() == values
    floats = np.array([0.1, -2.0, 0.1, 1e-300])
    assert blocks.unpack_floats(blocks.pack_floats(floats)).tolist() == floats.tolist()
