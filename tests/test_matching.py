"""Matching against a brute-force greedy assignment."""

import difflib
import random
import re
import unicodedata

import pytest

from touchline.functions.names import ALIASES, STOPWORDS, normalize_names
from touchline.operators import matching
from touchline.operators.matching import candidate_pairs, match_names


def norm(name):
    folded = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    tokens = {t for t in re.sub(r"[^a-z0-9\s]", " ", folded).split() if t not in STOPWORDS}
    return tokens, "".join(sorted(tokens))


def similarity(a, b):
    (ta, ja), (tb, jb) = norm(a), norm(b)
    if not ta or not tb:
        return 0.0
    return max(len(ta & tb) / len(ta | tb), difflib.SequenceMatcher(None, ja, jb).ratio())


def greedy(left, right, threshold=0.4):
    left, right, out = set(left), set(right), {}
    for a, b in ALIASES.items():
        if a in left and b in right:
            out[a] = b
    scored = sorted((-similarity(a, b), a, b) for a in left for b in right)
    used = set(out.values())
    for s, a, b in scored:
        if -s < threshold:
            break
        if a not in out and b not in used:
            out[a] = b
            used.add(b)
    return out


WORDS = ["real", "madrid", "união", "köln", "inter", "milan", "borussia", "town", "city", "rovers", "ab", "1899"]


def teams(rng, n):
    return sorted({" ".join(rng.sample(WORDS, rng.randint(1, 3))) + rng.choice(["", " FC", " CF", "!"]) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_equals_greedy(spark, seed):
    rng = random.Random(seed)
    blocks = {b: (teams(rng, 12) + ["PSG"], teams(rng, 12) + ["Paris Saint-Germain"]) for b in ("p", "q")}
    left = spark.createDataFrame([(b, x) for b, (l, _) in blocks.items() for x in l], "block string, left_name string")
    right = spark.createDataFrame([(b, x) for b, (_, r) in blocks.items() for x in r], "block string, right_name string")
    got = {(r.block, r.left_name): r.right_name for r in match_names(left, right, ["block"]).collect()}
    want = {(b, a): x for b, (l, r) in blocks.items() for a, x in greedy(l, r).items()}
    assert got == want


def test_no_good_enough_pair_is_lost(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdeklmnorst ") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    names = [n for n in names if norm(n)[0]]
    a, b = names[:60], names[60:]
    l, r = (normalize_names(spark.createDataFrame([("x", n) for n in set(s)], "block string, name string"), "name") for s in (a, b))
    for threshold in (0.4, 0.7):
        got = [(p.l_name, p.r_name) for p in candidate_pairs(l, r, ["block"], threshold).collect()]
        assert len(got) == len(set(got))
        want = {(x, y) for x in a for y in b if similarity(x, y) >= threshold}
        assert want <= set(got)


def test_below_threshold_stays_unmapped(spark):
    left = spark.createDataFrame([("b", "qqq"), ("b", "FC")], "block string, left_name string")
    right = spark.createDataFrame([("b", "zzz"), ("b", "AFC")], "block string, right_name string")
    assert match_names(left, right, ["block"]).isEmpty()


def test_letters_are_worked_out_once(spark, monkeypatch):
    """Scoring needs one Python worker a task: the letters of both sides are read, not worked out again on each branch and level."""
    seen, indexed = [], matching._indexed

    def watched(names, threshold):
        seen.append("letters" in names.columns)
        return indexed(names, threshold)

    monkeypatch.setattr(matching, "_indexed", watched)
    left = spark.createDataFrame([(1, "Alpha Beta"), (1, "Gamma Delta"), (2, "Omega")], "block int, left_name string")
    right = spark.createDataFrame([(1, "Alpha Betta"), (1, "Gama Delta"), (2, "Zzz")], "block int, right_name string")
    got = {(r.left_name, r.right_name) for r in matching.match_names(left, right, ["block"]).collect()}
    assert got == {("Alpha Beta", "Alpha Betta"), ("Gamma Delta", "Gama Delta")}
    assert seen and all(seen)
