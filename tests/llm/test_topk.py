"""Exact top-k against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import topk
from touchline.llm.topk import LEAST, search, top_k_report

NAMES = "vec_id long, embedding array<double>, label int, rank int, score string, data string"


def brute(rows, every=50, k=5):
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(valid):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(valid) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y") for i, v in rows], NAMES)


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["random", "clustered", "ties"])
def test_equals_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(topk, "PACKS", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6)) * 0.3
    if kind == "clustered":
        v = np.sort(v, axis=0)
    if kind == "ties":
        v = np.round(v)
        v[:300] = [1, 0, 0, -1, 0, 0]
    rows = [(int(i) * 7 - 900, x.tolist()) for i, x in enumerate(v)]
    assert result(top_k_report(frame(spark, rows), every=5)) == brute(rows, every=5)


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_blocks_of_a_group_in_any_order(spark, monkeypatch, order):
    """Floors are those of the own query, also if the blocks of a group do not arrive by id."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 5)
    monkeypatch.setattr(topk, "PACKS", 2)
    real = topk.blocks

    def mixed(vectors):
        """One file of all blocks, sorted by something else than their ids."""
        out = real(vectors)
        by = ["_n"] if order == "descending" else ["_h"]
        first = F.conv(F.hex(F.reverse(F.substring("ids", 1, 8))), 16, 10)
        return out.withColumns({"_n": -first.cast("double"), "_h": F.xxhash64("ids")}).coalesce(1).sortWithinPartitions(*by).drop("_n", "_h")

    monkeypatch.setattr(topk, "blocks", mixed)
    v = np.random.default_rng(4).normal(size=(400, 6)) * np.linspace(0.1, 3, 400)[:, None]
    rows = [(i * 7, x.tolist()) for i, x in enumerate(v)]
    assert result(top_k_report(frame(spark, rows), every=5)) == brute(rows, every=5)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (1, [1e6, -1e6]), (2, []), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf")]), (None, [1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [0.0, 9.0]), (100, [-1e6, 1e6])]
    assert result(top_k_report(frame(spark, rows))) == brute(rows)
    twice = [(50, [1.0]), (1, [2.0]), (1, [3.0]), (2, [1.0]), (50, [4.0]), (1, [3.0])]
    assert result(top_k_report(frame(spark, twice))) == brute(twice) and len(brute(twice)) == 10
    assert result(top_k_report(frame(spark, []))) == [] and result(top_k_report(frame(spark, [(1, [1.0])]))) == []
    assert result(top_k_report(frame(spark, [(50, [1.0])]))) == []


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    rng = np.random.default_rng(0)
    index = []
    for b in range(20):
        data = rng.integers(0, 5, (16, 4)) + (100 if b == 7 else 0)
        index.append((np.arange(16) + 16 * b, np.arange(16) + 16 * b, data))
    scored = []
    real = topk.best_per_query
    monkeypatch.setattr(topk, "best_per_query", lambda found, k: scored.append(1) or real(found, k))
    query, ident, score = search((np.array([-1]), np.ones((1, 4), np.int64)), index, np.array([LEAST]), 5)
    assert len(scored) == 1 and set(ident // 16) == {7} and len(score) == 5


def test_large_weights_stay_exact():
    big = np.array([[2**30, 1], [2**30, 2]])
    _, ident, score = search((np.array([9]), np.array([[2**31, 1]])), [(np.array([1, 2]), np.array([1, 2]), big)], np.array([LEAST]), 2)
    assert ident.tolist() == [2, 1] and score.tolist() == [2**61 + 2, 2**61 + 1]
