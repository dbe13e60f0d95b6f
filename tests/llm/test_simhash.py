"""SimHash: fingerprints against the engine's own hash, components against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.simhash import (
    GrayIndex, drop_near_copies, fingerprint, fingerprint_links, gray_rank, simhash_groups, simhash_report,
)


def brute_roots(values, distance=4):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def scattered(n, centres, flips, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2**64, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        v = v ^ np.where(rng.random(n) < .5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return v


def test_gray_rank_orders_neighbours_by_one_bit():
    order = np.argsort(gray_rank(np.arange(64, dtype=np.uint64))).astype(np.uint64)
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("n,centres,flips", [(0, 1, 0), (1, 1, 0), (9, 2, 3), (700, 40, 5), (1500, 1, 6), (1200, 600, 4)])
def test_index_equals_all_pairs(n, centres, flips):
    index = GrayIndex(scattered(n, centres, flips))
    if n:
        assert index.links(4).tolist() == brute_roots(index.values)


@pytest.mark.parametrize("bucket_rows", [50_000, 8])
def test_links_over_buckets_keep_every_component(spark, bucket_rows):
    values = np.unique(scattered(900, 60, 5, seed=3))
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components(fingerprint_links(df, 4, bucket_rows)).collect()}
    signed = values.view(np.int64).tolist()
    want = brute_roots(values)
    groups = {}
    for x, root in zip(signed, want):
        groups.setdefault(root, set()).add(x)
    found = {}
    for x in signed:
        found.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_a_path_a_hub_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_equal_the_engine_hash(spark):
    texts = ["", "  \n", "One", "one two THREE", "a b c d", "a b  c\td\x0be f", "x " * 50, "Ünder DER Ägide é", "a b c d e"]
    for text in texts:
        words = text.translate({ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
        shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(
            F.xxhash64("s")).collect()] if shingles else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fingerprint(text) == want


def test_report_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash_report(docs).toPandas()
    texts = docs.toPandas()
    prints = {i: fingerprint(t or "") for i, t in zip(texts.doc_id, texts.text)}
    assert {i: f"{p:016x}" for i, p in prints.items()} == dict(zip(got.doc_id, got.fingerprint))
    ids = sorted(prints)
    roots = brute_roots(np.array([prints[i] for i in ids], np.uint64))
    assert dict(zip(got.doc_id, got.component_id)) == {i: ids[r] for i, r in zip(ids, roots)}


def test_edge_cases(frame):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(3, "same words in here now"), (2, "same words in here now"), (2, "same words in here now"), (None, "  "), (9, None),
            (5, ""), (None, "alone stands this one text"), (11, long), (10, long + " end")]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash_groups(frame(rows)).collect()}
    assert got[3, got_fp(rows[0][1])] == 2 and got[5, 0] == 5 and got[9, 0] == 5 and got[None, 0] == 5
    assert got[None, got_fp(rows[6][1])] is None and got[11, got_fp(long)] == 10
    kept = drop_near_copies(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 5), (False, 10), (True, 0)]
    assert simhash_report(frame([])).count() == 0


def got_fp(text):
    return int(np.array([fingerprint(text)], np.uint64).view(np.int64)[0])
