"""Exact duplicates: edge cases, hot groups and an index that lives on."""

import hashlib
import re

from touchline.llm import exact_dedup as ed
from touchline.llm.exact_dedup import dedup, drop_exact_copies, exact_dedup, new_index


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        group = [(-len(u or ""), j is None, j or 0, k) for k, ((j, u), m) in enumerate(zip(rows, norm)) if m == n]
        keep = min(group)
        out.append((i, rows[keep[3]][0], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [(5, "a b"), (3, "a  b"), (4, "ab"), (2, "a b"), (9, None), (8, " \t"), (7, ""), (None, "ünï x"), (1, "ünï x"), (1, "ünïx "),
        (6, "x" * 50_000), (6, "x" * 50_000), (6, "x" * 50_000 + "\x0b"), (None, "solo"), (None, "solo")]


def test_equals_brute_force(frame):
    got = exact_dedup(frame(ROWS)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == sorted(
        (i or -1, k or -1, n, h) for i, k, n, h in brute(ROWS))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert exact_dedup(frame([])).count() == 0


def test_rows_that_stay_keep_their_columns(frame):
    docs = frame(ROWS)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text[:6] for r in kept.collect()) == sorted(["a  b", "a b", " \t", "ünï x", "xxxxxx", "solo"])


def test_hot_group_meets_the_index_through_salted_pairs(frame):
    rows = [(i, "same text") for i in range(400)] + [(i, f"own {i}") for i in range(400, 600)]
    got = exact_dedup(frame(rows)).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 400} == {(0, 400)} and sum(r.kept for r in got) == 201


def test_index_is_kept_between_batches(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    first = new_index(frame([]), path=path, buckets=3)
    dedup(frame([(1, "one"), (2, "two"), (3, "o ne")]), first).collect()
    again = new_index(frame([]), path=path, buckets=3)
    spark.catalog.refreshTable(again.table)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup(frame([(7, "on e"), (8, "three")]), again).collect()}
    assert got == {7: (3, 3, False), 8: (8, 1, True)}
    assert again.read().count() == 3
    groups = again.read().select("digest", "keep_id", "keep_row", "keep_points", "group_size", "batch")
    again.append(groups)  # a batch that comes again after a failure
    assert again.read().count() == 3


def test_append_reads_the_index_without_a_shuffle(spark, frame):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = new_index(frame([]), buckets=4)
        index.append(ed.materialize(frame([(1, "x")]).selectExpr(
            "unhex('00') digest", "doc_id keep_id", "doc_id keep_row", "1L keep_points", "1L group_size", "'b' batch")))
        plan = frame([(1, "x")]).selectExpr("unhex(hex(doc_id)) digest").join(
            index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
