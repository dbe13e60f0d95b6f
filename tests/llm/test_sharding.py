"""Jump consistent hashing: movement, balance, gapless slots."""

import zlib

import numpy as np

from touchline.llm.sharding import jump_hash, jump_shards, shard_documents, write_shards


def scalar_jump(key, shards):
    at, jump = -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) % 2**64
        jump = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_equals_the_scalar_rule_and_moves_little():
    keys = np.random.default_rng(0).integers(0, 2**64, 4000, dtype=np.uint64)
    keys[:3] = [0, 1, 2**64 - 1]
    for n in (1, 2, 8, 9, 100):
        assert jump_hash(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]
    old, new = jump_hash(keys, 8), jump_hash(keys, 9)
    moved = old != new
    assert (new[moved] == 8).all() and abs(moved.mean() - 1 / 9) < 0.03
    assert len(jump_hash(keys[:0], 8)) == 0


def test_manifest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    got, texts = shard_documents(docs).toPandas(), docs.toPandas().set_index("doc_id").text
    assert sorted(got.doc_id) == sorted(texts.index) and set(got.law) == {"key"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got["shard"] != got.grown_shard
    assert (got.grown_shard[moved] == 8).all() and got["shard"].between(0, 7).all()
    sizes = dict(zip(got.doc_id, zip(got["size"], got.text_crc32)))
    assert sizes == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_edge_cases(frame, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "é" * 100_000)]
    docs = frame(rows)
    got = shard_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert len({r.shard for r in got if r.doc_id == 1}) == len({r.shard for r in got if r.doc_id is None}) == 1
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(frame([])).count() == 0
    assert jump_shards(docs, "doc_id", 1).select("slot").orderBy("slot").toPandas().slot.tolist() == list(range(6))
    path = str(tmp_path / "shards")
    write_shards(docs, "doc_id", 3, path)
    assert docs.sparkSession.read.parquet(path).count() == 6
