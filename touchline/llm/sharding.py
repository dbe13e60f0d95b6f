"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from touchline.llm.common import free_name, plain, text_of
from touchline.session import materialize


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. With one more shard a key stays or moves to the new shard."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    at, jump = np.zeros(len(state), np.int64), np.zeros(len(state), np.float64)
    going = np.arange(len(state))
    while len(going):
        at[going] = jump[going].astype(np.int64)
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[going] = np.floor((at[going] + 1) * (float(1 << 31) / ((state[going] >> np.uint64(33)) + np.uint64(1))))
        going = going[jump[going] < shards]
    return at


def jump_shards(df: DataFrame, key: str, shards: int, grown: int | None = None,
                keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``shard``, ``grown_shard`` (the shard among ``grown``) and ``slot``, gapless from 0 in each shard.

    The key's 64-bit hash and the shard count alone decide the shard; a null key is a key like any other and
    rows with equal keys share a shard. Rows are numbered where they lie: a task counts each shard's rows as it
    writes them, and only the counts per (task, shard) are added up, so no shard passes through one task.
    An empty table gives an empty result. ``keep`` names the columns to carry (default: the key); columns of
    the input that are not named there do not matter, whatever they are called.
    """
    keep = keep if keep is not None else {key: df[f"`{key}`"]}
    if clash := {"shard", "grown_shard", "slot", "_hash", "_part", "_local"} & set(keep):
        raise ValueError(f"columns would be overwritten: {sorted(clash)}")
    grown = grown or shards
    source = df.select(*[c.alias(n) for n, c in keep.items()], F.xxhash64(df[f"`{key}`"]).alias("_hash"))
    added = "shard int, grown_shard int, _part int, _local long"
    schema = T.StructType([*source.drop("_hash").schema.fields, *T.StructType.fromDDL(added).fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            hashes = batch.column(batch.schema.get_field_index("_hash")).to_numpy(zero_copy_only=False)
            keys = hashes.astype(np.int64).view(np.uint64)
            shard, local = jump_hash(keys, shards), np.empty(len(keys), np.int64)
            for s in range(shards):
                rows = np.flatnonzero(shard == s)
                local[rows] = seen[s] + np.arange(len(rows))
                seen[s] += len(rows)
            fields = [i for i, f in enumerate(batch.schema) if f.name != "_hash"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in fields], pa.array(shard, pa.int32()),
                 pa.array(jump_hash(keys, grown), pa.int32()), pa.array(np.full(len(keys), part), pa.int32()),
                 pa.array(local, pa.int64())],
                names=[*[batch.schema.field(i).name for i in fields], "shard", "grown_shard", "_part", "_local"])

    placed = materialize(source.mapInArrow(place, schema))
    counts = placed.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, ["_part", "shard"]).withColumn("slot", F.col("_start") + F.col("_local")).drop(
        "_part", "_local", "_start")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Manifest of documents by shard: size in bytes plus 1, checksum, shard, slot, and the shard after growth by one.

    A null text counts as no bytes and has the checksum of the empty text.
    """
    text = text_of(docs, text_col)
    placed = jump_shards(docs, id_col, shards, shards + 1, {
        "doc_id": docs[f"`{id_col}`"], "size": (F.octet_length(text) + F.lit(1)).cast("long"),
        "text_crc32": F.crc32(text.cast("binary"))})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write the rows themselves, one folder per shard; each task writes to every folder, so no shard is one task's.

    The added columns are ``shard`` and ``slot``, with underscores in front where the rows have columns of that name.
    """
    safe, name = plain(df)
    placed = jump_shards(safe, name[key], shards, keep={c: F.col(c) for c in safe.columns}).select(*safe.columns, "slot", "shard")
    slot, shard = (free_name(n, df.columns) for n in ("slot", "shard"))
    placed.toDF(*df.columns, slot, shard).write.partitionBy(shard).parquet(path)
