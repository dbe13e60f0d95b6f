"""Exact top-k by inner product: ranges of rows in blocks, pruned by the largest weight of each term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.session import materialize

K = 5
#: Rows of a block, blocks of a group (one task holds a group), packs of queries that meet a group at once.
BLOCK_ROWS, GROUP_BLOCKS, PACKS = 256, 16, 50
LEAST = np.iinfo(np.int64).min

BLOCKS = "part int, grp int, ids binary, nums binary, dims int, data binary"
PACK = "part int, grp int, ids binary, nums binary, dims int, data binary, found_query binary, found_id binary, found_score binary"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(num, vec_id, v): floor(scale * x) of every component as long, and a number of the row's own, as ids may repeat. Rows whose
    id or vector is null, or whose vector holds a null or non-finite component, take no part."""
    x = F.transform(df[f"`{vector_col}`"], lambda c: c.cast("double"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.select(df[f"`{id_col}`"].cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    # Written, so that a number stays with its row.
    return materialize(kept.select(F.monotonically_increasing_id().alias("num"), "vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")))


def blocks(vectors: DataFrame) -> DataFrame:
    """Forward index: ranges of ids in blocks, each with its rows' terms as one array."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, rows = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            dims = max(len(v) for _, _, v in rows)
            data = np.zeros((len(rows), dims), np.int64)
            for i, (_, _, v) in enumerate(rows):
                data[i, :len(v)] = v
            ids, nums = (np.array([r[k] for r in rows], np.int64) for k in (1, 0))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "grp": pa.array([number // GROUP_BLOCKS], pa.int32()),
                "ids": [ids.tobytes()], "nums": [nums.tobytes()], "dims": pa.array([dims], pa.int32()), "data": [data.tobytes()]})

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                rows.append(row)
                if len(rows) == BLOCK_ROWS:
                    yield block()
                    number, rows = number + 1, []
        if rows:
            yield block()

    return vectors.select("num", "vec_id", "v").repartitionByRange("vec_id", "num").sortWithinPartitions("vec_id", "num").mapInArrow(build, BLOCKS)


def _matrix(row, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers and weights of a block."""
    ids, nums = np.frombuffer(row.ids, np.int64), np.frombuffer(row.nums, np.int64)
    data = np.frombuffer(row.data, np.int64).reshape(len(ids), row.dims)
    return ids, nums, np.pad(data, ((0, 0), (0, dims - row.dims))) if row.dims < dims else data[:, :dims]


def best_per_query(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, score) arrays, the k best of each query: highest score, then smallest id."""
    query, ident, score = found
    order = np.lexsort((ident, -score, query))
    query, ident, score = query[order], ident[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], ident[keep], score[keep]


def search(queries: tuple[np.ndarray, np.ndarray], index: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
           floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(place of the query, id, score) of the k best of the blocks in ``index`` that reach the query's ``floor``.

    ``queries`` are row numbers and weights; a query does not find its own row, but other rows of its id.

    A block's bound for a query is the sum over terms of its weight times the block's largest (for a negative
    weight, smallest) weight. Each query takes blocks in falling order of bounds, until they lie below its kth score.
    """
    nums, q = queries
    size = max([1, *(np.abs(d).max(initial=0) for _, _, d in index)])
    exact = float(np.abs(q).max(initial=0)) * float(size) * max(1, q.shape[1]) < 2**53  # doubles hold every partial sum
    kind = np.float64 if exact else np.int64
    weights = q.astype(kind)
    high = np.array([d.max(0) for _, _, d in index]).astype(kind)
    low = np.array([d.min(0) for _, _, d in index]).astype(kind)
    bounds = np.maximum(weights, 0) @ high.T + np.minimum(weights, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth, data = floor.copy(), [d.astype(kind).T for _, _, d in index]
    found = (np.zeros(0, np.int64),) * 3
    for step in range(len(index)):
        block = order[:, step]
        going = np.flatnonzero(bounds[np.arange(len(nums)), block] >= kth)
        if not len(going):
            break
        new = [found]
        for b in np.unique(block[going]):
            rows = going[block[going] == b]
            scores = weights[rows] @ data[b]
            at, column = np.nonzero(scores >= kth[rows][:, None])
            other = index[b][1][column] != nums[rows[at]]
            at, column = at[other], column[other]
            new.append((rows[at], index[b][0][column], scores[at, column].astype(np.int64)))
        found = best_per_query(tuple(map(np.concatenate, zip(*new))), k)
        full, counts = np.unique(found[0], return_counts=True)
        last = np.cumsum(counts) - 1
        kth[full[counts == k]] = np.maximum(kth[full[counts == k]], found[2][last[counts == k]])
    return found


def _index(pdf: pd.DataFrame, dims: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [_matrix(row, dims) for row in pdf.itertuples()]


def top_k(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """(query_id, vec_id, score, rank): for each row whose id is divisible by ``every``, its k best other rows, ties to the smaller id.

    ``vectors`` has num (the row's own number), vec_id and v (array of long; a shorter vector lacks its last terms); scores must fit a
    long. Rows that repeat an id are rows of their own: each is a candidate, each is ranked for where its id is asked. Queries first search the group
    of blocks they lie in, which gives each a floor. Then packs of queries meet every other group, in tasks of bounded
    size, and only scores that reach the floor are returned. An empty table gives an empty result.
    """
    index = materialize(blocks(vectors))

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        dims = int(pdf["dims"].max())
        own = _index(pdf, dims)
        ids, nums, data = (np.concatenate([x[i] for x in own]) for i in range(3))
        asked = np.flatnonzero(ids % every == 0)
        asked = asked[np.argsort(nums[asked], kind="stable")]  # a group's blocks arrive in any order, packs are searched by number
        if not len(asked):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("part", "grp", "ids", "nums", "dims", "data", "found_query", "found_id", "found_score")})
        ids, nums, data = ids[asked], nums[asked], data[asked]
        query, ident, score = search((nums, data), own, np.full(len(ids), LEAST), k)
        return pd.DataFrame({
            "part": [pdf["part"].iloc[0]], "grp": [pdf["grp"].iloc[0]], "ids": [ids.tobytes()], "nums": [nums.tobytes()],
            "dims": [dims], "data": [np.ascontiguousarray(data).tobytes()], "found_query": [nums[query].tobytes()],
            "found_id": [ident.tobytes()], "found_score": [score.tobytes()]})

    packs = materialize(index.groupBy("part", "grp").applyInPandas(at_home, PACK))
    parts, groups, n = packs_shape(index, packs)
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    many = max(1, -(-n // PACKS))
    dealt = packs.withColumn("deal", F.pmod(F.xxhash64("part", "grp"), F.lit(many)).cast("int")).select(
        F.col("part").alias("own_part"), F.col("grp").alias("own_grp"), "ids", "nums", "dims", "data", "found_query", "found_score", "deal")
    asked = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(groups)))).where("part <> own_part OR grp <> own_grp")
    spread = index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def abroad(own: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 4]
        if len(own) and len(packed):
            dims = int(max(own["dims"].max(), packed["dims"].max()))
            group = _index(own, dims)
            for row in packed.itertuples():
                ids, nums, data = _matrix(row, dims)
                floor = np.full(len(nums), LEAST)
                at = np.searchsorted(nums, np.frombuffer(row.found_query, np.int64))
                seen = np.bincount(at, minlength=len(floor))
                lowest = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(lowest, at, np.frombuffer(row.found_score, np.int64))
                floor[seen == k] = lowest[seen == k]
                query, ident, score = search((nums, data), group, floor, k)
                out.append((nums[query], ids[query], ident, score))
        return pd.DataFrame(dict(zip(("num", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    keys = ["part", "grp", "deal"]
    elsewhere = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        abroad, "num long, query_id long, vec_id long, score long")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                ids, nums = np.frombuffer(row.ids, np.int64), np.frombuffer(row.found_query, np.int64)
                yield pd.DataFrame({"num": nums, "query_id": ids[np.searchsorted(np.frombuffer(row.nums, np.int64), nums)],
                                    "vec_id": np.frombuffer(row.found_id, np.int64), "score": np.frombuffer(row.found_score, np.int64)})

    home = packs.select("ids", "nums", "found_query", "found_id", "found_score").mapInPandas(
        unpack, "num long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("num").orderBy(F.desc("score"), "vec_id"))
    return home.union(elsewhere).withColumn("rank", place).where(F.col("rank") <= k)


def packs_shape(index: DataFrame, packs: DataFrame) -> tuple[int, int, int]:
    """Largest part and group number, and how many packs there are."""
    part, grp = index.agg(F.max("part"), F.max("grp")).first()
    return part or 0, grp or 0, packs.count()


def top_k_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50,
                 k: int = K) -> DataFrame:
    """Each query's k best other rows. Equal scores go by the smaller id; rows that repeat an id are all candidates, and each is asked
    for where its id is; other columns are ignored."""
    return top_k(quantised(df, id_col, vector_col), every, k).select("query_id", "rank", "vec_id", "score")
