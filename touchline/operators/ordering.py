"""Global order: dense row index, dense dictionaries, temporal split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.config import SplitConfig
from touchline.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Dense 0-based position under ``order`` without a one-partition window.

    Rows are range-partitioned, so a hot value is split by the later order columns; only one offset
    per partition crosses tasks. The placement is written out once, because a range partitioning may
    not come out the same when it is worked out again.
    """
    cols = [F.col(c) for c in order]
    placed = materialize(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("_pos", _LOCAL_BITS)
    starts = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_part", "_start")
    )  # one row per partition, so the window and the broadcast are bounded by the partition count
    return (
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_part", "_pos", "_start")
    )


def dense_index(df: DataFrame, groups: Sequence[str], value: str, name: str = "idx") -> DataFrame:
    """Distinct rows numbered from 1 inside each group in value order, without a window per group."""
    ranked = row_index(df.distinct(), [*groups, value], "_at")
    starts = ranked.groupBy(*groups).agg(F.min("_at").alias("_first"))
    return ranked.join(starts, list(groups)).withColumn(
        name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def split_bounds(n_rows: Column, split: SplitConfig = SplitConfig()) -> tuple[Column, Column]:
    """Ends of the train and validation ranges, truncated in double arithmetic."""
    train = F.lit(float(split.train_fraction))
    both = F.lit(float(split.train_fraction + split.val_fraction))
    n = n_rows.cast("double")
    return F.floor(n * train), F.floor(n * both)


def temporal_split(df: DataFrame, split: SplitConfig = SplitConfig(), index: str = "row_idx") -> DataFrame:
    """Adds ``split`` in {train, val, test}: ordered, disjoint, half-open ranges of the row index."""
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    train_end, val_end = split_bounds(n_rows, split)
    i = F.col(index)
    return df.withColumn("split", F.when(i < train_end, "train").when(i < val_end, "val").otherwise("test"))


def split_ranges(df: DataFrame, split: SplitConfig = SplitConfig()) -> dict[str, tuple[int, int]]:
    """The ranges of ``temporal_split`` as numbers, for reads that prune by the row index."""
    n = F.count(F.lit(1))
    ends = df.agg(*[F.array(F.lit(0).cast("long"), *split_bounds(n, split), n).alias("e")]).first()["e"]
    return dict(zip(("train", "val", "test"), zip(ends, ends[1:])))


def row_range(df: DataFrame, start: int, end: int, shards: int = 1, shard: int = 0,
              index: str = "row_idx") -> DataFrame:
    """Half-open range of the row index, optionally one residue class of it; reaches the Parquet scan."""
    out = df.where((F.col(index) >= start) & (F.col(index) < end))
    return out if shards <= 1 else out.where(F.pmod(F.col(index), F.lit(shards)) == shard)


def seeded_shuffle(df: DataFrame, seed: int, index: str = "row_idx") -> DataFrame:
    """Reproducible random order: the sort key depends on the row index and the seed alone."""
    return df.orderBy(F.xxhash64(F.col(index), F.lit(seed)), F.col(index))
