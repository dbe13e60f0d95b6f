"""Session helpers: cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Per thread, the tables written inside each ``passing`` that is open.
_open = threading.local()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one is made only for a local master."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-checkpoint-"))
        shared = sc.getCheckpointDir()
    return shared


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends: what later steps need is in tables by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from its files.

    The files outlive any executor, and unlike cached blocks a re-read prunes columns, pushes filters
    down and knows its size, so a join may pick a broadcast only when the table is small. Shuffle files of the writing go at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/touchline-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(path)
    keep_track(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_track(path: str) -> None:
    """Notes a table's folder for the innermost ``passing``, if there is one."""
    if levels := getattr(_open, "levels", None):
        levels[-1].append(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside go at the end, except those read by a frame given to the function it yields; these belong to the
    ``passing`` around it. What leaves the block is a kept frame or values on the driver.
    """
    levels = _open.__dict__.setdefault("levels", [])
    levels.append([])
    read: set[str] = set()

    def keep(frame: DataFrame) -> DataFrame:
        read.update(part for file in frame.inputFiles() for part in file.split("/"))
        return frame

    try:
        yield keep
    finally:
        for path in levels.pop():
            if path.rpartition("/")[2] in read:
                keep_track(path)
            else:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, materialized; the tables it wrote on the way go."""
    with passing(spark) as keep:
        return keep(materialize(build()))
