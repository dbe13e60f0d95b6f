"""Helpers that the operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from touchline.session import checkpoint_dir, materialize, tidy_shuffles  # noqa: F401  the operators take it from here

#: The six characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints, which every executor and the driver can reach."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_of(df: DataFrame, column: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(df[f"`{column}`"].cast("string"), F.lit(""))


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named by place, so that no name of theirs clashes or needs quoting, and the new name of each."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores in front as make it one that is not taken."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


#: The column of ``numbered``, whose rows come from ``plain``.
ROW = "_row"


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, written out so that a number stays with its row."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()))


def per_worker(name: str, build: Callable[[], Any]) -> Any:
    """A value kept by a Python worker from task to task: vocabularies and word caches are built once."""
    kept = sys.modules.setdefault("_touchline_worker", types.ModuleType("_touchline_worker")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]
