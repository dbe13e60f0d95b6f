"""Readers for landed files and the repair of JSON wrapped in a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.functions.scalars import col
from touchline.schemas import landed_schema

Reader = Callable[[SparkSession, str, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register_reader(name: str, reader: Reader) -> None:
    """A reader takes (spark, path, kind) and returns the rows of one collection."""
    _READERS[name] = reader


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Line-delimited JSON under ``path``; blank lines are skipped, bad lines kept in _corrupt_record."""
    return spark.read.schema(landed_schema(kind)).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_parquet(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(landed_schema(kind)).parquet(path)


register_reader("jsonl", read_jsonl)
register_reader("parquet", read_parquet)


def read_landed(spark: SparkSession, path: str, kind: str, reader: str = "jsonl") -> DataFrame:
    """Rows of a collection from files, partition directories _league=../_season=.. included."""
    if reader not in _READERS:
        raise ValueError(f"unknown reader {reader!r}; known: {sorted(_READERS)}")
    return _READERS[reader](spark, path, kind)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def repair_wrapped_json(text: Column | str) -> Column:
    """The body of a page if it holds JSON; any other text comes back as it is."""
    t = col(text)
    body = _strip(F.regexp_extract(t, r"(?s)<body>(.*?)(?:</body>|$)", 1))
    return F.when(F.ltrim(_strip(t)).startswith("<") & body.rlike(r"^[\[{]"), body).otherwise(t)


def read_wrapped(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(file_name, text, repaired) of whole files, optionally those whose name starts with ``prefix``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"),
                                                         F.col("value").alias("text"))
    if prefix is not None:
        files = files.where(F.col("file_name").startswith(prefix))
    fixed = files.withColumn("fixed", repair_wrapped_json("text"))
    return fixed.select("file_name", F.col("fixed").alias("text"), (F.col("fixed") != F.col("text")).alias("repaired"))
