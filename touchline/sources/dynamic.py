"""Landed records whose fields come and go: lines as VARIANT values, columns picked from wherever a record keeps them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from touchline.schemas import landed_schema

RECORD, REASON = "record", "reject_reason"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(line, record, reject_reason, partition columns): each line of the files as a VARIANT, or why it is none.

    No schema is declared or inferred, so a field that appears later, moves into an object or changes its type breaks nothing.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    parsed = lines.withColumn(RECORD, F.try_parse_json("line"))
    kind = F.schema_of_variant(RECORD)
    return parsed.withColumn(REASON, F.when(F.col(RECORD).isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object"))


def places(name: str) -> list[str]:
    """Where a record may keep a column: under its name, or, for names joined by '_', inside objects of the first part's name."""
    found = [[name]]
    cut = [i for i, c in enumerate(name) if c == "_"]
    found += [[name[:i], name[i + 1:]] for i in cut if 0 < i < len(name) - 1]
    return ["$" + "".join(f"['{part}']" for part in path) for path in found]


def picked(name: str, kind: T.DataType) -> Column:
    """The column's value from the first place that holds one; numbers may be written as text and the other way round."""
    ddl = kind.simpleString()
    tries = [F.try_variant_get(RECORD, p, ddl) for p in places(name)]
    if isinstance(kind, T.DoubleType):
        tries += [F.try_variant_get(RECORD, p, "string").try_cast("double") for p in places(name)]
    return F.coalesce(*tries).alias(name)


def collection(records: DataFrame, kind: str, tags: Sequence[str] = ()) -> DataFrame:
    """The good records in the collection's declared columns; ``tags`` are columns of ``records`` to keep, such as partition folders."""
    fields = [f for f in landed_schema(kind).fields if not f.name.startswith("_")]
    return records.where(F.col(REASON).isNull()).select(*[picked(f.name, f.dataType) for f in fields], *tags)


def rejected(records: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """The lines that are no records, with their reasons."""
    return records.where(F.col(REASON).isNotNull()).select("line", REASON, *tags)
