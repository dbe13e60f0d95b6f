"""Flattening, value cleaning and provenance tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

_KEPT = (T.StringType, T.BooleanType, T.LongType, T.ArrayType, T.MapType, T.StructType, T.NullType)


def flatten_columns(df: DataFrame) -> DataFrame:
    """Nested structs to one level; non-empty stripped parts of the path joined with '_'."""
    def walk(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
            else:
                name = "_".join(p for p in (s.strip() for s in here) if p).strip("_")
                yield F.col(".".join(f"`{p}`" for p in here)).alias(name)

    return df.select(*walk(df.schema, ()))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text, with microseconds only where there are any."""
    whole, full = (F.date_format(ts, f"yyyy-MM-dd'T'HH:mm:ss{s}") for s in ("", ".SSSSSS"))
    return F.when(full.endswith(".000000"), whole).otherwise(full)


def clean_values(df: DataFrame) -> DataFrame:
    """NaN to null, timestamps to ISO text, integers to bigint, nested values kept, the rest to text."""
    def clean(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out = F.when(~F.isnan(c), c.cast("double"))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out = iso_text(c)
        elif isinstance(kind, T.IntegralType):
            out = c.cast("long")
        elif isinstance(kind, _KEPT):
            out = c
        else:
            out = c.cast("string")
        return out.alias(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def tag_provenance(df: DataFrame, source: str, league: Column | str, season: Column | str) -> DataFrame:
    """Adds _source, _league, _season; texts are constants, columns are taken as they are."""
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    return df.withColumns({"_source": value(source), "_league": value(league), "_season": value(season)})
