"""A Python data source for landed JSON lines: partitions by file, pruned by pushed filters, in batches or as a stream.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").option("kind", "schedule").load(folder).where("_league = 'L1'")

``folder`` holds ``_league=../_season=..`` folders and must be one that driver and executors can open.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
)
from pyspark.sql.types import DoubleType, StructType

from touchline.schemas import landed_ddl
from touchline.sources.landed import register_reader

TAGS = ("_league", "_season")
ROWS = 4096


@dataclass
class LandedFile(InputPartition):
    path: str
    tags: dict[str, str]


def landed_files(folder: str) -> list[LandedFile]:
    """Files under ``folder`` with the tags of their folders, in the order of their names, in which they are landed."""
    root = urlparse(folder).path if folder.startswith("file:") else folder
    found = []
    for at, _, names in os.walk(root):
        parts = dict(p.split("=", 1) for p in os.path.relpath(at, root).split(os.sep) if "=" in p)
        found += [LandedFile(os.path.join(at, n), {k: unquote(v) for k, v in parts.items() if k in TAGS})
                  for n in names if not n.startswith((".", "_"))]
    return sorted(found, key=lambda f: (os.path.basename(f.path), f.path))


def read_file(file: LandedFile, schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows of a file in batches. Blank lines are skipped; a line that is no JSON object keeps its text in _corrupt_record."""
    kinds = [pa.float64() if isinstance(f.dataType, DoubleType) else pa.string() for f in schema.fields]

    def value(record: dict, name: str, kind: pa.DataType):
        found = record.get(name, file.tags.get(name))
        if found is None:
            return None
        if kind == pa.float64():
            return float(found) if isinstance(found, (int, float)) and not isinstance(found, bool) else None
        return found if isinstance(found, str) else json.dumps(found)

    def batch(records: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([value(r, f.name, k) for r in records], k) for f, k in zip(schema.fields, kinds)], names=schema.names)

    with open(file.path, encoding="utf-8") as lines:
        records: list[dict] = []
        for line in lines:
            if not line.strip():
                continue
            try:
                record = json.loads(line)
            except ValueError:
                record = None
            records.append(record if isinstance(record, dict) else {"_corrupt_record": line.rstrip("\n")})
            if len(records) == ROWS:
                yield batch(records)
                records = []
        if records:
            yield batch(records)


class PagesReader(DataSourceReader):
    """One partition per file. Filters on the folders' tags are answered by leaving files out; others stay with Spark."""

    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.schema, self.wanted = folder, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in TAGS:
                self.wanted.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            yield f  # a record may name its own tags, so the rows are still looked at

    def partitions(self) -> list[LandedFile]:
        return [f for f in landed_files(self.folder) if all(f.tags.get(name, None) in {*values, None} for name, values in self.wanted)]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return read_file(partition, self.schema)


class PagesStream(DataSourceStreamReader):
    """Files by their number in the order of their names; new files must sort behind those already there."""

    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.schema = folder, schema

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(landed_files(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        return landed_files(self.folder)[start["files"]:end["files"]]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return read_file(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    """Options: ``path``, and ``kind``, a collection with a declared schema."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return landed_ddl(self.options.get("kind", "schedule"))

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> PagesStream:
        return PagesStream(self.options["path"], schema)


def read_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed_pages").option("kind", kind).load(path)


def stream_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(LandedPages)
    return spark.readStream.format("landed_pages").option("kind", kind).load(path)


register_reader("pages", read_pages)
