"""Streaming landing: new files are cleaned, tagged, de-duplicated and loaded so that a replay does no harm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from touchline.schemas import landed_schema
from touchline.sources.clean import clean_values, tag_provenance
from touchline.sources.tables import PARTITIONS, append_table


def landing_stream(spark: SparkSession, path: str, kind: str, max_files: int | None = None) -> DataFrame:
    """Rows of newly landed line-delimited JSON files."""
    reader = spark.readStream.schema(landed_schema(kind)).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record")
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).json(path)


def prepare(rows: DataFrame, source: str, league: Column | str, season: Column | str) -> DataFrame:
    return tag_provenance(clean_values(rows), source, league, season)


def deduplicate(rows: DataFrame, key: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """First arrival per key within the watermark; state older than the delay is dropped."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def start_landing(rows: DataFrame, table: str, key: Sequence[str], checkpoint: str,
                  partition_by: Sequence[str] = PARTITIONS, within: tuple[str, str] | None = None) -> StreamingQuery:
    """Loads what has arrived and stops; rows already in the table are left out, so a retried batch is harmless.

    ``within`` = (event time column, delay) drops repeated keys in the stream already, so the table is asked about fewer rows.
    """
    if within:
        rows = deduplicate(rows, key, *within)

    def load(batch: DataFrame, _batch_id: int) -> None:
        append_table(batch, table, key, partition_by)

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
