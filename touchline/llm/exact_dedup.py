"""Exact duplicates by a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.llm.common import ROW, SPACES, numbered, plain, shared_folder, text_of, type_of
from touchline.session import materialize

SALTS = 32


def normalised(text: Column) -> Column:
    """Text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(text, SPACES, "")


@dataclass
class DigestIndex:
    """A table of known digests under ``path``: bucketed and sorted by digest, opened again by later sessions.

    One row per digest: the id of the document that stays, its batch and row in it, its length and the size
    of its group in that batch. ``buckets`` belongs to the folder and must stay the same for its life.
    """

    spark: SparkSession
    path: str
    id_type: str
    buckets: int

    @property
    def table(self) -> str:
        return f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"

    def open(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self.id_type}, keep_row BIGINT, "
            f"keep_points BIGINT, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add the digests that are not known yet: a sort-merge anti-join reads the index without a shuffle.

        A batch that is appended again after a failure adds nothing.
        """
        known = self.read().select("digest").hint("merge")
        fresh = groups.join(known, "digest", "left_anti")
        fresh.select(*[f.name for f in self.read().schema.fields]).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text",
          row_col: str | None = None) -> DataFrame:
    """Each row of the batch with the row that stays of its group; the batch's new digests join the index.

    Texts are equal when they are equal without white space; null counts as empty. Of a group new to the index, the
    row with the most code points stays, then the smallest id (null last), then the first of repeated
    rows, so exactly one. Of a group already known, none does and keep_id is the indexed document.
    Result: doc_id, keep_id, group_size (rows of the batch plus those known when the digest was indexed), kept,
    text_sha256 and row, the batch's row number (``row_col`` if named). An empty batch gives an empty result.

    Texts are read once and never shuffled: digests are written out first. A hot group meets its index entry
    through (digest, salt) pairs that were counted before the shuffle, so it spreads over ``SALTS`` tasks.
    """
    batch, text = uuid.uuid4().hex, text_of(docs, text_col)
    rows = materialize(docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("points"),
        (docs[row_col] if row_col else F.monotonically_increasing_id()).alias("row")))
    rows = rows.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    order = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    pairs = materialize(rows.groupBy("digest", "salt").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")))
    groups = materialize(pairs.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("group_size")))
    index.append(groups.select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
        (-F.col("best.less")).alias("keep_points"), "group_size", F.lit(batch).alias("batch")))
    known = index.read().select("digest", "keep_id", "keep_row", "batch", F.col("group_size").alias("known"))
    found = groups.select("digest", "group_size").join(known.hint("merge"), "digest").select(
        "digest", "keep_id", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row"),
        (F.col("group_size") + F.when(F.col("batch") == batch, 0).otherwise(F.col("known"))).alias("group_size"))
    members = pairs.select("digest", "salt").join(found, "digest")
    return rows.join(members, ["digest", "salt"]).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "row")


def new_index(docs: DataFrame, id_col: str = "doc_id", path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """An index in ``path`` (default: a new shared folder). Buckets: as many as the session's shuffle partitions."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, path or shared_folder(spark, "digest-index"), type_of(docs, id_col).simpleString(),
                       buckets).open()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup`` of one batch against an index that starts empty."""
    return dedup(docs, new_index(docs, id_col), id_col, text_col).drop("row")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns as they are."""
    safe, name = plain(docs)
    rows = numbered(safe)
    kept = dedup(rows, new_index(safe, name[id_col]), name[id_col], name[text_col], ROW).where("kept")
    return rows.join(kept.select(F.col("row").alias(ROW)), ROW, "left_semi").select(*safe.columns).toDF(*docs.columns)
