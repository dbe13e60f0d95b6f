"""SimHash near-duplicates: fingerprints linked by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from touchline.llm.common import ROW, numbered, plain, text_of
from touchline.llm.components import components
from touchline.session import materialize

WORDS, DISTANCE, SEED, BITS = 4, 4, 42, 64
#: Children of a node of the index.
FAN = 8
#: Pairs of nodes looked at in one step, which bounds memory.
STEP_PAIRS = 200_000
#: Fingerprints that one bucket holds before it is dealt again by a second key.
BUCKET_ROWS = 50_000
#: Fingerprints of small buckets that one call indexes, about.
DEAL_ROWS = 20_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority over the bits of the hashes of all shingles, repeats included; no words: zero."""
    parts = text.encode().lower().split()  # both know ASCII only: A-Z, and [\x20\x09-\x0D]
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    whole, digest, seed = b" ".join(parts), xxhash.xxh64_intdigest, SEED
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1:].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at:at + 8192]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, keep: dict[str, Column], words: int = WORDS) -> DataFrame:
    """The columns in ``keep`` and ``fp``, the fingerprint of the whole text as a signed 64-bit integer."""
    source = docs.select(*[c.alias(n) for n, c in keep.items()], text_of(docs, text_col).alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))],
                                             names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(hashed, schema)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order, where neighbours differ in one bit."""
    rank = values.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Distinct fingerprints in Gray order under levels of nodes.

    A node keeps the bits its members share: where ``ones`` and ``zeros`` agree the pattern is fixed, the rest is
    masked out. Two nodes differ at least in the bits that are fixed and unlike, and at most in all that are not
    fixed alike, so whole groups are cut or linked without looking at their members.
    """

    def __init__(self, values: np.ndarray, fan: int = FAN) -> None:
        values = np.unique(values.astype(np.uint64))
        self.values, self.fan = values[np.argsort(gray_rank(values), kind="stable")], fan
        self.shared, self.any = [self.values], [self.values]  # by level: the conjunction and the union of the members
        while len(self.shared[-1]) > 1:
            starts = np.arange(0, len(self.shared[-1]), fan)
            self.shared.append(np.bitwise_and.reduceat(self.shared[-1], starts))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], starts))

    def _children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of each node, and to which of ``node`` each belongs."""
        first = node * self.fan
        many = np.minimum(first + self.fan, len(self.shared[level - 1])) - first
        owner = np.repeat(np.arange(len(node)), many)
        return first[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), owner

    def links(self, distance: int = DISTANCE) -> np.ndarray:
        """Root of each value of ``values``, as its place, under links of at most ``distance`` differing bits."""
        parent = np.arange(len(self.values))
        top = len(self.shared) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, left, right = stack.pop()
            if len(left) > STEP_PAIRS:
                stack.append((level, left[STEP_PAIRS:], right[STEP_PAIRS:]))
                left, right = left[:STEP_PAIRS], right[:STEP_PAIRS]
            a1, b1, a0, b0 = self.shared[level][left], self.shared[level][right], self.any[level][left], self.any[level][right]
            near = np.bitwise_count((a1 & ~b0) | (b1 & ~a0)) <= distance
            left, right = left[near], right[near]
            most = np.bitwise_count((a0 | b0)[near] & ~(a1 & b1)[near])
            linked = most <= distance
            if level == 0:
                parent = self._join(parent, left[left != right], right[left != right])
                continue
            if linked.any():
                span = self.fan ** level
                for node in (left[linked], right[linked]):  # each group hangs on its first member
                    for n in np.unique(node).tolist():
                        members = np.arange(n * span, min((n + 1) * span, len(parent)))
                        parent = self._join(parent, members, np.full(len(members), members[0]))
                parent = self._join(parent, left[linked] * span, right[linked] * span)
                left, right = left[~linked], right[~linked]
            if len(left):
                left, right = self._apart(level, parent, left, right)
            if not len(left):
                continue
            children, owner = self._children(level, left)
            others, pair = self._children(level, right[owner])
            first, second = children[pair], others
            once = (left[owner][pair] != right[owner][pair]) | (first <= second)
            stack.append((level - 1, first[once], second[once]))
        return parent

    def _apart(self, level: int, parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leave out pairs of nodes all of whose members are in one component already."""
        span = self.fan ** level
        starts = np.arange(0, len(parent), span)
        low, high = np.minimum.reduceat(parent, starts), np.maximum.reduceat(parent, starts)
        keep = ~((low[left] == high[left]) & (low[right] == high[right]) & (low[left] == low[right]))
        return left[keep], right[keep]

    @staticmethod
    def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Union of the pairs: smaller roots spread along them until nothing moves."""
        while len(a):
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        return parent


def _pieces(parts: int, width: int) -> list[tuple[int, int]]:
    """``parts`` runs of bits over ``width`` as (first bit, bits)."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _field(column: str, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << bits) - 1))


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp) with at most ``distance`` differing bits, directly or by others.

    Of ``distance`` + 1 runs of bits, two linked fingerprints have one in common, so each run deals the
    fingerprints into buckets and linked ones meet in one. Each bucket is indexed in Gray order and gives a star per
    component, never all pairs. A bucket beyond ``bucket_rows`` is dealt again: its members share a run, so of the
    other bits, cut into ``distance`` + 1 runs again, they have another in common.
    """
    runs = _pieces(distance + 1, BITS)
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("run"), _field("fp", a, n).alias("part")) for i, (a, n) in enumerate(runs)])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.run", "k.part")
    sizes = materialize(dealt.groupBy("run", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    large = sizes.where(F.col("n") > bucket_rows).select("run", "part")
    usual = dealt.join(sizes.where(F.col("n") <= bucket_rows).select("run", "part"), ["run", "part"]).select(
        "fp", "run", "part", F.lit(-1).cast("long").alias("sub"), F.lit(0).cast("long").alias("rest"))

    def others(i: int) -> Column:
        first, bits = runs[i]
        low = F.col("fp").bitwiseAND(F.lit((1 << first) - 1))
        high = F.shiftrightunsigned("fp", first + bits) if first + bits < BITS else F.lit(0).cast("long")
        packed = low.bitwiseOR(F.shiftleft(high, first))
        return F.array(*[F.struct(F.lit(j).cast("long").alias("sub"), F.shiftrightunsigned(packed, a).bitwiseAND(
            F.lit((1 << n) - 1)).alias("rest")) for j, (a, n) in enumerate(_pieces(distance + 1, BITS - bits))])

    again = F.element_at(F.array(*[others(i) for i in range(len(runs))]), (F.col("run") + 1).cast("int"))
    split = dealt.join(large, ["run", "part"]).select("fp", "run", "part", F.explode(again).alias("k")).select(
        "fp", "run", "part", "k.sub", "k.rest")

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, values = pdf[["run", "part", "sub", "rest"]].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        order = np.lexsort(keys.T)
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        found = [(np.zeros(0, np.int64),) * 2]
        for first, end in zip(starts, [*starts[1:], len(values)]):
            if end - first > 1:
                index = GrayIndex(values[first:end])
                roots, signed = index.links(distance), index.values.view(np.int64)
                moved = np.flatnonzero(roots != np.arange(len(roots)))
                found.append((signed[moved], signed[roots[moved]]))
        a, b = map(np.concatenate, zip(*found))
        return pd.DataFrame({"a": a, "b": b})

    dealt_rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deals = F.lit(max(1, dealt_rows // DEAL_ROWS))
    keyed = usual.union(split).withColumn("deal", F.pmod(F.xxhash64("run", "part", "sub", "rest"), deals))
    return keyed.groupBy("deal").applyInPandas(stars, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   distance: int = DISTANCE, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest id among the rows reachable over links), and ``keep``.

    A text is its words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; shingles are ``words`` words long, a shorter text is one
    shingle, and one without words (null, empty, blank) has fingerprint zero and is linked like any other. Copies
    are linked through their common fingerprint. Null ids come last among ids; where a component has no other, its
    id is null. Repeated rows are each returned; an empty table gives an empty result.
    """
    rows = materialize(with_fingerprints(docs, text_col, {"doc_id": docs[f"`{id_col}`"], **(keep or {})}, words))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(distinct.select("fp"), distance))
    rooted = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return simhash_groups(docs, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, the first of repeated rows."""
    safe, name = plain(docs)
    rows = numbered(safe)
    found = simhash_groups(rows, name[id_col], name[text_col], keep={"row": rows[ROW]})
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("row").alias(ROW))
    return rows.join(first.select(ROW), ROW, "left_semi").select(*safe.columns).toDF(*docs.columns)
