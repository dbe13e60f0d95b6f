"""Repeated passages by a distributed merge sort of suffixes that never compares known prefixes again."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from touchline.llm.common import shared_folder, text_of
from touchline.session import materialize

#: Bytes of a string that counts as a passage, and of the grams that choose the suffixes to sort.
LENGTH, GRAM = 200, 64
#: Starts of one numpy segment; places in a segment fit the low bits of a key.
SEGMENT = 1 << 19
PLACE_BITS = 20
#: Anchors matched inside a task before the others are shuffled; suffixes of a sorted run, of its blocks and of a merged part.
CHUNK_ANCHORS, RUN_ROWS, BLOCK_ROWS, PART_ROWS = 500_000, 60_000, 256, 20_000
#: Block keys drawn to choose where parts begin: so many per part, and so many at least. The driver holds them: about 0.1 MB per 2.5 M
#: contexts, which is the scale at which this operator ends (a gigabyte of them at some 2 TB of text).
DRAWS_PER_PART, SPLIT_SAMPLE = 8, 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every place, by doubling: two neighbouring halves make a whole."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        left, right = h[:-width], h[width:]
        h = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (right ^ (right >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        width *= 2
    return h ^ (h >> np.uint64(31))


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first start, last start): each string of ``LENGTH`` bytes chooses the place of its least gram,
    the leftmost of equals; a place stands with the run of starts that chose it.

    The choice depends on the string alone, so equal strings choose the same place in them, wherever they stand.
    """
    array, span = np.frombuffer(data, np.uint8), LENGTH - GRAM + 1
    found = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)]
    for begin in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = array[begin:begin + SEGMENT + LENGTH - 1]
        hashes = gram_hashes(part)
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least, width = keys, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        starts = len(part) - LENGTH + 1
        least = np.minimum(least[:starts], least[span - width:span - width + starts])
        chosen = (least & low).astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        place = chosen[change]
        last = np.append(change[1:], starts) - 1
        found.append((hashes[place], place + begin, change + begin, last + begin))
    return tuple(map(np.concatenate, zip(*found)))


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts of at least ``LENGTH`` bytes, each once, with the number of its copies; bucketed and sorted by their id (half
    of their SHA-256), so later joins by id leave the texts where they are."""
    spark, text = docs.sparkSession, text_of(docs, text_col)
    name = f"suffix_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(text.alias("text")).where(F.octet_length("text") >= LENGTH).withColumn(
        "id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).substr(1, 16))
    (texts.groupBy("id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
     .write.bucketBy(buckets, "id").sortBy("id").option("path", shared_folder(spark, "suffix-texts")).saveAsTable(name))
    return spark.table(name)


def candidate_anchors(texts: DataFrame) -> DataFrame:
    """(id, places): the anchors whose gram stands elsewhere too, by their hash.

    What repeats inside a chunk is settled there; the rest sends one row per gram and chunk, so a passage that a third of
    all texts share has as many rows to meet as there are chunks, not texts.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ids: list[bytes] = []
        count = 0

        def settle() -> Iterator[pa.RecordBatch]:
            h, place, low, high = map(np.concatenate, zip(*held))
            owner = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            packed = place << 16 | (place - high) << 8 | (place - low)  # offsets of the place in its strings, least and most
            order = np.argsort(h, kind="stable")
            h, owner, packed = h[order].view(np.int64), owner[order], packed[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            random = (packed * -7046029254386353131) ^ (owner.astype(np.int64) * 0x2545F4914F6CDD1D)
            rows = np.concatenate((np.flatnonzero(alone), np.flatnonzero(first & ~alone), np.flatnonzero(~alone)))
            kinds = np.repeat(np.array([0, 1, 2], np.int8), (alone.sum(), (first & ~alone).sum(), (~alone).sum()))
            keys = np.where(kinds == 2, random[rows], h[rows])
            names = pa.array(ids, pa.binary())
            for at in range(0, len(rows), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[cut]), pa.array(kinds[cut]), names.take(pa.array(owner[rows[cut]])), pa.array(packed[rows[cut]])],
                    names=["key", "kind", "id", "place"])

        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                found = anchors(text.as_py().encode())
                held.append(found)
                ids.append(ident.as_py())
                count += len(found[0])
                if count >= CHUNK_ANCHORS:
                    yield from settle()
                    held, ids, count = [], [], 0
        if held:
            yield from settle()

    found = texts.select("id", "text").mapInArrow(scan, "key long, kind byte, id binary, place long")
    same = F.count(F.lit(1)).over(Window.partitionBy("key", F.col("kind") == 2))
    return found.withColumn("n", same).where("kind = 2 OR (kind = 0 AND n > 1)").groupBy("id").agg(
        F.collect_list("place").alias("places"))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    most = min(len(a), len(b))
    while known < most and a[known:known + 32] == b[known:known + 32]:
        known += 32
    known = min(known, most)
    while known < most and a[known] == b[known]:
        known += 1
    return known


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted keys as lengths of the prefix shared with the one before, lengths of the rests, and the rests."""
    shared = [0, *(common_prefix(a, b, 0) for a, b in zip(keys, keys[1:]))]
    rests = [k[s:] for k, s in zip(keys, shared)]
    return np.array(shared, np.uint16).tobytes(), np.array([len(r) for r in rests], np.uint16).tobytes(), b"".join(rests)


def front_decode(shared: bytes, lengths: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, length of the prefix shared with the one before)."""
    key, at = b"", 0
    for s, n in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(lengths, np.uint16).tolist()):
        key, at = key[:s] + rests[at:at + n], at + n
        yield key, s


class LoserTree:
    """Merges sorted runs of (key, prefix shared with the key before in the run, item).

    Each key that lost keeps the length of the prefix it shares with its winner. Of two keys measured against the same winner,
    the one that shares more comes first; only at equal lengths bytes are compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.runs = runs
        self.keys: list[bytes | None] = [None] * self.size
        self.shared, self.items = [0] * self.size, [None] * self.size
        for i in range(len(runs)):
            self._next(i)
            self.shared[i] = 0
        self.losers = [0] * self.size
        winners = list(range(self.size))
        node = self.size
        while len(winners) > 1:
            node -= len(winners) // 2
            played = [self._play(a, b) for a, b in zip(winners[::2], winners[1::2])]
            self.losers[node:node + len(played)] = [b for _, b in played]
            winners = [a for a, _ in played]
        self.winner = winners[0]

    def _next(self, i: int) -> None:
        self.keys[i], self.shared[i], self.items[i] = next(self.runs[i], (None, 0, None))

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.keys[a], self.keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        s, t = self.shared[a], self.shared[b]
        if s != t:
            return (a, b) if s > t else (b, a)
        same = common_prefix(x, y, s)
        if x[same:same + 1] <= y[same:same + 1]:
            self.shared[b] = same
            return a, b
        self.shared[a] = same
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[self.winner] is not None:
            w = self.winner
            yield self.keys[w], self.shared[w], self.items[w]
            self._next(w)
            node = (w + self.size) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


RUNS = ("chunk long, block int, first binary, last binary, shared binary, lengths binary, rests binary, least binary, most binary, "
        "many binary, base long, ids binary, owners binary, places binary, numbers binary")


def sorted_runs(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per chunk of texts, the distinct contexts of its candidate anchors as a sorted, front-coded run in blocks, and one
    row (block -1) that tells which texts and places each context stands at.

    A context is the suffix from the anchor, as far as its strings reach, then what stands before it, backwards.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        known: dict[tuple[bytes, int, int], int] = {}
        counts: list[int] = []
        ids: list[bytes] = []
        refs: list[tuple[int, int, int]] = []
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in RUNS.split(", "))])

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 24 | number
            listed = list(known)
            order = sorted(range(len(listed)), key=listed.__getitem__)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rows = []
            for block, at in enumerate(range(0, len(order), BLOCK_ROWS)):
                cut = order[at:at + BLOCK_ROWS]
                keys = [listed[i][0] for i in cut]
                shared, lengths, rests = front_code(keys)
                rows.append({"chunk": chunk, "block": block, "first": keys[0], "last": keys[-1], "shared": shared,
                             "lengths": lengths, "rests": rests, "base": at,
                             "least": np.array([listed[i][1] for i in cut], np.uint8).tobytes(),
                             "most": np.array([listed[i][2] for i in cut], np.uint8).tobytes(),
                             "many": np.array([min(counts[i], 2) for i in cut], np.uint8).tobytes()})
            context, owner, place = np.array(refs, np.int64).reshape(-1, 3).T
            rows.append({"chunk": chunk, "block": -1, "ids": b"".join(ids), "owners": owner.astype(np.int32).tobytes(),
                         "places": place.tobytes(), "numbers": rank[context].astype(np.int32).tobytes()})
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[at:at + 64], schema=schema)

        for batch in batches:
            for ident, text, places in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                owner = len(ids)
                ids.append(ident.as_py())
                for packed in places.as_py():
                    place, least, most = packed >> 16, packed >> 8 & 255, packed & 255
                    key = (data[place:place - least + LENGTH] + data[place - most:place][::-1], least, most)
                    context = known.setdefault(key, len(known))
                    if context == len(counts):
                        counts.append(0)
                    counts[context] += 1
                    refs.append((context, owner, place))
                if len(known) >= RUN_ROWS or len(refs) >= 8 * RUN_ROWS:
                    yield from flush()
                    known, counts, ids, refs, number = {}, [], [], [], number + 1
        if refs:
            yield from flush()

    joined = texts.select("id", "text").join(candidates, "id")
    return materialize(joined.mapInArrow(build, RUNS))


def choose_parts(runs: DataFrame, part_rows: int, sample: int) -> tuple[list[bytes], set[bytes]]:
    """Keys at which parts begin, and grams so common that parts begin inside them.

    Elsewhere a part begins with a whole gram, so the contexts that can hold equal strings meet in one part.
    """
    blocks = runs.where("block >= 0")
    total = blocks.agg(F.coalesce(F.sum(F.length("many")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_rows))
    wanted = max(sample, DRAWS_PER_PART * parts)  # so a part's size stays what it is, however many there are
    drawn = sorted(r[0] for r in blocks.select("first").orderBy(F.xxhash64("chunk", "block")).limit(wanted).collect())
    picks = [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []
    # A gram is common when it fills more than a part: it has more than a part's share of the draws.
    grams, share = Counter(p[:GRAM] for p in drawn), len(drawn) / parts
    hot = {g for g in {p[:GRAM] for p in picks} if grams[g] > max(share, 1)}
    return sorted({p if p[:GRAM] in hot else p[:GRAM] for p in picks}), hot


def repeated_offsets(group: list[tuple[bytes, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Of contexts (key, least, most, occurrences up to 2) that share their gram: runs of offsets at which the string
    also stands elsewhere."""
    if len(group) == 1:
        _, least, most, many = group[0]
        return [[(least, most)] if many > 1 else []]
    halves = [(key[:LENGTH - least], key[LENGTH - least:][::-1]) for key, least, _, _ in group]
    found: list[list[tuple[int, int]]] = [[(least, most)] if many > 1 else [] for _, least, most, many in group]
    single = [i for i, c in enumerate(group) if c[3] == 1]
    for offset in range(min((group[i][1] for i in single), default=0), max((group[i][2] for i in single), default=-1) + 1):
        strings = [(i, halves[i][1][len(halves[i][1]) - offset:] + halves[i][0][:LENGTH - offset])
                   for i, c in enumerate(group) if c[1] <= offset <= c[2]]
        counts = Counter(s for _, s in strings)
        for i, s in strings:
            if group[i][3] == 1 and counts[s] > 1:
                if found[i] and found[i][-1][1] == offset - 1:
                    found[i][-1] = (found[i][-1][0], offset)
                else:
                    found[i].append((offset, offset))
    return found


PIECES = "part int, chunk long, base long, shared binary, lengths binary, rests binary, least binary, most binary, many binary"
PIECE_COLUMNS = [field.split()[0] for field in PIECES.split(", ")]
VERDICTS = "chunk long, numbers array<int>, least array<int>, most array<int>, string binary, many int"


def merge_parts(runs: DataFrame, part_rows: int | None = None, sample: int | None = None) -> DataFrame:
    """Per chunk and context, runs of offsets whose strings also stand elsewhere; from merging all runs part by part.

    Parts hold about ``part_rows`` contexts by sampled splitters. Contexts of a gram that parts begin inside give a digest row per string
    instead, which the caller counts over all parts.
    """
    splits, hot = choose_parts(runs, PART_ROWS if part_rows is None else part_rows, SPLIT_SAMPLE if sample is None else sample)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks cut where parts begin, so each context goes to one part."""
        for pdf in frames:
            rows = []
            for b in pdf.itertuples():
                shared, lengths = np.frombuffer(b.shared, np.uint16), np.frombuffer(b.lengths, np.uint16)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts: list[tuple[int, bytes, int]] = []  # place, key, part
                if bisect_right(splits, b.first) == bisect_right(splits, b.last):
                    starts.append((0, b.first, bisect_right(splits, b.first)))
                else:
                    for n, (key, _) in enumerate(front_decode(b.shared, b.lengths, b.rests)):
                        part = bisect_right(splits, key)
                        if not starts or starts[-1][2] != part:
                            starts.append((n, key, part))
                for (n, key, part), stop in zip(starts, [*(x[0] for x in starts[1:]), len(shared)]):
                    piece_shared, piece_lengths = shared[n:stop].copy(), lengths[n:stop].copy()
                    piece_shared[0], piece_lengths[0] = 0, len(key)  # the first key of a piece stands whole
                    rows.append((part, b.chunk, b.base + n, piece_shared.tobytes(), piece_lengths.tobytes(),
                                 key + b.rests[ends[n]:ends[stop - 1]], b.least[n:stop], b.most[n:stop], b.many[n:stop]))
            yield pd.DataFrame(rows, columns=PIECE_COLUMNS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, tuple[list, list, list]] = {}
        rows: list[tuple] = []

        def run(pieces: pd.DataFrame) -> Iterator[tuple]:
            before = b""
            for b in pieces.sort_values("base").itertuples():
                limits = zip(*(np.frombuffer(x, np.uint8).tolist() for x in (b.least, b.most, b.many)))
                for n, ((key, shared), limit) in enumerate(zip(front_decode(b.shared, b.lengths, b.rests), limits)):
                    yield key, shared if n else common_prefix(before, key, 0), (b.chunk, b.base + n, *limit)
                    before = key

        def settle(group: list[tuple[bytes, tuple]]) -> None:
            if group[0][0][:GRAM] in hot:
                for key, (chunk, number, least, most, many) in group:
                    right, left = key[:LENGTH - least], key[LENGTH - least:][::-1]
                    for o in range(least, most + 1):
                        digest = hashlib.blake2b(left[len(left) - o:] + right[:LENGTH - o], digest_size=16).digest()
                        rows.append((chunk, [number], [o], [o], digest, many))
                return
            merged: dict[tuple, list] = {}
            for key, (chunk, number, least, most, many) in group:
                known = merged.setdefault((key, least, most), [0, []])
                known[0] += many
                known[1].append((chunk, number))
            contexts = [(key, least, most, min(2, many)) for (key, least, most), (many, _) in merged.items()]
            for spans, (_, places) in zip(repeated_offsets(contexts), merged.values()):
                for a, b in spans:
                    for chunk, number in places:
                        numbers, froms, tos = out.setdefault(chunk, ([], [], []))
                        numbers.append(number)
                        froms.append(a)
                        tos.append(b)

        group: list[tuple[bytes, tuple]] = []
        for key, shared, item in LoserTree([run(x) for _, x in pdf.groupby("chunk")]):
            if group and shared < GRAM:
                settle(group)
                group = []
            group.append((key, item))
        if group:
            settle(group)
        rows += [(chunk, *lists, None, 0) for chunk, lists in out.items()]
        return pd.DataFrame(rows, columns=["chunk", "numbers", "least", "most", "string", "many"])

    blocks = runs.where("block >= 0").select("chunk", "first", "last", "shared", "lengths", "rests", "least", "most", "many", "base")
    return blocks.mapInPandas(cut, PIECES).groupBy("part").applyInPandas(merge, VERDICTS)


def repeated_spans(docs: DataFrame, text_col: str = "text", part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the distinct texts, and per id of a text that has any, ``spans``: the merged byte ranges to remove."""
    texts = distinct_texts(docs, text_col)
    runs = sorted_runs(texts, candidate_anchors(texts))
    verdicts = materialize(merge_parts(runs, part_rows))
    strings = verdicts.where("string IS NOT NULL")
    common = strings.groupBy("string").agg(F.sum("many").alias("n")).where("n > 1").select("string")
    settled = verdicts.where("string IS NULL").select("chunk", "numbers", "least", "most").union(
        strings.join(common, "string").select("chunk", "numbers", "least", "most"))

    def expand(refs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(refs) and len(found):
            ref = refs.iloc[0]
            numbers, least, most = (np.concatenate(found[c].to_numpy()).astype(np.int64) for c in ("numbers", "least", "most"))
            order = np.argsort(numbers, kind="stable")
            numbers, least, most = numbers[order], least[order], most[order]
            at = np.frombuffer(ref.numbers, np.int32)
            first, many = np.searchsorted(numbers, at), np.searchsorted(numbers, at, "right")
            many -= first
            each = np.repeat(np.arange(len(at)), many)
            which = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + first[each]
            place, owner = np.frombuffer(ref.places, np.int64)[each], np.frombuffer(ref.owners, np.int32)[each]
            start, end = place - most[which], place - least[which] + LENGTH
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order], end[order]
            for text in np.unique(owner).tolist():
                a, b = np.searchsorted(owner, text), np.searchsorted(owner, text, "right")
                reach = np.maximum.accumulate(end[a:b])
                opens = np.concatenate(([True], start[a + 1:b] > reach[:-1]))
                lasts = np.append(np.flatnonzero(opens)[1:] - 1, b - a - 1)
                rows.append((ref.ids[16 * text:16 * text + 16], start[a:b][opens].tolist(), reach[lasts].tolist()))
        return pd.DataFrame(rows, columns=["id", "starts", "ends"])

    spans = runs.where("block = -1").select("chunk", "ids", "owners", "places", "numbers").groupBy("chunk").cogroup(
        settled.groupBy("chunk")).applyInPandas(expand, "id binary, starts array<long>, ends array<long>")
    return texts, spans


REMOVED = "id binary, n_removed long, n_spans long, kept binary"


def without_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per text with spans: bytes removed, number of removed runs, and the bytes that stay."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for row in batch.slice(at, 64).to_pylist():
                    data = row["text"].encode()
                    edges = [0, *(x for pair in zip(row["starts"], row["ends"]) for x in pair), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((row["id"], len(data) - len(kept), len(row["starts"]), kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["id", "n_removed", "n_spans", "kept"])

    return texts.where("copies = 1").select("id", "text").join(spans, "id").mapInArrow(cut, REMOVED)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False,
                   part_rows: int = PART_ROWS) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, and a digest of what stays (``with_kept``: also the bytes).

    Every byte that lies in a string of ``LENGTH`` bytes which starts anywhere else too, in this document or another, is removed;
    strings are judged on the input. A text that has copies is one such string after another, so all of it goes. Null and
    empty texts have no bytes; texts shorter than ``LENGTH`` stay whole; an empty table gives an empty result.
    """
    text = text_of(docs, text_col)
    whole = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = materialize(docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), whole.alias("whole"),
                                   *([text.cast("binary").alias("bytes")] if with_kept else [])))
    texts, spans = repeated_spans(docs, text_col, part_rows)
    cut = without_spans(texts, spans).select(
        "id", "n_removed", "n_spans", F.unhex(F.sha2("kept", 256)).alias("digest"), *(["kept"] if with_kept else []))
    copied = texts.where("copies > 1").select(
        "id", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.unhex(F.sha2(F.lit("").cast("binary"), 256)).alias("digest"), *([F.lit("").cast("binary").alias("kept")] if with_kept else []))
    found = cut.union(copied)
    joined = rows.withColumn("id", F.col("whole").substr(1, 16)).join(found, "id", "left")
    touched = F.col("n_spans").isNotNull()
    return joined.select(
        "doc_id", "n_bytes", F.when(touched, F.coalesce("n_removed", "n_bytes")).otherwise(0).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.lower(F.hex(F.when(touched, F.col("digest")).otherwise(F.col("whole")))).alias("kept_sha256"),
        *([F.when(touched, F.col("kept")).otherwise(F.col("bytes")).alias("kept")] if with_kept else []))
