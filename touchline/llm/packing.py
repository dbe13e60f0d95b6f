"""Best-fit packing by bin completion: few sequences of bounded length, with pieces whole."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from touchline.llm.common import per_worker, text_of
from touchline.session import materialize

CAPACITY = 4096
#: Pieces packed together, about. Each such group loses less than one sequence to its last, unfilled one.
GROUP_ROWS = 20_000
#: Steps of one batch of fillings, and of one group's whole search. ``STEPS`` bounds the effort, not the pieces: a search that
#: ends early keeps its best-fit solution.
FILLINGS, STEPS = 400, 250_000
WORDS_KEPT = 500_000
#: The id at the end of each document.
END = array("I", [1]).tobytes()
MARKS = (".", ",")


class WordIds:
    """Ids of the words between spaces and line ends, as the tokenizer gives them for whole texts.

    The tokenizer drops white space and never joins across it, so words can be encoded apart and kept.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # lower-cased words may spell a special token that the text does not hold
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("special tokens that take in what stands beside them are not supported")
        #: Special tokens by their strings; no word has a line end, so theirs are free for their places among the words.
        self.special = {t.content: f"\n{i}" for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.places = {f"\n{i}": array("I", [i]).tobytes() for i in added}
        self.known: dict[str, bytes] = dict(self.places)

    def _learn(self, new: set[str]) -> None:
        """Encode words: those that are letters and one mark are their letters' ids and the mark's."""
        marked = {w for w in new if w[-1:] in MARKS and w[:-1].isalpha()}
        listed = list((new - marked | {w[:-1] for w in marked}).difference(self.known) | set(MARKS).difference(self.known))
        for word, encoding in zip(listed, self.tokenizer.encode_batch_fast(listed, add_special_tokens=False)):
            self.known[word] = array("I", encoding.ids).tobytes()
        for word in marked:
            self.known[word] = self.known[word[:-1]] + self.known[word[-1]]

    def _words(self, text: str) -> list[str]:
        if self.cut and any(mark in text for mark in self.special):
            parts = self.cut.split(text)
            return [w for i, part in enumerate(parts) for w in ([self.special[part]] if i % 2 else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return text.encode().lower().decode().replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, each followed by the end id.

        A-Z are lower-cased first, as the tokenizer does too, which makes more words alike. Strings of special tokens part the text
        before that, and are those tokens, as the tokenizer has it.
        """
        words = [self._words(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known = dict(self.places)
            new = set().union(*words).difference(self.known)
        if new:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, w)) + END for w in words]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces of at most ``capacity`` ids; only documents that are longer are cut.

    A null or empty text is one piece with the end id alone. Repeated rows each have pieces.
    """
    source = docs.select(docs[f"`{id_col}`"].alias("doc_id"), text_of(docs, text_col).alias("text"))
    added = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(added).fields])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(f"words {vocabulary}", lambda: WordIds(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "ids")}
                for row, ids in enumerate(words.encode(part.column(1).to_pylist())):
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start:4 * (start + capacity)]
                        rows.append(row)
                        for k, x in zip(out, (n, start, len(cut) // 4, zlib.crc32(cut), cut)):
                            out[k].append(x)
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32()),
                          *[pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(out["ids"], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(pieces, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing over lengths in falling order: each goes where the least room stays."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in lengths:
        i = bisect_left(rooms, (x, -1))
        if i == len(rooms):
            bins.append([x])
            insort(rooms, (capacity - x, len(bins) - 1))
        else:
            room, b = rooms.pop(i)
            bins[b].append(x)
            insort(rooms, (room - x, b))
    return bins


@dataclass
class Effort:
    """Steps a search may still take."""

    left: int


def fillings(sizes: list[int], counts: dict[int, int], room: int, batch: int = FILLINGS, effort: Effort | None = None,
             ) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """Undominated fillings of ``room`` as (waste, lengths), all of them in the end: found ``batch`` steps at a time, each batch the
    least waste first, None for a batch that found nothing. A batch ends early with a filling without waste.

    ``sizes`` are the lengths at hand in falling order; the search may change them and ``counts`` between two fillings if it puts them back.
    A filling is dominated when one of its lengths can give way to a longer one at hand that still fits, or when anything more fits.
    """
    looked, found, effort = 0, [], effort or Effort(1 << 60)

    def first_fit(limit: int) -> int:
        return len(sizes) - bisect_left(sizes[::-1], limit + 1)

    stack: list[tuple[int, int, tuple[int, ...]]] = [(first_fit(room), room, ())]
    while stack and effort.left > 0:
        i, left, chosen = stack.pop()
        looked += 1
        effort.left -= 1
        while i < len(sizes) and chosen.count(sizes[i]) >= counts[sizes[i]]:
            i += 1
        if i == len(sizes) or not left:
            rising = sizes[::-1]
            smaller = next((s for s in rising if s <= left and chosen.count(s) < counts[s]), None) if left else None
            if smaller is None:
                swap = any((j := bisect_left(rising, x + 1)) < len(rising) and any(
                    chosen.count(y) < counts[y] for y in rising[j:bisect_left(rising, x + left + 1)]) for x in set(chosen)) if left else False
                if not swap:
                    found.append((left, chosen))
        else:
            size = sizes[i]
            skip = max(i + 1, first_fit(left))
            stack.append((skip, left, chosen))
            stack.append((max(i, first_fit(left - size)), left - size, (*chosen, size)))
        if looked >= batch or found and not found[-1][0]:
            yield from sorted(found) or [None]
            looked, found = 0, []
    yield from sorted(found)


def complete_bins(lengths: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Bin completion: around the longest length left, try undominated fillings, the least waste of a batch first.

    Best fit decreasing is the first incumbent. Waste may not exceed what one bin fewer than the incumbent allows; a
    branch beyond that is cut, and no other. Fillings are enumerated as they are asked for. The search goes depth first and ends at
    the lower bound, when all is tried, or after ``steps`` steps of enumeration.
    """
    lengths = sorted(lengths, reverse=True)
    best, total = best_fit(lengths, capacity), sum(lengths)
    bound = -(-total // capacity)
    if not lengths:
        return []
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    sizes, effort = sorted(counts, reverse=True), Effort(steps)

    def take(chosen: tuple[int, ...], sign: int) -> None:
        for x in chosen:
            had = counts.get(x, 0)
            counts[x] = had - sign
            if sign > 0 and had == 1:
                del sizes[len(sizes) - 1 - bisect_left(sizes[::-1], x)]
            elif sign < 0 and had == 0:
                insort(sizes, x, key=lambda y: -y)

    while len(best) > bound and effort.left > 0:
        allowed = (len(best) - 1) * capacity - total
        bins: list[tuple[int, ...]] = []
        levels: list[tuple[int, Iterator[tuple[int, tuple[int, ...]] | None], int]] = []  # first, fillings left to try, waste so far
        waste, solved = 0, False
        while effort.left > 0 or not sizes:
            if not sizes:
                solved = True
                break
            first = sizes[0]
            levels.append((first, fillings(sizes, counts, capacity - first, effort=effort), waste))
            option = None
            while levels and effort.left > 0:
                first, options, waste = levels[-1]
                take((first,), 1)  # the first is taken while its fillings are enumerated
                # Batches without a filling that wastes little enough give way to the next.
                option = next((f[1] for f in options if f and waste + f[0] <= allowed), None)
                take((first,), -1)
                if option is not None:
                    break
                levels.pop()
                if bins and levels:
                    take(bins.pop(), -1)
            if not levels or option is None:
                break
            take((first, *option), 1)
            bins.append((first, *option))
            waste += capacity - sum(bins[-1])
        if not solved:
            break
        best = [list(b) for b in bins]
        for b in bins:
            take(b, -1)
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces (``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Pieces that fill a sequence get one of their own; the others are dealt evenly into groups of about
    ``group_rows``, and each group is packed by bin completion, so one task holds a bounded number of lengths.
    Equal lengths are interchangeable; which of them stands where follows the rows' order.
    """
    rows = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    short = rows.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_rows))
    full = rows.where(F.col("length") >= capacity).select(
        "*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_group"].iloc[0])
        pdf = pdf.sort_values(["length", "_row"], kind="stable")
        at: dict[int, list[int]] = {}
        for i, x in enumerate(pdf["length"].tolist()):
            at.setdefault(x, []).append(i)
        sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for b, chosen in enumerate(complete_bins(pdf["length"].tolist(), capacity)):
            filled = 0
            for x in chosen:
                i = at[x].pop()
                sequence[i], offset[i] = (group << 32) + b, filled
                filled += x
        return pd.DataFrame({"_row": pdf["_row"].to_numpy(), "sequence_id": sequence, "offset": offset})

    placed = (short.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int").alias("_group"))
              .groupBy("_group").applyInPandas(fill, "_row long, sequence_id long, offset long"))
    return full.unionByName(short.join(placed, "_row")).drop("_row")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as pieces in sequences. ``with_ids`` adds each piece's ids (little-endian unsigned 32-bit).

    A null or empty text is one piece of one id; equal lengths and repeated rows are each packed; an empty table gives
    an empty result; columns other than the id and the text are not read.
    """
    return pack(tokenized_pieces(docs, vocabulary, capacity, id_col, text_col, with_ids), capacity)
