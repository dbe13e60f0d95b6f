"""Tokens of two tokenizers linked where their bytes overlap, and how many documents hold each linked pair of ids.

Both tokenizers encode the whole text. A place where a token of each begins with a space, so that both had ended right before it, is
an anchor, verified by the tokens' bytes. Anchors cut a document into windows, mostly one word long; a window's alignment depends
on its ids alone, so it is worked out once per tuple of ids and remembered.

Documents are dealt in chunks. A chunk sends its distinct pairs with their document counts to the pair's part, which adds them up;
the highest count per id of the first tokenizer is one number per id of its vocabulary. The sums go back to the chunks.
"""

from __future__ import annotations

import hashlib
import math
import os
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from touchline.llm.blocks import cuts, names_of, pack, spread, unpack
from touchline.llm.common import per_worker, text_of, tidy_shuffles, type_of
from touchline.session import materialize

CHUNK_CHARS = 4_000_000
PART_PAIRS = 250_000
#: Windows kept from chunk to chunk, about; those of more than so many ids hardly come again and are not remembered.
WINDOWS_KEPT, WINDOW_IDS = 500_000, 48


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokens:
    """Bytes of each id, their numbers, and which begin with a space."""

    def __init__(self, of: list[bytes]) -> None:
        self.of = of
        self.sizes = np.array([len(b) for b in of], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in of], bool)


class First:
    """A byte-level vocabulary of the tokenizers library.

    Where ids follow the merges, as they do in the vocabularies of this family, merging by id is the same and tiktoken does it several
    times as fast; else the library itself encodes. Special tokens are ordinary text either way.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import json

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.of = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.of[i] = bytes(letters[c] for c in name)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab[x + y] for x, y in pairs]
        if ids == sorted(set(ids)) and len(ids) + 256 == len(vocab):
            import tiktoken

            encoder = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(self.of)}, special_tokens={})
            self.encode = lambda texts: [encoder.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


class Pair:
    """Both tokenizers and the remembered windows: a window is a number, under which its alignment is kept."""

    def __init__(self, first: str, second: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self.a = First(first, pattern)
        self.first = Tokens(self.a.of)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.second = Tokens([self._piece(i) for i in range(self.b.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.fresh: list[tuple[bytes, bytes]] = []  # numbered, to be aligned all at once
        self.groups, self.texts = array("I"), []
        self.pairs: dict[int, int] = {}  # first id << 32 | second id -> its number
        self.links, self.ends = array("I"), array("Q", [0])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of ``" " + text`` by the first and of the text by the second, which adds the space; none where bytes differ."""
        none = np.zeros(0, np.uint32)
        for text, a, b in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts, num_threads=1)):
            whole = (" " + text).encode()
            if text and b"".join(map(self.first.of.__getitem__, a)) == whole == b"".join(map(self.second.of.__getitem__, b)):
                yield np.array(a, np.uint32), np.array(b, np.uint32)
            else:
                yield none, none

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The numbers of a document's windows in order."""
        if not len(a):
            return []
        size_a, size_b = self.first.sizes[a], self.second.sizes[b]
        from_a, from_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        marked_a, marked_b = np.flatnonzero(self.first.spaced[a]), np.flatnonzero(self.second.spaced[b])
        _, at_a, at_b = np.intersect1d(from_a[marked_a], from_b[marked_b], assume_unique=True, return_indices=True)
        # The text's own first token is an anchor too.
        cut_a, cut_b = (4 * np.append(m[at], len(x)) for m, at, x in ((marked_a, at_a, a), (marked_b, at_b, b)))
        cut_a, cut_b = (np.unique(np.append(0, c)).tolist() for c in (cut_a, cut_b))
        data_a, data_b, known = a.tobytes(), b.tobytes(), self.known
        keys = [(data_a[i:j], data_b[k:n]) for i, j, k, n in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        found = list(map(known.get, keys))
        if None in found:
            number = len(self.texts) + len(self.fresh)
            for at, key in enumerate(keys):
                if found[at] is None:
                    again = known.get(key)
                    if again is None:
                        again, number = number, number + 1
                        self.fresh.append(key)
                        if len(key[0]) + len(key[1]) <= 4 * WINDOW_IDS:
                            known[key] = again
                    found[at] = again
        return found

    def learn(self) -> None:
        """Align the fresh windows. Both sides of a window have as many bytes, so all of them are aligned as one long text: a token
        overlaps those of the other side from the one that holds its first byte to the one that holds its last."""
        if not self.fresh:
            return
        a, b = (np.frombuffer(b"".join([k[i] for k in self.fresh]), np.uint32).astype(np.int64) for i in (0, 1))
        upto = np.cumsum([len(k[0]) // 4 for k in self.fresh])  # tokens of the first up to each window's end
        size_a = self.first.sizes[a]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(self.second.sizes[b])
        low = np.searchsorted(ends_b, ends_a - size_a, "right")
        n = np.searchsorted(ends_b, ends_a, "left") - low + 1
        linked = np.cumsum(n)
        codes = np.repeat(a, n) << 32 | b[np.arange(linked[-1]) - np.repeat(linked - n, n) + np.repeat(low, n)]
        kinds, places = np.unique(codes, return_inverse=True)
        numbers = np.array([self.pairs.setdefault(c, len(self.pairs)) for c in kinds.tolist()], np.uint32)
        self.links.frombytes(numbers[places].tobytes())
        self.ends.frombytes((self.ends[-1] + linked[upto - 1]).astype(np.uint64).tobytes())
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        names_a, names_b, i, j, parts = list(map(str, a.tolist())), list(map(str, b.tolist())), 0, 0, []
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            parts.append(f"{names_a[i]}|{names_b[j]}" if x - i == 1 == y - j else f"{','.join(names_a[i:x])}|{','.join(names_b[j:y])}")
            i, j = x, y
        until = np.searchsorted(last_a, upto - 1, "right").tolist()  # groups up to each window's end
        self.groups.extend(np.diff(until, prepend=0).tolist())
        self.texts += [(parts[x] if y - x == 1 else ";".join(parts[x:y])).encode() for x, y in zip([0, *until], until)]
        self.fresh = []

    def figures(self, documents: list[list[int]]) -> tuple[list[int], list[int], list[str], np.ndarray, np.ndarray]:
        """Per document groups, links and the groups' hash; the documents' links one after the other as numbers of pairs; the pairs."""
        self.learn()
        ends, links = np.frombuffer(self.ends, np.uint64).astype(np.int64), np.frombuffer(self.links, np.uint32)
        windows = np.fromiter((w for d in documents for w in d), np.int64, sum(map(len, documents)))
        at = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)])
        start, n = ends[windows], ends[windows + 1] - ends[windows]
        upto = np.concatenate([[0], np.cumsum(n)])
        held = links[np.arange(upto[-1]) - np.repeat(upto[:-1] - start, n)].astype(np.int64)
        groups = np.concatenate([[0], np.cumsum(np.array(self.groups, np.int64)[windows])])
        hashes = [hashlib.sha256(b";".join([self.texts[w] for w in d])).hexdigest() if d else "" for d in documents]
        return np.diff(groups[at]).tolist(), np.diff(upto[at]).tolist(), hashes, held, np.fromiter(self.pairs, np.int64, len(self.pairs))


CHUNK = ("chunk long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, hash array<string>, "
         "pairs binary, docs binary, held binary, ends binary, times binary, n_pairs long")


def chunks(docs: DataFrame, first: str, second: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: per document its figures, and the distinct pairs of the chunk, which of them each document holds how often."""
    source = docs.select(docs[f"`{id_col}`"].alias("id"), text_of(docs, text_col).alias("text"))
    schema = T.StructType([T.StructField("id", T.ArrayType(type_of(docs, id_col))), *T.StructType.fromDDL(CHUNK).fields])
    lists = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.binary()] * 5, pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = per_worker(f"aligned {first} {second} {pattern}", lambda: Pair(first, second, pattern))
        numbers = (TaskContext.get().partitionId() << 32 | i for i in count())

        def row(kind: pa.DataType, ids: list, rows: list) -> pa.RecordBatch:
            groups, links, hashes, numbered, pairs = pair.figures([r[2] for r in rows])
            met = np.flatnonzero(np.bincount(numbered, minlength=len(pairs)))
            met = met[np.argsort(pairs[met])]
            place = np.zeros(len(pairs), np.int64)
            place[met] = np.arange(len(met))
            of = np.repeat(np.arange(len(rows)), links)
            width = max(1, len(met))
            held, times = np.unique(of * width + place[numbered], return_counts=True)
            of, held = held // width, held % width
            cells = [next(numbers), [r[0] for r in rows], [r[1] for r in rows], groups, links, hashes, pack(np.diff(pairs[met], prepend=0)),
                     pack(np.bincount(held, minlength=len(met))), pack(np.diff(held, prepend=0)),
                     pack(np.cumsum(np.bincount(of, minlength=len(rows)))), pack(times), len(met)]
            if len(pair.texts) > WINDOWS_KEPT:
                pair.forget()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), *[pa.array([c], k) for c, k in zip(cells, lists)]], names=schema.names)

        ids, rows, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                texts = part.column(1).to_pylist()
                for i, text, (a, b) in zip(part.column(0).to_pylist(), texts, pair.encode(texts)):
                    rows.append((len(a), len(b), pair.windows(a, b)))
                    ids.append(i)
                    size += len(text) + 8
                    if size >= CHUNK_CHARS:
                        yield row(kind, ids, rows)
                        ids, rows, size = [], [], 0
        if ids:
            yield row(kind, ids, rows)

    return source.mapInArrow(cut, schema)


def _requests(texts: DataFrame, parts: int) -> DataFrame:
    """Distinct pairs with the chunk's document counts, one row per chunk and part."""
    ddl = "part long, chunk long, pairs binary, docs binary"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                pairs, docs, rows = np.cumsum(unpack(r.pairs)), unpack(r.docs), []
                part = (spread(pairs) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for p, a, b in cuts(part[order]):
                    rows.append((p, r.chunk, pack(np.diff(pairs[order[a:b]], prepend=0)), pack(docs[order[a:b]])))
                yield pd.DataFrame(rows, columns=names_of(ddl))

    return texts.select("chunk", "pairs", "docs").mapInPandas(ask, ddl)


def pair_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """One row per part: its pairs, in how many documents each is linked, and where each chunk's pairs stand among them."""
    parts = max(1, math.ceil((texts.agg(F.sum("n_pairs")).first()[0] or 0) / PART_PAIRS))
    ddl = "part long, pairs binary, docs binary, chunks array<long>, sizes array<long>, places binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [np.cumsum(unpack(p)) for p in pdf["pairs"]]
        found, places = np.unique(np.concatenate(blocks), return_inverse=True)
        docs = np.bincount(places, weights=np.concatenate([unpack(d) for d in pdf["docs"]])).astype(np.int64)
        return pd.DataFrame([(int(pdf["part"].iloc[0]), pack(np.diff(found, prepend=0)), pack(docs), pdf["chunk"].tolist(),
                              [len(b) for b in blocks], pack(places))], columns=names_of(ddl))

    return materialize(_requests(texts, parts).groupBy("part").applyInPandas(add, ddl)), parts


def pair_table(counts: DataFrame) -> DataFrame:
    """(a, b, docs): in how many documents each pair of ids is linked."""
    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for pairs, docs in zip(pdf["pairs"], pdf["docs"]):
                found = np.cumsum(unpack(pairs))
                yield pd.DataFrame({"a": found >> 32, "b": found & 0xFFFFFFFF, "docs": unpack(docs)})

    return counts.select("pairs", "docs").mapInPandas(listed, "a long, b long, docs long")


def highest(counts: DataFrame) -> dict[int, int]:
    """Each first id's highest count: at most one number per id of the vocabulary."""
    return {r.a: r.top for r in pair_table(counts).groupBy("a").agg(F.max("docs").alias("top")).collect()}


def align_documents(docs: DataFrame, first: str, second: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's tokens by both vocabularies, their groups and links, and how common its links are corpus-wide.

    ``first`` is a byte-level vocabulary of the tokenizers library, ``second`` a sentencepiece model that puts a space first; both are
    paths on the workers. ``pattern`` cuts texts for the first. Special tokens are ordinary text. A null or empty text, and one whose tokens' bytes are not the space and the
    text, has no tokens, zeros and an empty hash. Repeated rows are documents of their own and all count; ties for an id's highest
    count are all best; long texts are encoded whole; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        texts = materialize(chunks(docs, first, second, pattern, id_col, text_col))
        counts, parts = pair_counts(texts)
        top = highest(counts)
    tops = np.zeros(max(top, default=0) + 1, np.int64)
    tops[list(top)] = list(top.values())
    packed = pack(tops)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = unpack(packed)
        for pdf in frames:
            for r in pdf.itertuples():
                docs, places, end = unpack(r.docs), unpack(r.places), np.cumsum(r.sizes)
                best = docs == tops[np.cumsum(unpack(r.pairs)) >> 32]
                yield pd.DataFrame([(c, r.part, pack(docs[places[a:b]] << 1 | best[places[a:b]])) for c, a, b in zip(r.chunks, [0, *end[:-1]], end)],
                                   columns=["chunk", "part", "said"])

    said = counts.mapInPandas(answer, "chunk long, part long, said binary")
    figures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), *[T.StructField(f, T.LongType()) for f in figures],
                           T.StructField("groups_sha256", T.StringType())])

    def finish(text: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in text.itertuples():
            pairs = np.cumsum(unpack(r.pairs))
            part, known = (spread(pairs) % np.uint64(parts)).astype(np.int64), np.zeros(len(pairs), np.int64)
            if len(replies):
                known[np.argsort(part, kind="stable")] = np.concatenate(replies.sort_values("part")["said"].map(unpack).tolist())
            held, times, ends = np.cumsum(unpack(r.held)), unpack(r.times), unpack(r.ends)
            at = np.concatenate([[0], ends])
            sums = [np.concatenate([[0], np.cumsum(times * v)]) for v in (known[held] & 1, known[held] >> 1)]
            out.append(pd.DataFrame({
                id_col: pd.Series(list(r.id), dtype=object), **{f: list(getattr(r, f)) for f in figures[:4]},
                **{f: s[at[1:]] - s[at[:-1]] for f, s in zip(figures[4:], sums)}, "groups_sha256": list(r.hash)}))
        return pd.concat(out) if out else pd.DataFrame({f: [] for f in schema.names})

    return texts.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(finish, schema)
