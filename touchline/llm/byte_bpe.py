"""Byte-level BPE by prefix dynamic programming: every byte prefix has one valid last token."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from touchline.llm.common import per_worker, text_of

WORDS_KEPT = 400_000
PAIRS_KEPT = 300_000


class Vocabulary:
    """Ranks of a byte-level BPE. ``compatible(a, b)`` tells whether the encoding of a's and b's bytes is [a, b].

    A sequence of tokens is an encoding exactly when all its neighbours are compatible, so an encoding can be
    grown token by token without looking back further than one.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.lengths = {i: len(b) for b, i in ranks.items()}
        self.ending = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ending.add_word(token.decode("latin-1"), i)
        self.ending.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """Encoding by repeated merging of the pair of lowest rank, leftmost first; only used on one or two tokens' bytes."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if token not in self._whole:
            self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return self._whole[token]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known


class PrefixTable:
    """The last token of every prefix of one piece of text. Appends go on from it; edits redo only what they touch."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _grow(self, data: bytes, last: list[int]) -> Iterator[int]:
        """Add the last token of each further prefix; yields the prefix's length after each.

        The automaton names all tokens that end at a byte, the longest first; the one that fits the last token of
        the prefix before it is the only one that does.
        """
        v, base = self.vocabulary, max(0, len(last) - self.vocabulary.longest)
        lengths, pairs, compatible, done = v.lengths, v._pairs, v.compatible, len(last)
        for end, token in v.ending.iter(data[base:].decode("latin-1")):
            i = base + end + 1
            if i <= done:
                continue
            if i > done + 1:
                break
            start = i - lengths[token]
            if start < 0:
                continue
            if start == 0:
                fits = v.whole(token)
            else:
                before = last[start - 1]
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = compatible(before, token)
            if fits:
                last.append(token)
                done = i
                yield i
        if len(last) < len(data):
            raise ValueError(f"no token ends at byte {len(last) + 1}: the vocabulary lacks a byte")

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        for _ in self._grow(self.data, self.last):
            pass
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace bytes [start, end). Once as many last tokens in a row as the longest token has bytes are what they
        were, all later ones are, since each depends on no more than those."""
        data, last = self.data[:start] + new + self.data[end:], self.last[:start]
        shift, same = len(new) - (end - start), 0
        for i in self._grow(data, last):
            old = i - shift
            same = same + 1 if old > end and self.last[old - 1] == last[-1] else 0
            if same >= self.vocabulary.longest:
                last += self.last[old:]
                break
        self.data, self.last = data, last
        return self

    def tokens(self) -> list[int]:
        """The encoding, read backwards from the last prefix."""
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i - 1])
            i -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Words(dict):
    """Encodings of pieces as little-endian unsigned 32-bit ids; emptied when full, so its memory is bounded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        ids = [token] if token is not None else PrefixTable(self.vocabulary, data).tokens()
        packed = np.array(ids, "<u4").tobytes()
        if len(data) <= 64:  # longer pieces hardly come again
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encodes whole texts, each match of ``pattern`` separately, and decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        vocabulary = Vocabulary.read(path)
        self.words, self.split = Words(vocabulary), regex.compile(pattern).findall
        self.bytes_of = [vocabulary.bytes_of.get(i) for i in range(max(vocabulary.bytes_of, default=-1) + 1)]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


OUTPUTS = {"n_tokens": "long", "ids": "binary", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: dict[str, Column], text_col: str = "text",
                     outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Each row's whole text as token ids, and what decoding those ids gives.

    ``vocabulary`` is the path of a rank file on the workers. ``outputs`` names columns of ``OUTPUTS``: ids are
    little-endian unsigned 32-bit integers. Special tokens are ordinary text. A null or empty text has no ids; repeated rows are
    encoded alike; an empty table gives an empty result. Only the columns in ``keep`` are carried. Rows do not move.
    """
    source = docs.select(*[c.alias(n) for n, c in keep.items()], text_of(docs, text_col).alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields,
                           *[T.StructField(n, T.StructType.fromDDL(f"x {OUTPUTS[n]}")["x"].dataType) for n in outputs]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(f"codec {vocabulary} {pattern}", lambda: Codec(vocabulary, pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = {n: [] for n in outputs}
                for text in part.column(part.num_columns - 1):
                    ids = codec.encode(text.as_py())
                    decoded = codec.decode(ids) if any("decoded" in n for n in outputs) else b""
                    values = {"n_tokens": len(ids) // 4, "ids": ids, "decoded": decoded}
                    for n in outputs:
                        rows[n].append(hashlib.sha256(values[n.removesuffix("_sha256")]).hexdigest()
                                       if n.endswith("_sha256") else values[n])
                kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(part.num_columns - 1)],
                     *[pa.array(rows[n], kinds[OUTPUTS[n]]) for n in outputs]],
                    names=[*part.schema.names[:-1], *outputs])

    return source.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, ids_col: str, keep: dict[str, Column]) -> DataFrame:
    """The bytes of ids (little-endian unsigned 32-bit); null ids give null."""
    source = encoded.select(*[c.alias(n) for n, c in keep.items()], encoded[ids_col].alias("_ids"))
    schema = T.StructType([*source.drop("_ids").schema.fields, T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(f"codec {vocabulary} .", lambda: Codec(vocabulary, "."))
        for batch in batches:
            done = [None if x is None else codec.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(done, pa.binary())],
                                             names=[*batch.schema.names[:-1], "decoded"])

    return source.mapInArrow(decode, schema)
