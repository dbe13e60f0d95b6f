"""Language-model scores by Katz back-off over Good-Turing discounted n-gram counts.

An n-gram's parent is the gram without its last word, so a gram is a pair (parent's id, word's id) and the model is one table
per order. Texts are cut into words in chunks of documents. Order by order a chunk sends its distinct grams, already
counted, to the parts of the table they belong to, and gets back ids, counts and back-off weights; what it learns at one order makes
the pairs of the next. A chunk so sends a gram once however often it holds it, and keys travel as sorted, packed blocks.

For a context h with C training occurrences, d the discount of a count and P' the next lower order,

    P(w | h) = d(c) * c / C                 where c = count(h w) > 0
    P(w | h) = weight(h) * P'(w)            elsewhere,   weight(h) = (1 - sum of the first) / (1 - sum of P' over the seen w)

so each context's probabilities add up to one, the one class of unknown words included. A context with no discounted count keeps
1 / (C + 1) for the unseen. Contexts that hold many occurrences are dealt over several parts by word; their sums meet by context.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from touchline.llm.blocks import cuts, names_of, pack, pack_floats, spread, unpack, unpack_floats
from touchline.llm.common import text_of, tidy_shuffles, type_of
from touchline.session import materialize

END = b""  # no word is empty
BEGIN, UNKNOWN = -1, -1  # ids of the context at the start of a text and of a word training lacks


@dataclass(frozen=True)
class Settings:
    """``order``: longest gram. ``largest``: counts up to it are discounted. ``chunk_chars``: texts of a chunk, a text stays whole.
    ``part_grams``: grams sent to one part of a table. Contexts met more than ``split`` times in training are dealt over parts."""

    order: int = 2
    largest: int = 5
    chunk_chars: int = 12_000_000
    part_grams: int = 1_000_000
    split: int = 100_000


def word_parts(words: Sequence[bytes], parts: int) -> np.ndarray:
    """Parts rise with the words' hashes, the order in which a chunk lists its words."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * parts >> 32


# Good-Turing discounts

def discounts(seen: Sequence[int], largest: int) -> np.ndarray:
    """d(1) to d(largest) from the numbers of grams that occur once, twice, and so on up to largest + 1 times.

    Katz's discounts hold only where they all lie in (0, 1) and fall with the count's rarity; else the largest discounted count is
    lowered, and where none will do every such count loses a half (tiny or copied corpora).
    """
    for k in range(largest, 1, -1):
        n = [0, *seen]
        if min(n[1:k + 2]) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array(d + [1.0] * (largest - k))
    return np.array([1 - 0.5 / r for r in range(1, largest + 1)])


@dataclass(frozen=True)
class Level:
    """What is known of one order: discounts, occurrences, distinct grams; at order 1 the unknown words' share too."""

    rates: np.ndarray
    total: int
    kinds: int
    unknown: float = 0.0
    spare: bool = False

    @classmethod
    def of(cls, seen: Sequence[int], total: int, kinds: int, largest: int) -> Level:
        rates = discounts(seen, largest)
        lost = sum(r * n * (1 - d) for r, n, d in zip(count(1), seen, rates))
        if lost > 0:
            return cls(rates, total, kinds, lost / total)
        return cls(rates, total, kinds, 1 / (total + 1), True)

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        """Counts after discounting."""
        table = np.concatenate([[0.0], self.rates * np.arange(1, len(self.rates) + 1)])
        return np.where(counts < len(table), table[np.minimum(counts, len(table) - 1)], counts.astype(float))

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities at order 1."""
        return np.where(counts > 0, self.discounted(counts) / max(1, self.total + self.spare), self.unknown)


# Chunks of texts

def words_of(text: str) -> list[bytes]:
    """Words between the six white-space characters, A-Z lower-cased: what bytes do by themselves."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def chunks(docs: DataFrame, id_col: str, text_col: str, learn: Column, settings: Settings) -> DataFrame:
    """One row per chunk: ids, whether each text is learnt from, where it ends, its words as numbers, the chunk's words."""
    source = docs.select(docs[f"`{id_col}`"].alias("id"), learn.alias("learn"), text_of(docs, text_col).alias("text"))
    id_type = type_of(docs, id_col)
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("id", T.ArrayType(id_type)), T.StructField("learn", T.ArrayType(T.BooleanType())),
        T.StructField("ends", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = (TaskContext.get().partitionId() << 32 | i for i in count())
        ids, kept, ends, tokens, size, held = [], [], [], [], 0, 0
        known = defaultdict(count().__next__)

        def row(out_type):
            words = list(known)
            place = np.empty(len(words), np.int64)
            order = sorted(range(len(words)), key=lambda i: (zlib.crc32(words[i]), words[i]))
            place[order] = np.arange(len(words))
            local = place[np.concatenate(tokens)]
            mine = np.repeat(np.array(kept, bool), np.diff(np.array(ends), prepend=0))
            n = np.bincount(local[mine], minlength=len(words))
            cells = [next(numbers), ids, kept, pack(np.array(ends)), pack(local), zstandard.compress(b"\n".join(words[i] for i in order), 1),
                     pack(n), len(local), len(words)]
            kinds = [pa.int64(), pa.list_(out_type), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=schema.names)

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for i, learnt, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                found = words_of(text)
                found.append(END)
                ids.append(i)
                kept.append(bool(learnt))
                held += len(found)
                ends.append(held)
                tokens.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(text) + 8
                if size >= settings.chunk_chars:
                    yield row(id_kind)
                    ids, kept, ends, tokens, size, held = [], [], [], [], 0, 0
                    known = defaultdict(count().__next__)
        if ids:
            yield row(id_kind)

    return source.mapInArrow(cut, schema)


class Chunk:
    """A chunk's grams, order by order, with what the tables have said of them."""

    def __init__(self, row, replies: pd.DataFrame, levels: Sequence[Level], starts: int) -> None:
        self.row, self.starts = row, starts
        self.tokens, self.ends = unpack(row.tokens), unpack(row.ends)
        self.n_words = row.n_words
        self.learnt = np.repeat(np.array(row.learn, bool), np.diff(self.ends, prepend=0))
        self.since = np.arange(len(self.tokens)) - np.repeat(np.concatenate([[0], self.ends[:-1]]), np.diff(self.ends, prepend=0))
        self.grams: list[dict] = []
        for n, level in enumerate(levels, 1):
            self.grams.append(self._level(n, level, replies[replies["level"] == n]))

    def keys(self, n: int) -> dict:
        """Distinct grams of order n: their context's and last word's ids, training counts, lower-order probability.

        A gram is asked for only where its context was seen in training. ``at`` tells each position's gram (-1: none).
        """
        lower, words = self.grams[n - 2], self.grams[0]
        begins = n == 2
        at = np.full(len(self.tokens), -1)
        context = np.full(len(self.tokens), -1)
        context[1:] = lower["at"][:-1]
        context[self.since == 0] = -1
        if begins:
            context[self.since == 0] = len(lower["id"])
        ids, counts = np.append(lower["id"], BEGIN), np.append(lower["count"], self.starts if begins else 0)
        valid = np.flatnonzero((context >= 0) & (counts[context] > 0))
        width = self.n_words + 1
        # All words training lacks are one word after a context.
        word = np.where(words["count"][self.tokens[valid]] > 0, self.tokens[valid], self.n_words)
        keys, first, at[valid] = np.unique(context[valid] * width + word, return_index=True, return_inverse=True)
        here = valid[first]
        counted = np.bincount(at[valid][self.learnt[valid]], minlength=len(keys))
        context, word = keys // width, keys % width
        return {"at": at, "context": ids[context], "context_count": counts[context], "of": context, "first": here,
                "word": np.append(words["id"], UNKNOWN)[word], "mine": counted, "lower": self.lower(n)[here]}

    def lower(self, n: int) -> np.ndarray:
        """Each position's probability at order n - 1."""
        return self.grams[n - 2]["p"]

    def _level(self, n: int, level: Level, replies: pd.DataFrame) -> dict:
        if n == 1:
            found = {"id": np.full(self.n_words, UNKNOWN), "count": np.zeros(self.n_words, np.int64)}
            if len(replies):
                replies = replies.sort_values("part")
                found = {"id": np.concatenate(replies["ids"].map(unpack).tolist()), "count": np.concatenate(replies["counts"].map(unpack).tolist())}
            found["id"][found["count"] == 0] = UNKNOWN
            return found | {"at": self.tokens, "p": level.words(found["count"])[self.tokens]}
        k = self.keys(n)
        size = len(k["word"])
        ids, counts, weight, spare = np.full(size, -1), np.zeros(size, np.int64), np.ones(size), np.zeros(size, bool)
        sums = replies[replies["part"].isna()]
        replies = replies[replies["part"].notna()]
        if len(replies):
            replies = replies.sort_values("part")
            part = gram_parts(k, int(replies["parts"].iloc[0]), int(replies["split"].iloc[0]))
            order = np.lexsort((k["word"], k["context"], part))
            for name, values in (("ids", ids), ("counts", counts), ("spare", spare)):
                values[order] = np.concatenate(replies[name].map(unpack).tolist())
            weight[order[counts[order] == 0]] = np.concatenate(replies["weights"].map(unpack_floats).tolist())
        if len(sums):  # contexts dealt over several parts
            known = dict(zip(sums["context"].astype("int64"), zip(sums["weight"], sums["kept"])))
            for i in np.flatnonzero(k["context_count"] > int(sums["split"].iloc[0])):
                weight[i], spare[i] = known[int(k["context"][i])]
        p = np.where(counts > 0, level.discounted(counts) / (k["context_count"] + spare), weight * k["lower"])
        at = k["at"]
        return {"at": at, "id": ids, "count": counts, "p": np.where(at >= 0, p[at] if size else 0.0, self.lower(n))}


def gram_parts(k: dict, parts: int, split: int) -> np.ndarray:
    """The part of each gram: by its context, and for contexts above ``split`` by its word among so many parts too."""
    among = (k["context_count"] - 1) // split  # 0 up to split occurrences
    salt = np.where(among > 0, spread(k["word"]) % (np.maximum(among, 1) + 1).astype(np.uint64), 0).astype(np.uint64)
    return (spread(spread(k["context"]) + salt) % np.uint64(parts)).astype(np.int64)


# What is sent, merged and answered

REQUEST = ("part long, chunk long, contexts binary, words binary, counts binary, lower binary, hot binary")
MERGED = ("part long, contexts binary, words binary, counts binary, lower binary, hot binary, chunks array<long>, sizes array<long>, "
          "places binary, seen array<long>, total long, kinds long")
REPLY = ("chunk long, level int, part long, parts long, split long, ids binary, counts binary, weights binary, spare binary, "
         "context long, weight double, kept boolean")


def _requests(texts: DataFrame, replies: DataFrame | None, levels: Sequence[Level], starts: int, parts: int, settings: Settings) -> DataFrame:
    """The distinct grams of the next order, one row per chunk and part."""
    split = settings.split

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = zstandard.decompress(r.words).split(b"\n")
                counts, rows = unpack(r.counts), []
                for p, a, b in cuts(word_parts(found, parts)):
                    rows.append((p, r.chunk, b"", zstandard.compress(b"\n".join(found[a:b]), 1), pack(counts[a:b]), b"", b""))
                yield pd.DataFrame(rows, columns=names_of(REQUEST))

    if replies is None:
        return texts.select("chunk", "words", "counts").mapInPandas(words, REQUEST)

    def grams(text: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in text.itertuples():
            k = Chunk(r, said, levels, starts).keys(len(levels) + 1)
            part = gram_parts(k, parts, split)
            order = np.lexsort((k["word"], k["context"], part))
            for p, a, b in cuts(part[order]):
                o = order[a:b]
                context = k["context"][o]
                hot = np.unique(context[k["context_count"][o] > split])
                rows.append((p, r.chunk, pack(np.diff(context, prepend=0)), pack(k["word"][o]), pack(k["mine"][o]),
                             pack_floats(k["lower"][o]), pack(hot)))
        return pd.DataFrame(rows, columns=names_of(REQUEST))

    return texts.drop("words").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(grams, REQUEST)


def _merge(requests: DataFrame, largest: int) -> DataFrame:
    """One row per part of the order's table: its grams with summed counts, where each chunk's grams stand, counts of counts."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [unpack(c) for c in pdf["counts"]]
        sizes = [len(c) for c in counts]
        counts = np.concatenate(counts)
        texts = pdf["contexts"].iloc[0] == b""
        lower, contexts, hot = b"", b"", b""
        if texts:
            found = pa.chunked_array([pa.array(zstandard.decompress(w).split(b"\n"), pa.binary()) for w in pdf["words"]])
            coded = found.combine_chunks().dictionary_encode()
            codes, kinds = coded.indices.to_numpy(), np.array(coded.dictionary.to_pylist(), object)
            summed = np.bincount(codes, weights=counts).astype(np.int64)
            order = np.array(sorted(range(len(kinds)), key=lambda i: (-summed[i], kinds[i])))  # so that common words have small ids
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            places, summed, words = place[codes], summed[order], zstandard.compress(b"\n".join(kinds[order]), 1)
        else:
            context = np.concatenate([np.cumsum(unpack(c)) for c in pdf["contexts"]])
            word = np.concatenate([unpack(w) for w in pdf["words"]])
            order = np.lexsort((word, context))
            new = (np.diff(context[order], prepend=np.iinfo(np.int64).min) != 0) | (np.diff(word[order], prepend=np.iinfo(np.int64).min) != 0)
            places = np.empty(len(order), np.int64)
            places[order] = np.cumsum(new) - 1
            firsts = order[new]
            summed = np.bincount(places, weights=counts).astype(np.int64)
            lower = pack_floats(np.concatenate([unpack_floats(x) for x in pdf["lower"]])[firsts])
            contexts, words = pack(np.diff(context[firsts], prepend=0)), pack(word[firsts])
            hot = pack(np.unique(np.concatenate([unpack(h) for h in pdf["hot"]])))
        seen = np.bincount(np.minimum(summed, largest + 2), minlength=largest + 3)[1:largest + 2]
        return pd.DataFrame([(int(pdf["part"].iloc[0]), contexts, words, pack(summed), lower, hot, pdf["chunk"].tolist(), sizes, pack(places),
                              seen.tolist(), int(summed.sum()), int((summed > 0).sum()))], columns=names_of(MERGED))

    return requests.groupBy("part").applyInPandas(merge, MERGED)


def _context_sums(row, largest: int) -> tuple[np.ndarray, dict]:
    """Of each context of a part: counts of counts, occurrences, and the lower order's share of the seen words."""
    context, summed, lower = np.cumsum(unpack(row.contexts)), unpack(row.counts), unpack_floats(row.lower)
    new = np.diff(context, prepend=np.iinfo(np.int64).min) != 0
    of = np.cumsum(new) - 1
    sums = {f"n{r}": np.bincount(of[summed == r], minlength=new.sum()) for r in range(1, largest + 1)}
    sums["total"] = np.bincount(of, weights=summed).astype(np.int64)
    sums["lower"] = np.bincount(of[summed > 0], weights=lower[summed > 0], minlength=new.sum())
    return of, {"context": context[new], **sums}


def _weights(sums: dict, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Back-off weights and whether a context keeps one more occurrence for the unseen."""
    lost = reduce(lambda a, b: a + b, [sums[f"n{r}"] * r * (1 - d) for r, d in enumerate(level.rates, 1)])
    spare = lost <= 0
    left = np.where(spare, 1.0, lost) / (np.maximum(sums["total"], 1) + spare)
    return left / (1 - sums["lower"]), spare


def _replies(merged: DataFrame, n: int, level: Level, parts: int, settings: Settings) -> DataFrame:
    """Ids, counts and weights back to the chunks, one row per part and chunk."""
    largest, split = settings.largest, settings.split
    names = names_of(REPLY)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                summed, places = unpack(r.counts), unpack(r.places)
                ids = np.arange(len(summed)) * parts + r.part
                weight, spare = np.ones(len(summed)), np.zeros(len(summed), bool)
                if n > 1:
                    of, sums = _context_sums(r, largest)
                    weight, spare = (x[of] for x in _weights(sums, level))
                rows, end = [], np.cumsum(r.sizes)
                for chunk, a, b in zip(r.chunks, [0, *end[:-1]], end):
                    at = places[a:b]
                    some = summed[at] == 0
                    last = n == settings.order  # no order above asks for its ids
                    rows.append((chunk, n, r.part, parts, split, pack(np.zeros(len(at)) if last and n > 1 else ids[at]), pack(summed[at]),
                                 pack_floats(weight[at][some]), pack(spare[at]), None, None, None))
                yield pd.DataFrame(rows, columns=names).astype({"part": "Int64", "context": "Int64", "weight": "Float64", "kept": "boolean"})

    answers = merged.mapInPandas(answer, REPLY)
    if n == 1:
        return answers

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums over this part's words of contexts that are dealt over several parts, and the chunks that hold such a context."""
        for pdf in frames:
            for r in pdf.itertuples():
                hot = unpack(r.hot)
                if not len(hot):
                    continue
                of, sums = _context_sums(r, largest)
                is_hot = np.isin(sums["context"], hot)
                yield pd.DataFrame({**{k: v[is_hot] for k, v in sums.items()}, "chunk": None})[[*columns]]
                places, end = unpack(r.places), np.cumsum(r.sizes)
                for chunk, a, b in zip(r.chunks, [0, *end[:-1]], end):
                    met = np.unique(of[places[a:b]])
                    met = sums["context"][met[is_hot[met]]]
                    zero = np.zeros(len(met), np.int64)
                    yield pd.DataFrame({**{k: zero for k in columns}, "context": met, "chunk": chunk})[[*columns]]

    columns = {"context": "long", **{f"n{r}": "long" for r in range(1, largest + 1)}, "total": "long", "lower": "double", "chunk": "long"}
    parts_of = materialize(merged.drop("words").mapInPandas(shares, ", ".join(f"{k} {v}" for k, v in columns.items())))
    lost = reduce(lambda a, b: a + b, [F.col(f"n{r}") * F.lit(float(r * (1 - d))) for r, d in enumerate(level.rates, 1)])
    sums = parts_of.where("chunk IS NULL").groupBy("context").agg(*[F.sum(c).alias(c) for c in columns if c not in ("context", "chunk")])
    weights = sums.select("context", (lost <= 0).alias("kept"), (
        F.when(lost <= 0, 1.0).otherwise(lost) / (F.col("total") + (lost <= 0).cast("int")) / (1.0 - F.col("lower"))).alias("weight"))
    asked = parts_of.where("chunk IS NOT NULL").select("chunk", "context").distinct().join(weights, "context")
    nothing = F.lit(None)
    return answers.unionByName(asked.select(
        "chunk", F.lit(n).alias("level"), nothing.cast("long").alias("part"), F.lit(parts).cast("long").alias("parts"),
        F.lit(split).cast("long").alias("split"), *[nothing.cast("binary").alias(c) for c in ("ids", "counts", "weights", "spare")],
        "context", "weight", "kept"))


@dataclass(frozen=True)
class Model:
    """``tables``: per order the merged parts; ``replies``: per order what the chunks were told; ``starts``: texts learnt from."""

    texts: DataFrame
    tables: list[DataFrame]
    replies: list[DataFrame]
    levels: list[Level]
    starts: int
    settings: Settings


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model:
    """Counts all grams of the rows where ``learn`` holds; other rows' grams travel along to be scored.

    The tables lie in the shared checkpoint folder, one row per part, and survive lost executors.
    """
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        texts = materialize(chunks(docs, id_col, text_col, learn, settings))
        sizes = texts.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum(F.size(F.filter("learn", lambda x: x)))).first()
        starts = sizes[2] or 0
        tables, replies, levels = [], [], []
        for n in range(1, settings.order + 1):
            parts = max(1, math.ceil((sizes[0 if n == 1 else 1] or 0) / settings.part_grams))
            told = reduce(DataFrame.unionByName, replies) if replies else None
            merged = materialize(_merge(_requests(texts, told, levels, starts, parts, settings), settings.largest))
            total = merged.agg(*[F.sum(F.col("seen")[i]) for i in range(settings.largest + 1)], F.sum("total"), F.sum("kinds")).first()
            *seen, occurrences, kinds = [int(x or 0) for x in total]
            levels.append(Level.of(seen, occurrences, kinds, settings.largest))
            tables.append(merged)
            replies.append(_replies(merged, n, levels[-1], parts, settings))
    return Model(texts, tables, replies, levels, starts, settings)


def gram_table(model: Model, n: int) -> DataFrame:
    """The order's grams that training holds: (context, word, id, count); at order 1 word is the text (empty: the end)."""
    first = n == 1
    parts = model.tables[n - 1].count()

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                counts = unpack(r.counts)
                out = pd.DataFrame({"id": np.arange(len(counts)) * r.of + r.part, "count": counts})
                out["context"] = None if first else np.cumsum(unpack(r.contexts))
                out["word"] = zstandard.decompress(r.words).split(b"\n") if first else unpack(r.words)
                yield out[["context", "word", "id", "count"]][counts > 0]

    of = model.replies[n - 1].agg(F.max("parts")).first()[0] or max(1, parts)
    rows = model.tables[n - 1].select("part", "contexts", "words", "counts").withColumn("of", F.lit(of).cast("long"))
    return rows.mapInPandas(listed, f"context long, word {'binary' if first else 'long'}, id long, count long")


def score(model: Model) -> DataFrame:
    """Per text: id, learn, n_tokens, n_known, base_score, score (log10), each token's probability found order by order."""
    levels, starts = model.levels, model.starts
    id_type = model.texts.schema["id"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("learn", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(text: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in text.itertuples():
            c = Chunk(r, said, levels, starts)
            counts = c.grams[0]["count"][c.tokens]
            base = np.log10((counts + 1) / (levels[0].total + levels[0].kinds + 1))
            at = np.concatenate([[0], c.ends[:-1]])
            out.append(pd.DataFrame({
                "id": pd.Series(list(r.id), dtype=object), "learn": list(r.learn), "n_tokens": np.diff(c.ends, prepend=0),
                "n_known": np.add.reduceat((counts > 0).astype(np.int64), at),
                "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(c.grams[-1]["p"]), at)}))
        return pd.concat(out) if out else pd.DataFrame({f: [] for f in schema.names})

    told = reduce(DataFrame.unionByName, model.replies)
    return model.texts.drop("words", "counts").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(scored, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Every text's log10 probability, learning from the rows whose crc32 of the id as text, mod 7, is not 2.

    Null and empty texts are the end token alone; a null id counts as the empty text, so its row is learnt from; repeated rows are
    counted and scored each; very long texts stay whole in one chunk; other columns are ignored; an empty table gives an empty result.
    Words that training lacks are one class. With nothing to learn from, that class has probability one.
    """
    remainder = F.crc32(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).cast("binary")) % 7
    model = train(docs, remainder != 2, id_col, text_col, settings)
    return score(model).select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.levels[0].total).cast("long").alias("train_tokens"), "base_score", "score")
