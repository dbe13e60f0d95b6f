"""Toxic text by compression distance: two zstandard dictionaries, windows, and calibrated scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from touchline.llm.common import plain, text_of

THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample that is learnt from, and sizes of dictionaries and windows.

    Labelled rows are drawn by a hash of their id, so the sample is the same at every run. Only rows of up to
    ``row_bytes`` are drawn; every row is scored whole.
    """

    toxic_rows: int = 1200
    ordinary_rows: int = 4000
    calibration_rows: int = 4000
    row_bytes: int = 32_768
    ordinary_bytes: int = 112_640
    toxic_bytes: int = 2048
    window_words: int = 12
    tail_bytes: int = 48
    grams: tuple[int, ...] = (6, 10)
    least_rows: int = 8
    contrast: float = 20.0


@dataclass
class Model:
    """Contents of both dictionaries and the weights of the score; ``prior`` alone when a class has no rows."""

    settings: Settings
    prior: float
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _words(text: str) -> list[str]:
    return text.lower().split()


def _bare(text: str) -> set[bytes]:
    return {f" {w.strip('.,!?;:()')} ".encode() for w in _words(text)}


def _grams(word: bytes, sizes: tuple[int, ...]) -> list[tuple[int, bytes]]:
    """(place, gram) of every size, by place."""
    return [(i, word[i:i + n]) for i in range(len(word)) for n in sizes if i + n <= len(word)]


def windows(text: str, words: int) -> list[bytes]:
    """The whole text in windows of so many words; a text without words is one empty window."""
    parts = _words(text)
    return [f" {' '.join(parts[i:i + words])} ".encode() for i in range(0, max(1, len(parts)), words)]


def _without_copies(texts: Iterable[str]) -> list[str]:
    """Texts of which at most a tenth was seen before, so a copied text doesn't pass for a common one."""
    seen: set[int] = set()
    fresh = []
    for text in texts:
        data = text.encode()
        marks = {zlib.crc32(data[i:i + 40]) for i in range(len(data) - 39) if data[i] % 16 == 1}
        if len(marks & seen) <= 0.1 * len(marks):
            fresh.append(text)
        seen |= marks
    return fresh


def _telling_parts(toxic: list[str], ordinary: list[str], s: Settings) -> list[bytes]:
    """Per toxic text the parts of its words that stand out: byte runs far commoner in toxic texts than in others."""
    counts, others = Counter(), Counter()
    bare = [_bare(t) for t in toxic]
    for words in bare:
        counts.update({g for w in words for _, g in _grams(w, s.grams)})
    least = max(3, min(s.least_rows, len(toxic) // 4))  # a quarter of a very small sample is enough
    common = {g for g, n in counts.items() if n >= least}
    for text in ordinary:
        others.update({g for w in _bare(text) for _, g in _grams(w, s.grams) if g in common})
    share = s.contrast * len(toxic) / max(1, len(ordinary))
    telling = {g for g in common if counts[g] > share * (others[g] + 0.5)}
    found = []
    for words in bare:
        parts: list[bytes] = []
        for word in sorted(words):
            end = -1
            for i, gram in _grams(word, s.grams):
                if gram in telling:
                    if end < i:
                        parts.append(gram)
                    else:
                        parts[-1] += word[end:i + len(gram)]
                    end = max(end, i + len(gram))
        found.append(b"".join(parts))
    return [p for p in found if p]


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves when they are too few to train on."""
    samples = [x for x in samples if x]
    if sum(map(len, samples)) > size:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


class Distance:
    """Per window, the bytes that the toxic dictionary saves. Both compressors share the ordinary dictionary at the same
    distance, so the saving is zero unless a match in toxic text is used. Every window is followed by the same known
    bytes: without them the compressor neither looks for matches near a window's end nor compresses short windows."""

    def __init__(self, model: Model) -> None:
        self.words, self.tail = model.settings.window_words, model.ordinary[-model.settings.tail_bytes:]
        self.plain, self.toxic = self._compressor(model.ordinary), self._compressor(model.toxic + model.ordinary)

    @staticmethod
    def _compressor(content: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(
            6, source_size=128, dict_size=len(content), min_match=5, write_content_size=0, write_checksum=0,
            write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=shared, compression_params=settings).compress

    def features(self, text: str) -> tuple[float, float, float]:
        """Constant, largest saving, and logarithm of all savings."""
        most = total = 0
        plain, toxic = self.plain, self.toxic
        for window in windows(text, self.words):
            window += self.tail
            saved = len(plain(window)) - len(toxic(window))
            if saved > 0:
                total += saved
                if saved > most:
                    most = saved
        return 1.0, float(min(most, 12)), math.log1p(total)


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights by Newton steps with a small ridge, until they stand still."""
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from a bounded sample of labelled rows that are not held out.

    Dictionaries come from rows of each class, weights from other rows drawn without regard to the class, so scores
    follow the true share of toxic rows. Rows without a label, id or text take no part. Without rows of both classes the
    score of every text is the share of toxic rows, or 0 if there are none.
    """
    s = settings
    usable = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(~is_held_out(F.col("id"))).groupBy("id").agg(
        F.max("label").alias("label")).withColumn("draw", F.xxhash64("id", F.lit(4)))
    fit, prior = F.col("draw") % 4 != 0, usable.agg(F.avg("label")).first()[0] or 0.0
    drawn = [usable.where(fit & (F.col("label") == label)).orderBy("draw", "id").limit(n)
             for label, n in ((1, s.toxic_rows), (0, s.ordinary_rows))]
    drawn.append(usable.where(~fit).orderBy("draw", "id").limit(s.calibration_rows))
    ids = drawn[0].union(drawn[1]).withColumn("use", F.lit("fit")).union(drawn[2].withColumn("use", F.lit("calibrate")))
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).where(
        F.octet_length("text") <= s.row_bytes).join(F.broadcast(ids), "id")  # a sample of at most as many rows as Settings allows
    rows = sorted(texts.groupBy("id", "label", "use", "draw").agg(F.min("text").alias("text")).collect(), key=lambda r: (r.draw, r.id))
    toxic, ordinary = ([r.text for r in rows if r.use == "fit" and r.label == k] for k in (1, 0))
    if not toxic or not ordinary:
        return Model(s, float(prior))
    telling = _telling_parts(_without_copies(toxic), ordinary, s)
    plain = _train([w for t in ordinary for w in windows(t, s.window_words)], s.ordinary_bytes)
    repeats = max(1, 200 * s.toxic_bytes // max(1, sum(map(len, telling))))
    model = Model(s, float(prior), plain, _train(telling * repeats, s.toxic_bytes))
    distance = Distance(model)
    rest = [r for r in rows if r.use == "calibrate"] or rows
    x = np.array([distance.features(r.text) for r in rest])
    model.weights = _logistic(x, np.array([r.label for r in rest], float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None,
          name: str = "score") -> DataFrame:
    """The columns in ``keep`` and the score of the whole text, 0 to 1; null and empty texts are scored like any other.

    The model's dictionaries (about 110 KB by ``Settings``) travel with the tasks. Rows do not move; equal texts have equal scores.
    """
    source = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], text_of(docs, text_col).alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model) if model.weights else None
        for batch in batches:
            texts, values = batch.column(batch.num_columns - 1), []
            for text in texts:
                if distance is None:
                    values.append(model.prior)
                else:
                    z = sum(w * f for w, f in zip(model.weights, distance.features(text.as_py())))
                    values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())],
                                             names=[*batch.schema.names[:-1], name])

    return source.mapInArrow(scored, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every document, whether it is held out from learning, and the decision at ``THRESHOLD``.

    Repeated rows are each scored; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    scored = score(docs, model, text_col, {"doc_id": docs[f"`{id_col}`"]})
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows below ``THRESHOLD``, with their columns as they are."""
    model = train(docs, labels, id_col, text_col)
    safe, name = plain(docs)
    kept = score(safe, model, name[text_col], {c: F.col(c) for c in safe.columns}, "_score").where(F.col("_score") < THRESHOLD)
    return kept.select(*safe.columns).toDF(*docs.columns)
