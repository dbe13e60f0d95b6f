"""Strictly prior rolling state per key: moving averages, counts and the last few dates, as an associative scan.

One EMA step is affine, so any run of observations is one map ``state -> q**n * state + end`` with q = 1 - alpha, and two
runs one after the other are one such map again. Rows are cut into blocks of consecutive order numbers:

* up: each (key, block) becomes one row with its map; blocks are put together in runs of ``FAN``, those again, until one run is left;
* down: the states at the ends of runs go back to the blocks, so each (key, block) knows the state it starts from;
* each row adds what its own block holds before it.

Rows are dealt by block, not by key, so they stay narrow and a key's history never lies in one task; a block's rows are scanned as
columns, by doubling, for all keys at once. Where many rows share an order number, a block's keys are dealt out by their hash.
The start of a key's history is its first value, from which the first step leads to itself. NaN and infinities never fade.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from touchline.operators.ordering import row_index
from touchline.session import materialize, passing

#: Runs of blocks that are put together at a time.
FAN = 128
#: A block is ``SPANS`` times as long as it takes a value to fade to exp(-FADE).
FADE, SPANS = 230.0, 16
#: Most rows that share an order number in a part of a block, on average.
ABREAST = 4


@dataclass(frozen=True)
class Trackers:
    """EMAs that advance together: every value column is null in exactly the same rows.

    ``values`` maps output column to value column, ``by`` narrows the history to rows that agree with
    the current row in these extra columns, ``count`` names the prior observation count.
    """

    values: Mapping[str, str]
    count: str
    alpha: float = 0.2
    by: tuple[str, ...] = ()

    @property
    def decay(self) -> float:
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must lie in (0, 1]")
        return max(1.0 - self.alpha, 1e-12)

    @property
    def span(self) -> int:
        """Steps in which a value fades to exp(-FADE)."""
        return max(2, min(1_000_000, math.floor(FADE / -math.log(self.decay))))

    @property
    def observed(self) -> Column:
        return F.col(next(iter(self.values.values()))).isNotNull()


def prior_states(rows: DataFrame, keys: Sequence[str], order: Sequence[str], trackers: Sequence[Trackers],
                 recent: tuple[str, str, int] | None = None, keep: Sequence[str] | None = None, only: str | None = None) -> DataFrame:
    """``rows`` plus, for each tracker group, the prior count and the prior averages (null when unset).

    ``recent`` = (column, prefix, n) adds the last n prior values of a column, nulls left out, as prefix_1 (latest) to prefix_n. ``order`` must be a
    total order inside a key; one dense whole number, such as the row index, is used as it is, anything else is numbered first.
    ``keep`` names the columns of ``rows`` that come out (without it: all). ``only`` names a boolean column: rows that do not hold it count as
    history, but come out only as far as they share the blocks from the first that does. ``rows`` is read once for its order numbers, once for the blocks' maps, on its own columns only, and once for the result.
    """
    keys, whole = list(keys), T.ByteType | T.ShortType | T.IntegerType | T.LongType
    dense = len(order) == 1 and isinstance(rows.schema[order[0]].dataType, whole)
    base, at = (rows, order[0]) if dense else (row_index(rows, list(order), "_at"), "_at")
    size = SPANS * min([t.span for t in trackers], default=1000)
    begin = F.min(F.when(F.col(f"`{only}`"), F.col(at))) if only else F.lit(None)
    low, high, n, begin = base.agg(F.min(at), F.max(at), F.count(F.lit(1)), begin).first()
    first, blocks = (0, 0) if low is None else (low // size, high // size - low // size + 1)
    shares = 1 if low is None else max(1, min(1 << 20, math.ceil(n / (high - low + 1) / ABREAST)))
    base = base.withColumn("_b", F.floor(F.col(at) / F.lit(size)) - F.lit(first))
    sets = list(dict.fromkeys([*([()] if recent else []), *[t.by for t in trackers]]))
    extra = list(dict.fromkeys(c for by in sets for c in by))
    share = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(shares)) if shares > 1 else F.lit(0).cast("long")

    with passing(rows.sparkSession) as hold:
        maps = _block_maps(base.withColumn("_h", share), keys, extra, sets, at, trackers, recent)
        carried = hold(_carried(maps, [*keys, *extra, "_set"], blocks, trackers, recent))
    kind = rows.schema[recent[0]].dataType if recent else None
    added = [T.StructField(o, T.DoubleType()) for t in trackers for o in t.values] + [T.StructField(t.count, T.LongType()) for t in trackers]
    added += [T.StructField(f"{recent[1]}_{i}", kind) for i in range(1, recent[2] + 1)] if recent else []
    if only:
        asked = F.col("_b") >= F.lit((high // size + 1 if begin is None else begin // size) - first) if low is not None else F.lit(False)
        base, carried = base.where(asked), carried.where(asked)
    left = base.withColumn("_h", share).groupBy("_b", "_h")
    right = carried.withColumn("_h", share).groupBy("_b", "_h")
    kept = [f for f in rows.schema.fields if keep is None or f.name in keep]
    return left.cogroup(right).applyInArrow(
        _filled(keys, sets, at, tuple(trackers), recent, [f.name for f in kept]), T.StructType([*kept, *added]))


@dataclass(frozen=True)
class Scan:
    """One of several histories over the same rows: ``frame`` holds its observations, and ``made`` makes those of one block from the block's rows."""

    frame: DataFrame
    made: Callable[[pa.Table], pa.Table]
    keys: tuple[str, ...]
    trackers: tuple[Trackers, ...]
    recent: tuple[str, str, int] | None = None


def block_states(rows: DataFrame, at: str, scans: Sequence[Scan], beside: DataFrame, finish: Callable[[pa.Table, list[pa.Table], pa.Table], pa.Table],
                 schema: T.StructType) -> DataFrame:
    """``prior_states`` of several histories in one step: every block of ``rows`` meets all states it starts from, and the rows of ``beside`` of its numbers.

    ``at`` numbers ``rows`` and ``beside`` densely. ``finish`` makes a block's result from its rows, one table per scan, in the order of what
    ``made`` returns, with prior counts and averages as in ``prior_states``, and the block's part of ``beside`` (``at`` and doubles).
    """
    size = SPANS * min(t.span for s in scans for t in s.trackers)
    low, high = rows.agg(F.min(at), F.max(at)).first()
    first, blocks = (0, 0) if low is None else (low // size, high // size - low // size + 1)

    def block(df: DataFrame) -> DataFrame:
        return df.withColumn("_b", F.floor(F.col(at) / F.lit(size)) - F.lit(first))

    states, steps = [], []
    with passing(rows.sparkSession) as hold:
        for i, s in enumerate(scans):
            sets = list(dict.fromkeys([*([()] if s.recent else []), *[t.by for t in s.trackers]]))
            extra = list(dict.fromkeys(c for by in sets for c in by))
            maps = _block_maps(block(s.frame).withColumn("_h", F.lit(0).cast("long")), list(s.keys), extra, sets, at, s.trackers, s.recent)
            carried = hold(_carried(maps, [*s.keys, *extra, "_set"], blocks, s.trackers, s.recent))
            states.append(carried.select("_b", F.struct(*[c for c in carried.columns if c != "_b"]).alias(f"_{i}")))
            steps.append((f"_{i}", s.made, _filled(list(s.keys), sets, at, s.trackers, s.recent, None)))
    numbers = [c for c in beside.columns if c != at]
    states.append(block(beside).select("_b", F.struct(at, *[F.col(c).cast("double").alias(c) for c in numbers]).alias("_beside")))
    right = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        def part(name: str) -> pa.Table:
            kept = states[name].combine_chunks()
            return pa.Table.from_struct_array(kept.filter(kept.is_valid()))

        filled = [fill(made(rows), part(name)) for name, made, fill in steps]
        return finish(rows, filled, part("_beside"))

    return block(rows).groupBy("_b").cogroup(right.groupBy("_b")).applyInArrow(run, schema)


def _codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """One number per row, equal where all columns are equal or null together."""
    code = None
    for c in columns:
        one = pc.dictionary_encode(c.combine_chunks(), null_encoding="encode")
        one = (one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = one if code is None else np.unique(code * (one.max(initial=0) + 1) + one, return_inverse=True)[1].reshape(-1)
    return code


def _scan(u: np.ndarray, seat: np.ndarray, decay: float) -> np.ndarray:
    """Per segment of rows (``seat``: place in the segment), e[i] = u[i] + decay * e[i - 1], by doubling; what is not finite never fades."""
    e, step, odd = u.copy(), 1, not np.isfinite(u).all()
    longest = int(seat.max(initial=0))
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        while step <= longest:
            weight = decay ** step
            if weight == 0.0 and not odd:
                break
            rows = np.flatnonzero(seat >= step)
            before = e[rows - step]
            e[rows] += np.where(np.isfinite(before), weight * before, before) if odd else weight * before
            step *= 2
    return e


def _values(table: pa.Table, names: Sequence[str], rows: np.ndarray) -> np.ndarray:
    """The columns as doubles, in the given rows, in which none is null."""
    taken = [table[c].combine_chunks().take(pa.array(rows)) for c in names]
    return np.stack([c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in taken], axis=1)


class _Segments:
    """Rows of a table in the order (key, order number), and which of them hold a value."""

    def __init__(self, code: np.ndarray, at: np.ndarray) -> None:
        self.order = np.lexsort((at, code))
        self.code = code[self.order]
        self.start = np.flatnonzero(np.diff(self.code, prepend=self.code[:1] - 1))  # of each key present
        self.lengths = np.diff(self.start, append=len(code))

    def observed(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with a value, their places in their segments; per ordered row the values before it, and where its segment's begin."""
        held = column.combine_chunks().is_valid().to_numpy(zero_copy_only=False)[self.order]
        before = np.cumsum(held) - held
        begin = np.repeat(before[self.start], self.lengths)
        return self.order[held], (before - begin)[held], before - begin, begin

    def count(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows each key has."""
        held = np.zeros(len(self.order), np.int64)
        held[rows] = 1
        return np.add.reduceat(held[self.order], self.start)


def _block_maps(base: DataFrame, keys: list[str], extra: list[str], sets: list[tuple[str, ...]], at: str,
                trackers: Sequence[Trackers], recent) -> DataFrame:
    """One row per set of ``by`` columns, key and block: observations, where a block's values lead, the first value, the last values of ``recent``."""
    columns = list(dict.fromkeys([*keys, *extra, "_b", "_h", at, *[v for t in trackers for v in t.values.values()], *([recent[0]] if recent else [])]))
    fields = _fields(trackers, base.schema[recent[0]].dataType if recent else None)
    schema = T.StructType([T.StructField(c, base.schema[c].dataType) for c in dict.fromkeys([*keys, *extra])] + [
        T.StructField("_set", T.IntegerType()), T.StructField("_b", T.LongType()), T.StructField("m", T.StructType(fields))])
    names = [f.name for f in fields]
    trackers = tuple(trackers)

    def run(table: pa.Table) -> pa.Table:
        out, number = [], table[at].to_numpy()
        for which, by in enumerate(sets):
            seg = _Segments(_codes([table[c] for c in [*keys, *by]]), number)
            n, made = len(seg.start), {}
            for t in trackers:
                if t.by != by:
                    made[f"n_{t.count}"] = pa.array(np.zeros(n, np.int64))
                    made |= {f"{x}_{o}": pa.array(np.zeros(n), mask=np.full(n, x == "first")) for o in t.values for x in ("end", "first")}
                    continue
                rows, seat, _, _ = seg.observed(table[next(iter(t.values.values()))])
                v = _values(table, list(t.values.values()), rows)
                e = _scan(t.alpha * v, seat, t.decay)
                count = seg.count(rows)
                last = np.cumsum(count) - 1
                none = count == 0
                made[f"n_{t.count}"] = pa.array(count.astype(np.int64))
                for i, o in enumerate(t.values):
                    end = np.zeros(n)
                    end[~none] = e[last[~none], i]
                    begun = np.zeros(n)
                    begun[~none] = v[(last - count + 1)[~none], i]
                    made[f"end_{o}"], made[f"first_{o}"] = pa.array(end), pa.array(begun, mask=none)
            if recent:
                if by == ():
                    rows, _, _, _ = seg.observed(table[recent[0]])
                    count = seg.count(rows)
                    kept = np.minimum(count, recent[2])
                    ends = np.cumsum(count)
                    place = np.concatenate([[0], np.cumsum(kept)])
                    index = np.arange(place[-1]) - np.repeat(place[:-1], kept) + np.repeat(ends - kept, kept)
                    made["recent"] = pa.ListArray.from_arrays(pa.array(place, pa.int32()), table[recent[0]].combine_chunks().take(pa.array(rows[index])))
                else:
                    made["recent"] = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), table[recent[0]].combine_chunks()[:0])
            keyed = table.take(pa.array(seg.order[seg.start]))
            here = {c: keyed[c] if c in (*keys, *by) else pa.nulls(n, table.schema.field(c).type) for c in dict.fromkeys([*keys, *extra])}
            maps = pa.StructArray.from_arrays([made[x] for x in names], names=names)
            out.append(pa.table({**here, "_set": pa.array(np.full(n, which, np.int32)), "_b": keyed["_b"], "m": maps}))
        return pa.concat_tables(out)

    return base.select(*columns).groupBy("_b", "_h").applyInArrow(run, schema)


def _filled(keys: list[str], sets: list[tuple[str, ...]], at: str, trackers: tuple[Trackers, ...], recent, columns: list[str] | None):
    """A block's rows, or their ``columns``, with their prior states, from the states that its keys start from."""
    def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
        number, total, made = rows[at].to_numpy(), rows.num_rows, {}
        if not total:
            starts = starts.slice(0, 0)
        for which, by in enumerate(sets):
            mine = starts.filter(pc.equal(starts["_set"], which))
            both = _codes([pa.chunked_array([*rows[c].chunks, *mine[c].chunks], rows[c].type) for c in [*keys, *by]])
            code, place = both[:total], np.full(both.max(initial=-1) + 1, -1)
            place[both[total:]] = np.arange(mine.num_rows)
            place = place[code]  # of each row's start
            begun = mine["_start"].combine_chunks()
            seg = _Segments(code, number)
            for t in trackers:
                if t.by != by:
                    continue
                held, seat, before, begin = seg.observed(rows[next(iter(t.values.values()))])
                known = begun.field(f"n_{t.count}").to_numpy(zero_copy_only=False)[place]
                count = np.empty(total, np.int64)
                count[seg.order] = before
                state = np.stack([begun.field(f"e_{o}").fill_null(0.0).to_numpy(zero_copy_only=False)[place] for o in t.values], axis=1)
                v = _values(rows, list(t.values.values()), held)
                with np.errstate(invalid="ignore", over="ignore"):
                    u, head = t.alpha * v, seat == 0
                    old = state[held[head]]
                    u[head] = np.where((known[held[head]] > 0)[:, None], u[head] + np.where(np.isfinite(old), t.decay * old, old), v[head])
                e = _scan(u, seat, t.decay)
                some = before > 0
                state[seg.order[some]] = e[(begin + before - 1)[some]]
                for i, o in enumerate(t.values):
                    made[o] = pa.array(state[:, i], mask=known + count == 0)
                made[t.count] = pa.array(known + count)
            if recent and by == ():
                held, _, before, begin = seg.observed(rows[recent[0]])
                lists = begun.field("recent")
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[place][seg.order]
                ends = ends[place][seg.order]
                column = rows[recent[0]]
                pool = pa.chunked_array([column.combine_chunks().take(pa.array(held)), lists.flatten()], column.type).combine_chunks()
                for i in range(1, recent[2] + 1):
                    index = np.empty(total, np.int64)
                    index[seg.order] = np.where(i <= before, begin + before - i, np.where(i - before <= size, len(held) + ends - (i - before), -1))
                    made[f"{recent[1]}_{i}"] = pool.take(pa.array(index, mask=index < 0))
        wanted = [o for t in trackers for o in t.values] + [t.count for t in trackers] + ([f"{recent[1]}_{i}" for i in range(1, recent[2] + 1)] if recent else [])
        kept = rows.column_names if columns is None else columns
        return pa.table([*[rows[c] for c in kept], *[made[c] for c in wanted]], names=[*kept, *wanted])

    return run


def _fields(trackers: Sequence[Trackers], kind: T.DataType | None) -> list[T.StructField]:
    fields = [T.StructField(f"n_{t.count}", T.LongType()) for t in trackers]
    fields += [T.StructField(f"{x}_{o}", T.DoubleType()) for t in trackers for o in t.values for x in ("end", "first")]
    return fields + ([T.StructField("recent", T.ArrayType(kind))] if kind is not None else [])


def _fade(decay: float, steps: Column) -> Column:
    return F.pow(F.lit(decay), steps.cast("double"))


def _held(weight: Column, state: Column) -> Column:
    """A state after it has faded; what never fades stays."""
    return F.when(F.isnan(state) | (F.abs(state) == float("inf")), state).otherwise(weight * state)


def _carried(maps: DataFrame, on: list[str], blocks: int, group: Sequence[Trackers], recent) -> DataFrame:
    """(key, block, _start): the state each block starts from; its average is the key's first value where nothing came before."""
    maps = materialize(maps)
    kind = maps.schema["m"].dataType
    decay = {o: t.decay for t in group for o in t.values}
    count = {o: f"n_{t.count}" for t in group for o in t.values}
    keep = recent[2] if recent else 0

    def both(a: Column, b: Column) -> Column:
        """The map of one run followed by another's."""
        fields = [(a[f"n_{t.count}"] + b[f"n_{t.count}"]).alias(f"n_{t.count}") for t in group]
        for o in decay:
            faded = _held(_fade(decay[o], b[count[o]]), a[f"end_{o}"])
            fields += [(faded + b[f"end_{o}"]).alias(f"end_{o}"), F.coalesce(a[f"first_{o}"], b[f"first_{o}"]).alias(f"first_{o}")]
        if recent:
            joined = F.concat(a["recent"], b["recent"])
            fields.append(F.slice(joined, F.greatest(F.size(joined) - keep + 1, F.lit(1)), keep).alias("recent"))
        # In the order and with the types of the maps, as the fold asks for.
        named = dict(zip(_names(group, recent), fields))
        return F.struct(*[named[f.name].cast(f.dataType).alias(f.name) for f in kind.fields]).cast(kind)

    def nothing() -> Column:
        def zero(f: T.StructField) -> Column:
            value = F.array() if f.name == "recent" else F.lit(None) if f.name.startswith("first_") else F.lit(0)
            return value.cast(f.dataType).alias(f.name)

        return F.struct(*[zero(f) for f in kind.fields]).cast(kind)

    def incoming(level: DataFrame, blocks: int) -> DataFrame:
        """(key, _b, before): the map of everything before each block of the level."""
        runs = level.withColumn("_u", F.floor(F.col("_b") / F.lit(FAN))).groupBy(*on, "_u").agg(
            F.array_sort(F.collect_list(F.struct("_b", "m")), lambda x, y: (x["_b"] - y["_b"]).cast("int")).alias("l"))  # at most FAN
        if blocks > FAN:
            runs = materialize(runs)
            whole = runs.select(*on, F.col("_u").alias("_b"), F.aggregate("l", nothing(), lambda s, x: both(s, x["m"])).alias("m"))
            above = incoming(whole, -(-blocks // FAN)).withColumnRenamed("_b", "_u")
            match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*on, "_u"]]
            runs = runs.alias("l").join(above.alias("r"), match).select("l.*", "r.before")
        else:
            runs = runs.withColumn("before", nothing())
        # One fold along the run: what came before each block is kept as it goes by, so a block is put together once.
        kept = F.array(F.struct(F.lit(0).cast("long").alias("_b"), nothing().alias("before"), nothing().alias("m")))
        none = F.filter(kept, lambda x: F.lit(False))
        start = F.struct(F.col("before").alias("now"), none.alias("kept"))
        steps = F.aggregate("l", start, lambda s, x: F.struct(
            both(s["now"], x["m"]).alias("now"),
            F.concat(s["kept"], F.array(F.struct(x["_b"].alias("_b"), s["now"].alias("before"), x["m"].alias("m")))).alias("kept")), lambda s: s["kept"])
        return runs.select(*on, F.inline(steps)).select(*on, "_b", "before", "m")

    found = incoming(maps, blocks)

    def start(o: str) -> Column:
        """Where the state stands: from the history's first value through all maps before the block."""
        b, n = F.col("before"), F.col("before")[count[o]]
        begun = F.coalesce(b[f"first_{o}"], F.col("m")[f"first_{o}"])
        return F.when(n > 0, _held(_fade(decay[o], n), begun) + b[f"end_{o}"]).otherwise(begun)

    fields = [F.col("before")[f"n_{t.count}"].alias(f"n_{t.count}") for t in group] + [start(o).alias(f"e_{o}") for o in decay]
    if recent:
        fields.append(F.col("before")["recent"].alias("recent"))
    # Written, as the blocks are read with their rows.
    return materialize(found.select(*on, "_b", F.struct(*fields).alias("_start")))


def _names(group: Sequence[Trackers], recent) -> list[str]:
    """Fields of ``both`` in the order it makes them."""
    counts = [f"n_{t.count}" for t in group]
    return counts + [f"{x}_{o}" for t in group for o in t.values for x in ("end", "first")] + (["recent"] if recent else [])


def ema_prior(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, name: str = "ema") -> DataFrame:
    """Exponential moving average over strictly prior rows; nulls leave it unchanged, null when unset."""
    return prior_states(df, keys, order, [Trackers({name: value}, "_obs", alpha)]).drop("_obs")
