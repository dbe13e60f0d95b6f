"""Conversations brought back to ``(s?(ua)+)?`` by their cheapest edits: a Wagner-Fischer alignment per target length.

The grammar has one string per length (0, 2, 3, 4, ...; odd ones begin with the system turn), so a conversation is aligned with every
length that could still be as cheap as the best one found. The incumbent's cost bounds how far an alignment may stray from the
diagonal (Ukkonen's band), and the lengths worth trying. Costs to go are filled from the end, so following the least letter
forwards spells the ASCII-least audit of its length; audits of lengths that cost the same are compared.

Only one letter per turn is gathered per conversation. Texts are sorted behind their edits and hashed as they pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from touchline.llm.common import SPACES, type_of
from touchline.session import materialize

REROLE, INSERT, DELETE, CUT = 3, 3, 4, 3
ROLES = {"u": "user", "a": "assistant"}
FORCED = "-"  # a turn that has to go; else s, u, a or x (any other role), upper case where the text is cut short
FAR = 1 << 40
VISIBLE, ENDS = r"[^\x20\x09-\x0D]", ".!?"


def target(length: int) -> str:
    return ("s" if length % 2 else "") + "ua" * (length // 2)


def _spent(n: int, cheap: int) -> int:
    """Least cost of n deletions where so many turns are cut short and cost one to delete instead of keeping."""
    return min(n, cheap) * (DELETE - CUT) + max(0, n - cheap) * DELETE


def _band(m: int, length: int, cheap: int, limit: int) -> tuple[int, int]:
    """Least and largest lead of the target over the turns that a path of at most this cost can have."""
    end = length - m

    def cost(lead: int) -> int:
        into = INSERT * lead if lead > 0 else _spent(-lead, cheap)
        rest = end - lead
        return into + (INSERT * rest if rest > 0 else _spent(-rest, cheap))

    low, high = min(0, end), max(0, end)
    while low > -m and cost(low - 1) <= limit:
        low -= 1
    while high < length and cost(high + 1) <= limit:
        high += 1
    return low, high


def _align(turns: str, length: int, limit: int, cheap: int) -> tuple[int, str | None]:
    """Cost over the unavoidable one, and the ASCII-least audit if it is within the limit, of turns against one target."""
    m, low = len(turns), 0
    low, high = _band(m, length, cheap, limit)
    width, odd = high - low + 1, length % 2
    leads = np.arange(low, high + 1)
    wanted = np.frombuffer((" " * (m + width) + target(length) + " " * (m + width)).encode(), "u1")
    at = m + width  # place of the target's first letter
    codes = np.frombuffer(turns.lower().encode(), "u1")
    go = [DELETE - CUT if t.isupper() else DELETE for t in turns]
    togo = np.empty((m + 1, width), np.int64)
    j = m + leads
    togo[m] = np.where((j >= 0) & (j <= length), INSERT * (length - j), FAR)
    if odd and 0 <= -m - low < width:
        togo[m, -m - low] = FAR
    step = INSERT * leads
    for i in range(m - 1, -1, -1):
        after = togo[i + 1]
        want = wanted[at + i + low:at + i + high + 1]
        found = after + np.where(want == codes[i], 0, np.where((want == 117) | (want == 97), REROLE, FAR))
        found[1:] = np.minimum(found[1:], after[:-1] + go[i])
        first = -i - low  # where no letter of the target is used
        if first > 0:
            found[:first] = FAR
        past = length - i - low + 1
        if past < width:
            found[max(0, past):] = FAR
        filled = np.minimum.accumulate((found + step)[::-1])[::-1] - step
        if odd and 0 <= first < width:
            filled[first] = found[first]
        if first > 0:
            filled[:first] = FAR
        togo[i] = filled
    if -low >= width or togo[0, -low] > limit:
        return FAR, None
    out, i, j = [], 0, 0
    while i < m or j < length:
        here = togo[i, j - i - low]
        lead = j - i - low
        if i < m and lead >= 1 and togo[i + 1, lead - 1] + go[i] == here:
            out.append("D")
            i += 1
        elif j < length and lead + 1 < width and not (odd and j == 0) and togo[i, lead + 1] + INSERT == here:
            out.append("I")
            j += 1
        else:
            out.append("K" if wanted[at + j] == codes[i] else "R")
            i, j = i + 1, j + 1
    return int(togo[0, -low]), "".join(out)


@lru_cache(maxsize=50_000)
def repair(turns: str) -> tuple[int, str]:
    """Least cost and ASCII-least audit. ``turns``: one letter per turn, ``FORCED`` for turns that have to be deleted."""
    kept = turns.replace(FORCED, "")
    m, cheap = len(kept), sum(t.isupper() for t in kept)
    plain = kept.lower()
    # Every turn kept or given the wanted role, one put in at the end of an odd number.
    incumbent = REROLE * sum(a != b for a, b in zip(plain, target(m + m % 2))) + INSERT * (m % 2)
    incumbent = min(incumbent, _spent(m, cheap))
    audits, lengths = [], {}
    for length in [0, *range(2, m + incumbent // INSERT + 2)]:
        lengths[length] = INSERT * (length - m) if length >= m else _spent(m - length, cheap)
    for length in sorted(lengths, key=lambda n: (lengths[n], n)):
        if lengths[length] > incumbent:
            break
        cost, audit = _align(kept, length, incumbent, cheap)
        if audit is not None and cost <= incumbent:
            audits = [a for a in audits if cost == incumbent] + [audit]
            incumbent = cost
    letters, out, rows = iter(min(audits)), [], iter(turns)
    # Forced deletions come before anything else that can stand at their place: no letter is less than D.
    for row in rows:
        if row == FORCED:
            out.append("D")
            continue
        for letter in letters:
            out.append(letter)
            if letter != "I":
                break
    out.extend(letters)
    return incumbent + DELETE * (len(turns) - m) + CUT * cheap, "".join(out)


def edits(turns: str, audit: str) -> list[tuple[int, str, str | None]]:
    """(turn's number from 1, letter, new role) in order; a turn put in has the number of the turn behind it."""
    wanted, out, at, row = target(sum(x != "D" for x in audit)), [], 0, 1
    for letter in audit:
        role = None if letter == "D" else wanted[at]
        out.append((row, letter, ROLES[role] if letter in "IR" else None))
        at += letter != "D"
        row += letter != "I"
    return out


# Spark

def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and whether the row was dropped; nulls in role and text are one space.

    By the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes
    it a user's.
    """
    conv, at, who, said = (rows[f"`{c}`"] for c in (conv_id, turn, role, text))

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    drawn = F.crc32(F.concat(shown(conv), F.lit(":"), shown(at)).cast("binary")) % 20
    body = shown(said)
    out = rows.select(
        conv.alias("conv"), at.alias("turn"), F.when(drawn == 4, "user").otherwise(shown(who)).alias("role"),
        F.when(drawn == 1, "").when(drawn == 2, F.translate(body, ENDS, "")).otherwise(body).alias("text"),
        (drawn == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(drawn == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds each row's number in its conversation (by turn, nulls first; equal turns by role and text) and its first fault.

    The windows refine the partitioning by conversation, so one shuffle serves them.
    """
    order = [F.asc_nulls_first("turn"), "role", "text"]
    live = Window.partitionBy("conv", "dropped").orderBy(*order)
    same = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    ending = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return rows.withColumns({"rn": F.row_number().over(live).cast("long"), "_seen": F.row_number().over(same)}).withColumn(
        "fault", F.when(~F.col("text").rlike(VISIBLE), "blank").when(F.col("_seen") > 1, "duplicate")
        .when(~ending.isin(*ENDS), "truncated")).drop("_seen")


def conversation_codes(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, fault counts, illegal neighbours, and one letter per turn."""
    alive = ~F.col("dropped")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), FORCED).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    before = F.lag(initial).over(Window.partitionBy("conv", "dropped").orderBy("rn"))
    pair = F.concat(before, initial)
    marked = rows.select("conv", "turn", "dropped", "rn", "fault", letter.alias("letter"), (
        (F.col("rn") > 1) & ~F.coalesce(pair, F.lit("")).isin("su", "ua", "au")).alias("bad"))
    live_turn = F.when(alive, F.col("turn"))
    return marked.groupBy("conv").agg(
        F.coalesce(F.max(live_turn) - F.min(live_turn) + 1 - F.count_distinct(live_turn), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(alive & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(alive & F.col("bad")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(alive, F.struct("rn", "letter")))), lambda x: x["letter"]), "").alias("turns"))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: its figures, cost, audit and the hash of the repaired turns."""
    rows = materialize(rows)
    conv_type = type_of(rows, "conv")
    schema = T.StructType([T.StructField("conv", conv_type), *[T.StructField(c, T.LongType()) for c in FIGURES], T.StructField("audit", T.StringType()),
                           T.StructField("edits", T.ArrayType(T.StructType.fromDDL("rn long, letter string, new string")))])

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(*repair(t), t) for t in pdf["turns"]]
            yield pdf.drop(columns="turns").assign(
                cost=[c for c, _, _ in found], audit=[a for _, a, _ in found],
                edits=[[{"rn": r, "letter": x, "new": n} for r, x, n in edits(t, a)] for _, a, t in found])

    aligned = materialize(conversation_codes(rows).mapInPandas(align, schema))

    def nothing(kind: str, *names: str) -> dict[str, Column]:
        return {n: F.lit(None).cast(kind) for n in names}

    # Sorted by conversation: its figures, then each edit right before the turn it works on.
    head = aligned.drop("edits").withColumns({"rn": F.lit(0).cast("long"), "step": F.lit(0), **nothing("string", "letter", "role", "text")})
    steps = aligned.select("conv", F.posexplode("edits").alias("step", "e")).select(
        "conv", F.col("e.rn").alias("rn"), "step", F.col("e.letter").alias("letter"), F.col("e.new").alias("role"))
    steps = steps.withColumns({**nothing("long", *FIGURES), **nothing("string", "audit", "text")})
    turns = rows.where("NOT dropped").select("conv", "rn", F.lit((1 << 31) - 1).alias("step"), "role", "text").withColumns(
        {**nothing("long", *FIGURES), **nothing("string", "audit", "letter")})
    stream = head.unionByName(steps).unionByName(turns).repartition("conv").sortWithinPartitions("conv", "rn", "step")
    result = T.StructType([*schema.fields[:-1], T.StructField("repaired_sha256", T.StringType())])
    figures = [*FIGURES, "audit"]

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, digest, first, edit = None, None, True, None

        def write(line: str) -> None:
            nonlocal first
            digest.update((line if first else "\n" + line).encode())
            first = False

        for pdf in frames:
            out = []
            for conv, rn, letter, role, text, *rest in zip(*[pdf[c] for c in ("conv", "rn", "letter", "role", "text", *figures)]):
                if rn == 0:
                    if known is not None:
                        out.append((*known, digest.hexdigest()))
                    known, digest, first = (conv, *rest), hashlib.sha256(), True
                elif letter == "I":
                    write(f"{role}:")
                elif letter is not None:
                    edit = letter, role
                elif edit[0] != "D":
                    write(f"{edit[1] or role}:{text}")
            if out:
                yield pd.DataFrame(out, columns=result.names)
        if known is not None:
            yield pd.DataFrame([(*known, digest.hexdigest())], columns=result.names)

    return stream.mapInPandas(hashed, result)


def conversation_report(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every conversation of the damaged rows: faults, the cheapest repair's cost and audit, and what it leaves, as a hash.

    Null role and text are one space, as is a null id or turn in the text that is drawn from; null ids are one conversation, null turns
    come first; rows with equal turns follow role and text; repeated rows are duplicates; empty texts are blank; texts of any length pass
    by one at a time; other columns are ignored; a conversation without rows after damage has zeros, an empty audit and the
    empty text's hash; an empty table gives an empty result. One conversation's letters, one a turn, and its alignment are
    held by one task.
    """
    found = repaired(faults(damaged(rows, conv_id, turn, role, text)))
    return found.select(F.col("conv").alias(conv_id), *FIGURES, "audit", "repaired_sha256")
