"""One-to-one name matching between two sources, block by block.

The result equals taking the best free pair over and over, in the order (score desc, left, right),
until no pair reaches the threshold. It is reached without writing out all pairs of a block:

1. names joined by a fixed alias;
2. names equal after normalisation, the only pairs with score 1, zipped by rank;
3. for what is left, level by level of falling thresholds: pairs that share a token, or share enough letters for the
   character ratio to reach the level (a prefix index over letters), followed by rounds that keep mutual best pairs.

Pairs at or above a level are all taken before any below it, so names that have found their partner never meet the weaker
candidates, which are the many: at 0.40 the letter index lets most pairs of a block through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.functions.names import ALIASES, name_similarity, normalize_names, token_jaccard
from touchline.operators.ordering import dense_index
from touchline.session import materialize

#: Scores at which a level ends, besides the threshold itself.
LEVELS = (0.6,)

# Letters from rare to common; any fixed order is right, this one makes the index selective.
_RANK = {c: i for i, c in enumerate("0123456789qxjzwkvfybhgpmucdltoirnsae")}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(joined: pd.Series) -> pd.Series:
    """Each letter with its occurrence number ('a1', 'a2'), rare letters first: a multiset as a set."""
    def numbered(text):
        seen, out = Counter(), []
        for c in sorted(text, key=_RANK.__getitem__):
            seen[c] += 1
            out.append(f"{c}{seen[c]}")
        return out

    return joined.map(numbered)


def _indexed(names: DataFrame, threshold: float) -> DataFrame:
    """Adds the letter multiset and the part of it that any good enough partner must touch."""
    size = F.size("letters")
    least = F.ceil(F.lit(threshold / (2.0 - threshold)) * size - F.lit(1e-9))
    lettered = names if "letters" in names.columns else names.withColumn("letters", _letters(F.col("joined")))
    return lettered.withColumn(
        "prefix", F.slice("letters", F.lit(1), F.greatest(size - least + 1, F.lit(1)).cast("int")))


def candidate_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """Pairs in one block whose similarity can reach the threshold, each once.

    Inputs hold the block columns, a name, ``tokens`` and ``joined``; output has both sides with the
    prefixes l_ and r_.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        renamed = _indexed(df, threshold)
        return renamed.select(*block, *[F.col(c).alias(f"{tag}_{c}") for c in ("name", "tokens", "joined", "letters", "prefix")])

    l, r = side(left, "l"), side(right, "r")

    def meet(on: str) -> DataFrame:
        pairs = l.withColumn("_key", F.explode(f"l_{on}")).join(
            r.withColumn("_key", F.explode(f"r_{on}")), [*block, "_key"])
        first = F.get(F.array_intersect(f"l_{on}", f"r_{on}"), F.lit(0))
        return pairs.where(F.col("_key") == first).drop("_key")

    shared = F.size(F.array_intersect("l_letters", "r_letters"))
    reach = 2.0 * shared / (F.size("l_letters") + F.size("r_letters")) >= threshold - 1e-12
    by_letters = meet("prefix").where(reach)
    by_token = meet("tokens").where(
        ~(F.arrays_overlap("l_prefix", "r_prefix") & reach) & (token_jaccard("l_tokens", "r_tokens") >= threshold - 1e-12))
    return by_letters.unionByName(by_token)


def _take(pairs: DataFrame, block: Sequence[str]) -> DataFrame:
    return pairs.select(*block, "left_name", "right_name", "score")


def _alias_pairs(names: DataFrame, block: list[str], aliases: dict[str, str]) -> DataFrame:
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.col("name"))
    wanted = names.where("is_left").select(*block, F.col("name").alias("left_name"), target.alias("right_name"))
    known = names.where("NOT is_left").select(*block, F.col("name").alias("right_name"))
    return _take(wanted.join(known, [*block, "right_name"]).withColumn("score", F.lit(1.0)), block)


def _without(names: DataFrame, pairs: DataFrame, block: list[str]) -> DataFrame:
    """Names not used in ``pairs`` on their own side."""
    used = pairs.select(*block, F.inline(F.array(
        F.struct(F.col("left_name").alias("name"), F.lit(True).alias("is_left")),
        F.struct(F.col("right_name").alias("name"), F.lit(False).alias("is_left")))))
    return names.join(used, [*block, "name", "is_left"], "left_anti")


def _zipped(names: DataFrame, several: DataFrame, block: list[str]) -> DataFrame:
    """Groups with several spellings on both sides: paired by rank."""
    same = [*block, "joined"]
    members = names.join(several, same, "left_semi")
    sides = [
        dense_index(members.where(F.col("is_left") == left).select(*same, F.col("name").alias(c)), same, c, "_rank")
        for left, c in ((True, "left_name"), (False, "right_name"))]
    return _take(sides[0].join(sides[1], [*same, "_rank"]).withColumn("score", F.lit(1.0)), block)


def match_names(left: DataFrame, right: DataFrame, block: Sequence[str], threshold: float = 0.40,
                aliases: dict[str, str] | None = None) -> DataFrame:
    """Block columns, left_name, right_name, score. Inputs: block columns and left_name / right_name."""
    block = list(block)
    aliases = ALIASES if aliases is None else aliases
    stacked = left.select(*block, F.col("left_name").alias("name"), F.lit(True).alias("is_left")).unionByName(
        right.select(*block, F.col("right_name").alias("name"), F.lit(False).alias("is_left"))).distinct()
    names = materialize(normalize_names(stacked.where("name IS NOT NULL"), "name"))
    found = []

    if aliases and not names.where(F.col("is_left") & F.col("name").isin(list(aliases))).isEmpty():
        found.append(materialize(_alias_pairs(names, block, aliases)))
        names = _without(names, found[0], block)

    names = names.where(F.size("tokens") > 0)
    l, r = F.when(F.col("is_left"), F.col("name")), F.when(~F.col("is_left"), F.col("name"))
    groups = materialize(names.groupBy(*block, "joined").agg(
        F.min(l).alias("left_name"), F.count(l).alias("_nl"), F.min(r).alias("right_name"), F.count(r).alias("_nr")))
    many = (F.col("_nl") > 1) & (F.col("_nr") > 1)
    paired = F.least("_nl", "_nr")
    left_over = groups.agg(
        F.sum(F.col("_nl") - paired).alias("l"), F.sum(F.col("_nr") - paired).alias("r"),
        F.count_if(many).alias("several")).first()
    equal = _take(groups.where(~many & (F.col("_nl") > 0) & (F.col("_nr") > 0)).withColumn("score", F.lit(1.0)), block)
    if left_over["several"]:
        equal = materialize(equal.unionByName(_zipped(names, groups.where(many), block)))
    found.append(equal)
    if not (left_over["l"] and left_over["r"]):
        return reduce(DataFrame.unionByName, found)

    # Written with their letters, so that no later task needs a Python worker for each side besides the one that scores.
    rest = _without(names, equal, block).withColumn("letters", _letters(F.col("joined")))
    for level in [*[x for x in LEVELS if x > threshold], threshold]:
        rest = materialize(rest)
        taken = _level(rest, block, level)
        found += taken
        if taken:
            rest = _without(rest, reduce(DataFrame.unionByName, taken), block)
    return reduce(DataFrame.unionByName, found)


def _level(names: DataFrame, block: list[str], level: float) -> list[DataFrame]:
    """Pairs that reach the level, the best free pair first: mutual best pairs, round by round."""
    scored = candidate_pairs(names.where("is_left"), names.where("NOT is_left"), block, level).select(
        *block, F.col("l_name").alias("left_name"), F.col("r_name").alias("right_name"),
        name_similarity("l_tokens", "l_joined", "r_tokens", "r_joined").alias("score"))
    open_pairs, taken = materialize(scored.where(F.col("score") >= level)), []
    while not open_pairs.isEmpty():
        best_l = open_pairs.groupBy(*block, "left_name").agg(
            F.min(F.struct((-F.col("score")).alias("s"), "right_name")).alias("b")
        ).select(*block, "left_name", "b.right_name", (-F.col("b.s")).alias("score"))
        best_r = open_pairs.groupBy(*block, "right_name").agg(
            F.min(F.struct((-F.col("score")).alias("s"), "left_name")).alias("b")
        ).select(*block, "b.left_name", "right_name")
        mutual = materialize(_take(best_l.join(best_r, [*block, "left_name", "right_name"]), block))
        taken.append(mutual)
        open_pairs = materialize(
            open_pairs.join(mutual, [*block, "left_name"], "left_anti")
            .join(mutual, [*block, "right_name"], "left_anti"))
    return taken


def event_name_map(stats: DataFrame, teams: DataFrame, threshold: float = 0.40) -> DataFrame:
    """league, season, source_name, team_name from event team names and schedule team names."""
    source = stats.select("league", "season", F.col("team").alias("left_name"))
    known = teams.select("league", "season", F.col("team").alias("right_name"))
    return match_names(source, known, ["league", "season"], threshold).select(
        "league", "season", F.col("left_name").alias("source_name"), F.col("right_name").alias("team_name"))
