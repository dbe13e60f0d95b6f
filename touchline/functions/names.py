"""Name normalisation and similarity. Python runs on distinct names or candidate pairs only."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from touchline.functions.scalars import col

# Tokens that say nothing about which club is meant.
STOPWORDS = [
    "fc", "afc", "cf", "cd", "ac", "as", "ssc", "rc", "sc", "ud", "sd", "us",
    "calcio", "club", "de", "the", "1", "04", "05", "08", "09",
    "1846", "1899", "1900",
]
# Abbreviations no text similarity resolves.
ALIASES = {"PSG": "Paris Saint-Germain", "RBL": "RB Leipzig"}


@F.pandas_udf(T.StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    def fold(s):
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))

    return names.map(fold)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def tokens_of(folded: Column | str) -> Column:
    """Sorted distinct tokens of an already folded name, without the stopwords."""
    words = F.split(F.regexp_replace(col(folded), "[^a-z0-9]+", " "), " ")
    kept = F.array_except(words, F.array(*[F.lit(w) for w in ["", *STOPWORDS]]))
    return F.array_sort(F.array_distinct(kept))


def normalize_names(df: DataFrame, name: str, tokens: str = "tokens", joined: str = "joined") -> DataFrame:
    return df.withColumn(tokens, tokens_of(fold_accents(col(name)))).withColumn(
        joined, F.array_join(F.col(tokens), "")
    )


def token_jaccard(left: Column | str, right: Column | str) -> Column:
    a, b = col(left), col(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def name_similarity(left_tokens, left_joined, right_tokens, right_joined) -> Column:
    """The larger of token Jaccard and the character ratio; 0 if either name has no token left."""
    empty = (F.size(col(left_tokens)) == 0) | (F.size(col(right_tokens)) == 0)
    return F.when(empty, 0.0).otherwise(
        F.greatest(token_jaccard(left_tokens, right_tokens), sequence_ratio(col(left_joined), col(right_joined)))
    )
