"""Scalar column functions: scores, seasons, dates, lenient numbers, clamps and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the first two integers in the text, whatever separates them.
SCORE_PATTERN = r"([0-9]+)[^0-9]+([0-9]+)"
STRICT_SCORE_PATTERN = r"^\s*([0-9]+)\s*[-–]\s*([0-9]+)\s*$"
#: Zone offsets and the basic form are read too.
_ZONE = r"(Z|[+-]\d{2}(:?\d{2})?)$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])"
_BASIC_TIME = r"(?<=[T ])(\d{2})(\d{2})(\d{2})?(?=$|\.|Z|[+-])"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$"
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ORDINAL_OF_EPOCH = 719163


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_score(score: Column | str, strict: bool = False) -> tuple[Column, Column]:
    """Home and away goals as integers, null where the text holds no score."""
    pattern = STRICT_SCORE_PATTERN if strict else SCORE_PATTERN
    return tuple(
        F.regexp_extract(col(score), pattern, g).try_cast("int") for g in (1, 2)
    )


def outcome_label(home_goals: Column | str, away_goals: Column | str) -> Column:
    """0 home win, 1 draw, 2 away win."""
    h, a = col(home_goals), col(away_goals)
    return F.when(h > a, 0).when(h == a, 1).when(h < a, 2)


def points(goals_for: Column | str, goals_against: Column | str) -> Column:
    f, a = col(goals_for), col(goals_against)
    return F.when(f > a, 3.0).when(f == a, 1.0).when(f < a, 0.0)


def rating_score(home_goals: Column | str, away_goals: Column | str) -> Column:
    h, a = col(home_goals), col(away_goals)
    return F.when(h > a, 1.0).when(h == a, 0.5).when(h < a, 0.0)


def _season_part(year: Column) -> Column:
    return F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")


def _if_season(code: Column, value: Column) -> Column:
    return F.when(code.rlike("^[0-9]{4}$"), value)


def prev_season(season: Column | str) -> Column:
    """'2526' -> '2425'; years wrap modulo 100; null unless the code has exactly four digits."""
    s = col(season)
    start = F.substring(s, 1, 2).try_cast("int")
    return _if_season(s, F.concat(_season_part(start - 1), _season_part(start)))


def next_season(season: Column | str) -> Column:
    s = col(season)
    start, end = (F.substring(s, p, 2).try_cast("int") for p in (1, 3))
    return _if_season(s, F.concat(_season_part(start + 1), _season_part(end + 1)))


def coerce_date(raw: Column | str) -> Column:
    """ISO text (or a timestamp) to a zone-free timestamp, null if it is not a date.

    The extended and the basic form are read. A time with an offset or Z is taken to UTC, then its zone is dropped.
    """
    text = col(raw).cast("string")
    # Plain text of the extended form, by far the most common, needs none of the rewriting. The rewriting stands in a function of its
    # own: in line with the rest it outgrows a generated method that the JVM compiles.
    other = F.get(F.transform(F.array(text), _rewritten_date), F.lit(0))
    return F.when(text.rlike(ISO_PATTERN), text.try_cast("timestamp_ntz")).otherwise(other)


def _rewritten_date(text: Column) -> Column:
    basic = F.regexp_replace(text, _BASIC, "$1-$2-$3")
    full = F.regexp_replace(F.regexp_replace(basic, _BASIC_TIME, "$1:$2:$3"), ":(?=$|Z|[+-])", "")
    zone = F.regexp_extract(full, "[T ].*?" + _ZONE, 1)
    local = F.when(zone == "", full).otherwise(F.regexp_replace(full, _ZONE, ""))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = (F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60
               + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    shift = F.when(zone.startswith("-"), minutes).otherwise(-minutes)
    read = F.when(local.rlike(ISO_PATTERN), local.try_cast("timestamp_ntz"))
    return F.when(zone == "", read).otherwise(read + F.make_dt_interval(mins=shift))


def game_day_from_text(game: Column | str) -> Column:
    return F.substring(col(game), 1, 10)


def game_day(date: Column | str) -> Column:
    return F.date_format(col(date), "yyyy-MM-dd")


def lenient_double(raw: Column | str) -> Column:
    """Number, else the part before the first '-', else 0."""
    text = col(raw).cast("string")

    def number(c: Column) -> Column:
        return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))

    return F.coalesce(number(text), number(F.substring_index(text, "-", 1)), F.lit(0.0))


def orient(home: Column | str, away: Column | str, value: Column | str) -> Column:
    """Flip the sign so that the value refers to the smaller name; the same call flips it back."""
    return F.when(col(home) > col(away), -col(value)).otherwise(col(value))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(col(x), F.lit(high))))


def season_progress(week: Column | str, span: Column | str) -> Column:
    w, s = col(week), col(span)
    return F.when(w.isNotNull() & (s > 0), clamp(w.cast("double") / s, 0.0, 1.0)).otherwise(0.0)


def whole_days(earlier: Column | str, later: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded towards minus infinity."""
    return F.floor(F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(86_400_000_000.0))


def epoch_micros(date: Column | str) -> Column:
    """Microseconds from 1970 on the date's own clock."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(date))


def micros_days(earlier: Column | str, later: Column | str) -> Column:
    """``whole_days`` of two ``epoch_micros``."""
    return F.floor((col(later) - col(earlier)) / F.lit(86_400_000_000.0))


def cold_start(value: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(value), F.lit(default))


def ordinal_day(date: Column | str) -> Column:
    """Proleptic ordinal day, 0 for a missing date."""
    return F.coalesce(F.unix_date(F.to_date(col(date))) + F.lit(ORDINAL_OF_EPOCH), F.lit(0))


def time_decay(day: Column | str, reference_day: Column | str, half_life: float) -> Column:
    """0.5 ** (age / half_life), 1 when decay is off. Mean-one rescaling is left to the aggregate."""
    if half_life <= 0:
        return F.lit(1.0)
    age = F.greatest(col(reference_day) - col(day), F.lit(0)).cast("double")
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))
