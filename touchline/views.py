"""Schedule, event, player, prediction, name and run tables derived from the base tables.

The SQL runs unchanged in Spark and in the checking engine, so both sides read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEDULE = """
SELECT CAST(o_orderkey AS STRING) AS game_id,
       concat(d, ' ', home_team, '-', away_team) AS game,
       concat(d, 'T00:00:00') AS date,
       league, season, home_team, away_team,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 1 + CAST(floor(((doy + 150) % 365) / 7.0) AS BIGINT) END AS week,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL
            WHEN o_orderkey % 101 = 0 THEN 'postponed'
            ELSE concat(CAST((o_orderkey * 7 + o_custkey) % 5 AS STRING),
                        CASE WHEN o_orderkey % 2 = 0 THEN '–' ELSE '-' END,
                        CAST((o_orderkey * 3 + o_custkey * 11) % 4 AS STRING)) END AS score
FROM (SELECT o_orderkey, o_custkey,
             substr(CAST(o_orderdate AS STRING), 1, 10) AS d,
             dayofyear(o_orderdate) AS doy,
             concat('L', CAST(n_regionkey AS STRING)) AS league,
             concat('T', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS home_team,
             concat('T', lpad(CAST((c_nationkey + 5 * (1 + o_orderkey % 4)) % 25 AS STRING), 2, '0')) AS away_team,
             CASE WHEN month(o_orderdate) >= 8
                  THEN concat(lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0'), lpad(CAST((year(o_orderdate) + 1) % 100 AS STRING), 2, '0'))
                  ELSE concat(lpad(CAST((year(o_orderdate) - 1) % 100 AS STRING), 2, '0'), lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0'))
             END AS season
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) s
"""

MATCH_EVENTS = """
SELECT s.game_id, s.game, s.league AS _league, s.season AS _season,
       concat('FC ', CASE WHEN l_linenumber % 2 = 0 THEN s.home_team ELSE s.away_team END) AS team,
       CASE l_partkey % 8 WHEN 0 THEN 'Goal' WHEN 1 THEN 'SavedShot' WHEN 2 THEN 'MissedShots' WHEN 3 THEN 'ShotOnPost'
                          WHEN 4 THEN 'CornerAwarded' WHEN 5 THEN 'Card' ELSE 'Pass' END AS type,
       CASE WHEN l_suppkey % 3 = 0 THEN 'Unsuccessful' ELSE 'Successful' END AS outcome_type,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 2 END AS x,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_quantity * 2 END AS end_x
FROM {lineitem} JOIN {v_schedule} s ON CAST(l_orderkey AS STRING) = s.game_id
"""

PLAYERS = """
SELECT concat('T', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS team,
       CASE c_custkey % 3 WHEN 0 THEN '9596' WHEN 1 THEN '9697' ELSE '9899' END AS season,
       concat(CAST(18 + c_custkey % 20 AS STRING), '-', lpad(CAST(c_custkey % 365 AS STRING), 3, '0')) AS age,
       CAST(c_custkey % 17 AS STRING) AS gls,
       CASE WHEN c_custkey % 31 = 0 THEN 'n/a' ELSE concat(CAST(c_custkey % 34 AS STRING), '.', CAST(c_custkey % 10 AS STRING)) END AS nineties,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 3000 AS STRING) END AS minutes,
       CASE WHEN c_custkey % 11 = 0 THEN CAST(50 + c_custkey % 45 AS STRING) ELSE NULL END AS save_pct
FROM {customer}
"""

PREDICTIONS = """
SELECT l_orderkey, l_linenumber, l_partkey,
       0.2e0 + l_quantity / 20e0 AS rate_home, 0.2e0 + l_discount * 25e0 AS rate_away, l_tax * 10e0 - 0.4e0 AS rho,
       CAST((l_orderkey + l_partkey) % 6 AS BIGINT) AS home_goals, CAST((l_orderkey + l_suppkey) % 4 AS BIGINT) AS away_goals,
       CAST((l_partkey + l_suppkey) % 3 AS INT) AS label,
       CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 1 END AS targets_present
FROM {lineitem}
"""

NAMES = """
SELECT DISTINCT p_type AS block, concat(p_name, ' FC') AS left_name,
       concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) AS right_name
FROM {part}
"""

# Tokens are runs of one letter, so the character ratio of two names is twice their common tokens over all tokens.
CLUBS = """
SELECT block, k,
       CASE WHEN p % 12 = 7 THEN 'PSG' WHEN p % 12 = 5 THEN concat('Zzzz ', CAST(p AS STRING))
            WHEN p % 4 = 1 THEN concat('FC ', a, '-', upper(b), ' ', replace(c, 'ee', 'éé')) ELSE concat(a, ' ', b, ' ', c, ' 04') END AS left_name,
       CASE WHEN p % 12 = 7 THEN 'Paris Saint-Germain' WHEN p % 12 = 5 THEN 'Club de 1900'
            WHEN p % 3 = 0 THEN concat(c, ' ', a, ' ', d) WHEN p % 3 = 1 THEN concat(b, ' ', a)
            ELSE concat(c, ' ', b, ' ', a, ' AFC') END AS right_name
FROM (SELECT p_partkey AS p, CAST(floor(p_partkey / 12) AS BIGINT) AS block, p_partkey % 12 AS k,
             repeat(substr('bdefghijklmnopqrstuvwxy', 1 + CAST((p_partkey * 7) % 23 AS INT), 1), 4) AS a,
             repeat(substr('bdefghijklmnopqrstuvwxy', 1 + CAST((p_partkey * 5 + p_size) % 23 AS INT), 1), 4) AS b,
             repeat(substr('bdefghijklmnopqrstuvwxy', 1 + CAST((p_partkey + 3 * p_size) % 23 AS INT), 1), 4) AS c,
             repeat(substr('bdefghijklmnopqrstuvwxy', 1 + CAST((p_partkey * 11 + p_size) % 23 AS INT), 1), 4) AS d
      FROM {part}) n
"""

RUNS = """
SELECT p_brand AS tag, CAST(p_partkey % 5 AS INT) AS seed, 40 + p_size % 3 AS num_numeric_features,
       (p_partkey % 1000) / 1000e0 AS val_accuracy, 0.9e0 + (p_size % 50) / 100e0 AS val_log_loss
FROM {part}
"""

# Events in the batches they arrive in: most soon, some days after they happened.
ARRIVALS = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(floor((hours + CASE WHEN event_id % 7 = 0 THEN (event_id * 37) % 90 ELSE (event_id * 13) % 3 END) / 120e0) AS INT) AS arrival
FROM (SELECT *, 24 * (CAST(substr(CAST(ts AS STRING), 9, 2) AS INT) - 1) + CAST(substr(CAST(ts AS STRING), 12, 2) AS INT) AS hours FROM {events}) e
"""

DRIFTING = """
SELECT c_custkey AS k, team, season, age, gls, nineties, minutes, save_pct
FROM (SELECT concat('T', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS team,
       CASE c_custkey % 3 WHEN 0 THEN '9596' WHEN 1 THEN '9697' ELSE '9899' END AS season, CAST(18 + c_custkey % 20 AS STRING) AS age,
       CAST(c_custkey % 17 AS STRING) AS gls, CAST(c_custkey % 34 AS STRING) AS nineties,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 3000 AS STRING) END AS minutes,
       CASE WHEN c_custkey % 11 = 0 THEN CAST(50 + c_custkey % 45 AS STRING) ELSE NULL END AS save_pct, c_custkey
FROM {customer}) p
"""

VIEWS = {
    "v_drifting": (DRIFTING, ("customer",)),
    "v_arrivals": (ARRIVALS, ("events",)),
    "v_schedule": (SCHEDULE, ("orders", "customer", "nation")),
    "v_match_events": (MATCH_EVENTS, ("lineitem", "v_schedule")),
    "v_players": (PLAYERS, ("customer",)),
    "v_predictions": (PREDICTIONS, ("lineitem",)),
    "v_names": (NAMES, ("part",)),
    "v_clubs": (CLUBS, ("part",)),
    "v_runs": (RUNS, ("part",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the derived views over ``sf_dir``."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql, inputs = VIEWS[name]
    return spark.sql(sql, **{i: view(spark, sf_dir, i) for i in inputs})


def as_ctes(*names: str) -> str:
    """The named views and what they need as a WITH list, for the checking engine."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            sql, inputs = VIEWS[name]
            for i in inputs:
                add(i)
            done[name] = f"{name} AS ({sql.format(**{i: i for i in inputs})})"

    for n in names:
        add(n)
    return ",\n".join(done.values())
