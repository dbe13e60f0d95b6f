"""SQL twins of the registered queries, for the checking engine.

Each reads whole tables. Floats are rounded to six decimals on both sides; adding 0 removes negative zeros.
"""

from __future__ import annotations

from touchline.config import NUMERIC_FEATURES
from touchline.views import as_ctes

ALPHA, ELO_BASE, ELO_K = "0.2e0", "1500e0", "20e0"


def r6(expr: str, name: str) -> str:
    return f"round(({expr}) + 0e0, 6) + 0e0 AS {name}"


PARSED = """
parsed AS (
  SELECT *, CASE WHEN home_goals IS NULL OR away_goals IS NULL THEN 'score' WHEN date IS NULL THEN 'date'
                 WHEN home_team IS NULL OR away_team IS NULL THEN 'team' WHEN league IS NULL THEN 'league'
                 WHEN season IS NULL THEN 'season' WHEN home_team = away_team THEN 'same_team' END AS reject_reason
  FROM (SELECT league, season, game, game_id, TRY_CAST(date AS TIMESTAMP) AS date, week, home_team, away_team, score,
               TRY_CAST(regexp_extract(score, '([0-9]+)[^0-9]+([0-9]+)', 1) AS INTEGER) AS home_goals,
               TRY_CAST(regexp_extract(score, '([0-9]+)[^0-9]+([0-9]+)', 2) AS INTEGER) AS away_goals
        FROM v_schedule) p),
valid AS (
  SELECT * EXCLUDE (reject_reason, score),
         CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS label
  FROM parsed WHERE reject_reason IS NULL)"""

STATS = """
stats AS (
  SELECT game_id, team, min(game) AS game, min(_league) AS league, min(_season) AS season,
         count(*) FILTER (WHERE type IN ('Goal', 'SavedShot')) AS sot,
         count(*) FILTER (WHERE type = 'CornerAwarded' AND outcome_type = 'Successful') AS corners,
         count(*) FILTER (WHERE type = 'Card') AS cards,
         count(*) FILTER (WHERE type IN ('Goal', 'SavedShot', 'MissedShots', 'ShotOnPost')) AS shots,
         count(*) FILTER (WHERE type IN ('Goal', 'SavedShot', 'MissedShots', 'ShotOnPost') AND x >= 83) AS box_shots,
         count(*) FILTER (WHERE type = 'Pass' AND outcome_type = 'Successful' AND end_x >= 75) AS deep_comp,
         count(*) FILTER (WHERE type = 'Pass') AS passes,
         count(*) FILTER (WHERE type = 'Pass' AND outcome_type = 'Successful') AS passes_ok
  FROM v_match_events GROUP BY game_id, team)"""

EVENT_COLS = ["sot", "corners", "cards", "shots", "box_shots", "deep_comp", "passes", "passes_ok"]

GAMES = f"""
teams AS (SELECT league, season, home_team AS team FROM v_schedule UNION SELECT league, season, away_team FROM v_schedule),
name_map AS (SELECT DISTINCT s.league, s.season, s.team AS source_name, t.team AS team_name
             FROM stats s JOIN teams t ON s.league = t.league AND s.season = t.season AND s.team = concat('FC ', t.team)),
named AS (SELECT s.*, m.team_name FROM stats s LEFT JOIN name_map m
          ON s.league = m.league AND s.season = m.season AND s.team = m.source_name),
paired AS (SELECT league, season, game_id, min(game) AS game, count(team) AS teams, count(team_name) AS mapped,
                  min(team_name) AS pair_lo, max(team_name) AS pair_hi,
                  {", ".join(f"arg_min({c}, team_name) AS lo_{c}, arg_max({c}, team_name) AS hi_{c}" for c in EVENT_COLS)}
           FROM named GROUP BY league, season, game_id),
games AS (SELECT league, season, day, pair_lo, pair_hi, max(game_id) AS event_game_id,
                 {", ".join(f"arg_max({s}_{c}, game_id) AS {s}_{c}" for s in ("lo", "hi") for c in EVENT_COLS)}
          FROM (SELECT *, substr(game, 1, 10) AS day FROM paired WHERE teams = 2 AND mapped = 2) g
          GROUP BY league, season, day, pair_lo, pair_hi)"""

TARGETS = f"""
targeted AS (
  SELECT v.*, CAST(g.event_game_id IS NOT NULL AS INTEGER) AS targets_present,
         {", ".join(f"coalesce(CASE WHEN v.home_team = g.pair_lo THEN {a}_{c} ELSE {b}_{c} END, 0) AS {s}_{c}"
                    for s, a, b in (("home", "lo", "hi"), ("away", "hi", "lo")) for c in EVENT_COLS)}
  FROM valid v LEFT JOIN games g ON v.league = g.league AND v.season = g.season
       AND strftime(v.date, '%Y-%m-%d') = g.day
       AND least(v.home_team, v.away_team) = g.pair_lo AND greatest(v.home_team, v.away_team) = g.pair_hi),
m AS (SELECT *, row_number() OVER (ORDER BY date, game, game_id) - 1 AS row_idx FROM targeted)"""

ROWS = """
tr AS (
  SELECT row_idx, date, season, home_team AS team, TRUE AS is_home, home_goals::DOUBLE AS gf, away_goals::DOUBLE AS ga,
         CASE label WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 0e0 END AS pts,
         CASE WHEN targets_present = 1 THEN home_sot::DOUBLE END AS sot,
         CASE WHEN targets_present = 1 THEN home_shots::DOUBLE END AS shots,
         CASE WHEN targets_present = 1 THEN away_shots::DOUBLE END AS shots_against,
         CASE WHEN targets_present = 1 THEN home_box_shots::DOUBLE END AS box_shots,
         CASE WHEN targets_present = 1 THEN home_deep_comp::DOUBLE END AS deep_comp
  FROM m
  UNION ALL
  SELECT row_idx, date, season, away_team, FALSE, away_goals::DOUBLE, home_goals::DOUBLE,
         CASE label WHEN 2 THEN 3e0 WHEN 1 THEN 1e0 ELSE 0e0 END,
         CASE WHEN targets_present = 1 THEN away_sot::DOUBLE END,
         CASE WHEN targets_present = 1 THEN away_shots::DOUBLE END,
         CASE WHEN targets_present = 1 THEN home_shots::DOUBLE END,
         CASE WHEN targets_present = 1 THEN away_box_shots::DOUBLE END,
         CASE WHEN targets_present = 1 THEN away_deep_comp::DOUBLE END
  FROM m)"""

PLAIN_MATCHES = """
m AS (SELECT *, row_number() OVER (ORDER BY date, game, game_id) - 1 AS row_idx, 0 AS targets_present,
             0 AS home_sot, 0 AS away_sot, 0 AS home_shots, 0 AS away_shots, 0 AS home_box_shots, 0 AS away_box_shots,
             0 AS home_deep_comp, 0 AS away_deep_comp FROM valid)"""

FOLD = f"lambda s, v: v * {ALPHA} + s * (1e0 - {ALPHA})"


def ema(value: str, window: str) -> str:
    """Sequential fold over the prior non-null values, 0 when there are none."""
    values = f"list({value}) FILTER (WHERE {value} IS NOT NULL) OVER {window}"
    return f"CASE WHEN len({values}) > 0 THEN list_reduce({values}, {FOLD}) ELSE 0e0 END"


PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
W_TEAM = f"(PARTITION BY team ORDER BY row_idx {PRIOR})"
W_VENUE = f"(PARTITION BY team, is_home ORDER BY row_idx {PRIOR})"
W_PAIR = f"(PARTITION BY pair_lo, pair_hi ORDER BY row_idx {PRIOR})"

PREV = "concat(lpad(CAST((CAST(substr(season, 1, 2) AS INTEGER) + 99) % 100 AS VARCHAR), 2, '0'), substr(season, 1, 2))"
NEXT = ("concat(lpad(CAST((CAST(substr(season, 1, 2) AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0'), "
        "lpad(CAST((CAST(substr(season, 3, 2) AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0'))")

WHOLE_DAYS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400e6) AS BIGINT)"

SIDE_PARTS = {
    "gf_ema": ema("gf", W_TEAM), "ga_ema": ema("ga", W_TEAM), "pts_ema": ema("pts", W_TEAM),
    "venue_gf_ema": ema("gf", W_VENUE), "venue_ga_ema": ema("ga", W_VENUE), "venue_pts_ema": ema("pts", W_VENUE),
    "sot_ema": ema("sot", W_TEAM), "shots_ema": ema("shots", W_TEAM),
    "shots_against_ema": ema("shots_against", W_TEAM), "box_shots_ema": ema("box_shots", W_TEAM),
    "deep_comp_ema": ema("deep_comp", W_TEAM),
    "played": f"CAST(count(*) OVER {W_TEAM} AS DOUBLE)", "venue_played": f"CAST(count(*) OVER {W_VENUE} AS DOUBLE)",
    "ws_cov": f"CASE WHEN count(sot) OVER {W_TEAM} > 0 THEN 1e0 ELSE 0e0 END",
    "rest_days": ("coalesce(greatest(0e0, least(30e0, CAST("
                  + WHOLE_DAYS.format(a="lag(date) OVER (PARTITION BY team ORDER BY row_idx)", b="date")
                  + " AS DOUBLE))), 7e0)"),
    "congestion14": ("CAST(len(list_filter(coalesce(list(date) OVER (PARTITION BY team ORDER BY row_idx "
                     "ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), []), lambda d: "
                     + WHOLE_DAYS.format(a="d", b="date") + " BETWEEN 0 AND 14)) AS DOUBLE)"),
    "new_to_season": f"CASE WHEN list_contains(coalesce(list(season) OVER {W_TEAM}, []), {PREV}) THEN 0e0 ELSE 1e0 END",
}
# greatest and least skip nulls, so the first match needs its own branch.
SIDE_PARTS["rest_days"] = (
    "CASE WHEN lag(date) OVER (PARTITION BY team ORDER BY row_idx) IS NULL THEN 7e0 ELSE "
    + SIDE_PARTS["rest_days"] + " END")

PER_SIDE = ["gf_ema", "ga_ema", "sot_ema", "pts_ema", "rest_days", "played", "venue_gf_ema", "venue_ga_ema",
            "venue_pts_ema", "venue_played", "congestion14", "new_to_season", "shots_ema", "shots_against_ema",
            "box_shots_ema", "deep_comp_ema", "ws_cov"]

SIDES = "sides AS (SELECT row_idx, team, is_home, " + ", ".join(f"{SIDE_PARTS[c]} AS {c}" for c in PER_SIDE) + " FROM tr)"

H2H = f"""
pr AS (SELECT row_idx, home_team, away_team, least(home_team, away_team) AS pair_lo, greatest(home_team, away_team) AS pair_hi,
              CASE WHEN home_team > away_team THEN -(home_goals - away_goals)::DOUBLE ELSE (home_goals - away_goals)::DOUBLE END AS gd
       FROM m),
h2h AS (SELECT row_idx, CAST(least(count(*) OVER {W_PAIR}, 10) AS DOUBLE) AS h2h_played,
               CASE WHEN home_team > away_team THEN -1e0 ELSE 1e0 END * {ema("gd", W_PAIR)} AS h2h_gd_ema FROM pr)"""

# Teams of a league meet only each other here, so a league is one component and 25 ratings ride along.
ELO = f"""
slots AS (SELECT team, row_number() OVER (PARTITION BY comp ORDER BY team) AS slot, comp
          FROM (SELECT DISTINCT team, CAST(substr(team, 2) AS INTEGER) % 5 AS comp FROM tr) t),
steps AS (SELECT m.row_idx, h.comp, h.slot AS hs, a.slot AS aws,
                 CASE label WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END AS score,
                 row_number() OVER (PARTITION BY h.comp ORDER BY m.row_idx) AS seq
          FROM m JOIN slots h ON m.home_team = h.team JOIN slots a ON m.away_team = a.team),
walk AS (
  SELECT comp, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS row_idx, CAST(NULL AS DOUBLE) AS rh, CAST(NULL AS DOUBLE) AS ra,
         list_transform(range(100), lambda i: {ELO_BASE}) AS ratings FROM (SELECT DISTINCT comp FROM slots) c
  UNION ALL
  SELECT comp, seq, row_idx, rh, ra,
         list_transform(ratings, lambda r, i: CASE WHEN i = hs THEN rh + {ELO_K} * (score - e)
                                                   WHEN i = aws THEN ra + {ELO_K} * ((1e0 - score) - (1e0 - e)) ELSE r END)
  FROM (SELECT w.comp, s.seq, s.row_idx, w.ratings, s.hs, s.aws, s.score, w.ratings[s.hs] AS rh, w.ratings[s.aws] AS ra,
               1e0 / (1e0 + pow(10e0, (w.ratings[s.aws] - w.ratings[s.hs]) / 400e0)) AS e
        FROM walk w JOIN steps s ON w.comp = s.comp AND s.seq = w.seq + 1) z),
elo AS (SELECT row_idx, rh AS home_elo, ra AS away_elo FROM walk WHERE row_idx IS NOT NULL)"""

SPAN = "span AS (SELECT league, season, coalesce(max(CAST(week AS DOUBLE)), 0e0) AS span FROM v_schedule GROUP BY league, season)"
PROGRESS = "CASE WHEN week IS NOT NULL AND span > 0 THEN greatest(0e0, least(1e0, CAST(week AS DOUBLE) / span)) ELSE 0e0 END"

VOCAB = """
vocab AS (
  SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS BIGINT) AS idx
  FROM (SELECT 'team' AS kind, home_team AS value FROM v_schedule UNION SELECT 'team', away_team FROM v_schedule
        UNION SELECT 'league', league FROM v_schedule UNION SELECT 'season', season FROM v_schedule) u
  UNION ALL SELECT kind, '<unk>', CAST(0 AS BIGINT) FROM (VALUES ('team'), ('league'), ('season')) k(kind))"""


def build(ctes: list[str], select: str, *views: str) -> str:
    recursive = "RECURSIVE " if ELO in ctes or CLUBS in ctes else ""
    return f"WITH {recursive}{as_ctes(*views)},\n" + ",\n".join(c.strip() for c in ctes) + "\n" + select if ctes else (
        f"WITH {as_ctes(*views)}\n{select}")


S, E, P = "v_schedule", "v_match_events", "v_predictions"
EVENTFUL = [PARSED, STATS, GAMES, TARGETS]
PLAIN = [PARSED, PLAIN_MATCHES]


def _form(names: list[str], with_events: bool = False) -> str:
    ctes = (EVENTFUL if with_events else PLAIN) + [ROWS]
    cols = ", ".join(r6(SIDE_PARTS[c], c) for c in names)
    return build(ctes, f"SELECT row_idx, team, is_home, {cols} FROM tr", *((E, S) if with_events else (S,)))


PMF = """
pr AS (SELECT *, greatest(rate_home, 1e-9) AS lh, greatest(rate_away, 1e-9) AS la, 0.15e0 * tanh(rho) AS r,
              row_number() OVER () AS rid FROM v_predictions),
k AS (SELECT CAST(range AS INTEGER) AS k, CAST(factorial(CAST(range AS INTEGER)) AS DOUBLE) AS f FROM range(11)),
rates AS (SELECT DISTINCT lh, la, r FROM pr),
cells AS (
  SELECT lh, la, r, i.k AS i, j.k AS j,
         greatest(0e0, exp(-lh + i.k * ln(lh) - ln(i.f)) * exp(-la + j.k * ln(la) - ln(j.f)) *
           CASE WHEN i.k = 0 AND j.k = 0 THEN 1e0 - lh * la * r WHEN i.k = 0 AND j.k = 1 THEN 1e0 + lh * r
                WHEN i.k = 1 AND j.k = 0 THEN 1e0 + la * r WHEN i.k = 1 AND j.k = 1 THEN 1e0 - r ELSE 1e0 END) AS p
  FROM rates, k i, k j),
sums AS (SELECT lh, la, r, sum(p) FILTER (WHERE i > j) AS h, sum(p) FILTER (WHERE i = j) AS d,
                sum(p) FILTER (WHERE i < j) AS a FROM cells GROUP BY lh, la, r),
probs AS (SELECT pr.*, round(h / greatest(h + d + a, 1e-9), 12) AS p_home, round(d / greatest(h + d + a, 1e-9), 12) AS p_draw,
                 round(a / greatest(h + d + a, 1e-9), 12) AS p_away
          FROM pr JOIN sums s ON pr.lh = s.lh AND pr.la = s.la AND pr.r = s.r)"""

ID = "l_orderkey, l_linenumber, l_partkey"
P_TRUE = "CASE label WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END"
CLIP = "least(1e0, greatest(1e-12, {}))"


def pick_sql(boost: str = "1e0", h: str = "p_home", d: str = "p_draw", a: str = "p_away") -> str:
    return f"CASE WHEN {h} >= {d} * {boost} AND {h} >= {a} THEN 0 WHEN {d} * {boost} >= {a} THEN 1 ELSE 2 END"


def scaled(t: str) -> str:
    ps = {n: f"pow({CLIP.format(n)}, 1e0 / {t})" for n in ("p_home", "p_draw", "p_away")}
    total = " + ".join(ps.values())
    return ", ".join(f"CASE WHEN {t} = 1e0 THEN {n} ELSE {p} / ({total}) END AS c{n[1:]}" for n, p in ps.items())


def _prob(select: str, extra: list[str] | None = None) -> str:
    return build([PMF, *(extra or [])], select, P)


CLASS = """
cm AS (SELECT {key_of} t.t AS t, p.p AS p, count(y.label) AS n FROM (VALUES (0), (1), (2)) t(t) CROSS JOIN (VALUES (0), (1), (2)) p(p)
       {grid} LEFT JOIN picked y ON y.label = t.t AND y.pred = p.p {on} GROUP BY {key_of} t.t, p.p),
pc AS (SELECT {key} k, sum(n) FILTER (WHERE t = k AND p = k) AS tp, sum(n) FILTER (WHERE p = k) AS pp,
              sum(n) FILTER (WHERE t = k) AS tt FROM cm CROSS JOIN (VALUES (0), (1), (2)) c(k) GROUP BY {key} k),
pr2 AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp::DOUBLE ELSE 0e0 END AS pre, CASE WHEN tt > 0 THEN tp / tt::DOUBLE ELSE 0e0 END AS rec FROM pc),
cl AS (SELECT {key} sum(tp) / sum(tt)::DOUBLE AS accuracy, avg(pre) AS macro_precision, avg(rec) AS macro_recall,
              avg(CASE WHEN pre + rec > 0 THEN 2e0 * pre * rec / (pre + rec) ELSE 0e0 END) AS macro_f1 FROM pr2 {by})"""

CLASS_ALL = CLASS.format(key_of="", key="", grid="", on="", by="")
CLASS_BOOST = CLASS.format(key_of="b.boost,", key="boost,", grid="CROSS JOIN boosts b", on="AND y.boost = b.boost", by="GROUP BY boost")
BOOSTS = "boosts AS (SELECT round(0.5e0 + 0.05e0 * range, 2) AS boost FROM range(51))"
PICKED_BOOST = (
    "picked AS (SELECT label, boost, CASE WHEN p_home >= p_draw * boost AND p_home >= p_away THEN 0 "
    "WHEN p_draw * boost >= p_away THEN 1 ELSE 2 END AS pred FROM probs, boosts)")
PICKED = f"picked AS (SELECT label, {pick_sql()} AS pred FROM probs)"
LOSSES = """
grid AS (SELECT round(0.5e0 + 0.01e0 * range, 2) AS temperature FROM range(251)),
uniq AS (SELECT p_home, p_draw, p_away, label, count(*) AS n FROM probs GROUP BY ALL),
losses AS (SELECT temperature, sum(n * -ln(least(1e0, greatest(1e-12, CASE label WHEN 0 THEN c_home WHEN 1 THEN c_draw ELSE c_away END))))
                  / sum(n) AS log_loss
           FROM (SELECT u.*, temperature, """ + scaled("temperature") + """ FROM uniq u, grid) s GROUP BY temperature)"""

NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def num(c: str) -> str:
    def one(x: str) -> str:
        return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"

    return f"coalesce({one(c)}, {one(f'''split_part({c}, '-', 1)''')}, 0e0)"


PRIORS = f"""
keep AS (SELECT team, season, sum({num("save_pct")} * {num("minutes")}) / sum({num("minutes")}) AS gk_save
         FROM v_players GROUP BY team, season HAVING sum({num("minutes")}) > 0),
squads AS (SELECT team, season, sum({num("gls")}) AS g, sum({num("nineties")}) AS n, sum({num("minutes")}) AS mm,
                  sum({num("minutes")} * {num("minutes")}) AS m2, sum({num("age")} * {num("minutes")}) AS am
           FROM v_players GROUP BY team, season),
priors AS (SELECT s.team, {NEXT.replace("season", "s.season")} AS season, g / n AS gls90, coalesce(gk_save, 0e0) AS gk_save,
                  m2 / (mm * mm) AS min_hhi, am / mm AS age
           FROM squads s LEFT JOIN keep k ON s.team = k.team AND s.season = k.season WHERE n > 0 AND mm > 0)"""

STOP = ("fc afc cf cd ac as ssc rc sc ud sd us calcio club de the 1 04 05 08 09 1846 1899 1900").split()
CLUBS = f"""
named AS (SELECT DISTINCT block, side, name,
                 list_distinct(list_filter(string_split(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g'), ' '),
                                           lambda t: t NOT IN ('', {", ".join(f"'{w}'" for w in STOP)}))) AS tokens
          FROM (SELECT block, 'l' AS side, left_name AS name FROM v_clubs UNION ALL SELECT block, 'r', right_name FROM v_clubs) u),
alias AS (SELECT l.block, l.name AS left_name, r.name AS right_name FROM named l JOIN named r ON l.block = r.block AND l.side = 'l'
          AND r.side = 'r' AND l.name = 'PSG' AND r.name = 'Paris Saint-Germain'),
free AS (SELECT n.* FROM named n WHERE NOT EXISTS (SELECT 1 FROM alias a WHERE a.block = n.block AND n.name IN (a.left_name, a.right_name))),
scored AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, left_name, right_name) AS place FROM (
  SELECT l.block, l.name AS left_name, r.name AS right_name,
         2e0 * len(list_intersect(l.tokens, r.tokens)) / (len(l.tokens) + len(r.tokens)) AS score
  FROM free l JOIN free r ON l.block = r.block AND l.side = 'l' AND r.side = 'r' AND len(l.tokens) > 0 AND len(r.tokens) > 0) p
  WHERE score >= 0.4e0),
walk AS (
  SELECT block, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS ul, CAST([] AS VARCHAR[]) AS ur, CAST(NULL AS VARCHAR) AS left_name,
         CAST(NULL AS VARCHAR) AS right_name, CAST(NULL AS DOUBLE) AS score, FALSE AS taken FROM (SELECT DISTINCT block FROM scored) b
  UNION ALL
  SELECT block, place, CASE WHEN ok THEN list_append(ul, left_name) ELSE ul END, CASE WHEN ok THEN list_append(ur, right_name) ELSE ur END,
         left_name, right_name, score, ok
  FROM (SELECT w.block, s.place, w.ul, w.ur, s.left_name, s.right_name, s.score,
               NOT list_contains(w.ul, s.left_name) AND NOT list_contains(w.ur, s.right_name) AS ok
        FROM walk w JOIN scored s ON s.block = w.block AND s.place = w.place + 1) z),
club AS (SELECT block, left_name, right_name, 1e0 AS score FROM alias
         UNION ALL SELECT block, left_name, right_name, score FROM walk WHERE taken)"""

PRED = """
pp AS (SELECT *, l_orderkey * 0 + rate_home AS pred_home, rate_away AS pred_away FROM v_predictions)"""


CHOSEN = f"""
chosen AS (SELECT CASE WHEN (SELECT sum(n * -ln({CLIP.format(P_TRUE)})) / sum(n) FROM uniq) - log_loss >= 0.005e0 THEN temperature ELSE 1e0 END AS temperature
           FROM (SELECT * FROM losses ORDER BY round(log_loss, 12), temperature LIMIT 1) b)"""
PICKED_CALIBRATED = f"""
picked AS (SELECT label, boost, {pick_sql("boost", "c_home", "c_draw", "c_away")} AS pred
           FROM (SELECT label, temperature, {scaled("temperature")} FROM probs, chosen) s, boosts)"""

RHO = """
k AS (SELECT CAST(range AS INTEGER) AS k, CAST(factorial(CAST(range AS INTEGER)) AS DOUBLE) AS f FROM range(11)),
rhos AS (SELECT round(-1e0 + 0.1e0 * range, 1) AS rho FROM range(21)),
rates AS (SELECT DISTINCT rate_home, rate_away FROM v_predictions),
cells AS (
  SELECT rate_home, rate_away, rho, i.k AS i, j.k AS j,
         exp(-rate_home + i.k * ln(rate_home) - ln(i.f)) * exp(-rate_away + j.k * ln(rate_away) - ln(j.f)) * greatest(0e0,
           CASE WHEN i.k = 0 AND j.k = 0 THEN 1e0 - rate_home * rate_away * 0.15e0 * tanh(rho) WHEN i.k = 0 AND j.k = 1 THEN 1e0 + rate_home * 0.15e0 * tanh(rho)
                WHEN i.k = 1 AND j.k = 0 THEN 1e0 + rate_away * 0.15e0 * tanh(rho) WHEN i.k = 1 AND j.k = 1 THEN 1e0 - 0.15e0 * tanh(rho) ELSE 1e0 END) AS p
  FROM rates, rhos, k i, k j),
masses AS (SELECT rate_home, rate_away, rho, sum(p) FILTER (WHERE i > j) / sum(p) AS h, sum(p) FILTER (WHERE i = j) / sum(p) AS d,
                  sum(p) FILTER (WHERE i < j) / sum(p) AS a FROM cells GROUP BY ALL),
rho_losses AS (SELECT l_orderkey % 5 AS league_idx, q.rho, avg(-ln(greatest(1e-9, CASE label WHEN 0 THEN h WHEN 1 THEN d ELSE a END))) AS loss
               FROM v_predictions v JOIN masses q ON q.rate_home = v.rate_home AND q.rate_away = v.rate_away GROUP BY ALL)"""


SPLIT_LATE = """
newest AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v_arrivals GROUP BY arrival),
split AS (SELECT a.*, coalesce(a.ts < n.seen - INTERVAL 12 HOUR, FALSE) AS late FROM v_arrivals a JOIN newest n ON n.arrival = a.arrival)"""

FIELDS_READ = {
    "player_standard": {"Performance_Gls": "gls", "Playing Time_90s": "nineties", "Playing Time_Min": "minutes", "age": "age"},
    "player_keeper": {"Performance_Save%": "save_pct", "Playing Time_Min": "minutes"},
    "player_shooting": {"Standard_Gls": "gls", "Standard_Sh": "minutes"},
    "player_playing_time": {"Playing Time_Min": "minutes", "Playing Time_90s": "nineties"},
    "player_misc": {"Performance_Fls": "gls"}}
KINDS_READ = "SELECT kind, field, team, season, value, count(*) AS rows FROM (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{n}' AS field, team, season, {c} AS value FROM v_drifting WHERE k % 13 <> 0 AND k % 17 <> 0"
    + (" AND k % 3 <> 1" if n == list(fields)[-1] else "")
    for kind, fields in FIELDS_READ.items() for n, c in fields.items()) + """
 UNION ALL SELECT 'match_events', 'x', team, 'all', CAST(CAST(x AS BIGINT) AS VARCHAR) FROM v_match_events) t
WHERE value IS NOT NULL GROUP BY kind, field, team, season, value"""

TRAIN = """
train AS (SELECT *, pow(0.5e0, date_diff('day', CAST(date AS DATE), max(CAST(date AS DATE)) OVER ()) / 390e0) AS w
          FROM m WHERE row_idx < (SELECT floor(count(*) * 0.7e0) FROM m))"""

HISTORY = {"val_accuracy": "val_accuracy", "val_log_loss": "val_log_loss", "val_macro_f1": "val_accuracy * 0.7137e0",
           "test_accuracy": "val_accuracy * 0.3713e0", "test_log_loss": "val_log_loss * 0.5717e0", "test_rps": "val_log_loss * 0.2917e0",
           "test_macro_f1": "val_accuracy * 0.1319e0"}


def state_fold(value: str, also: str = "") -> str:
    """Fold over all of a group's values in order; null when there are none."""
    order = "row_idx"
    return f"list_reduce(nullif(list({value} ORDER BY {order}) FILTER (WHERE {value} IS NOT NULL {also}), []), {FOLD})"


def feature_select() -> str:
    numeric = [r6(f"{p}.{c}", f"{t}_{c}") for p, t in (("h", "h"), ("a", "a")) for c in PER_SIDE]
    return f"""
SELECT m.row_idx, m.game, m.game_id, strftime(m.date, '%Y-%m-%d %H:%M:%S') AS date, m.league, m.season,
       vh.idx AS home_team_idx, va.idx AS away_team_idx, vl.idx AS league_idx, vs.idx AS season_idx, m.label,
       {", ".join(f"CAST(m.{s}_{c} AS DOUBLE) AS {s}_{c}" for c in ("goals", "sot", "corners", "cards") for s in ("home", "away"))},
       m.targets_present, {", ".join(numeric)}, {r6("home_elo", "home_elo")}, {r6("away_elo", "away_elo")},
       {r6("h.gf_ema - a.gf_ema", "gf_ema_diff")}, {r6("h.ga_ema - a.ga_ema", "ga_ema_diff")},
       {r6("h.pts_ema - a.pts_ema", "pts_ema_diff")}, {r6("home_elo - away_elo", "elo_diff")},
       {r6("h.venue_pts_ema - a.venue_pts_ema", "venue_pts_ema_diff")},
       h2h_played, {r6("h2h_gd_ema", "h2h_gd_ema")}, {r6(PROGRESS, "season_progress")}
FROM m JOIN sides h ON h.row_idx = m.row_idx AND h.is_home JOIN sides a ON a.row_idx = m.row_idx AND NOT a.is_home
     JOIN h2h ON h2h.row_idx = m.row_idx JOIN elo ON elo.row_idx = m.row_idx
     JOIN span sp ON sp.league = m.league AND sp.season = m.season
     JOIN vocab vh ON vh.kind = 'team' AND vh.value = m.home_team JOIN vocab va ON va.kind = 'team' AND va.value = m.away_team
     JOIN vocab vl ON vl.kind = 'league' AND vl.value = m.league JOIN vocab vs ON vs.kind = 'season' AND vs.value = m.season"""


def oracles() -> dict[str, str]:
    stat_cols = ", ".join(EVENT_COLS)
    sides = ", ".join(f"{s}_{c}" for s in ("home", "away") for c in EVENT_COLS)
    split = ("CASE WHEN row_idx < floor(n * 0.7e0) THEN 'train' WHEN row_idx < floor(n * (0.7e0 + 0.15e0)) THEN 'val' ELSE 'test' END")
    out = {
        "event_team_stats": build([STATS], f"SELECT game_id, team, game, league, season, {stat_cols} FROM stats", E),
        "two_team_games": build([STATS, GAMES], "SELECT * FROM games", E, S),
        "attach_event_targets": build(EVENTFUL, f"SELECT game_id, league, season, home_team, away_team, targets_present, {sides} FROM targeted", E, S),
        "parsed_matches": build([PARSED], "SELECT * REPLACE (strftime(date, '%Y-%m-%d %H:%M:%S') AS date, CAST(week AS DOUBLE) AS week) FROM valid", S),
        "match_quarantine": build([PARSED], "SELECT game_id, game, score, reject_reason FROM parsed WHERE reject_reason IS NOT NULL", S),
        "match_points": build([PARSED], """
SELECT game_id, CASE label WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 0e0 END AS home_points,
       CASE label WHEN 2 THEN 3e0 WHEN 1 THEN 1e0 ELSE 0e0 END AS away_points,
       CASE label WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END AS rating_score FROM valid""", S),
        "season_codes": build([], f"SELECT DISTINCT season, {PREV} AS prev_season, {NEXT} AS next_season FROM v_schedule", S),
        "season_span": build([SPAN], "SELECT * FROM span", S),
        "season_teams": build([], "SELECT league, season, home_team AS team FROM v_schedule UNION SELECT league, season, away_team FROM v_schedule", S),
        "season_progress": build([SPAN], f"SELECT game_id, {r6(PROGRESS, 'season_progress')} FROM v_schedule s JOIN span p ON s.league = p.league AND s.season = p.season", S),
        "ordinal_days": build([PARSED], "SELECT game_id, CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) + 719163 AS INTEGER) AS day FROM valid", S),
        "vocabulary": build([VOCAB], "SELECT * FROM vocab", S),
        "vocabulary_sizes": build([VOCAB], "SELECT kind, count(*) AS size FROM vocab GROUP BY kind", S),
        "encoded_matches": build([VOCAB], """
SELECT game_id, h.idx AS home_team_idx, a.idx AS away_team_idx, l.idx AS league_idx, s.idx AS season_idx
FROM v_schedule v JOIN vocab h ON h.kind = 'team' AND h.value = v.home_team JOIN vocab a ON a.kind = 'team' AND a.value = v.away_team
     JOIN vocab l ON l.kind = 'league' AND l.value = v.league JOIN vocab s ON s.kind = 'season' AND s.value = v.season""", S),
        "row_index": build(PLAIN, "SELECT game_id, row_idx FROM m", S),
        "temporal_split": build(PLAIN, f"SELECT row_idx, {split} AS split FROM m, (SELECT CAST(count(*) AS DOUBLE) AS n FROM m) c", S),
        "row_range_shard": build(PLAIN, "SELECT row_idx, game_id FROM m, (SELECT count(*) AS n FROM m) c WHERE row_idx >= n // 4 AND row_idx < n - n // 4 AND row_idx % 3 = 1", S),
        "team_form": _form(["gf_ema", "ga_ema", "pts_ema"]),
        "venue_form": _form(["venue_gf_ema", "venue_ga_ema", "venue_pts_ema"]),
        "event_form": _form(["sot_ema", "shots_ema", "shots_against_ema", "box_shots_ema", "deep_comp_ema"], True),
        "prior_counts": _form(["played", "venue_played", "ws_cov"], True),
        "rest_days": _form(["rest_days"]),
        "congestion": _form(["congestion14"]),
        "new_to_season": _form(["new_to_season"]),
        "head_to_head": build([*PLAIN, H2H], f"SELECT row_idx, h2h_played, {r6('h2h_gd_ema', 'h2h_gd_ema')} FROM h2h", S),
        "elo_ratings": build([*PLAIN, ROWS, ELO], f"SELECT row_idx, {r6('home_elo', 'home_elo')}, {r6('away_elo', 'away_elo')} FROM elo", S),
        "match_components": build([], """
SELECT team, concat('T', lpad(CAST(CAST(substr(team, 2) AS INTEGER) % 5 AS VARCHAR), 2, '0')) AS component
FROM (SELECT home_team AS team FROM v_schedule UNION SELECT away_team FROM v_schedule) t""", S),
        "feature_table": build([*EVENTFUL, ROWS, SIDES, H2H, ELO, SPAN, VOCAB], feature_select(), E, S),
        "as_of_features": f"""
SELECT game_id AS fixture_id, {", ".join(NUMERIC_FEATURES)} FROM ({build([*EVENTFUL, ROWS, SIDES, H2H, ELO, SPAN, VOCAB], feature_select(), E, S)}) t""",
        "feature_coverage": build(EVENTFUL, """
SELECT (SELECT count(*) FROM m) AS rows_written, (SELECT count(*) FROM parsed WHERE reject_reason IS NOT NULL) AS rows_skipped,
       (SELECT CAST(sum(targets_present) AS BIGINT) FROM m) AS targets_present,
       round((SELECT avg(targets_present) * 100e0 FROM m), 6) AS targets_pct,
       (SELECT count(*) FROM paired WHERE teams = 2 AND mapped = 2) AS games_indexed,
       (SELECT count(*) FROM paired WHERE NOT (teams = 2 AND mapped = 2)) AS games_skipped,
       (SELECT count(*) FROM (SELECT DISTINCT league, season, team FROM named WHERE team_name IS NULL) u) AS unmapped_names""", E, S),
        "name_jaccard": build([], """
SELECT block, left_name, right_name, round(CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0e0
         ELSE len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r)))::DOUBLE END, 6) AS jaccard
FROM (SELECT *, list_filter(list_distinct(string_split(lower(left_name), ' ')), lambda t: t NOT IN ('fc', '')) AS l,
             list_filter(list_distinct(string_split(lower(right_name), ' ')), lambda t: t NOT IN ('fc', '')) AS r FROM v_names) n""", "v_names"),
        "name_matches": build([], """
SELECT DISTINCT l.block, l.left_name, r.right_name, 1e0 AS score
FROM (SELECT block, left_name, list_sort(string_split(lower(replace(left_name, ' FC', '')), ' ')) AS t FROM v_names) l
JOIN (SELECT block, right_name, list_sort(string_split(lower(right_name), ' ')) AS t FROM v_names) r ON l.block = r.block AND l.t = r.t""", "v_names"),
        "club_matches": build([CLUBS], f"SELECT block, left_name, right_name, {r6('score', 'score')} FROM club", "v_clubs"),
        "club_unmapped": build([CLUBS], """
SELECT CAST(block AS VARCHAR) AS league, 'all' AS season, name AS source_name FROM named n
WHERE side = 'l' AND NOT EXISTS (SELECT 1 FROM club c WHERE c.block = n.block AND c.left_name = n.name)""", "v_clubs"),
        "known_teams": build(PLAIN, """
SELECT DISTINCT team FROM (SELECT home_team AS team FROM v_schedule UNION SELECT away_team FROM v_schedule) t
WHERE team IN (SELECT home_team FROM m UNION SELECT away_team FROM m)""", S),
        "seeded_shuffle": build(PLAIN, "SELECT row_idx, game_id FROM m", S),
        "replace_partitions": build([], """
SELECT * REPLACE (CAST(week AS DOUBLE) AS week), 'landed' AS _source, league AS _league, season AS _season FROM v_schedule""", S),
        "rate_certificate": build([*EVENTFUL, VOCAB, TRAIN], f"""
SELECT head, coefficient, rows, TRUE AS stationary, CASE WHEN coefficient = 'intercept' THEN mean END AS mean_fitted
FROM (SELECT unnest({[f"{s}_{c}" for c in ("goals", "sot", "corners", "cards") for s in ("home", "away")]}) AS head,
             unnest([{", ".join(["count(*)"] * 2 + ["count(*) FILTER (WHERE targets_present = 1)"] * 6)}]) AS rows,
             unnest([{", ".join(f"round(sum(w * {s}_goals) / sum(w), 6)" for s in ("home", "away"))}, {", ".join(["NULL"] * 6)}]) AS mean FROM train) h,
     (SELECT unnest({["intercept", *NUMERIC_FEATURES]}) AS coefficient
      UNION ALL SELECT DISTINCT concat('league_', CAST(idx AS VARCHAR)) FROM train JOIN vocab ON kind = 'league' AND value = league) c""", E, S),
        "sweep_certificate": """
SELECT reg_param, half_life_days, class_weight_power, TRUE AS converged, TRUE AS at_rest, TRUE AS scored
FROM (SELECT unnest([0.001e0, 0.01e0, 0.1e0]) AS reg_param) r, (SELECT unnest([0e0, 180e0, 390e0, 730e0]) AS half_life_days) h,
     (SELECT unnest([0e0, 0.5e0, 1e0]) AS class_weight_power) p""",
        "landed_schedule": build([], """
SELECT league, season, game, game_id, date, CAST(week AS DOUBLE) AS week, home_team, away_team, score, league AS _league, season AS _season
FROM v_schedule""", S),
        "live_landing": build([], "SELECT DISTINCT game_id, home_team, away_team, league AS _league, season AS _season FROM v_schedule", S),
        "feature_table_written": build(PLAIN, "SELECT row_idx, game_id FROM m", S),
        "append_null_keys": """
SELECT DISTINCT CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS key, CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus END AS _league,
       'all' AS _season FROM orders""",
        "composite_score": _prob(f"""
SELECT {r6(f"avg(goals) + 0.7e0 * avg(-ln(greatest(1e-9, {P_TRUE}))) + (0.3e0 * sum((h + a) / 2e0 * m) + 0.2e0 * sum(h * m) + 0.1e0 * sum(c * m)) / greatest(sum(m), 1)", "composite")}
FROM (SELECT *, targets_present AS m,
             ((rate_home - home_goals * ln(rate_home + 1e-8)) + (rate_away - away_goals * ln(rate_away + 1e-8))) / 2e0 AS goals,
             CASE WHEN abs(rate_home - home_goals) <= 1e0 THEN 0.5e0 * pow(rate_home - home_goals, 2) ELSE abs(rate_home - home_goals) - 0.5e0 END AS h,
             CASE WHEN abs(rate_away - away_goals) <= 1e0 THEN 0.5e0 * pow(rate_away - away_goals, 2) ELSE abs(rate_away - away_goals) - 0.5e0 END AS a,
             CASE WHEN abs(rate_away - away_goals) <= 0.5e0 THEN 0.5e0 * pow(rate_away - away_goals, 2)
                  ELSE 0.5e0 * (abs(rate_away - away_goals) - 0.25e0) END AS c FROM probs) t"""),
        "decision_layer": _prob(f"""
SELECT temperature, CASE WHEN acc >= plain + 0.01e0 THEN acc_boost ELSE 1e0 END AS draw_boost_acc, f1_boost AS draw_boost_f1
FROM (SELECT temperature FROM chosen) t,
     (SELECT accuracy AS acc, boost AS acc_boost FROM cl ORDER BY round(accuracy, 12) DESC, boost LIMIT 1) a,
     (SELECT boost AS f1_boost FROM cl ORDER BY round(macro_f1, 12) DESC, boost LIMIT 1) f,
     (SELECT accuracy AS plain FROM cl WHERE boost = 1e0) p""", [LOSSES, CHOSEN, BOOSTS, PICKED_CALIBRATED, CLASS_BOOST]),
        "league_rho": build([RHO], """
SELECT league_idx, arg_min(rho, (round(loss, 12), abs(rho), rho)) AS rho FROM rho_losses GROUP BY league_idx""", P),
        "team_state": build([*EVENTFUL, ROWS, ELO], f"""
SELECT team, {", ".join(r6(state_fold(c), f"{c}_ema") for c in ("gf", "ga", "pts", "sot", "shots", "shots_against", "box_shots", "deep_comp"))},
       count(*) AS played, count(sot) AS ws_played, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last_date,
       {", ".join(r6(state_fold(c, f"AND {'' if side == 'home' else 'NOT '}is_home"), f"{side}_{c}_ema") for side in ("home", "away") for c in ("gf", "ga", "pts"))},
       count(*) FILTER (WHERE is_home) AS home_played, count(*) FILTER (WHERE NOT is_home) AS away_played, {r6("any_value(rating)", "elo")}
FROM tr JOIN (SELECT s.team AS rated, w.ratings[s.slot] AS rating FROM slots s JOIN walk w ON w.comp = s.comp
              AND w.seq = (SELECT max(x.seq) FROM walk x WHERE x.comp = w.comp)) e ON e.rated = tr.team GROUP BY team""", E, S),
        "h2h_state": build([*PLAIN, H2H], f"SELECT pair_lo, pair_hi, count(*) AS met, {r6(state_fold('gd'), 'gd_ema')} FROM pr GROUP BY pair_lo, pair_hi", S),
        "unmapped_names": build([STATS, GAMES], "SELECT DISTINCT league, season, team AS source_name FROM named WHERE team_name IS NULL", E, S),
        "squad_priors": build([PRIORS], f"SELECT team, season, {r6('gls90', 'gls90')}, {r6('gk_save', 'gk_save')}, {r6('min_hhi', 'min_hhi')}, {r6('age', 'age')} FROM priors", "v_players"),
        "keeper_save_pct": build([PRIORS], f"SELECT team, season, {r6('gk_save', 'gk_save')} FROM keep", "v_players"),
        "match_priors": build([PARSED, PRIORS], f"""
SELECT game_id, {", ".join(r6(f"{s[0]}.{c}", f"{s}_{c}") for s in ("home", "away") for c in ("gls90", "gk_save", "min_hhi", "age"))}
FROM valid v LEFT JOIN priors h ON h.team = v.home_team AND h.season = v.season
     LEFT JOIN priors a ON a.team = v.away_team AND a.season = v.season""", S, "v_players"),
        "lenient_numbers": build([], f"SELECT team, season, age, minutes, nineties, {num('age')} AS age_value, {num('minutes')} AS minutes_value, {num('nineties')} AS nineties_value FROM v_players", "v_players"),
        "outcome_probs": _prob(f"SELECT {ID}, {r6('p_home', 'p_home')}, {r6('p_draw', 'p_draw')}, {r6('p_away', 'p_away')} FROM probs"),
        "score_grid": build([PMF], f"SELECT {r6('rate_home', 'rate_home')}, {r6('rate_away', 'rate_away')}, {r6('rho', 'rho')}, i, j, {r6('p', 'p')} FROM (SELECT DISTINCT rate_home, rate_away, rho, lh, la, r FROM pr) q JOIN cells c ON q.lh = c.lh AND q.la = c.la AND q.r = c.r", P),
        "poisson_pmf": build([PMF], f"SELECT {r6('rate_home', 'rate_home')}, k, {r6('exp(-rate_home + k * ln(rate_home) - ln(f))', 'p')} FROM (SELECT DISTINCT rate_home FROM v_predictions) q, k", P),
        "temperature_scaled": _prob(f"SELECT {ID}, {r6('c_home', 'p_home')}, {r6('c_draw', 'p_draw')}, {r6('c_away', 'p_away')} FROM (SELECT *, {scaled('1.3e0')} FROM probs) t"),
        "picks": _prob(f"SELECT {ID}, {pick_sql()} AS pick_plain, {pick_sql('1.35e0')} AS pick_boosted FROM probs"),
        "probability_metrics": _prob(f"""
SELECT {r6(f"avg(-ln({CLIP.format(P_TRUE)}))", "log_loss")},
       {r6("avg(pow(p_home - (label = 0)::INT, 2) + pow(p_draw - (label = 1)::INT, 2) + pow(p_away - (label = 2)::INT, 2))", "brier")},
       {r6("avg((pow(p_home - (label = 0)::INT, 2) + pow(p_home + p_draw - (label <= 1)::INT, 2) + pow(p_home + p_draw + p_away - 1e0, 2)) / 2e0)", "rps")} FROM probs"""),
        "reliability": _prob(f"""
SELECT CAST(b AS INTEGER) AS bin, round(b * 0.1e0, 6) AS bin_low, round(CASE WHEN b = 9 THEN 1e0 ELSE (b + 1) * 0.1e0 END, 6) AS bin_high,
       count(c) AS count, {r6("coalesce(avg(c), 0e0)", "mean_confidence")}, {r6("coalesce(avg(ok), 0e0)", "accuracy")}
FROM range(10) g(b) LEFT JOIN (SELECT greatest(p_home, p_draw, p_away) AS c, CAST({pick_sql()} = label AS DOUBLE) AS ok FROM probs) s
     ON c >= b * 0.1e0 AND (c < (b + 1) * 0.1e0 OR (b = 9 AND c <= 1e0)) GROUP BY b"""),
        "confusion": _prob("SELECT t AS label, p AS pred, n AS count FROM cm", [PICKED, CLASS_ALL]),
        "class_report": _prob(f"SELECT {r6('accuracy', 'accuracy')}, {r6('macro_precision', 'macro_precision')}, {r6('macro_recall', 'macro_recall')}, {r6('macro_f1', 'macro_f1')} FROM cl", [PICKED, CLASS_ALL]),
        "masked_mae": build([], f"""
SELECT {r6("sum(abs(rate_home - home_goals) * targets_present) / greatest(sum(targets_present), 1)", "mae_home")},
       {r6("sum(abs(rate_away - away_goals) * targets_present) / greatest(sum(targets_present), 1)", "mae_away")} FROM v_predictions""", P),
        "goal_mae": build([], f"""
SELECT {r6("avg(abs(rate_home - home_goals))", "mae_home_goals")}, {r6("avg(abs(rate_away - away_goals))", "mae_away_goals")},
       {r6("(avg(abs(rate_home - home_goals)) + avg(abs(rate_away - away_goals))) / 2e0", "mae_goals")} FROM v_predictions""", P),
        "poisson_nll": build([], f"""
SELECT {r6("avg(l)", "plain")}, {r6("sum(l * w) / sum(w)", "decayed")}
FROM (SELECT ((rate_home - home_goals * ln(rate_home + 1e-8)) + (rate_away - away_goals * ln(rate_away + 1e-8))) / 2e0 AS l,
             pow(0.5e0, (l_orderkey % 1000) / 390e0) AS w FROM v_predictions) t""", P),
        "outcome_nll": _prob(f"""
SELECT {r6(f"avg(-ln(greatest(1e-9, {P_TRUE})))", "plain")},
       {r6(f"sum(-w * ln(greatest(1e-9, {P_TRUE}))) / sum(w)", "weighted")}
FROM (SELECT *, CASE label WHEN 0 THEN 0.8e0 WHEN 1 THEN 1.3e0 ELSE 0.9e0 END AS w FROM probs) t"""),
        "masked_huber": build([], f"""
SELECT {r6("sum((h + a) / 2e0 * targets_present) / greatest(sum(targets_present), 1)", "huber")}
FROM (SELECT targets_present,
             CASE WHEN abs(rate_home - home_goals) <= 1e0 THEN 0.5e0 * pow(rate_home - home_goals, 2) ELSE abs(rate_home - home_goals) - 0.5e0 END AS h,
             CASE WHEN abs(rate_away - away_goals) <= 1e0 THEN 0.5e0 * pow(rate_away - away_goals, 2) ELSE abs(rate_away - away_goals) - 0.5e0 END AS a
      FROM v_predictions) t""", P),
        "temperature_losses": _prob(f"SELECT temperature, {r6('log_loss', 'log_loss')} FROM losses", [LOSSES]),
        "fit_temperature": _prob(f"SELECT temperature, {r6('log_loss', 'log_loss')} FROM losses ORDER BY round(losses.log_loss, 12), temperature LIMIT 1", [LOSSES]),
        "boost_scores": _prob(f"SELECT boost, {r6('accuracy', 'accuracy')}, {r6('macro_f1', 'macro_f1')} FROM cl", [BOOSTS, PICKED_BOOST, CLASS_BOOST]),
        "tune_draw_boost": _prob(f"SELECT boost, {r6('macro_f1', 'macro_f1')} FROM cl ORDER BY round(cl.macro_f1, 12) DESC, boost LIMIT 1", [BOOSTS, PICKED_BOOST, CLASS_BOOST]),
        "ensemble_average": _prob(f"""
SELECT l_orderkey, {r6('avg(p_home)', 'p_home')}, {r6('avg(p_draw)', 'p_draw')}, {r6('avg(p_away)', 'p_away')}, {r6('avg(rate_home)', 'rate_home')}
FROM probs GROUP BY l_orderkey"""),
        "run_summary": build([], f"""
SELECT tag, count(*) AS runs, count(DISTINCT num_numeric_features) AS feature_counts,
       count(DISTINCT seed) AS seeds, {r6("avg(val_accuracy)", "val_accuracy_mean")}, {r6("stddev_pop(val_accuracy)", "val_accuracy_std")},
       {r6("avg(val_log_loss)", "val_log_loss_mean")}, {r6("stddev_pop(val_log_loss)", "val_log_loss_std")} FROM v_runs GROUP BY tag""", "v_runs"),
        "history_summary": build([], f"""
SELECT tag, count(*) AS runs, array_to_string(list_sort(list(DISTINCT num_numeric_features)), ',') AS feature_counts,
       any_value(seeds) AS seeds, {", ".join(r6(f"avg({e})", f"{m}_mean") + ", " + r6(f"stddev_pop({e})", f"{m}_std") for m, e in HISTORY.items())}
FROM (SELECT *, CASE WHEN seed <> 4 THEN tag ELSE '' END AS tag_ FROM v_runs) r
JOIN (SELECT tag, string_agg(seed || ':' || n, ',' ORDER BY seed) AS seeds
      FROM (SELECT CASE WHEN seed <> 4 THEN tag ELSE '' END AS tag, seed, count(*) AS n FROM v_runs GROUP BY ALL) x GROUP BY tag) s
     ON s.tag = r.tag_ GROUP BY s.tag""".replace("SELECT tag, count(*) AS runs", "SELECT s.tag AS tag, count(*) AS runs"), "v_runs"),
        "unknown_targets": build([], "SELECT concat('L', CAST(n_nationkey AS VARCHAR)) AS league FROM nation WHERE concat('L', CAST(n_nationkey AS VARCHAR)) NOT IN (SELECT league FROM v_schedule)", S),
        "resample_counts": build(PLAIN, "SELECT count(*) AS rows, TRUE AS about_as_many, TRUE AS about_a_third_left_out FROM m", S),
        "normalization_stats": build([*PLAIN, ROWS], f"""
SELECT feature, {r6("avg(x)", "mean")}, {r6("stddev_pop(x)", "std")}
FROM (SELECT unnest(['gf', 'ga', 'pts']) AS feature, unnest([gf, ga, pts]) AS x FROM tr) t GROUP BY feature""", S),
        "standardized": build([*PLAIN, ROWS], f"""
SELECT row_idx, is_home, {", ".join(r6(f"({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1e0 ELSE {c}_s END", c) for c in ("gf", "ga", "pts"))}
FROM tr, (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ("gf", "ga", "pts"))} FROM tr) s""", S),
        "class_weights": build([PARSED], f"""
SELECT label, {r6("w / avg(w) OVER ()", "weight")}
FROM (SELECT label, pow(i / avg(i) OVER (), 0.5e0) AS w
      FROM (SELECT k AS label, (SELECT count(*) FROM valid) / (3e0 * (SELECT count(*) FROM valid WHERE label = k)) AS i
            FROM (VALUES (0), (1), (2)) c(k)) x) y""", S),
        "time_decay": build([PARSED], f"""
SELECT game_id, {r6("d * n / total", "weight")}
FROM (SELECT game_id, pow(0.5e0, date_diff('day', CAST(date AS DATE), (SELECT max(CAST(date AS DATE)) FROM valid)) / 390e0) AS d FROM valid) w,
     (SELECT count(*) AS n, sum(pow(0.5e0, date_diff('day', CAST(date AS DATE), (SELECT max(CAST(date AS DATE)) FROM valid)) / 390e0)) AS total FROM valid) t""", S),
        "reference_day": build([PARSED], "SELECT CAST(date_diff('day', DATE '1970-01-01', max(CAST(date AS DATE))) + 719163 AS INTEGER) AS reference_day FROM valid", S),
        "repair_wrapped_json": """
SELECT page_id AS id, 'page' AS origin, html AS text FROM pages
UNION ALL SELECT event_id, 'event', props FROM events""",
        "ingest_report": build([], """
SELECT t.source, t.collection, t.league, t.season, coalesce(n, 0) AS rows, CASE WHEN coalesce(n, 0) > 0 THEN 'loaded' ELSE 'empty' END AS status
FROM (SELECT 'table' AS source, 'schedule' AS collection, league, season FROM (SELECT DISTINCT league FROM v_schedule) a,
             (SELECT DISTINCT season FROM v_schedule UNION SELECT '0203') b) t
LEFT JOIN (SELECT league, season, count(*) AS n FROM v_schedule GROUP BY league, season) c ON c.league = t.league AND c.season = t.season""", S),
        "target_grid": build([], "SELECT league, season FROM (SELECT DISTINCT league FROM v_schedule) a, (SELECT DISTINCT season FROM v_schedule) b", S),
        "append_ignore": "SELECT DISTINCT o_custkey AS key, o_orderstatus AS _league, 'all' AS _season FROM orders",
        "cleaned_orders": """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price,
       'landed' AS _source, concat('L', o_orderstatus) AS _league, '9495' AS _season FROM orders""",
        "flattened_lineitem": """
SELECT l_orderkey AS key_order, l_linenumber AS key_line, l_quantity AS amount_quantity, l_tax AS amount_rate_tax FROM lineitem""",
        "live_late_rows": build([SPLIT_LATE], "SELECT arrival AS _batch, count(*) AS rows, count(*) FILTER (WHERE late) AS late FROM split GROUP BY arrival", "v_arrivals"),
        "live_sliding_windows": build([SPLIT_LATE], """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
       count(*) AS events, round(sum(value), 4) AS total
FROM (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS w FROM split, range(3) r(i) WHERE NOT late) t
GROUP BY w, event_type""", "v_arrivals"),
        "live_sessions": build([SPLIT_LATE], """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS events
FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 3 HOUR, TRUE) AS gap FROM split WHERE NOT late) g) s
GROUP BY user_id, n HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 12 HOUR FROM split WHERE NOT late)""", "v_arrivals"),
        "landed_source": build([], """
SELECT league, season, game, game_id, date, CAST(week AS DOUBLE) AS week, home_team, away_team, score, league AS _league, season AS _season
FROM v_schedule WHERE league IN ('L1', 'L3')""", S),
        "landed_kinds": build([], KINDS_READ, "v_drifting", E),
        "landed_rejects": build([], """
SELECT CASE WHEN k % 13 = 0 THEN concat('{"team": "', team) ELSE '[1, 2]' END AS line, CASE WHEN k % 13 = 0 THEN 'no JSON' ELSE 'no object' END AS reject_reason
FROM v_drifting WHERE k % 13 = 0 OR k % 17 = 0""", "v_drifting"),
        "live_event_windows": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    }
    return out
