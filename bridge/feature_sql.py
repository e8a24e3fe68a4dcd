"""SQL twin of the feature plan, generated for any spine of pairings.

Every lookup is an ``ASOF`` join on a per-day state, so the same text serves games and
arbitrary requests.
"""

from __future__ import annotations

from bridge.views import SQL
from daybefore.plans.columns import (GOALIE_STRENGTHS, LINEUP, SHARES, STANDING_MEASURES, TEAM_STATS,
                                     TEAM_STRENGTHS)


def _last_of_day(src, keys, time, id, n, outs):
    """State after each (keys, day): frame of the last n rows at the day's last row."""
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT {', '.join(keys)}, {time} AS day, row_number() OVER (PARTITION BY {', '.join(keys)}, {time} ORDER BY {id} DESC) AS rn, {outs}
  FROM {src} WINDOW w AS (PARTITION BY {', '.join(keys)} ORDER BY {time}, {id} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) x
WHERE rn = 1"""


def _m(c, o=None):
    return f"CASE WHEN count({c}) OVER w >= 3 THEN avg({c}) OVER w END AS {o or c}"


SQL["tsday"] = ("tstats", _last_of_day("tstats", ["team_id"], "date", "game_id", 10, ", ".join(_m(c) for c in TEAM_STATS)))
SQL["advday"] = ("shares", _last_of_day("shares", ["team_id"], "date", "game_id", 10, ", ".join(_m(c) for c in SHARES)))
SQL["svday"] = ("goalies", _last_of_day("goalies", ["player_id"], "date", "game_id", 10,
                "CASE WHEN count(saves) OVER w >= 3 AND count(shots_against) OVER w >= 3 AND sum(shots_against) OVER w <> 0 "
                "THEN sum(saves) OVER w / CAST(sum(shots_against) OVER w AS DOUBLE) END AS goalie_sv"))
SQL["gvday"] = ("gvals", _last_of_day("gvals", ["player_id"], "date", "game_id", 10, _m("value", "goalie_gsax")))
SQL["oppday"] = ("gtg", _last_of_day("gtg", ["team_id", "season"], "date", "game_id", 10, "list(opp_id) OVER w AS opps"))
SQL["splitday"] = ("gtg", _last_of_day("gtg", ["team_id", "season", "is_home"], "date", "game_id", 100_000_000,
                   "count(*) OVER w AS sg, sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) OVER w AS sw"))
SQL["playday"] = ("gtg", "SELECT DISTINCT team_id, date AS day FROM gtg")
SQL["lelo0"] = ("games", """
SELECT season, date AS match_date, id AS match_id, home_team_id AS home_id, away_team_id AS away_id,
       CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY season ORDER BY date, id) AS rn FROM games""")


def _rating():
    from bridge.timed import _STEP
    SQL["lelo"] = ("lelo0", _STEP.format(src="lelo0", me="lelo"))
    SQL["eloday"] = ("lelo", """
SELECT season, team_id, day, rating FROM (
  SELECT season, team_id, d AS day, rating, row_number() OVER (PARTITION BY season, team_id, d ORDER BY id DESC) AS rn FROM (
    SELECT season, home_id AS team_id, d, id, nh AS rating FROM lelo WHERE rn > 0
    UNION ALL SELECT season, away_id, d, id, na FROM lelo WHERE rn > 0) u) x WHERE rn = 1""")


_rating()


def _pairday(where):
    return f"""
SELECT lo, hi, day, n, wlo, whi FROM (
  SELECT lo, hi, date AS day, row_number() OVER (PARTITION BY lo, hi, date ORDER BY id DESC) AS rn, count(*) OVER w AS n,
         sum(CASE WHEN (home_team_id = lo AND home_score > away_score) OR (away_team_id = lo AND away_score > home_score) THEN 1 ELSE 0 END) OVER w AS wlo,
         sum(CASE WHEN (home_team_id = hi AND home_score > away_score) OR (away_team_id = hi AND away_score > home_score) THEN 1 ELSE 0 END) OVER w AS whi
  FROM (SELECT *, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi FROM games WHERE {where}) b
  WINDOW w AS (PARTITION BY lo, hi ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE rn = 1"""


SQL["pairday2"] = ("games", _pairday("game_type = 2"))
SQL["pairday"] = ("games", _pairday("true"))

_STATE_NEEDS = ("standings tsday advday playday eloday league splitday oppday skday lateststart goalies gvals svday gvday "
                "cums cumv lgs lgv prevs prevv")


def _bm(x, n, m, w):
    return f"((({x}) * ({n}) + ({m}) * ({w})) / (({n}) + ({w})))"


def side_sql(p: str, spine: str, needs: str, mode: str, use_rest: bool = True) -> None:
    """Register ``{p}side``: all per-side columns for a sides spine
    (sid, season, date, team_id, is_home, game_id, asked)."""
    SQL[f"{p}sp"] = (needs, spine)
    SQL[f"{p}td"] = (f"{p}sp", f"SELECT DISTINCT team_id, season, date FROM {p}sp")
    SQL[f"{p}sched"] = (f"{p}td oppday standings", f"""
SELECT e.team_id, e.season, e.date, avg(s.point_pctg) AS sv, count(s.point_pctg) AS sn
FROM (SELECT t.team_id, t.season, t.date, unnest(o.opps) AS opp_id FROM {p}td t
      ASOF JOIN oppday o ON o.team_id = t.team_id AND o.season = t.season AND t.date > o.day) e
ASOF LEFT JOIN standings s ON s.team_id = e.opp_id AND s.season = e.season AND e.date > s.as_of_date GROUP BY 1, 2, 3""")
    SQL[f"{p}rank"] = (f"{p}td skday", f"""
SELECT t.team_id, t.season, t.date, k.date AS seen, k.rolling_toi_sec AS toi, coalesce(k.rolling_points, 0) AS pts,
       coalesce(k.rolling_sog, 0) AS sog,
       row_number() OVER (PARTITION BY t.team_id, t.season, t.date ORDER BY k.rolling_toi_sec DESC, k.player_id) AS rn
FROM {p}td t JOIN skday k ON k.team_id = t.team_id AND k.season = t.season AND k.date < t.date
  AND (k.until IS NULL OR k.until >= t.date) WHERE k.rolling_toi_sec IS NOT NULL""")
    on = "rn <= 6 AND seen >= date - 10"
    SQL[f"{p}line"] = (f"{p}rank", f"""
SELECT team_id, season, date, act / CAST(greatest(top, 1) AS DOUBLE) - 0.8 AS lineup_availability,
       CASE WHEN act > 0 THEN ws / w - 0.6 ELSE 0 END AS top_skater_impact, tt / greatest(dt, 1) - 0.55 AS deployment_concentration
FROM (SELECT team_id, season, date, sum(CASE WHEN {on} THEN 1 ELSE 0 END) AS act, sum(CASE WHEN rn <= 6 THEN 1 ELSE 0 END) AS top,
             sum(CASE WHEN {on} THEN greatest(toi, 1) * (pts + CAST(0.05 AS DOUBLE) * sog) END) AS ws,
             sum(CASE WHEN {on} THEN greatest(toi, 1) END) AS w, sum(CASE WHEN rn <= 6 THEN toi END) AS tt, sum(toi) AS dt
      FROM {p}rank WHERE rn <= 12 GROUP BY 1, 2, 3) x""")
    if mode == "actual":
        member = f"""
SELECT t.*, g.player_id AS roller, coalesce(g.player_id, l.player_id) AS player_id FROM {p}sp t
LEFT JOIN goalies g ON g.game_id = t.game_id AND g.team_id = t.team_id AND g.is_home = t.is_home
ASOF LEFT JOIN lateststart l ON l.team_id = t.team_id AND t.date > l.date"""
    else:
        member = f"""
SELECT u.*, u.player_id AS roller FROM (
  SELECT t.*, CASE WHEN f.first < t.date THEN t.asked ELSE l.player_id END AS player_id FROM {p}sp t
  ASOF LEFT JOIN lateststart l ON l.team_id = t.team_id AND t.date > l.date
  LEFT JOIN (SELECT team_id, player_id, min(date) AS first FROM goalies GROUP BY 1, 2) f
    ON f.team_id = t.team_id AND f.player_id = t.asked) u"""
    SQL[f"{p}mem"] = (f"{p}sp goalies lateststart", member)
    std = ", ".join(f"s.{c}" for c in STANDING_MEASURES)
    SQL[f"{p}raw"] = (f"{p}mem {p}sched {p}line {_STATE_NEEDS}", f"""
SELECT m.*, s.as_of_date, {std}, {', '.join(f'ts.{c} AS rolling_{c}' for c in TEAM_STATS)}, {', '.join(f'a.{c}' for c in SHARES)},
       date_diff('day', pd.day, m.date) AS rest_days, coalesce(e.rating, CAST(1500 AS DOUBLE)) AS elo,
       coalesce(l.gf, CAST(3 AS DOUBLE)) AS lgf, coalesce(l.ga, CAST(3 AS DOUBLE)) AS lga, coalesce(sp.sg, 0) AS sg,
       CASE WHEN sp.sg > 0 THEN sp.sw / CAST(sp.sg AS DOUBLE) ELSE coalesce(s.win_pctg, CAST(0.5 AS DOUBLE)) END AS spl,
       coalesce(h.sv, CAST(0.5 AS DOUBLE)) AS sv, coalesce(h.sn, 0) AS sn,
       {', '.join(f'coalesce(ln.{c}, 0) AS {c}' for c in LINEUP)}, sd.goalie_sv, gd.goalie_gsax,
       coalesce(c.cs, 0) AS cs, coalesce(c.csh, 0) AS csh, coalesce(c.cn, 0) - coalesce(c14.cn, 0) AS s14,
       coalesce(c.cn, 0) - coalesce(c7.cn, 0) AS s7, coalesce(cv.cv, 0) AS cv, coalesce(cv.cn, 0) AS cvn,
       coalesce(ps.ps, 0) AS ps, coalesce(ps.psh, 0) AS psh, coalesce(pv.pv, 0) AS pv, coalesce(pv.pn, 0) AS pn,
       CASE WHEN ls.a > 0 THEN ls.s / CAST(ls.a AS DOUBLE) ELSE 0.905 END AS lr, CASE WHEN lv.n > 0 THEN lv.v / lv.n ELSE 0 END AS lv
FROM {p}mem m
ASOF LEFT JOIN standings s ON s.team_id = m.team_id AND s.season = m.season AND m.date > s.as_of_date
ASOF LEFT JOIN tsday ts ON ts.team_id = m.team_id AND m.date > ts.day
ASOF LEFT JOIN advday a ON a.team_id = m.team_id AND m.date > a.day
ASOF LEFT JOIN playday pd ON pd.team_id = m.team_id AND m.date > pd.day
ASOF LEFT JOIN eloday e ON e.team_id = m.team_id AND e.season = m.season AND m.date > e.day
ASOF LEFT JOIN league l ON l.season = m.season AND m.date > l.as_of_date
ASOF LEFT JOIN splitday sp ON sp.team_id = m.team_id AND sp.season = m.season AND sp.is_home = m.is_home AND m.date > sp.day
ASOF LEFT JOIN svday sd ON sd.player_id = m.roller AND m.date > sd.day
ASOF LEFT JOIN gvday gd ON gd.player_id = m.roller AND m.date > gd.day
ASOF LEFT JOIN cums c ON c.player_id = m.player_id AND c.season = m.season AND m.date > c.date
ASOF LEFT JOIN cums c14 ON c14.player_id = m.player_id AND c14.season = m.season AND m.date - 14 > c14.date
ASOF LEFT JOIN cums c7 ON c7.player_id = m.player_id AND c7.season = m.season AND m.date - 7 > c7.date
ASOF LEFT JOIN cumv cv ON cv.player_id = m.player_id AND cv.season = m.season AND m.date > cv.date
ASOF LEFT JOIN lgs ls ON ls.season = m.season AND m.date > ls.date
ASOF LEFT JOIN lgv lv ON lv.season = m.season AND m.date > lv.date
LEFT JOIN prevs ps ON ps.player_id = m.player_id AND ps.season = m.season
LEFT JOIN prevv pv ON pv.player_id = m.player_id AND pv.season = m.season
LEFT JOIN {p}sched h ON h.team_id = m.team_id AND h.season = m.season AND h.date = m.date
LEFT JOIN {p}line ln ON ln.team_id = m.team_id AND ln.season = m.season AND ln.date = m.date""")
    gp = "coalesce(games_played, 0)"
    gf = f"CASE WHEN {gp} > 0 THEN goal_for / CAST(games_played AS DOUBLE) ELSE lgf END"
    ga = f"CASE WHEN {gp} > 0 THEN goal_against / CAST(games_played AS DOUBLE) ELSE lga END"
    win = "coalesce(win_pctg, CAST(0.5 AS DOUBLE))"
    recent = "least(coalesce(l10_points, 10) / CAST(20 AS DOUBLE), CAST(1 AS DOUBLE))"
    cur = "CASE WHEN cvn > 0 THEN cv / cvn ELSE lv END"
    prev = "CASE WHEN pn > 0 THEN pv / pn ELSE lv END"
    inner = f"CASE WHEN cvn + pn * 0.5 > 0 THEN (({cur}) * cvn + ({prev}) * (pn * 0.5)) / (cvn + pn * 0.5) ELSE {prev} END"
    rest = "rest_days" if use_rest else "2"
    none = "player_id IS NULL"
    SQL[f"{p}side"] = (f"{p}raw", f"""
SELECT *, 0.65 * ({_bm(recent, '10', win, '12')} - 0.5) + 0.2 * team_off_strength + 0.15 * team_def_strength AS team_form_blend,
       CASE WHEN {none} THEN 0 ELSE talent END AS goalie_talent_strength, CASE WHEN {none} THEN 0 ELSE s14 - 2 END AS goalie_workload,
       CASE WHEN {none} THEN 0 ELSE greatest(s7 - 1, 0) * 0.5 + CASE WHEN coalesce({rest}, 2) <= 1 THEN 0.75 ELSE 0 END END AS goalie_fatigue,
       CASE WHEN {none} THEN 0 ELSE talent - 0.35 * team_def_strength END AS goalie_team_adj_strength
FROM (SELECT *, {_bm(gf, gp, 'lgf', '20')} - lgf + 0.75 * (coalesce(xgf_pct, 0.5) - 0.5) AS team_off_strength,
             lga - {_bm(ga, gp, 'lga', '20')} + 0.75 * (coalesce(hdcf_pct_5v5, hdcf_pct, 0.5) - 0.5) AS team_def_strength,
             {_bm('sv', 'sn', '0.5', '10')} - 0.5 AS team_schedule_strength, {_bm('spl', 'sg', win, '6')} - {win} AS team_split_strength,
             (cs + 0.5 * ps + 500 * lr) / greatest(csh + 0.5 * psh + 500, 1) - lr + 0.015 * {_bm(inner, 'cvn + 0.5 * pn', 'lv', '15')} AS talent
      FROM {p}raw) o""")


def feature_columns() -> list[str]:
    """The hundred computed columns, in order."""
    return list(_assembly("h", "a"))


def _assembly(h: str, a: str) -> dict[str, str]:
    def z(x):
        return f"coalesce({x}, 0)"

    def half(x):
        return f"CASE WHEN coalesce({x}, 0) = 0 THEN 0.5 ELSE {x} END"

    out = {}
    sides = {"home": (h, a), "away": (a, h)}
    pg = {n: [f"{z(f'{s}.{c}')} / CAST(greatest(coalesce({s}.games_played, 0), 1) AS DOUBLE)" for c in ("goal_for", "goal_against")]
          for n, (s, _) in sides.items()}
    for n, (s, _) in sides.items():
        out |= {f"{n}_games_played": z(f"{s}.games_played"), f"{n}_point_pctg": half(f"{s}.point_pctg"),
                f"{n}_win_pctg": half(f"{s}.win_pctg"), f"{n}_reg_win_pctg": half(f"{s}.regulation_win_pctg"),
                f"{n}_goal_diff": z(f"{s}.goal_differential"), f"{n}_l10_points": z(f"{s}.l10_points"),
                f"{n}_points": z(f"{s}.points"), f"{n}_goals_for_per_game": pg[n][0], f"{n}_goals_against_per_game": pg[n][1]}
    for n, (s, _) in sides.items():
        out |= {f"{n}_goalie_sv_pctg": f"{s}.goalie_sv", f"{n}_goalie_gsax": f"{s}.goalie_gsax"}
    out |= {"home_rest_days": f"{h}.rest_days", "away_rest_days": f"{a}.rest_days"}
    for n, (s, _) in sides.items():
        out[f"{n}_is_b2b"] = f"CASE WHEN {s}.rest_days = 1 THEN 1 ELSE 0 END"
    out["rest_advantage"] = " - ".join(f"CASE WHEN coalesce({s}.rest_days, 0) = 0 THEN 2 ELSE {s}.rest_days END" for s in (h, a))
    pk = {n: f"(1 - {o}.rolling_pp_pctg)" for n, (_, o) in sides.items()}
    roll = {"pp_pctg": "pp_pctg", "faceoff_pctg": "faceoff_winning_pctg", "sog": "sog", "hits": "hits", "blocked_shots": "blocked_shots"}
    for n, (s, _) in sides.items():
        for short, c in roll.items():
            out[f"{n}_{short}"] = f"{s}.rolling_{c}"
            if short == "pp_pctg":
                out[f"{n}_pk_pctg"] = pk[n]

    def diff(f, c):
        return f"({f(f'{h}.{c}')}) - ({f(f'{a}.{c}')})"
    out |= {"diff_point_pctg": diff(half, "point_pctg"), "diff_goal_diff": diff(z, "goal_differential"),
            "diff_l10_points": diff(z, "l10_points"), "diff_points": diff(z, "points"),
            "diff_goalie_sv_pctg": diff(z, "goalie_sv"), "diff_goalie_gsax": diff(z, "goalie_gsax"),
            "diff_pp_pctg": diff(z, "rolling_pp_pctg"), "diff_pk_pctg": f"{z(pk['home'])} - {z(pk['away'])}",
            "diff_faceoff_pctg": diff(z, "rolling_faceoff_winning_pctg"), "diff_sog": diff(z, "rolling_sog"),
            "diff_goals_for_per_game": f"{pg['home'][0]} - {pg['away'][0]}",
            "diff_goals_against_per_game": f"{pg['home'][1]} - {pg['away'][1]}"}
    out |= {f"diff_{c}": diff(half, c) for c in SHARES}
    for c in (*TEAM_STRENGTHS, *GOALIE_STRENGTHS, *LINEUP):
        out |= {f"home_{c}": f"{h}.{c}", f"away_{c}": f"{a}.{c}", f"diff_{c}": f"{h}.{c} - {a}.{c}"}
    hw = f"{z(f'{h}.home_wins')} / CAST(greatest({z(f'{h}.home_wins')} + {z(f'{h}.home_losses')}, 1) AS DOUBLE)"
    aw = f"{z(f'{a}.road_wins')} / CAST(greatest({z(f'{a}.road_wins')} + {z(f'{a}.road_losses')}, 1) AS DOUBLE)"
    out |= {"home_home_win_pctg": hw, "away_road_win_pctg": aw, "diff_home_road_pctg": f"{hw} - {aw}",
            "h2h_home_win_pctg": "CASE WHEN p.n > 0 THEN CASE WHEN q.home_team_id = p.lo THEN p.wlo ELSE p.whi END / CAST(p.n AS DOUBLE) END",
            "home_elo": f"{h}.elo", "away_elo": f"{a}.elo", "elo_diff": f"{h}.elo - {a}.elo"}
    return out


def features_sql(p: str, pairs: str, pair_needs: str, mode: str, pairday: str) -> None:
    """Register ``{p}feat``: feature rows for the pairings spine
    (sid, game_id, season, date, game_type, home_team_id, away_team_id, home_asked, away_asked, target)."""
    SQL[f"{p}pairs"] = (pair_needs, pairs)
    side_sql(p, f"""
SELECT sid, season, date, home_team_id AS team_id, true AS is_home, game_id, home_asked AS asked FROM {p}pairs
UNION ALL SELECT sid, season, date, away_team_id, false, game_id, away_asked FROM {p}pairs""", f"{p}pairs", mode)
    cols = ", ".join(f"{e} AS {c}" for c, e in _assembly("h", "a").items())
    SQL[f"{p}feat"] = (f"{p}pairs {p}side {pairday}", f"""
SELECT q.sid AS game_id, q.season, q.date, q.game_type, q.home_team_id, q.away_team_id, q.target, {cols}
FROM {p}pairs q JOIN {p}side h ON h.sid = q.sid AND h.is_home JOIN {p}side a ON a.sid = q.sid AND NOT a.is_home
ASOF LEFT JOIN {pairday} p ON p.lo = least(q.home_team_id, q.away_team_id) AND p.hi = greatest(q.home_team_id, q.away_team_id) AND q.date > p.day
WHERE h.as_of_date IS NOT NULL AND a.as_of_date IS NOT NULL AND NOT coalesce(h.games_played = 0 AND a.games_played = 0, FALSE)""")
