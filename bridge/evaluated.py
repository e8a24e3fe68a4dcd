"""Score distributions, probability metrics, quotes and benchmarks."""

from __future__ import annotations

from math import comb

from pyspark.sql import functions as F

from bridge.basic import _DEVIG
from bridge.registry import query
from bridge.views import SQL
from daybefore.functions import scores
from daybefore.operators import isotonic, market, metrics
from daybefore.plans import backtest, ml

# ---- score distribution -----------------------------------------------------------------------

SQL["bounded"] = ("rate", """
SELECT match_id, season, home_score, away_score, lambda_home AS lh, lambda_away AS la,
       least(greatest(lambda3, 0), greatest(least(lambda_home, lambda_away) - 1e-9, 0)) AS l3 FROM rate""")
SQL["cells"] = ("bounded", """
SELECT match_id, i, j, sum(pow(lh - l3, i - k) / CAST(factorial(CAST(i - k AS INT)) AS DOUBLE) * pow(la - l3, j - k)
       / CAST(factorial(CAST(j - k AS INT)) AS DOUBLE) * pow(l3, k) / CAST(factorial(CAST(k AS INT)) AS DOUBLE)) AS w
FROM bounded, range(0, 11) a(i), range(0, 11) b(j), range(0, 11) c(k)
WHERE k <= least(i, j) GROUP BY match_id, i, j""")
SQL["grid"] = ("cells", "SELECT match_id, i, j, w / sum(w) OVER (PARTITION BY match_id) AS p FROM cells")
SQL["dist"] = ("grid bounded", """
SELECT g.*, least(greatest(p_home_win + p_tie * b.lh / (b.lh + b.la), 0), 1) AS p_final_home FROM (
  SELECT match_id, sum(CASE WHEN i > j THEN p ELSE 0 END) AS p_home_win, sum(CASE WHEN i < j THEN p ELSE 0 END) AS p_away_win,
         sum(CASE WHEN i = j THEN p ELSE 0 END) AS p_tie, sum(i * p) AS expected_home, sum(j * p) AS expected_away FROM grid GROUP BY match_id) g
JOIN bounded b ON b.match_id = g.match_id""")


def _dist(v):
    return scores.score_distribution(v.rate, "lambda_home", "lambda_away", "lambda3")


@query("poisson_mass", "F15", "match_id k p:d", "rate", """
SELECT match_id, k, w / sum(w) OVER (PARTITION BY match_id) AS p FROM (
  SELECT match_id, k, pow(lambda_home, k) / CAST(factorial(CAST(k AS INT)) AS DOUBLE) AS w FROM rate, range(0, 11) r(k)) x""")
def _(v):
    return v.rate.select("match_id", F.posexplode(scores.poisson_pmf(F.col("lambda_home"))).alias("k", "p"))


@query("score_grid", "F16", "match_id cell p:d", "grid", "SELECT match_id, i * 11 + j AS cell, p FROM grid")
def _(v):
    return _dist(v).select("match_id", F.posexplode("grid").alias("cell", "p"))


@query("score_distribution", "F17 F18 F19 L13", "match_id p_home_win:d p_away_win:d p_tie:d expected_home:d expected_away:d "
       "p_final_home:d", "dist", "SELECT * FROM dist")
def _(v):
    return _dist(v)


# equal cells can differ in the last bit between engines, so the argmax is over rounded mass
@query("most_likely_score", "T5", "match_id p:d", "grid", "SELECT match_id, max(p) AS p FROM grid GROUP BY match_id")
def _(v):
    d = _dist(v)
    at = F.col("most_likely_home") * 11 + F.col("most_likely_away")
    return d.select("match_id", F.get("grid", at).alias("p"))


_DIFF = """
SELECT match_id, d, sum(q) OVER (PARTITION BY match_id ORDER BY d) AS cdf FROM (
  SELECT match_id, i - j AS d, sum(p) AS q FROM grid GROUP BY 1, 2) x"""
SQL["rps"] = ("grid bounded", f"""
SELECT c.match_id, sum((cdf - CASE WHEN d >= greatest(least(b.home_score - b.away_score, 10), -10) THEN 1 ELSE 0 END)
       * (cdf - CASE WHEN d >= greatest(least(b.home_score - b.away_score, 10), -10) THEN 1 ELSE 0 END)) / 20 AS rps
FROM ({_DIFF}) c JOIN bounded b ON b.match_id = c.match_id GROUP BY c.match_id""")


@query("ranked_probability_score", "A19", "match_id rps:d", "rps", "SELECT * FROM rps")
def _(v):
    return scores.score_quality(v.rate, "home_score", "away_score")


@query("exact_score_rate", "A20 M12", "season n mean_rps:d", "rps bounded", """
SELECT b.season, count(*) AS n, avg(r.rps) AS mean_rps FROM rps r JOIN bounded b ON b.match_id = r.match_id GROUP BY b.season""")
def _(v):
    q = scores.score_quality(v.rate, "home_score", "away_score")
    return q.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.avg("rps").alias("mean_rps"))


SQL["top"] = ("grid", """
SELECT match_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, i, j) AS rn FROM grid) x WHERE rn = 1""")


@query("exact_hit", "A20 T5", "season hits", "top bounded", """
SELECT b.season, sum(CASE WHEN t.i = b.home_score AND t.j = b.away_score THEN 1 ELSE 0 END) AS hits
FROM top t JOIN bounded b ON b.match_id = t.match_id GROUP BY b.season""")
def _(v):
    q = scores.score_quality(v.rate, "home_score", "away_score")
    return q.groupBy("season").agg(F.sum("exact_hit").alias("hits"))


def _binom(n, i, p):
    return f"{comb(n, i)} * pow({p}, {i}) * pow(1 - {p}, {n - i})"


def _wins(w, nh, na):
    """P(A has w wins after nh home and na away games)."""
    return " + ".join(f"({_binom(nh, i, 'a')}) * ({_binom(na, w - i, 'b')})" for i in range(0, w + 1)
                      if i <= nh and w - i <= na)


# games before the deciding one as (A at home, A away), and who hosts the deciding one
_DECIDERS = {4: (2, 1, "b"), 5: (2, 2, "a"), 6: (3, 2, "b"), 7: (3, 3, "a")}
_LEN = {g: f"(({_wins(3, h, w)}) * {x} + ({_wins(g - 4, h, w)}) * (1 - {x}))" for g, (h, w, x) in _DECIDERS.items()}
_AWINS = " + ".join(f"({_wins(3, h, w)}) * {x}" for h, w, x in _DECIDERS.values())
_SERIES_COLS = "match_id p_a_wins:d p_len_4:d p_len_5:d p_len_6:d p_len_7:d expected_games:d"


@query("series_probability", "M14", _SERIES_COLS, "dist", f"""
SELECT match_id, {_AWINS} AS p_a_wins, {', '.join(f'{e} AS p_len_{g}' for g, e in _LEN.items())},
       {' + '.join(f'{g} * {e}' for g, e in _LEN.items())} AS expected_games
FROM (SELECT match_id, p_final_home AS a, 1 - (1 - p_final_home * CAST(0.75 AS DOUBLE)) AS b FROM dist) x""")
def _(v):
    d = _dist(v).select("match_id", F.col("p_final_home").alias("pa"), (1 - F.col("p_final_home") * 0.75).alias("pb"))
    return scores.series_probability(d, "pa", "pb")


@query("residual_covariance", "L12", "lambda3:d", "rate", """
SELECT greatest(avg((home_score - lambda_home) * (away_score - lambda_away)), 0) AS lambda3 FROM rate""")
def _(v):
    return ml.residual_covariance(v.rate, "home_score", "away_score", "lambda_home", "lambda_away")


# ---- metrics ----------------------------------------------------------------------------------

_EPS = "2.220446049250313e-16"
_Q = f"greatest(least(p, 1 - {_EPS}), {_EPS})"


def _metrics_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
SELECT {sel}n_games, accuracy, r AS baseline_accuracy, log_loss, -(r * ln(r) + (1 - r) * ln(1 - r)) AS baseline_log_loss, brier,
       r * (1 - r) AS baseline_brier, (rs - np * (np + 1) / 2) / (np * (n_games - np)) AS roc_auc, mean_predicted_prob, r AS actual_home_rate
FROM (SELECT {sel}count(*) AS n_games, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy,
             avg(CASE WHEN y = 1 THEN -ln({_Q}) ELSE -ln(1 - {_Q}) END) AS log_loss, avg((p - y) * (p - y)) AS brier, avg(p) AS mean_predicted_prob,
             avg(CAST(y AS DOUBLE)) AS r, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs, CAST(sum(y) AS DOUBLE) AS np
      FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}p) - 1) / CAST(2 AS DOUBLE) AS rk FROM {src}) k
      {grp}) x"""


_MET = ("n_games accuracy:d baseline_accuracy:d log_loss:d baseline_log_loss:d brier:d baseline_brier:d roc_auc:d "
        "mean_predicted_prob:d actual_home_rate:d")


@query("probability_metrics", "A15", _MET, "pred", _metrics_sql("pred"))
def _(v):
    return metrics.probability_metrics(v.pred, "p", "y")


@query("fold_metrics", "A24 A15 M11", "season " + _MET, "pred", _metrics_sql("pred", "season"))
def _(v):
    return backtest.fold_metrics(v.pred, "p", "y")[0]


@query("pooled_metrics", "A24", _MET + " n_folds mean_accuracy:d mean_log_loss:d mean_brier:d mean_roc_auc:d", "pred", f"""
SELECT a.*, f.* FROM ({_metrics_sql("pred")}) a, (SELECT count(*) AS n_folds, avg(accuracy) AS mean_accuracy, avg(log_loss) AS mean_log_loss,
  avg(brier) AS mean_brier, avg(roc_auc) AS mean_roc_auc FROM ({_metrics_sql("pred", "season")}) s) f""")
def _(v):
    return backtest.fold_metrics(v.pred, "p", "y")[1]


# margins far outside [0, 1], nine tenths of them equal
SQL["margin"] = ("pred", """
SELECT match_id, season, y, CASE WHEN match_id % 10 <> 0 THEN CAST(0 AS DOUBLE) ELSE (match_id * 37 % 1009) * CAST(12345.5 AS DOUBLE) - 6000000 END AS s FROM pred""")


@query("margin_ranking", "A15 A24", "season roc_auc:d", "margin", """
SELECT season, (rs - np * (np + 1) / 2) / (np * (n - np)) AS roc_auc FROM (
  SELECT season, count(*) AS n, CAST(sum(y) AS DOUBLE) AS np, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs FROM (
    SELECT *, rank() OVER (PARTITION BY season ORDER BY s) + (count(*) OVER (PARTITION BY season, s) - 1) / CAST(2 AS DOUBLE) AS rk FROM margin) k GROUP BY season) x""")
def _(v):
    tied = F.col("match_id") % 10 != 0
    rows = v.pred.withColumn("s", F.when(tied, F.lit(0.0)).otherwise((F.col("match_id") * 37 % 1009) * 12345.5 - 6000000))
    return metrics.auc(rows, "s", "y", ["season"])


# the fit at a score is the largest, over starts before it, of the least mean up to ends after it
SQL["isosums"] = ("pred", """
SELECT p, n, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS w, sum(t) OVER (ORDER BY p) AS s, n AS own, t FROM (
  SELECT p, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS t FROM pred GROUP BY p) g""")


@query("isotonic_calibration", "L3 L9", "p:d n fitted:d", "isosums", """
SELECT p, n, max(least_mean) AS fitted FROM (
  SELECT b.p, b.n, a.i, min((c.s - a.s + a.t) / (c.w - a.w + a.own)) AS least_mean
  FROM isosums b JOIN isosums a ON a.i <= b.i JOIN isosums c ON c.i >= b.i GROUP BY b.p, b.n, a.i) x GROUP BY p, n""")
def _(v):
    fit = isotonic.fit_isotonic(v.pred, "p", "y")
    return v.pred.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("fitted", fit.apply(F.col("p")))


@query("walk_forward_folds", "M11", "season n_train n_test", "pred", """
SELECT season, n_train, n_test FROM (
  SELECT season, n AS n_test, coalesce(sum(n) OVER (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_train,
         row_number() OVER (ORDER BY season) AS i FROM (SELECT season, count(*) AS n FROM pred WHERE season <> 1997 GROUP BY season) c) x
WHERE i > 2""")
def _(v):
    return backtest.fold_sizes(v.pred, exclude=[1997])


def _edges(n):
    return [i * (1.0 / n) for i in range(n)] + [1.0]


def _bin_sql(n):
    return " + ".join(f"CASE WHEN p >= CAST({e!r} AS DOUBLE) THEN 1 ELSE 0 END" for e in _edges(n)[1:-1])


def _calibration(n):
    lo = " ".join(f"WHEN {i} THEN {e!r}" for i, e in enumerate(_edges(n)[:-1]))
    hi = " ".join(f"WHEN {i} THEN {e!r}" for i, e in enumerate(_edges(n)[1:]))

    @query(f"calibration_{n}", "A16", "bin bucket_min:d bucket_max:d n pred_mean:d actual_mean:d", "pred", f"""
SELECT bin, CASE bin {lo} END AS bucket_min, CASE bin {hi} END AS bucket_max, count(*) AS n, avg(p) AS pred_mean, avg(y) AS actual_mean
FROM (SELECT *, {_bin_sql(n)} AS bin FROM pred) b GROUP BY bin""")
    def _(v):
        return metrics.calibration(v.pred, "p", "y", n)


_calibration(5)
_calibration(10)


@query("best_threshold", "A18", "season threshold:d accuracy:d", "pred", """
SELECT season, threshold, accuracy FROM (
  SELECT season, t AS threshold, avg(CASE WHEN (p > t) = (y = 1) THEN 1 ELSE 0 END) AS accuracy,
         row_number() OVER (PARTITION BY season ORDER BY sum(CASE WHEN (p > t) = (y = 1) THEN 1 ELSE 0 END) DESC, t) AS rn
  FROM pred, (SELECT CAST(0.3 AS DOUBLE) + i * CAST(0.010000000000000009 AS DOUBLE) AS t FROM range(0, 41) r(i)) s
  GROUP BY season, t) x WHERE rn = 1""")
def _(v):
    return metrics.best_threshold(v.pred, "p", "y", ["season"])


@query("absolute_error", "A21", "season mae:d baseline_mae:d", "rate", """
SELECT season, avg(abs(home_score - lambda_home)) AS mae, avg(abs(home_score - 3)) AS baseline_mae FROM rate GROUP BY season""")
def _(v):
    return metrics.absolute_error(v.rate, "lambda_home", "home_score", 3.0, ["season"])


_REPORT = """
SELECT label, precision_ AS precision, recall, CASE WHEN precision_ + recall > 0 THEN 2 * precision_ * recall / (precision_ + recall) ELSE 0 END AS f1, support
FROM (SELECT label, CASE WHEN pp > 0 THEN tp / CAST(pp AS DOUBLE) ELSE 0 END AS precision_,
             CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall, support
      FROM (SELECT label, sum(CASE WHEN yhat = label AND y = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN yhat = label THEN 1 ELSE 0 END) AS pp,
                   sum(CASE WHEN y = label THEN 1 ELSE 0 END) AS support
            FROM (SELECT y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yhat FROM pred) a, (VALUES (0), (1)) l(label) GROUP BY label) c) d"""


def _hat(v):
    return v.pred.withColumn("yhat", (F.col("p") > 0.5).cast("int"))


@query("classification_report", "A22", "label precision:d recall:d f1:d support", "pred", _REPORT)
def _(v):
    return metrics.classification_report(_hat(v), "yhat", "y")


@query("macro_f1", "A22", "macro_f1:d", "pred", f"SELECT avg(f1) AS macro_f1 FROM ({_REPORT}) r")
def _(v):
    return metrics.macro_f1(_hat(v), "yhat", "y")


# ---- market -----------------------------------------------------------------------------------

SQL["quoted"] = ("odds", f"""
SELECT game_id, min(CASE WHEN first = 1 THEN date END) AS date, 'unknown' AS provider,
       min(CASE WHEN kind = 'opening' AND rn = 1 THEN home_prob END) AS opening_home_prob,
       min(CASE WHEN kind = 'opening' AND rn = 1 THEN away_prob END) AS opening_away_prob,
       min(CASE WHEN kind = 'closing' AND rn = 1 THEN home_prob END) AS closing_home_prob,
       min(CASE WHEN kind = 'closing' AND rn = 1 THEN away_prob END) AS closing_away_prob
FROM (SELECT *, row_number() OVER (PARTITION BY game_id, kind ORDER BY quote_id DESC) AS rn,
             row_number() OVER (PARTITION BY game_id ORDER BY quote_id) AS first
      FROM (SELECT *, CASE WHEN lower(coalesce(snapshot_type, 'closing')) = 'opening' THEN 'opening' ELSE 'closing' END AS kind
            FROM ({_DEVIG}) d) k) r GROUP BY game_id""")
_PROBS = "opening_home_prob:d opening_away_prob:d closing_home_prob:d closing_away_prob:d"


@query("normalize_odds", "M9 F11 F12 U4", "game_id date:t provider:s " + _PROBS, "quoted", "SELECT * FROM quoted")
def _(v):
    return market.normalize_odds(v.odds, "quote_id")


_P9 = "greatest(least({p}, 1 - 1e-9), 1e-9)"


def _ll(p):
    q = _P9.format(p=p)
    return f"CASE WHEN home_win_outcome = 1 THEN -ln({q}) WHEN home_win_outcome = 0 THEN -ln(1 - {q}) END"


SQL["bench"] = ("served quoted", f"""
SELECT s.*, q.opening_home_prob AS op, q.closing_home_prob AS cp, s.home_win_probability - q.opening_home_prob AS edge_vs_open,
       s.home_win_probability - q.closing_home_prob AS edge_vs_close, ln(s.home_win_probability / q.closing_home_prob) AS clv_log_edge,
       (s.home_win_probability - s.home_win_outcome) * (s.home_win_probability - s.home_win_outcome) AS brier,
       {_ll('s.home_win_probability')} AS log_loss
FROM served s LEFT JOIN quoted q ON q.game_id = s.game_id""")


BENCH = ("game_id model_version:s model_home_win_prob:d market_open_home_prob:d "
         "market_close_home_prob:d edge_vs_open:d edge_vs_close:d clv_log_edge:d home_win_outcome brier:d log_loss:d")
BENCH_SQL = """
SELECT game_id, model_version, home_win_probability AS model_home_win_prob, op AS market_open_home_prob, cp AS market_close_home_prob,
       edge_vs_open, edge_vs_close, clv_log_edge, home_win_outcome, brier, log_loss FROM bench"""


@query("market_benchmark", "M10 J17 F13 F14", BENCH, "bench", BENCH_SQL)
def _(v):
    return market.market_benchmark(v.served, market.normalize_odds(v.odds, "quote_id"))


DAILY = ("date:t feature_version:s model_version:s n_games n_with_closing_odds n_with_outcomes mean_edge_vs_close:d "
         "mean_clv_log_edge:d model_brier:d model_log_loss:d market_closing_brier:d market_closing_log_loss:d")


DAILY_SQL = f"""
SELECT date, feature_version, model_version, count(*) AS n_games, count(cp) AS n_with_closing_odds, count(home_win_outcome) AS n_with_outcomes,
       avg(edge_vs_close) AS mean_edge_vs_close, avg(clv_log_edge) AS mean_clv_log_edge, avg(brier) AS model_brier, avg(log_loss) AS model_log_loss,
       avg((cp - home_win_outcome) * (cp - home_win_outcome)) AS market_closing_brier,
       avg(CASE WHEN cp IS NOT NULL THEN {_ll('cp')} END) AS market_closing_log_loss
FROM bench GROUP BY date, feature_version, model_version"""


@query("market_benchmark_daily", "A17 M10", DAILY, "bench", DAILY_SQL)
def _(v):
    return market.market_benchmark_daily(market.market_benchmark(v.served, market.normalize_odds(v.odds, "quote_id")))


@query("daily_calibration_slices", "A16 A17", "date:t model_version:s bucket_min:d n pred_mean:d actual_mean:d", "served", f"""
SELECT date, model_version, CASE bin {" ".join(f"WHEN {i} THEN {e!r}" for i, e in enumerate(_edges(5)[:-1]))} END AS bucket_min,
       count(*) AS n, avg(p) AS pred_mean, avg(home_win_outcome) AS actual_mean
FROM (SELECT *, {_bin_sql(5)} AS bin FROM (SELECT *, home_win_probability AS p FROM served WHERE home_win_outcome IS NOT NULL) a) b
GROUP BY date, model_version, bin""")
def _(v):
    d = market.market_benchmark_daily(market.market_benchmark(v.served, market.normalize_odds(v.odds, "quote_id")))
    return d.select("date", "model_version", F.inline("calibration_slices"))
