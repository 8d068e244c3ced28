"""Queries for the cross-sectional evaluation of factors, with SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog_selection import moments_three, solved_three
from barloom.functions.expr import col, pct
from barloom.operators.cross_section import PanelPlan, evaluate_panel, prepare_panel
from barloom.operators.walk_forward import METHODS, method_summary, out_of_sample, paired_tests
from barloom.sources.bars import DUCK_BARS, DUCK_PANEL, event_bars, user_bars

QUERIES: dict = {}
SQL: dict[str, str] = {}

_FACTORS = {"m1": pct(col("close")), "m2": pct(col("close"), 2), "m3": pct(col("close"), 3), "span": (col("high") - col("low")) / col("close")}
_GATES = {"min_valid": 10, "min_group": 2, "min_coverage": 0.3}


# ---- panels ----------------------------------------------------------------------------------
def _shown(panel, digits: int = 7):
    return panel.select("name", F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("string").alias("ts"), F.round("factor", digits).alias("factor"), F.round("ret", digits).alias("ret"))


_SAMPLED = PanelPlan(step=2, lag=1, sample=2, start="2024-01-08", outliers="mad", outlier_minutes=10080, mads=2.0)
_WINSOR = PanelPlan(lag=2, outliers="winsor", outlier_minutes=1440, lower=0.1, upper=0.9, mode="completed", timeframe="4h")
_INTRABAR = PanelPlan(lag=0, mode="intrabar", timeframe="4h", clean=True)
QUERIES["panel_sampled"] = lambda spark, sf_dir: _shown(prepare_panel(user_bars(spark, sf_dir), _FACTORS, _SAMPLED))
QUERIES["panel_completed"] = lambda spark, sf_dir: _shown(prepare_panel(event_bars(spark, sf_dir), {n: _FACTORS[n] for n in ("m1", "span")}, _WINSOR))
QUERIES["panel_intrabar"] = lambda spark, sf_dir: _shown(prepare_panel(event_bars(spark, sf_dir), {n: _FACTORS[n] for n in ("m1", "span")}, _INTRABAR))
_W = "(PARTITION BY symbol ORDER BY ts)"
_CELLS = "close / nullif(lag(close) OVER {w}, 0) - 1 AS m1, close / nullif(lag(close, 2) OVER {w}, 0) - 1 AS m2, close / nullif(lag(close, 3) OVER {w}, 0) - 1 AS m3, (high - low) / nullif(close, 0) AS span".format(w=_W)


def _long(source: str, names: list[str], extra: str = "") -> str:
    return f"SELECT symbol, ts, ret{extra}, unnest([{', '.join(repr(n) for n in names)}]) AS name, unnest([{', '.join(names)}]) AS factor FROM {source}"


_OUT = "SELECT name, CAST(symbol AS VARCHAR) AS symbol, CAST(ts AS VARCHAR) AS ts, round(factor, 7) AS factor, round(ret, 7) AS ret FROM"
SQL["panel_sampled"] = f"""WITH b AS ({DUCK_PANEL}), f AS (SELECT symbol, ts, {_CELLS}, lead(close, 2) OVER {_W} / nullif(close, 0) - 1 AS ret FROM b),
d AS (SELECT symbol, ts, ret, lag(m1) OVER {_W} AS m1, lag(m2) OVER {_W} AS m2, lag(m3) OVER {_W} AS m3, lag(span) OVER {_W} AS span FROM f), l AS ({_long("d", list(_FACTORS))}), g AS (SELECT *, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week FROM l),
m AS (SELECT name, symbol, week, median(factor) AS med FROM g GROUP BY name, symbol, week), a AS (SELECT g.*, m.med, abs(factor - med) AS dev FROM g JOIN m ON g.name = m.name AND g.symbol = m.symbol AND g.week = m.week),
s AS (SELECT name, symbol, week, median(dev) AS mad FROM a GROUP BY name, symbol, week), c AS (SELECT a.name, a.symbol, a.ts, a.ret, CASE WHEN a.factor IS NOT NULL AND mad > 0 THEN least(greatest(a.factor, med - 2 * mad), med + 2 * mad) ELSE a.factor END AS factor
  FROM a JOIN s ON a.name = s.name AND a.symbol = s.symbol AND a.week = s.week WHERE a.ret IS NOT NULL), n AS (SELECT ts AS nts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM c) AS q)
{_OUT} c JOIN n ON c.ts = n.nts WHERE i % 2 = 1 AND ts >= TIMESTAMP '2024-01-08'"""
SQL["panel_completed"] = f"""WITH b AS ({DUCK_BARS}), k AS (SELECT *, CAST(ceil(epoch(ts) / 14400) AS BIGINT) * 14400 AS ends, max(epoch(ts)) OVER (PARTITION BY symbol) AS last FROM b),
h AS (SELECT symbol, make_timestamp(ends * 1000000) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM k WHERE ends <= floor(last / 14400) * 14400 GROUP BY symbol, ends),
f AS (SELECT symbol, ts, {_CELLS} FROM h), r AS (SELECT symbol, ts, lead(close) OVER {_W} / nullif(close, 0) - 1 AS ret FROM b), j AS (SELECT r.symbol, r.ts, r.ret, f.m1, f.span FROM r ASOF LEFT JOIN f ON r.symbol = f.symbol AND r.ts >= f.ts),
d AS (SELECT symbol, ts, ret, lag(m1, 2) OVER {_W} AS m1, lag(span, 2) OVER {_W} AS span FROM j), l AS (SELECT *, CAST(ts AS DATE) AS day FROM ({_long("d", ["m1", "span"])}) AS q), q AS (SELECT name, symbol, day, quantile_cont(factor, 0.1) AS lo, quantile_cont(factor, 0.9) AS hi FROM l GROUP BY name, symbol, day)
{_OUT} (SELECT l.name, l.symbol, l.ts, l.ret, CASE WHEN factor IS NOT NULL THEN least(greatest(factor, lo), hi) END AS factor FROM l JOIN q ON l.name = q.name AND l.symbol = q.symbol AND l.day = q.day WHERE ret IS NOT NULL) AS x"""
SQL["panel_intrabar"] = f"""WITH b AS (SELECT * FROM ({DUCK_BARS}) AS q WHERE volume > 0), k AS (SELECT *, floor(epoch(ts) / 14400) AS bucket FROM b),
p AS (SELECT a.symbol, a.ts, arg_min(c.open, c.ts) AS open, max(c.high) AS high, min(c.low) AS low, max(a.close) AS close FROM k AS a JOIN k AS c ON a.symbol = c.symbol AND a.bucket = c.bucket AND c.ts <= a.ts GROUP BY a.symbol, a.ts),
f AS (SELECT symbol, ts, {_CELLS} FROM p), d AS (SELECT b.symbol, b.ts, f.m1, f.span, lead(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts) / nullif(b.close, 0) - 1 AS ret FROM b JOIN f ON b.symbol = f.symbol AND b.ts = f.ts)
{_OUT} ({_long("d", ["m1", "span"])}) AS l WHERE ret IS NOT NULL"""

# ---- evaluation --------------------------------------------------------------------------------
#: Measures and the digits that both engines agree on.
_MEASURES = {
    "n_symbols": 0, "n_periods": 0, "n_periods_ic": 0, "n_periods_returns": 0, "ic_segments": 0, "ic_same_sign": 0, "rank_ic_same_sign": 0, "ic_mean": 7, "ic_std": 7, "rank_ic_mean": 7, "rank_ic_std": 7, "ic_positive_ratio": 7, "avg_symbols": 5,
    "icir": 6, "rank_icir": 6, "ic_tstat": 5, "rank_ic_tstat": 5, "ic_skip_rate": 7, "returns_skip_rate": 7, "long_short_return": 6, "long_return": 6, "short_return": 6, "returns_std": 6, "win_rate": 7, "win_rate_after_cost": 7, "turnover": 7,
    "cost_per_period": 9, "long_short_return_after_cost": 6, "sharpe_ratio": 6, "sharpe_ratio_after_cost": 6, "annualized_sharpe": 5, "annualized_sharpe_after_cost": 5, "max_drawdown": 5, "max_drawdown_after_cost": 5,
    "monotonicity_mean": 6, "monotonicity_abs_mean": 6, "monotonicity_positive_ratio": 7, "group_mono_ratio": 7, "group_mono_perfect_ratio": 7, "fsc": 6, "avg_coverage": 7,
}


def _cs_evaluate(spark, sf_dir):
    found = evaluate_panel(prepare_panel(user_bars(spark, sf_dir), _FACTORS), **_GATES)
    # compounded totals outgrow fixed decimals: as logarithms, always
    grown = [F.round(F.signum(1 + F.col(c)) * F.log10(F.abs(1 + F.col(c))), 6).alias(f"log10_{c}") for c in ("total_return", "total_return_after_cost")]
    return found.select("name", *grown, *[F.col(c) if not d else F.round(c, d).alias(c) for c, d in _MEASURES.items()])


QUERIES["cs_evaluate"] = _cs_evaluate
_DAYS = f"""b AS ({DUCK_PANEL}), f AS (SELECT symbol, ts, {_CELLS}, lead(close) OVER {_W} / nullif(close, 0) - 1 AS ret FROM b), d AS (SELECT symbol, ts, ret, lag(m1) OVER {_W} AS m1, lag(m2) OVER {_W} AS m2, lag(m3) OVER {_W} AS m3, lag(span) OVER {_W} AS span FROM f),
panel AS ({_long("(SELECT * FROM d WHERE ret IS NOT NULL) AS q", list(_FACTORS))}), sizes AS (SELECT name, count(DISTINCT symbol) AS n_symbols, count(DISTINCT ts) AS n_periods FROM panel GROUP BY name),
gate AS (SELECT name, ts, count(*) AS total, count(*) FILTER (factor IS NOT NULL AND isfinite(factor) AND factor <> 0) AS valid FROM panel GROUP BY name, ts HAVING total >= 10 AND valid >= 10 AND valid >= 0.3 * total),
v AS (SELECT p.*, g.total, g.valid FROM panel AS p JOIN gate AS g ON p.name = g.name AND p.ts = g.ts WHERE factor IS NOT NULL AND isfinite(factor) AND factor <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY name, ts ORDER BY factor) + (count(*) OVER (PARTITION BY name, ts, factor) - 1) / 2e0 AS rf, rank() OVER (PARTITION BY name, ts ORDER BY ret) + (count(*) OVER (PARTITION BY name, ts, ret) - 1) / 2e0 AS rr,
  greatest(0, CAST(ceil((row_number() OVER (PARTITION BY name, ts ORDER BY factor, symbol) - 1) * 5e0 / (valid - 1)) AS INT) - 1) AS grp FROM v),
dd AS (SELECT name, ts, max(total) AS total, max(valid) AS valid, CASE WHEN stddev_samp(rf) * stddev_samp(ret) > 1e-14 THEN covar_samp(rf, ret) / (stddev_samp(rf) * stddev_samp(ret)) END AS ic, CASE WHEN stddev_samp(rf) * stddev_samp(rr) > 1e-14 THEN covar_samp(rf, rr) / (stddev_samp(rf) * stddev_samp(rr)) END AS rank_ic FROM r GROUP BY name, ts),
gm AS (SELECT name, ts, grp, avg(ret) AS m, count(*) AS n FROM r GROUP BY name, ts, grp), dates AS (SELECT *, lag(ts) OVER (PARTITION BY name ORDER BY ts) AS before FROM dd),
pair AS (SELECT a.name, a.ts, a.symbol, a.grp, a.rf, c.grp AS was, c.rf AS rw FROM r AS a JOIN dates AS t ON a.name = t.name AND a.ts = t.ts LEFT JOIN r AS c ON c.name = a.name AND c.ts = t.before AND c.symbol = a.symbol),
tv AS (SELECT pair.name, pair.ts, count(*) FILTER (was IS NULL OR was <> grp) / CAST(count(*) AS DOUBLE) AS turnover FROM pair JOIN dates USING (name, ts) WHERE grp IN (0, 4) AND before IS NOT NULL GROUP BY pair.name, pair.ts),
fr AS (SELECT name, ts, rank() OVER (PARTITION BY name, ts ORDER BY rf) + (count(*) OVER (PARTITION BY name, ts, rf) - 1) / 2e0 AS a, rank() OVER (PARTITION BY name, ts ORDER BY rw) + (count(*) OVER (PARTITION BY name, ts, rw) - 1) / 2e0 AS c FROM pair WHERE rw IS NOT NULL),
fs AS (SELECT name, ts, CASE WHEN stddev_samp(a) * stddev_samp(c) > 1e-14 THEN covar_samp(a, c) / (stddev_samp(a) * stddev_samp(c)) END AS fsc FROM fr GROUP BY name, ts HAVING count(*) >= 5)"""
SQL["cs_evaluate"] = f"""WITH {_DAYS},
gr AS (SELECT *, rank() OVER (PARTITION BY name, ts ORDER BY m) + (count(*) OVER (PARTITION BY name, ts, m) - 1) / 2e0 AS rm, lag(m) OVER (PARTITION BY name, ts ORDER BY grp) AS under FROM gm),
gs AS (SELECT name, ts, max(m) FILTER (grp = 4) AS hi, max(m) FILTER (grp = 0) AS lo, CASE WHEN min(m) < max(m) THEN covar_pop(rm, grp) / nullif(stddev_pop(rm) * stddev_pop(grp), 0) END AS mono, count(*) FILTER (m > under) AS up, count(*) FILTER (m < under) AS down FROM gr GROUP BY name, ts),
x AS (SELECT d.*, hi - lo AS ls, hi, lo, mono, CASE WHEN hi > lo THEN up / 4e0 WHEN hi < lo THEN down / 4e0 END AS steps, turnover, fsc FROM dates AS d JOIN gs USING (name, ts) LEFT JOIN tv USING (name, ts) LEFT JOIN fs USING (name, ts)),
y AS (SELECT *, ls - cost AS net FROM (SELECT *, CASE WHEN avg(turnover) OVER (PARTITION BY name) > 0 THEN avg(turnover) OVER (PARTITION BY name) * 0.001 ELSE 0.002 END AS cost FROM x) AS q),
z AS (SELECT *, product(1 + ls) OVER w AS grown, product(1 + net) OVER w AS grown_net FROM y WINDOW w AS (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, grown / max(grown) OVER w - 1 AS fall, grown_net / max(grown_net) OVER w - 1 AS fall_net FROM z WINDOW w AS (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING)),
o AS (SELECT name, count(*) AS n_periods_returns, avg(ls) AS long_short_return, avg(hi) AS long_return, avg(lo) AS short_return, stddev_samp(ls) AS returns_std, avg((ls > 0)::INT) AS win_rate, avg((net > 0)::INT) AS win_rate_after_cost, avg(turnover) AS turnover, max(cost) AS cost_per_period,
  arg_max(grown, ts) AS grown, arg_max(grown_net, ts) AS grown_net, min(fall) AS max_drawdown, min(fall_net) AS max_drawdown_after_cost, avg(mono) AS monotonicity_mean, avg(abs(mono)) AS monotonicity_abs_mean, avg((mono > 0)::INT) AS monotonicity_positive_ratio, avg(steps) AS group_mono_ratio,
  avg((steps = 1)::INT) AS group_mono_perfect_ratio, avg(fsc) AS fsc, avg(valid / CAST(total AS DOUBLE)) AS avg_coverage FROM u GROUP BY name),
i AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY ts) - 1 AS i, greatest(1, least(4, count(*) OVER (PARTITION BY name) // 5)) AS parts FROM dates WHERE ic IS NOT NULL OR rank_ic IS NOT NULL),
s AS (SELECT *, CASE WHEN i < (n % parts) * (n // parts + 1) THEN i // (n // parts + 1) ELSE n % parts + (i - (n % parts) * (n // parts + 1)) // (n // parts) END AS part FROM i),
im AS (SELECT name, count(*) AS n_periods_ic, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std, count(*) FILTER (ic > 0) / CAST(count(ic) AS DOUBLE) AS ic_positive_ratio, avg(valid) AS avg_symbols FROM s GROUP BY name),
sm AS (SELECT name, part, avg(ic) AS a, avg(rank_ic) AS c FROM s GROUP BY name, part), sg AS (SELECT sm.name, count(*) AS ic_segments, count(*) FILTER (sign(a) = sign(ic_mean) AND ic_mean <> 0) AS ic_same_sign, count(*) FILTER (sign(c) = sign(rank_ic_mean) AND rank_ic_mean <> 0) AS rank_ic_same_sign FROM sm JOIN im USING (name) GROUP BY sm.name),
e AS (SELECT sizes.*, im.* EXCLUDE (name), sg.* EXCLUDE (name), o.* EXCLUDE (name), ic_mean / nullif(ic_std, 0) AS icir, rank_ic_mean / nullif(rank_ic_std, 0) AS rank_icir, ic_mean * sqrt(n_periods_ic) / nullif(ic_std, 0) AS ic_tstat, rank_ic_mean * sqrt(n_periods_ic) / nullif(rank_ic_std, 0) AS rank_ic_tstat,
  long_short_return / nullif(returns_std, 0) AS sharpe_ratio, (long_short_return - cost_per_period) / nullif(returns_std, 0) AS sharpe_ratio_after_cost, long_short_return - cost_per_period AS long_short_return_after_cost, long_short_return / nullif(returns_std, 0) * sqrt(365) AS annualized_sharpe,
  (long_short_return - cost_per_period) / nullif(returns_std, 0) * sqrt(365) AS annualized_sharpe_after_cost, 1 - coalesce(n_periods_ic, 0) / CAST(n_periods AS DOUBLE) AS ic_skip_rate, 1 - coalesce(n_periods_returns, 0) / CAST(n_periods AS DOUBLE) AS returns_skip_rate
  FROM sizes LEFT JOIN im USING (name) LEFT JOIN sg USING (name) LEFT JOIN o USING (name))
SELECT name, round(sign(grown) * log10(abs(grown)), 6) AS log10_total_return, round(sign(grown_net) * log10(abs(grown_net)), 6) AS log10_total_return_after_cost, {", ".join(c if not d else f"round({c}, {d}) AS {c}" for c, d in _MEASURES.items())} FROM e"""

# ---- walk-forward ------------------------------------------------------------------------------
_WALKED = ["m1", "m2", "span"]
_SUMMARY = {
    "splits": 0, "n_periods": 0, "n_ic_periods": 0, "ic_mean": 7, "ic_std": 7, "icir": 6, "ic_tstat": 5, "ls_mean": 6, "sharpe": 5, "sharpe_after_cost": 5, "max_drawdown": 5, "max_drawdown_after_cost": 5, "turnover_mean": 7,
}


def _walked(spark, sf_dir):
    panel = prepare_panel(user_bars(spark, sf_dir), {n: _FACTORS[n] for n in _WALKED})
    return out_of_sample(panel, _WALKED, train=10, oos=5, step=5)


def _walk_forward(spark, sf_dir):
    found = method_summary(_walked(spark, sf_dir)[0])
    grown = [F.round(F.signum(1 + F.col(c)) * F.log10(F.abs(1 + F.col(c))), 6).alias(f"log10_{c}") for c in ("ls_total", "ls_total_after_cost")]
    return found.select("method", *grown, *[F.col(c) if not d else F.round(c, d).alias(c) for c, d in _SUMMARY.items()])


def _walk_forward_dates(spark, sf_dir):
    dates = _walked(spark, sf_dir)[0]
    return dates.select("method", F.col("ts").cast("string").alias("ts"), "split", *[F.round(c, 7).alias(c) for c in ("ic", "ls", "turnover", "net")])


def _walk_forward_weights(spark, sf_dir):
    weights = _walked(spark, sf_dir)[1]
    return weights.select("split", "method", *[F.round(F.col("weights")[i], 6).alias(n) for i, n in enumerate(_WALKED)])


def _walk_forward_tests(spark, sf_dir):
    found = paired_tests(_walked(spark, sf_dir)[0])
    return found.select("method_a", "method_b", "n", F.round("mean_diff", 7).alias("mean_diff"), F.round("std_diff", 7).alias("std_diff"), F.round("t_stat", 5).alias("t_stat"))


QUERIES |= {"walk_forward": _walk_forward, "walk_forward_dates": _walk_forward_dates, "walk_forward_weights": _walk_forward_weights, "walk_forward_tests": _walk_forward_tests}
_L1 = "(abs({0}1) + abs({0}2) + abs({0}3))"
_SHARES = {
    "equal_weight": ["1e0 / 3"] * 3,
    "ic_weight": [f"CASE WHEN o.n >= 5 AND {_L1.format('u')} > 0 THEN u{i} / {_L1.format('u')} ELSE 1e0 / 3 END" for i in (1, 2, 3)],
    "max_icir_weight": [f"CASE WHEN o.n >= 5 AND {_L1.format('w')} > 0 THEN w{i} / {_L1.format('w')} ELSE 1e0 / 3 END" for i in (1, 2, 3)],
}
_WALK = f"""b AS ({DUCK_PANEL}), f0 AS (SELECT symbol, ts, {_CELLS}, lead(close) OVER {_W} / nullif(close, 0) - 1 AS ret FROM b), d0 AS (SELECT symbol, ts, ret, lag(m1) OVER {_W} AS m1, lag(m2) OVER {_W} AS m2, lag(span) OVER {_W} AS span FROM f0),
panel AS ({_long("(SELECT * FROM d0 WHERE ret IS NOT NULL) AS q", _WALKED)}),
r AS (SELECT *, CASE WHEN factor IS NOT NULL THEN rank() OVER (PARTITION BY name, ts ORDER BY factor NULLS LAST) + (count(*) OVER (PARTITION BY name, ts, factor) - 1) / 2e0 END AS rf, rank() OVER (PARTITION BY name, ts ORDER BY ret) + (count(*) OVER (PARTITION BY name, ts, ret) - 1) / 2e0 AS rr FROM panel),
icd AS (SELECT ts, name, covar_samp(rf, rr) / nullif(stddev_samp(rf) * stddev_samp(CASE WHEN rf IS NOT NULL THEN rr END), 0) AS ic FROM r GROUP BY ts, name), iw AS (SELECT ts, {", ".join(f"max(ic) FILTER (name = '{n}') AS x{i + 1}" for i, n in enumerate(_WALKED))} FROM icd GROUP BY ts),
ends AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM r), sp AS (SELECT s AS split, t0 + to_days(CAST(5 * s AS INT)) AS a, t0 + to_days(CAST(5 * s + 10 AS INT)) AS m, t0 + to_days(CAST(5 * s + 15 AS INT)) AS z FROM ends, (SELECT unnest(generate_series(0, 1000)) AS s) AS g WHERE t0 + to_days(CAST(5 * s + 15 AS INT)) <= t1 + INTERVAL 23 HOUR),
tm AS (SELECT split, count(*) FILTER (x1 IS NOT NULL OR x2 IS NOT NULL OR x3 IS NOT NULL) AS n, {", ".join(f"coalesce(avg(x{i}), 0) AS u{i}, sum(coalesce(x{i}, 0)) / count(*) FILTER (x1 IS NOT NULL OR x2 IS NOT NULL OR x3 IS NOT NULL) AS z{i}" for i in (1, 2, 3))} FROM sp JOIN iw ON ts >= a AND ts < m GROUP BY split),
c AS (SELECT tm.split, n, u1, u2, u3, {moments_three([f"(coalesce(x{i}, 0) - z{i})" for i in (1, 2, 3)])} FROM tm JOIN sp USING (split) JOIN iw ON ts >= a AND ts < m AND (x1 IS NOT NULL OR x2 IS NOT NULL OR x3 IS NOT NULL) GROUP BY ALL), {solved_three("split")},
wt AS ({" UNION ALL ".join(f"SELECT o.split, '{method}' AS method, {', '.join(f'{x} AS v{i + 1}' for i, x in enumerate(cells))} FROM o JOIN tm USING (split)" for method, cells in _SHARES.items())}),
rw AS (SELECT ts, symbol, max(ret) AS ret, max(rr) AS rr, {", ".join(f"max(rf) FILTER (name = '{n}') AS r{i + 1}" for i, n in enumerate(_WALKED))} FROM r GROUP BY ts, symbol),
cs AS (SELECT wt.split, method, rw.ts, symbol, ret, rr, round({" + ".join(f"coalesce(r{i} * v{i}, 0)" for i in (1, 2, 3))}, 9) AS comp FROM sp JOIN wt USING (split) JOIN rw ON rw.ts >= m AND rw.ts < z WHERE {" OR ".join(f"(r{i} IS NOT NULL AND v{i} <> 0)" for i in (1, 2, 3))}),
pl AS (SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY split, method, ts ORDER BY comp DESC, symbol) AS i FROM cs WINDOW k AS (PARTITION BY split, method, ts)), ps AS (SELECT *, greatest(1, n // 5) AS held, CASE WHEN n >= 10 AND i <= greatest(1, n // 5) THEN 1 WHEN n >= 10 AND i > n - greatest(1, n // 5) THEN -1 END AS side FROM pl),
dd AS (SELECT split, method, ts, CASE WHEN stddev_samp(comp) * stddev_samp(rr) > 1e-14 THEN covar_samp(comp, rr) / (stddev_samp(comp) * stddev_samp(rr)) END AS ic, avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) AS ls FROM ps GROUP BY split, method, ts),
nb AS (SELECT split, method, ts, lag(ts) OVER (PARTITION BY split, method ORDER BY ts) AS before FROM dd WHERE ls IS NOT NULL), cur AS (SELECT nb.*, symbol, side / CAST(held AS DOUBLE) AS w FROM nb JOIN ps USING (split, method, ts) WHERE side IS NOT NULL),
al AS (SELECT split, method, ts, symbol FROM cur WHERE before IS NOT NULL UNION SELECT nb.split, nb.method, nb.ts, p.symbol FROM nb JOIN cur AS p ON p.split = nb.split AND p.method = nb.method AND p.ts = nb.before),
tv AS (SELECT al.split, al.method, al.ts, sum(abs(coalesce(x.w, 0) - coalesce(y.w, 0))) / 2 AS turnover FROM al JOIN nb ON nb.split = al.split AND nb.method = al.method AND nb.ts = al.ts LEFT JOIN cur AS x ON x.split = al.split AND x.method = al.method AND x.ts = al.ts AND x.symbol = al.symbol
  LEFT JOIN cur AS y ON y.split = al.split AND y.method = al.method AND y.ts = nb.before AND y.symbol = al.symbol GROUP BY al.split, al.method, al.ts),
oo AS (SELECT dd.*, turnover, ls - coalesce(turnover, 0) * 0.001 AS net FROM dd LEFT JOIN tv USING (split, method, ts) QUALIFY row_number() OVER (PARTITION BY method, ts ORDER BY split DESC) = 1)"""
SQL["walk_forward_dates"] = f"WITH {_WALK} SELECT method, CAST(ts AS VARCHAR) AS ts, CAST(split AS INT) AS split, round(ic, 7) AS ic, round(ls, 7) AS ls, round(turnover, 7) AS turnover, round(net, 7) AS net FROM oo"
SQL["walk_forward_weights"] = f"WITH {_WALK} SELECT CAST(split AS INT) AS split, method, {', '.join(f'round(v{i + 1}, 6) AS {n}' for i, n in enumerate(_WALKED))} FROM wt"
_RUN = "(PARTITION BY method ORDER BY ts ROWS UNBOUNDED PRECEDING)"
SQL["walk_forward"] = f"""WITH {_WALK}, gr AS (SELECT *, product(1 + coalesce(ls, 0)) OVER {_RUN} AS gl, product(1 + coalesce(net, 0)) OVER {_RUN} AS gn FROM oo), fl AS (SELECT *, gl / max(gl) OVER {_RUN} - 1 AS fl, gn / max(gn) OVER {_RUN} - 1 AS fn FROM gr WHERE ls IS NOT NULL),
a AS (SELECT method, count(ls) AS n_periods, avg(ls) AS ls_mean, arg_max(gl, ts) AS gl, arg_max(gn, ts) AS gn, avg(ls) / nullif(stddev_samp(ls), 0) * sqrt(252) AS sharpe, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS sharpe_after_cost, min(fl) AS max_drawdown, min(fn) AS max_drawdown_after_cost, avg(turnover) AS turnover_mean FROM fl GROUP BY method),
e2 AS (SELECT oo.method, count(DISTINCT split) AS splits, count(ic) AS n_ic_periods, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0) AS ic_tstat FROM oo GROUP BY oo.method)
SELECT e2.method, round(sign(gl) * log10(abs(gl)), 6) AS log10_ls_total, round(sign(gn) * log10(abs(gn)), 6) AS log10_ls_total_after_cost, {", ".join(f"coalesce({c}, 0) AS {c}" if c == "n_periods" else c if not d else f"round({c}, {d}) AS {c}" for c, d in _SUMMARY.items())} FROM e2 LEFT JOIN a USING (method)"""
SQL["walk_forward_tests"] = f"""WITH {_WALK}, pr AS (SELECT x.method AS method_a, y.method AS method_b, count(*) AS n, avg(x.net - y.net) AS m, stddev_samp(x.net - y.net) AS s FROM oo AS x JOIN oo AS y ON x.ts = y.ts AND x.net IS NOT NULL AND y.net IS NOT NULL
  JOIN (VALUES {", ".join(f"('{a}', '{c}')" for i, a in enumerate(METHODS) for c in METHODS[i + 1 :])}) AS p(a, b) ON x.method = p.a AND y.method = p.b GROUP BY x.method, y.method)
SELECT method_a, method_b, n, CASE WHEN n >= 10 THEN round(m, 7) END AS mean_diff, CASE WHEN n >= 10 THEN round(s, 7) END AS std_diff, CASE WHEN n >= 10 AND s > 0 THEN round(m / s * sqrt(n), 5) END AS t_stat FROM pr"""
