"""Signals and backtests over scored(symbol, ts, name, value, ret), labels and losses over panel(symbol, ts, factor, ret)."""

from __future__ import annotations

from .analysis import kurtosis, skewness
from .sqlop import SqlOp


def shown(x: str, digits: int) -> str:
    """Rounded to decimals, then to nine significant digits, as far as two engines agree on products of many returns."""
    return f"@SIG(round({x} * 1.0000000001, {digits}) * 1.0000000001)"


#: scored(symbol, ts, name, value, ret): rows without value or return are left out, then the outer fifths of each factor's whole history are held for one bar.
#: The held position is the signal of the bar before; a change of position costs $cost, a held one $slip. The first bar has no return.
_SIGNALS = """WITH d AS (SELECT symbol, ts, name, value, ret FROM #scored WHERE value IS NOT NULL AND ret IS NOT NULL), e AS (SELECT symbol AS es, name AS en, @PCT(value, 0.2) AS lo, @PCT(value, 0.8) AS hi FROM d GROUP BY symbol, name HAVING count(*) > 5),
g AS (SELECT d.*, @EXPLODE('long_short', 'long_only', 'short_only') AS strategy, CASE WHEN value <= lo THEN -1 WHEN value > hi THEN 1 ELSE 0 END AS side FROM d JOIN e ON d.symbol = e.es AND d.name = e.en),
s AS (SELECT symbol, name, strategy, ts, ret, CASE WHEN strategy = 'long_only' THEN greatest(side, 0) WHEN strategy = 'short_only' THEN least(side, 0) ELSE side END AS signal FROM g),
x AS (SELECT *, lag(signal) OVER (PARTITION BY symbol, name, strategy ORDER BY ts) AS held FROM s), r AS (SELECT symbol, name, strategy, ts, signal, held * ret - abs(signal - held) * $cost - abs(held) * $slip AS net FROM x WHERE held IS NOT NULL),
c AS (SELECT *, CASE WHEN count(CASE WHEN 1 + net = 0 THEN 1 END) OVER w > 0 THEN 0e0 ELSE (1 - 2 * (count(CASE WHEN 1 + net < 0 THEN 1 END) OVER w % 2)) * exp(sum(CASE WHEN 1 + net <> 0 THEN ln(abs(1 + net)) END) OVER w) END AS cumulative
  FROM r WINDOW w AS (PARTITION BY symbol, name, strategy ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, max(cumulative) OVER (PARTITION BY symbol, name, strategy ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM c),
v AS (SELECT *, (cumulative - peak) / nullif(peak, 0) AS drawdown FROM p)
"""
#: Each bar's signal, net return, running product of 1 + net, its sign and the logarithm of its size to the base 10, and drawdown from its maximum, for three strategies. A return of
#: -100 % makes the product 0 from there on; it has no logarithm then.
BACKTEST = SqlOp(
    _SIGNALS
    + "SELECT symbol, name, strategy, CAST(ts AS $string) AS ts, signal, "
    + f"{shown('net', 5)} AS net, {shown('cumulative', 4)} AS cumulative, CAST(sign(cumulative) AS INT) AS wealth_sign, round(CASE WHEN cumulative <> 0 THEN log10(abs(cumulative)) END, 5) AS log10_wealth, {shown('drawdown', 4)} AS drawdown FROM v",
    cost="0.001",
    slip="0.0005",
    string="STRING",
)

#: Performance of each symbol, factor and strategy; 252 bars a year. Measures without a denominator are 0, the profit ratio without losses is missing.
PERFORMANCE = SqlOp(
    _SIGNALS
    + """, l AS (SELECT symbol, name, strategy, @MAXBY(cumulative, ts) - 1 AS total, count(*) AS n, avg(net) AS mean, stddev_samp(net) AS std, stddev_samp(CASE WHEN net < 0 THEN net END) AS down, min(drawdown) AS worst,
  avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, abs(avg(CASE WHEN net > 0 THEN net END) / nullif(avg(CASE WHEN net < 0 THEN net END), 0)) AS profit_loss, """
    + "{skew} AS skewness, {kurt} AS kurtosis".format(skew="$skew", kurt="$kurt")
    + """ FROM v GROUP BY symbol, name, strategy), a AS (SELECT *, CASE WHEN 1 + total >= 0 THEN pow(1 + total, CAST(252 AS DOUBLE) / n) - 1 END AS annual FROM l)
SELECT symbol, name, strategy, n, """
    + ", ".join(
        f"{shown(x, digits)} AS {name}"
        for name, x, digits in (
            ("total", "total", 4), ("annual", "annual", 4), ("volatility", "(std * sqrt(252))", 4), ("sharpe", "(CASE WHEN std > 0 THEN (annual - $free) / (std * sqrt(252)) ELSE 0 END)", 4),
            ("sharpe_annual", "(CASE WHEN std > 0 THEN mean / std * sqrt(252) ELSE 0 END)", 4), ("sortino", "(CASE WHEN down > 0 THEN (annual - $free) / (down * sqrt(252)) ELSE 0 END)", 4),
            ("calmar", "(CASE WHEN worst <> 0 THEN annual / abs(worst) ELSE 0 END)", 4), ("max_drawdown", "worst", 4), ("win_rate", "win_rate", 5), ("profit_loss", "profit_loss", 4), ("mean", "mean", 5),
            ("skewness", "skewness", 3), ("kurtosis", "kurtosis", 3),
        )
    )
    + """ FROM a""",
    cost="0.001",
    slip="0.0005",
    free="0.02",
    skew=skewness("net"),
    kurt=kurtosis("net"),
)

#: Labels of the next bar and the split by position: 80 % train, 10 % validation, the rest test.
LABELS = SqlOp(
    """WITH l AS (SELECT symbol, ts, close, lead(close, $k) OVER (PARTITION BY symbol ORDER BY ts) AS later, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM #bars),
g AS (SELECT *, CASE WHEN close > 0 AND later > 0 THEN ln(later / close) END AS g FROM l)
SELECT symbol, CAST(ts AS $string) AS ts, round(g, 6) AS log_return, CASE WHEN g > 0 THEN 1 WHEN g IS NOT NULL THEN 0 END AS direction, round(sign(g) * sqrt(abs(g)), 6) AS scaled,
  CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS part FROM g""",
    k=1,
    string="STRING",
)

#: Losses of the factor as a prediction of the return.
LOSSES = SqlOp(
    """SELECT symbol, round(avg(pow(ret - factor, 2)), 6) AS mse, round(avg(pow(ret - factor, 2)) + 2.0 * avg(CASE WHEN ret * factor < 0 THEN pow(ret - factor, 2) ELSE 0 END), 6) AS direction_loss,
  round(avg(pow(ret - factor, 2)) + avg(1 - tanh(5.0 * ret * factor)), 6) AS composite_loss, round(avg(pow(ret - factor, 2)) + 2.0 * avg(abs(ret) * CASE WHEN ret * factor < 0 THEN 1e0 ELSE 0e0 END), 6) AS magnitude_loss,
  round(avg(pow(ret - factor, 2)) + avg(greatest(0e0, -ret * factor)), 6) AS hinge_loss FROM #panel GROUP BY symbol""",
)
