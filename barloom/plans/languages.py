"""Two expression languages over bars, compiled to one kind of factor expression: infix text and postfix tokens.

Infix: ``ts_mean(w=20)(close) - delay(d=1)(returns)``, ``gate(a, b, c)``; windows take what there is (at least one value) and every
node turns null and infinity to 0. Postfix: feature and opcode names in order; windows are padded with zeros at the start.
``cs_`` operators run over a symbol's history (scope="series") or over a date (scope="date").
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from barloom.functions.expr import (
    Expr, absolute, col, corr, cov, fn, high_of, kurt, lag, larger, lift, ln, low_of, mean, or_zero, pct, rank_of_last, roll, sign, skew, smaller, total, when, win,
)

O, H, L, C, V = (col(x) for x in ("open", "high", "low", "close", "volume"))
TINY = 1e-8


def clean(x: Expr) -> Expr:
    return fn("coalesce(CASE WHEN abs({0}) < 1e300 THEN {0} END, 0e0)", x)


def _std(x, w):
    return roll("stddev_samp({0})", x, w, 2)


_RET = pct(C)
#: Fixed names of the infix language's features.
FEATURES: dict[str, Expr] = {
    name: clean(e)
    for name, e in {
        "returns": _RET, "log_ret": ln(C / (lag(C) + TINY)), "volatility": _std(_RET, 20), "volume_ratio": V / (mean(V, 20, 1) + TINY),
        "price_position": (C - low_of(L, 20, 1)) / (high_of(H, 20, 1) - low_of(L, 20, 1) + TINY), "momentum": C / (lag(C, 10) + TINY) - 1.0, "high_low_range": (H - L) / (C + TINY),
        "close_open_diff": (C - O) / (O + TINY), "volume_price_corr": corr(_RET, pct(V), 20, 2), "ma_deviation": (C - mean(C, 20, 1)) / (_std(C, 20) + TINY), "basis": col("basis") + 0.0,
        "oi_change": pct(col("open_interest"), 12), "lsr_spread": col("lsr_global_account") - col("lsr_top_account"), "taker_imbalance": col("taker_buy_base") / V - 0.5, "funding_rate": col("funding_rate") + 0.0,
    }.items()
}


def series_rank(x: Expr) -> Expr:
    """Average-tie percent rank over the symbol's history."""
    first, ties, n = win("rank()", x, frame="PARTITION BY symbol ORDER BY {0}"), win("count(*)", x, frame="PARTITION BY symbol, {0}"), win("count({0})", x, frame="PARTITION BY symbol")
    return fn("({0} + ({1} - 1) / 2e0) / {2}", first, ties, n)


def over(scope: str) -> str:
    return "PARTITION BY ts" if scope == "date" else "PARTITION BY symbol"


def z_of(x: Expr, scope: str, tiny: float) -> Expr:
    return (x - win("avg({0})", x, frame=over(scope))) / (win("stddev_samp({0})", x, frame=over(scope)) + tiny)


def mad_of(x: Expr, scope: str, tiny: float) -> Expr:
    middle = win("percentile({0}, 0.5)", x, frame=over(scope), duck="quantile_cont({0}, 0.5)")
    spread = win("percentile({0}, 0.5)", absolute(x - middle), frame=over(scope), duck="quantile_cont({0}, 0.5)")
    return larger(smaller((x - middle) / (spread + tiny), 5.0), -5.0)


def date_rank(x: Expr) -> Expr:
    """Place on its date from 0 to 1, ties by symbol."""
    return (win("row_number()", x, frame="PARTITION BY ts ORDER BY {0}, symbol") - 1.0) / (win("count(*)", x, frame="PARTITION BY ts") - 1.0)


def _decay(x: Expr, w: int) -> Expr:
    whole = sum(0.9**k for k in range(w))
    return sum((or_zero(lag(x, k)) * (0.9**k / whole) for k in range(1, w)), x * (1.0 / whole))


def _propagate(op: Callable, x: Expr, y: Expr) -> Expr:
    return fn("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN {2} END", x, y, op(x, y))


#: name -> (arguments, default window, builder(arguments, window, scope))
INFIX: dict[str, tuple[int, int, Callable]] = {
    "max": (2, 0, lambda a, w, s: _propagate(larger, *a)), "min": (2, 0, lambda a, w, s: _propagate(smaller, *a)), "abs": (1, 0, lambda a, w, s: absolute(a[0])), "neg": (1, 0, lambda a, w, s: -a[0]),
    "sqrt": (1, 0, lambda a, w, s: fn("sqrt(abs({0}))", a[0])), "log": (1, 0, lambda a, w, s: ln(absolute(a[0]) + TINY)), "sign": (1, 0, lambda a, w, s: sign(a[0])), "gate": (3, 0, lambda a, w, s: when(a[0] > 0.0, a[1], a[2])),
    "delay": (1, 1, lambda a, w, s: lag(a[0], w)), "ts_mean": (1, 20, lambda a, w, s: mean(a[0], w, 1)), "ts_std": (1, 20, lambda a, w, s: _std(a[0], w)), "ts_max": (1, 20, lambda a, w, s: high_of(a[0], w, 1)),
    "ts_min": (1, 20, lambda a, w, s: low_of(a[0], w, 1)), "ts_rank": (1, 20, lambda a, w, s: rank_of_last(a[0], w, 1)), "ts_zscore": (1, 20, lambda a, w, s: (a[0] - mean(a[0], w, 1)) / (_std(a[0], w) + TINY)),
    "ts_decay": (1, 5, lambda a, w, s: _decay(a[0], w)), "ts_momentum": (1, 10, lambda a, w, s: a[0] / lag(a[0], w) - 1.0), "ts_skewness": (1, 20, lambda a, w, s: skew(a[0], w, max(3, w // 2))),
    "ts_kurtosis": (1, 20, lambda a, w, s: kurt(a[0], w, max(4, w // 2))), "ts_corr": (2, 20, lambda a, w, s: corr(*a, w, 2)), "ts_cov": (2, 20, lambda a, w, s: cov(*a, w, 2)),
    "cs_rank": (1, 0, lambda a, w, s: date_rank(a[0]) if s == "date" else series_rank(a[0])), "cs_zscore": (1, 0, lambda a, w, s: z_of(a[0], s, TINY)), "cs_mad_norm": (1, 0, lambda a, w, s: mad_of(a[0], s, TINY)),
}
_BINARY = {ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: lambda x, y: x / (y + TINY)}


def infix(text: str, scope: str = "series") -> Expr:
    """Compile infix text. Only names, numbers, + - * / and the calls above are accepted."""

    def build(node: ast.AST) -> Expr:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return lift(node.value)
        if isinstance(node, ast.Name) and node.id in FEATURES:
            return FEATURES[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return clean(-build(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return clean(_BINARY[type(node.op)](build(node.left), build(node.right)))
        if isinstance(node, ast.Call):
            call, options = node, {}
            if isinstance(node.func, ast.Call):
                options = {k.arg: ast.literal_eval(k.value) for k in node.func.keywords}
                call = node.func
            if isinstance(call.func, ast.Name) and call.func.id in INFIX:
                n, window, make = INFIX[call.func.id]
                args = [build(a) for a in node.args]
                if len(args) != n:
                    raise ValueError(f"{call.func.id} takes {n} arguments")
                return clean(make(args, int(options.get("w", options.get("d", window))), scope))
        raise ValueError(f"not part of the language: {ast.dump(node)[:80]}")

    return build(ast.parse(text, mode="eval"))


# ---- postfix ------------------------------------------------------------------------


def pad(x: Expr, k: int) -> Expr:
    return or_zero(lag(x, k))


def _padded_std(x: Expr, w: int) -> Expr:
    """Sample deviation over w values, missing ones at the start being 0."""
    s, ss = total(x, w, 1), total(x * x, w, 1)
    return fn("sqrt(greatest({0} - {1} * {1} / %d, 0e0) / %d)" % (w, w - 1), ss, s)


def _rank5(x: Expr) -> Expr:
    return sum((when(pad(x, k) <= x, 0.2, 0.0) for k in range(1, 5)), lift(0.2))


def _jump(x: Expr) -> Expr:
    z = (x - win("avg({0})", x, frame="PARTITION BY symbol")) / (win("stddev_samp({0})", x, frame="PARTITION BY symbol") + 1e-6)
    return larger(z - 3.0, 0.0)


#: Fixed opcode names, in their order: name -> (arguments, builder).
POSTFIX: dict[str, tuple[int, Callable]] = {
    "ADD": (2, lambda x, y: x + y), "SUB": (2, lambda x, y: x - y), "MUL": (2, lambda x, y: x * y), "DIV": (2, lambda x, y: x / (y + 1e-6)), "MAX": (2, larger), "MIN": (2, smaller), "NEG": (1, lambda x: -x), "ABS": (1, absolute),
    "SIGN": (1, sign), "SQRT": (1, lambda x: fn("sqrt(abs({0}) + 1e-8)", x)), "LOG": (1, lambda x: ln(absolute(x) + 1e-8)), "GATE": (3, lambda c, x, y: when(c > 0.0, x, y)), "JUMP": (1, _jump),
    "DECAY": (1, lambda x: x + pad(x, 1) * 0.8 + pad(x, 2) * 0.6), "DELAY1": (1, lambda x: pad(x, 1)), "DELAY3": (1, lambda x: pad(x, 3)), "MA5": (1, lambda x: total(x, 5, 1) / 5.0), "MA10": (1, lambda x: total(x, 10, 1) / 10.0),
    "MA20": (1, lambda x: total(x, 20, 1) / 20.0), "STD5": (1, lambda x: _padded_std(x, 5)), "STD10": (1, lambda x: _padded_std(x, 10)), "RANK5": (1, _rank5), "MOM5": (1, lambda x: x / (pad(x, 5) + 1e-6) - 1.0),
    "MOM10": (1, lambda x: x / (pad(x, 10) + 1e-6) - 1.0), "CS_RANK": (1, date_rank), "CS_ZSCORE": (1, lambda x: z_of(x, "date", 1e-6)), "CS_MAD": (1, lambda x: mad_of(x, "date", 1e-6)),
}


def robust(x: Expr) -> Expr:
    """Median and MAD over the history, clipped to +-5."""
    return or_zero(mad_of(clean(x), "series", 1e-6))


#: Fixed names of the postfix language's features.
POSTFIX_FEATURES: dict[str, Expr] = {
    "RET": robust(_RET), "LOG_VOL": robust(ln(V + 1.0)), "VOL_CHG": robust(pct(V)), "PV": robust(_RET * pct(V)), "TREND": robust(C / mean(C, 20, 1) - 1.0), "HL_RANGE": robust((H - L) / C), "CLOSE_POS": clean((C - L) / (H - L + 1e-6)),
    "MA_DEV": robust((C - mean(C, 10, 1)) / (mean(C, 10, 1) + 1e-6)), "VOLATILITY": robust(_std(_RET, 10)), "MOMENTUM": robust(pct(C, 10)), "BASIS": robust(col("basis") + 0.0), "OI_CHG": robust(pct(col("open_interest"), 12)),
    "LSR_SPREAD": robust(col("lsr_global_account") - col("lsr_top_account")), "TAKER_IMB": robust(col("taker_buy_base") / V - 0.5), "FUNDING": robust(col("funding_rate") + 0.0),
}


def postfix(tokens: list[str] | str) -> Expr | None:
    """Compile postfix tokens; None unless they leave exactly one value."""
    stack: list[Expr] = []
    for token in tokens.split() if isinstance(tokens, str) else tokens:
        if token in POSTFIX_FEATURES:
            stack.append(POSTFIX_FEATURES[token])
            continue
        if token not in POSTFIX:
            raise ValueError(f"unknown token {token}")
        n, make = POSTFIX[token]
        if len(stack) < n:
            return None
        args, stack = stack[-n:], stack[:-n]
        stack.append(clean(make(*args)))
    return stack[0] if len(stack) == 1 else None


#: Expressions that between them use every operator of both languages.
INFIX_SAMPLES = {
    "arithmetic": "abs(returns - log_ret) * neg(sign(momentum)) + sqrt(volatility) / log(volume_ratio)", "choice": "gate(momentum, max(returns, basis), min(funding_rate, lsr_spread))",
    "windows": "ts_mean(w=10)(close_open_diff) - ts_std(w=10)(high_low_range) + ts_max(w=5)(returns) * ts_min(w=5)(returns)", "ranks": "ts_rank(w=10)(volume_ratio) + ts_zscore(w=10)(price_position) + delay(d=2)(oi_change)",
    "shapes": "ts_decay(w=5)(returns) + ts_momentum(w=5)(volume_ratio) + ts_skewness(w=20)(taker_imbalance)", "pairs": "ts_corr(w=15)(ma_deviation, volume_ratio) + ts_cov(w=15)(returns, volume_price_corr)",
    "cross": "cs_rank(momentum) + cs_zscore(volatility) + cs_mad_norm(returns)",
}
POSTFIX_SAMPLES = {
    "basic": "RET LOG_VOL ADD VOL_CHG SUB PV MUL TREND DIV", "unary": "HL_RANGE NEG ABS SQRT MA_DEV LOG MAX CLOSE_POS SIGN MIN", "gate": "VOLATILITY MOMENTUM BASIS GATE OI_CHG DECAY ADD", "means": "RET MA5 RET MA10 SUB LSR_SPREAD MA20 ADD TAKER_IMB DELAY1 SUB",
    "spread": "RET STD5 RET STD10 ADD FUNDING RANK5 ADD", "moves": "CLOSE_POS MOM5 CLOSE_POS DELAY3 MUL RET JUMP ADD", "cross": "MOMENTUM CS_RANK TREND CS_ZSCORE ADD RET CS_MAD ADD",
}
