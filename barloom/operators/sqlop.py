"""Operators as parameterised SQL over named input frames.

The text uses the functions that Spark and DuckDB share; the few that differ are written as placeholders. ``__call__`` runs it on DataFrames, so inputs can
be any plan; ``duck`` gives the statement with the inputs' own SQL in front, for comparison runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Fixed spellings of the two dialects. NEAR leaves 12 significant digits in Spark, so that sums which differ only by the order of their terms are equal; the SQL keeps the raw number.
SPARK = {"NEAR": "try_cast(format_string('%.11e', CAST({0} AS DOUBLE)) AS DOUBLE)", "SIG": "try_cast(format_string('%.8e', CAST({0} AS DOUBLE)) AS DOUBLE)", "PCT": "percentile", "MAXBY": "max_by", "MINBY": "min_by", "LAST": "last_value", "SECS": "timestampdiff(SECOND, {0}, {1})", "IGN": "last({0}, true)", "ADD": "{0} + make_dt_interval(0, 0, 0, {1})", "FLOORSECS": "unix_seconds(CAST({0} AS TIMESTAMP))", "EXPLODE": "explode(array({*}))", "FIRST": "first({0}, true)", "SEQ": "explode(sequence({0}, {1}))", "ROUNDSECS": "CAST(bround(unix_micros(CAST({0} AS TIMESTAMP)) / 1e6, 0) AS BIGINT)"}
DUCK = {"NEAR": "{0}", "SIG": "CAST(printf('%.8e', CAST({0} AS DOUBLE)) AS DOUBLE)", "PCT": "quantile_cont", "MAXBY": "arg_max", "MINBY": "arg_min", "LAST": "last_value", "SECS": "date_diff('second', {0}, {1})", "IGN": "last_value({0} IGNORE NULLS)", "ADD": "{0} + to_seconds({1})", "FLOORSECS": "CAST(epoch({0}) AS BIGINT)", "EXPLODE": "unnest([{*}])", "FIRST": "first_value({0} IGNORE NULLS)", "SEQ": "unnest(generate_series({0}, {1}))", "ROUNDSECS": "CAST(round_even(epoch_us({0}) / 1e6, 0) AS BIGINT)"}


class SqlOp:
    def __init__(self, text: str, **defaults):
        self.text, self.defaults = text, defaults

    def _filled(self, dialect: dict[str, str], params: dict) -> str:
        out = self.text
        for key, value in {**self.defaults, **params}.items():
            out = out.replace(f"${key}", str(value))
        for name, form in dialect.items():
            while (at := out.find(f"@{name}(")) >= 0:
                depth, i, args, start = 0, at + len(name) + 1, [], at + len(name) + 2
                for j in range(i, len(out)):
                    depth += {"(": 1, ")": -1}.get(out[j], 0)
                    if depth == 1 and out[j] == "," or depth == 0:
                        args.append(out[start:j].strip())
                        start = j + 1
                    if depth == 0:
                        break
                new = form.replace("{*}", ", ".join(args)) if "{*}" in form else form.format(*args) if "{0}" in form else f"{form}({', '.join(args)})"
                out = out[:at] + new + out[j + 1 :]
        return out

    def __call__(self, params: dict | None = None, **frames: DataFrame) -> DataFrame:
        spark = next(iter(frames.values())).sparkSession
        text = self._filled(SPARK, params or {})
        for name in frames:
            text = text.replace(f"#{name}", "{" + name + "}")
        return spark.sql(text, **frames)

    def duck(self, params: dict | None = None, **inputs: str) -> str:
        text = self._filled(DUCK, params or {})
        for name in inputs:
            text = text.replace(f"#{name}", name)
        head = ", ".join(f"{name} AS ({sql})" for name, sql in inputs.items())
        return f"WITH {head}, {text[5:]}" if text.lstrip().upper().startswith("WITH ") else f"WITH {head} {text}"
