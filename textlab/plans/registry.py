"""Registry of named queries: a Spark callable and, when SQL can express it, the
DuckDB twin used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _close_paren(sql: str, open_at: int) -> tuple[int, list[int]]:
    """Index of the parenthesis closing ``sql[open_at]`` and the positions of
    top-level commas inside; string literals ('...' with '' escapes) are skipped."""
    depth, i, commas, quote, n = 0, open_at, [], False, len(sql)
    while i < n:
        ch = sql[i]
        if quote:
            if ch == "'":
                if i + 1 < n and sql[i + 1] == "'":
                    i += 2
                    continue
                quote = False
        elif ch == "'":
            quote = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i, commas
        elif ch == "," and depth == 1:
            commas.append(i)
        i += 1
    raise ValueError("unbalanced parentheses in oracle SQL")


def harmonise_round6(sql: str) -> str:
    """Rewrite every ``round(expr, 6)`` as the rounding Spark uses
    (``functions.numeric.rround``): half-even on the double ``expr * 1e6``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        while j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            j = sql.find("round(", j + 1)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        open_at = j + len("round")
        close, commas = _close_paren(sql, open_at)
        if commas and sql[commas[-1] + 1:close].strip() == "6":
            inner = harmonise_round6(sql[open_at + 1:commas[-1]])
            out.append(sql[i:j] + f"(round_even(CAST({inner} AS DOUBLE) * 1000000.0, 0) / 1000000.0)")
        else:
            out.append(sql[i:j] + "round(" + harmonise_round6(sql[open_at + 1:close]) + ")")
        i = close + 1


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = harmonise_round6(sql)
        return fn
    return deco
