"""Registered queries: a Spark plan over the tables and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskgrid.workload.binding import Tables

def _nudged(sql: str) -> str:
    """Write ``round(x, 6)`` as ``(round((x) - 1e-9, 6) + 0.0)``, the rounding of ``binding.round_all``."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body = _nudged(sql[start + 6 : end - 1])
        out.append(sql[at:start])
        six = body.rstrip().endswith(", 6")
        out.append(f"(round(({body.rstrip()[:-3]}) - 1e-9::DOUBLE, 6) + 0.0::DOUBLE)" if six else f"round({body})")
        at = end
    return "".join(out) + sql[at:]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(tables)`` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = _nudged(sql)
        return fn

    return register
