"""Every query offered to the driver: Spark function, column spec and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from checks import canon, testbed


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None


CHECKS: dict[str, Check] = {}


def add(name: str, spec: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    if name in CHECKS:
        raise ValueError(f"query {name} is registered twice")
    CHECKS[name] = Check(run, spec, sql)


def on_tables(name: str, spec: str, sql: str | None, fn) -> None:
    """Register a query over the derived sample tables."""
    add(name, spec, sql, lambda spark, sf: fn(testbed.telemetry(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf, c=c: canon.spark_frame(c.run(spark, sf), c.spec)) for n, c in CHECKS.items()}


def oracle_sql() -> dict[str, str]:
    from checks.sql import SHARED

    out = {}
    for name, c in CHECKS.items():
        if c.sql is None:
            continue
        body = f"SELECT * FROM result_{name}"
        shared = {**SHARED, f"result_{name}": (c.sql, [])}
        out[name] = testbed.with_tables(canon.duck_sql(body, c.spec), shared)
    return out
