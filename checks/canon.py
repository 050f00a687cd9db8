"""One column spec per query, applied to the Spark result and to the DuckDB text alike.

A spec is ``"name:kind ..."`` with kinds s string, i integer, d double, t timestamp (as epoch
milliseconds), b boolean (as 0/1). Doubles are cut to six decimals by the same float arithmetic on
both sides; the odd offset keeps values that sit on a rounding tie away from the edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

OFFSET = "0.50012345"


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def spark_frame(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in parse(spec):
        col = f"`{name}`"
        out.append(
            {
                "s": f"cast({col} AS STRING)",
                "i": f"cast({col} AS BIGINT)",
                "d": f"floor(cast({col} AS DOUBLE) * 1000000.0D + {OFFSET}D) / 1000000.0D",
                "t": f"unix_millis(cast({col} AS TIMESTAMP))",
                "b": f"cast({col} AS INT)",
            }[kind]
            + f" AS {col}"
        )
    return df.selectExpr(*out)


def duck_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in parse(spec):
        col = f'"{name}"'
        out.append(
            {
                "s": f"CAST({col} AS VARCHAR)",
                "i": f"CAST({col} AS BIGINT)",
                "d": f"floor(CAST({col} AS DOUBLE) * CAST(1000000.0 AS DOUBLE) + CAST({OFFSET} AS DOUBLE)) / CAST(1000000.0 AS DOUBLE)",
                "t": f"epoch_us({col}) // 1000",
                "b": f"CAST({col} AS INTEGER)",
            }[kind]
            + f" AS {col}"
        )
    return f"SELECT {', '.join(out)} FROM ({body}) final_rows"
