"""Declared extensions: derived columns, metrics and views that plug into the core."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.functions.flags import BOOT
from odolake.operators.medians import medians
from odolake.plans.insight import CORE_METRICS, FEW_READINGS
from odolake.sources.tables import Tables

NAME = re.compile(r"[a-z][a-z0-9_]*")
WORD = re.compile(r"'(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_]*")

# The words a derivation may use besides its table's own columns.
KEYWORDS = set("case when then else end is not null and or between in cast as distinct true false".split())
FUNCTIONS = set(
    "abs round floor ceil ceiling trunc sign least greatest coalesce nullif ifnull sqrt pow power exp ln log log2 log10 "
    "mod div degrees radians try_cast epoch_ms".split()
)
TYPES = {
    "boolean": "boolean",
    "tinyint": "tinyint",
    "smallint": "smallint",
    "integer": "int",
    "int": "int",
    "bigint": "bigint",
    "utinyint": "smallint",
    "usmallint": "int",
    "uinteger": "bigint",
    "ubigint": "decimal(20,0)",
    "hugeint": "decimal(38,0)",
    "decimal": "decimal(18,3)",
    "float": "float",
    "real": "float",
    "double": "double",
    "varchar": "string",
    "date": "date",
    "timestamp": "timestamp_ntz",
}
# Functions that Spark SQL spells differently; ``{}`` stands for the argument.
RESPELLED = {
    "log": "log10({})",
    "epoch_ms": "unix_millis(cast({} AS timestamp))",
    "trunc": "(sign({0}) * floor(abs({0})))",
}
SAMPLES = ("sample", "pull", "trip", "boot")


@dataclass(frozen=True)
class Derivation:
    """``table.column := expr``; new, or taking over a column the table has."""

    column: str
    type: str
    expr: str


@dataclass(frozen=True)
class Metric:
    key: str
    source_view: str
    source_column: str
    sample: str


@dataclass(frozen=True)
class Module:
    id: str
    derives: Sequence[Derivation] = ()
    metrics: Sequence[Metric] = ()
    views: Mapping[str, str] = field(default_factory=dict)
    requires: Sequence[str] = ()


def in_order(modules: Sequence[Module]) -> list[Module]:
    """Modules after those whose derived columns they require; ties by id; cycles refused."""
    owner = {d.column: m.id for m in modules for d in m.derives}
    waits = {m.id: {owner[r] for r in m.requires if r in owner} - {m.id} for m in modules}
    by_id = {m.id: m for m in modules}
    done: list[str] = []
    while len(done) < len(by_id):
        ready = sorted(i for i in by_id if i not in done and waits[i] <= set(done))
        if not ready:
            raise ValueError(f"modules wait for each other: {sorted(set(by_id) - set(done))}")
        done.append(ready[0])
    return [by_id[i] for i in done]


def checked_expression(expr: str, columns: Sequence[str]) -> str:
    """The expression for Spark SQL, or an error when it reaches beyond its own row."""
    own = {c.lower() for c in columns}
    bare = re.sub(r"'(?:[^']|'')*'", lambda m: " " * len(m.group()), expr)
    if ";" in bare:
        raise ValueError("a derivation is one expression: no semicolon")
    for m in WORD.finditer(bare):
        word = m.group().lower()
        if word not in own | KEYWORDS | FUNCTIONS | set(TYPES):
            raise ValueError(f"{word!r} is not a column of the table, a type, a keyword or an allowed function")
    typed = WORD.sub(lambda m: TYPES[m.group().lower()] if m.group().lower() in set(TYPES) - own else m.group(), expr)
    return _respelled(typed)


def _respelled(expr: str) -> str:
    """Rewrite calls that Spark SQL spells differently, innermost last."""
    call = re.search(r"\b(" + "|".join(RESPELLED) + r")\s*\(", expr, re.IGNORECASE)
    if not call:
        return expr
    depth, end = 1, call.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(expr[end], 0)
        end += 1
    inner = _respelled(expr[call.end() : end - 1])
    spelled = RESPELLED[call.group(1).lower()].format(inner)
    return expr[: call.start()] + spelled + _respelled(expr[end:])


def apply_derivations(t: Tables, modules: Sequence[Module]) -> Tables:
    """Add or take over the declared columns, each as one projection over its own table."""
    for m in in_order(modules):
        for d in m.derives:
            table, _, column = d.column.partition(".")
            if not NAME.fullmatch(table) or not NAME.fullmatch(column):
                raise ValueError(f"module {m.id}: {d.column!r} is not a lowercase table.column")
            if d.type.lower() not in TYPES:
                raise ValueError(f"module {m.id}: {d.type!r} is not a type")
            if table not in t:
                raise ValueError(f"module {m.id}: there is no table {table!r}")
            frame = t[table]
            expr = checked_expression(d.expr, frame.columns)
            t = t.replace(**{table: frame.withColumn(column, F.expr(expr).cast(TYPES[d.type.lower()]))})
    return t


def metric_keys(modules: Sequence[Module]) -> list[str]:
    """Core metric keys and those of the modules; a key has one owner."""
    keys = list(CORE_METRICS)
    for m in sorted(modules, key=lambda m: m.id):
        for metric in m.metrics:
            if metric.key in keys:
                raise ValueError(f"module {m.id}: metric {metric.key!r} already has an owner")
            keys.append(metric.key)
    return keys


def metric_arm(metric: Metric, view: DataFrame, boot_start: DataFrame) -> DataFrame:
    """Observations of one metric: every row of its view, or the median of each boot with enough rows."""
    for name in (metric.key, metric.source_view, metric.source_column):
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is not a lowercase identifier")
    if metric.sample not in SAMPLES:
        raise ValueError(f"sample {metric.sample!r} is not one of {SAMPLES}")
    rows = view.select(*BOOT, F.col(metric.source_column).cast("double").alias("value")).where("value IS NOT NULL")
    if metric.sample == "boot":
        rows = medians(rows, BOOT, "value", "value", "_n").where(F.col("_n") >= FEW_READINGS).drop("_n")
    dated = rows.join(boot_start, BOOT)
    return dated.select(*BOOT, F.lit(metric.key).alias("metric"), "value", "started_at")


def metric_arms(modules: Sequence[Module], view: Callable[[str], DataFrame], boot_start: DataFrame) -> list[DataFrame]:
    metric_keys(modules)
    return [
        metric_arm(metric, view(metric.source_view), boot_start)
        for m in sorted(modules, key=lambda m: m.id)
        for metric in m.metrics
    ]


def register_module_views(spark: SparkSession, modules: Sequence[Module]) -> None:
    """Create each module's views; a name that is taken is refused by Spark, never replaced."""
    for m in in_order(modules):
        for name, sql in m.views.items():
            spark.sql(sql).createTempView(name)
