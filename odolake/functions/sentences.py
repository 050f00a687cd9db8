"""Wording of health findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording a reader of the health summary already knows.
METRIC_NAMES = {
    "boost_psi": "Boost on hard acceleration",
    "lambda": "The air-fuel mix under load",
    "ltft_pct": "The engine's long-term fuel adjustment",
    "stft_pct": "The engine's short-term fuel adjustment",
}
ADVICE = {1: " Worth keeping an eye on.", 2: " Worth having looked at."}
CAUSE = {
    1: " Worth keeping an eye on.",
    2: " That can point to an air leak, a fuel delivery problem or a faulty sensor; worth having looked at.",
}
OUTSIDE = (
    "{name} is reading {value}, which is outside what the sensor can report. "
    "A sensor or its wiring may be at fault; have it looked at."
)
STEADY = "{name} is steady at {value}, the same as {since}."
DRIFT_MORE = (
    "{name} has moved from {base} to {value} over the last two weeks compared with {since}: "
    "the engine is adding more fuel than it used to.{advice}"
)
DRIFT_LESS = (
    "{name} has moved from {base} to {value} over the last two weeks compared with {since}: "
    "the engine is taking away more fuel than it used to.{advice}"
)
NORMAL = {
    "boost_psi": "Boost on hard acceleration is steady around {value}, which is normal for this engine.",
    "lambda": "The air-fuel mix under load is {value}, which is normal for this engine.",
    "trim": "{name} is {value}, inside the normal range.",
}
HIGH = {
    "boost_psi": (
        "Boost on hard acceleration is running high, around {value}; "
        "this engine normally stays under {limit}.{advice}"
    ),
    "lambda": (
        "Under load the engine is running leaner than expected (air-fuel mix {value}, normally under {limit}): "
        "more air for the fuel it is getting.{advice}"
    ),
    "trim": (
        "{name} is {value}: the engine is adding fuel to make up for something, "
        "beyond the {limit} it normally stays inside.{cause}"
    ),
}
LOW = {
    "boost_psi": (
        "Boost on hard acceleration is lower than usual, around {value}; "
        "this engine normally makes at least {limit}.{advice}"
    ),
    "lambda": (
        "Under load the engine is running richer than expected (air-fuel mix {value}, normally above {limit}).{advice}"
    ),
    "trim": "{name} is {value}: the engine is taking fuel away, beyond the {limit} it normally stays inside.{cause}",
}

TEMPLATES = {
    "outside": {k: OUTSIDE for k in NORMAL},
    "steady": {k: STEADY for k in NORMAL},
    "drift_more": {k: DRIFT_MORE for k in NORMAL},
    "drift_less": {k: DRIFT_LESS for k in NORMAL},
    "normal": NORMAL,
    "check_high": HIGH,
    "warn_high": HIGH,
    "check_low": LOW,
    "warn_low": LOW,
}


def template_rows(spark: SparkSession) -> DataFrame:
    """Templates by kind, metric and seriousness, with everything filled in that does not vary by row."""
    rows = []
    for kind, by_group in TEMPLATES.items():
        for metric, name in METRIC_NAMES.items():
            text = by_group[metric if metric in by_group else "trim"]
            for rank in (0, 1, 2):
                said = text.replace("{name}", name)
                said = said.replace("{advice}", ADVICE[max(rank, 1)]).replace("{cause}", CAUSE[max(rank, 1)])
                rows.append((kind, metric, rank, said))
    return spark.createDataFrame(rows, "kind string, metric string, rank int, template string")


def fill(template: Column, words: dict[str, Column]) -> Column:
    """Template text with its remaining ``{word}`` places filled from columns."""
    for word, said in words.items():
        template = F.replace(template, F.lit("{" + word + "}"), said)
    return template


def shown(metric: Column, value: Column) -> Column:
    """A metric's value as text; halves go to the even neighbour."""
    whole = F.bround(value)
    signed = F.when((whole == 0) & (value < 0), "-0%").otherwise(F.format_string("%+.0f%%", whole))
    text = (
        F.when(metric == "boost_psi", F.format_string("%.1f psi", value))
        .when(metric == "lambda", F.format_string("%.2f", value))
        .otherwise(signed)
    )
    return F.when(value.isNull(), "").otherwise(text)
