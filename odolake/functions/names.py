"""Names for codes and bitmaps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format.
GAP_CAUSES = {1: "no_fix", 2: "receiver_reset", 3: "powered_down", 4: "obstruction", 5: "time_jump"}
TIME_SOURCES = {1: "gnss", 2: "phone", 3: "modem_network", 4: "rtc"}
TRIP_EVENTS = {
    1: "TRIP_START",
    2: "TRIP_END",
    3: "HARSH_BRAKE",
    4: "HARSH_ACCELERATION",
    5: "HARSH_CORNERING",
    6: "IMPACT",
    7: "HARSH_MOTION",
    8: "CAPTURE_RECOVERED",
}
WAKE_REASONS = {0: "none", 1: "motion", 2: "engine voltage", 3: "periodic health"}
HEALTH_BITS = {
    1: "DEGRADED_GNSS",
    2: "DEGRADED_STORAGE",
    4: "DEGRADED_TIME",
    8: "DEGRADED_NETWORK",
    16: "LOW_POWER",
    32: "RECOVERY_REQUIRED",
    64: "DEGRADED_SENSING",
}


def named(code: Column, names: Mapping[int, str], unknown: str) -> Column:
    """Name of a code; ``{}`` in ``unknown`` stands for the code itself. NULL stays NULL."""
    found = F.coalesce(*[F.when(code == k, n) for k, n in names.items()])
    before, _, after = unknown.partition("{}")
    other = F.concat(F.lit(before), code.cast("string"), F.lit(after)) if "{}" in unknown else F.lit(unknown)
    return F.when(code.isNotNull(), F.coalesce(found, other))


def gap_cause(code: Column) -> Column:
    return named(code, GAP_CAUSES, "unknown({})")


def time_source(code: Column) -> Column:
    return named(code, TIME_SOURCES, "unknown({})")


def trip_event(code: Column) -> Column:
    return named(code, TRIP_EVENTS, "UNKNOWN_EVENT({})")


def health_names(state: Column) -> Column:
    """Set bits by name joined with ``|``, bits without a name as hex, ``OK`` when clear."""
    known = sum(HEALTH_BITS)
    rest = state.bitwiseAND(F.lit(255 - known))
    parts = [F.when(state.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in HEALTH_BITS.items()]
    parts.append(F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(rest), 2, "0")))))
    return F.when(state == 0, "OK").when(state.isNotNull(), F.concat_ws("|", *parts))
