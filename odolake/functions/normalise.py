"""Raw record fields to measured values: sentinels, scaling, clocks, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.functions.timecols import from_millis

# Fixed values of the record format: "no reading" per field width.
ABSENT = {"u8": 0xFF, "i8": -0x80, "u16": 0xFFFF, "i16": -0x8000, "u32": 0xFFFFFFFF}
# Fixed values of the record format: units per raw step.
SCALE = {"e7": 1e7, "cm_per_s": 100.0, "cdeg": 100.0, "cm": 100.0, "e2": 100.0, "e1": 10.0, "e4": 10000.0}
PSI_PER_KPA = 0.1450377
MAP_CEILING_KPA = 255
MAX_FIX_MPS = 50.0
MAX_FIX_TYPE = 5
MAX_HEADING_CDEG = 35999


def measured(col: Column | str, width: str) -> Column:
    """NULL where the field holds its width's "no reading" value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(ABSENT[width]))


def scaled(col: Column | str, unit: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c / F.lit(SCALE[unit])


def observed_at(basis_ms: Column | str, mono_ms: Column | str, offset_ms: Column | str | None = None) -> Column:
    """Wall-clock estimate: the bundle's basis plus the boot clock plus the fix's own offset."""
    basis, mono = (F.col(c) if isinstance(c, str) else c for c in (basis_ms, mono_ms))
    offset = F.lit(0) if offset_ms is None else F.coalesce(offset_ms, F.lit(0))
    return from_millis(basis + mono + offset)


def implied_basis(utc_ms: Column | str, mono_ms: Column | str) -> Column:
    """UTC of the boot clock's zero by one clock reading; NULL when that would be negative."""
    utc, mono = (F.col(c) if isinstance(c, str) else c for c in (utc_ms, mono_ms))
    return F.when(utc >= mono, utc - mono)


def valid_fix() -> Column:
    """A raw position row that is a fix at all: typed, not at 0/0, and no faster than 50 m/s."""
    return (
        (F.col("fix_type") != 0)
        & ~((F.col("lat_e7") == 0) & (F.col("lon_e7") == 0))
        & (scaled("speed_cmps", "cm_per_s") <= MAX_FIX_MPS)
    )


def positions(raw: DataFrame, basis: DataFrame) -> DataFrame:
    """Position rows from raw fields; ``basis`` gives utc_basis_ms per content_root."""
    rows = raw.where(valid_fix()).join(basis.select("content_root", "utc_basis_ms"), "content_root")
    return rows.select(
        "vehicle_id",
        "content_root",
        "boot_id",
        "mono_ms",
        "seq",
        observed_at("utc_basis_ms", "mono_ms", F.col("utc_offset_ms")).alias("observed_at"),
        scaled("lat_e7", "e7").alias("lat"),
        scaled("lon_e7", "e7").alias("lon"),
        scaled("alt_cm", "cm").alias("alt_m"),
        scaled("speed_cmps", "cm_per_s").alias("speed_mps"),
        scaled("heading_cdeg", "cdeg").alias("heading_deg"),
        "fix_type",
        measured("sats_used", "u8").alias("sats_used"),
        scaled(measured("hdop_e2", "u16"), "e2").alias("hdop"),
        scaled(measured("h_acc_cm", "u16"), "cm").alias("h_acc_m"),
        "source_flags",
    )


def fix_warnings() -> Column:
    """What a raw position row states that the format does not define."""
    return F.array_compact(
        F.array(
            F.when(F.col("fix_type") > MAX_FIX_TYPE, F.concat(F.lit("fix_type "), F.col("fix_type").cast("string"))),
            F.when(
                F.col("heading_cdeg") > MAX_HEADING_CDEG, F.concat(F.lit("heading "), F.col("heading_cdeg").cast("string"))
            ),
        )
    )


def gap_warnings() -> Column:
    bad = ~F.col("cause").between(1, 5)
    return F.array_compact(F.array(F.when(bad, F.concat(F.lit("cause "), F.col("cause").cast("string")))))


def quarantine(raw: DataFrame, warnings: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without warnings, and the others with theirs."""
    marked = raw.withColumn("warnings", warnings)
    return marked.where(F.size("warnings") == 0).drop("warnings"), marked.where(F.size("warnings") > 0)


def boost_columns(raw: DataFrame) -> DataFrame:
    """Gauge boost, mixture and absolute load; unknown where an input is."""
    gauge = (F.col("map_kpa") - F.col("baro_kpa")).cast("double")
    return raw.withColumns(
        {
            "boost_psi": gauge * PSI_PER_KPA,
            "lambda_ratio": scaled("lambda_e4", "e4"),
            "abs_load_pct": F.col("abs_load_raw") * 100.0 / 255.0,
            "map_saturated": F.coalesce(F.col("map_kpa") >= MAP_CEILING_KPA, F.lit(False)),
        }
    )
