"""Owner-written inputs: tune records, vehicle corrections, engine profiles."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.plans.repair import Correction
from odolake.sources.profiles import catalogue

TUNE_LIST = "array<struct<id: string, at: string, note: string>>"
REGISTRY = f"vehicles array<struct<id: string, display_name: string, engine_code: string, archived_at: string, tunes: {TUNE_LIST}>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Vehicles of the nested registry document, one row each."""
    doc = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    return doc.select(F.explode("vehicles").alias("v")).select(
        F.lower("v.id").alias("vehicle_id"),
        F.col("v.display_name").alias("display_name"),
        F.coalesce("v.engine_code", F.lit("")).alias("engine_code"),
        F.col("v.archived_at").isNotNull().alias("archived"),
        F.col("v.tunes").alias("tunes"),
    )


def tune_rows(registry: DataFrame) -> DataFrame:
    """Tune records; a tune starts with its day, UTC."""
    each = registry.select("vehicle_id", F.explode("tunes").alias("t"))
    return each.select(
        "vehicle_id",
        F.col("t.id").alias("tune_id"),
        F.to_date("t.at").cast("timestamp_ntz").alias("tuned_at"),
        F.coalesce("t.note", F.lit("")).alias("note"),
    )


CORRECTION_FIELDS = {"device_id", "boot_ids", "from_vehicle_id", "to_vehicle_id", "reason"}


def _is_id(text: Any) -> bool:
    return isinstance(text, str) and len(text) == 32 and all(c in "0123456789abcdef" for c in text)


def parse_corrections(doc: Mapping[str, Any]) -> list[Correction]:
    """Corrections in file order. A document that does not check is refused as a whole."""
    if unknown := set(doc) - {"corrections"}:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    out = []
    for n, raw in enumerate(doc.get("corrections", []), start=1):
        if unknown := set(raw) - CORRECTION_FIELDS:
            raise ValueError(f"correction {n}: unknown fields {sorted(unknown)}")
        c = Correction(
            str(raw.get("device_id", "")).lower(),
            [str(b).lower() for b in raw.get("boot_ids") or []],
            str(raw.get("from_vehicle_id", "")).lower(),
            str(raw.get("to_vehicle_id", "")).lower(),
            str(raw.get("reason", "")),
        )
        for name in ("device_id", "from_vehicle_id", "to_vehicle_id"):
            if not _is_id(getattr(c, name)):
                raise ValueError(f"correction {n}: {name} must be 32 hex digits")
        if c.from_vehicle_id == c.to_vehicle_id:
            raise ValueError(f"correction {n}: moves a vehicle to itself")
        if not c.boot_ids or not all(_is_id(b) for b in c.boot_ids):
            raise ValueError(f"correction {n}: boot_ids must name boots by 32 hex digits")
        if not c.reason.strip():
            raise ValueError(f"correction {n}: reason is empty")
        out.append(c)
    return out


def _document(spark: SparkSession, path: str) -> str:
    """A small owner-written file as text, from wherever the cluster keeps it."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_corrections(spark: SparkSession, path: str) -> list[Correction]:
    return parse_corrections(json.loads(_document(spark, path)))


def read_profiles(spark: SparkSession, paths: list[str]) -> list[dict[str, Any]]:
    """Built-in engine profiles with the given files over them."""
    return catalogue(_document(spark, p) for p in paths)
