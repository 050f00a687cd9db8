"""Engine profiles: limits per signal, looked up by engine code."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.plans.insight import CORE_METRICS

LIMITS = ("warn_low", "warn_high", "check_low", "check_high")
DEFAULTS = {"min_observations": 3.0, "ltft_drift_watch_pct": 3.0, "ltft_drift_check_pct": 6.0}
STATUSES = ("stub", "derived", "verified")


def _signal(key: str, low: float, high: float, **limits: float) -> dict[str, Any]:
    return {"key": key, "min": low, "max": high, **limits}


# The built-in limits.
BUILT_IN: list[dict[str, Any]] = [
    {
        "id": "bmw-n20",
        "name": "BMW N20/N26",
        "status": "derived",
        "codes": ["N20", "N26"],
        "signals": [
            _signal("boost_psi", 0, 30, warn_high=20),
            _signal("lambda", 0.5, 2, warn_high=1.1),
            _signal("ltft_pct", -25, 25, warn_low=-10, warn_high=10, check_low=-20, check_high=20),
            _signal("stft_pct", -25, 25),
        ],
        "thresholds": {
            "pull_boost_note_psi": 18,
            "pull_lambda_rich": 0.9,
            "ltft_drift_watch_pct": 3,
            "ltft_drift_check_pct": 6,
        },
    },
    {
        "id": "bmw-b58",
        "name": "BMW B58",
        "status": "stub",
        "codes": ["B58"],
        "signals": [
            _signal("boost_psi", 0, 30),
            _signal("lambda", 0.5, 2),
            _signal("ltft_pct", -25, 25),
            _signal("stft_pct", -25, 25),
        ],
        "thresholds": {},
    },
]
GENERIC: dict[str, Any] = {
    "id": "generic",
    "name": "Generic engine",
    "status": "derived",
    "codes": [],
    "signals": [
        _signal("ltft_pct", -25, 25, warn_low=-10, warn_high=10, check_low=-20, check_high=20),
        _signal("stft_pct", -25, 25),
    ],
    "thresholds": {"ltft_drift_watch_pct": 3, "ltft_drift_check_pct": 6},
}


def normal_code(code: str) -> str:
    return code.strip().upper()


def check_profile(p: Mapping[str, Any]) -> None:
    """Refuse a profile whose limits contradict each other."""
    allowed = {"schema", "id", "name", "status", "codes", "sources", "signals", "thresholds"}
    if unknown := set(p) - allowed:
        raise ValueError(f"profile has unknown fields {sorted(unknown)}")
    pid = p.get("id", "")
    if not pid or pid != pid.lower() or any(c in pid for c in " /\\"):
        raise ValueError(f"profile id {pid!r} must be lowercase without spaces or slashes")
    if not str(p.get("name", "")).strip():
        raise ValueError(f"profile {pid} needs a name")
    if p.get("status") not in STATUSES:
        raise ValueError(f"profile {pid}: status must be one of {STATUSES}")
    keys = [s.get("key", "") for s in p.get("signals", [])]
    if "" in keys or len(keys) != len(set(keys)):
        raise ValueError(f"profile {pid}: a signal key is empty or repeated")
    for s in p.get("signals", []):
        if s["min"] >= s["max"]:
            raise ValueError(f"profile {pid}: {s['key']}: min is not below max")
        wl, wh, cl, ch = (s.get(k) for k in LIMITS)
        pairs = [(wl, wh, True), (wh, ch, False), (cl, wl, False)]
        for low, high, strict in pairs:
            if low is not None and high is not None and (low > high or (strict and low == high)):
                raise ValueError(f"profile {pid}: {s['key']}: limits are out of order")
    if p["status"] == "stub":
        stated = any(s.get(k) is not None for s in p.get("signals", []) for k in LIMITS)
        if stated or p.get("thresholds"):
            raise ValueError(f"profile {pid}: a stub states no limit")


def catalogue(overrides: Iterable[Mapping[str, Any] | str] = ()) -> list[dict[str, Any]]:
    """Built-in profiles with overrides by id; a code may belong to one profile only."""
    by_id = {p["id"]: p for p in BUILT_IN}
    for raw in overrides:
        p = json.loads(raw) if isinstance(raw, str) else dict(raw)
        check_profile(p)
        by_id[p["id"]] = p
    owner: dict[str, str] = {}
    for pid in sorted(by_id):
        for code in by_id[pid].get("codes") or []:
            if owner.setdefault(normal_code(code), pid) != pid:
                raise ValueError(f"engine code {code} is claimed by {owner[normal_code(code)]} and {pid}")
    return [by_id[pid] for pid in sorted(by_id)]


def limit_rows(spark: SparkSession, profiles: Iterable[Mapping[str, Any]]) -> DataFrame:
    """One row per engine code and metric; the generic profile has a NULL code."""
    rows = []
    for p in [*profiles, GENERIC]:
        signals = {s["key"]: s for s in p.get("signals", [])}
        thresholds = {**DEFAULTS, **(p.get("thresholds") or {})}
        for code in [normal_code(c) for c in p.get("codes") or []] if p is not GENERIC else [None]:
            for metric in CORE_METRICS:
                s = signals.get(metric)
                values = [s.get(k) if s else None for k in ("min", "max", *LIMITS)]
                rows.append(
                    (
                        code, metric, s is not None, *[None if v is None else float(v) for v in values],
                        int(thresholds["min_observations"]), float(thresholds["ltft_drift_watch_pct"]),
                        float(thresholds["ltft_drift_check_pct"]),
                    )
                )
    schema = "code string, metric string, has_signal boolean, min double, max double, " + ", ".join(
        f"{k} double" for k in LIMITS
    )
    return spark.createDataFrame(rows, f"{schema}, min_observations int, drift_watch double, drift_check double")


def limits_for(vehicles: DataFrame, rows: DataFrame) -> DataFrame:
    """Limits per vehicle (vehicle_id, engine_code); an unknown or empty code gets the generic ones.

    The limit table has a few rows per profile, so it is broadcast.
    """
    codes = rows.select("code").where("code IS NOT NULL").distinct().withColumn("known", F.lit(True))
    keyed = vehicles.select("vehicle_id", F.upper(F.trim("engine_code")).alias("code"))
    keyed = keyed.join(F.broadcast(codes), "code", "left")
    keyed = keyed.select("vehicle_id", F.when(F.col("known"), F.col("code")).alias("want"))
    return keyed.join(F.broadcast(rows), F.col("want").eqNullSafe(F.col("code"))).drop("want", "code")
