"""Per-key state over streams: counter guard, field revisions, jump gate, standby pairing.

``foreachBatch`` functions that keep a few values per key under a folder and add their results to ``root``/out (see ``carried``).
Rows of a key that arrive in one batch are put in order first; across batches they are taken as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.functions.geo import metres
from odolake.plans.power import AWAKE, CLOCK_WRAP, HEALTH_REGION, POWER_TRIGGER, STANDBY
from odolake.plans.registry import counter_verdicts
from odolake.plans.repair import JUMP_MPS, JUMP_SLACK_M, MAX_REJECTS
from odolake.session import settle
from odolake.streaming.carried import Batch, KeyedStore, walked

#: Comes before everything a batch brings.
_EARLIER = -1


def counter_guard(root: str) -> Batch:
    """new / duplicate / conflict per offer (device_id, counter, content_root, arrival), and the gap a new counter leaves.

    Who owns a counter is kept by device and counter, and each device's highest one; both go ahead of the batch as
    earlier offers, and the verdicts are those of the batch view. Arrivals are not negative.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        offers = settle(batch.select("device_id", "counter", "content_root", "arrival").dropna(subset=["device_id", "counter"]))
        types = dict(offers.dtypes)
        columns = f"device_id {types['device_id']}, counter {types['counter']}, content_root string"
        owners = KeyedStore(f"{root}/owners", ["device_id", "counter"], columns)
        highs = KeyedStore(f"{root}/highs", ["device_id"], columns)
        known = owners.read(offers.select("device_id", "counter"), batch_id).unionByName(highs.read(offers.select("device_id"), batch_id)).distinct()
        earlier = settle(known.withColumn("arrival", F.lit(_EARLIER).cast(types["arrival"])))
        judged = counter_verdicts(offers.unionByName(earlier.select(*offers.columns))).where(F.col("arrival") > _EARLIER)
        judged = settle(judged.select("device_id", "counter", "content_root", "arrival", "verdict", "gap"))
        judged.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        new = judged.where("verdict = 'new'").select("device_id", "counter", "content_root")
        owners.write(new, batch_id)
        top = F.max_by("content_root", "counter").alias("content_root")
        both = new.unionByName(earlier.select(*new.columns))
        highs.write(both.groupBy("device_id").agg(F.max("counter").alias("counter"), top).select(*new.columns), batch_id)

    return step


class FieldRevisions:
    """All-or-nothing updates of a target's fields by base revision."""

    def __init__(self, stored: dict | None):
        self.current: dict[str, int] = stored or {}

    def take(self, row: dict) -> Iterator[tuple]:
        names = row["fields"] or []
        now = [self.current.get(n, 0) for n in names]
        if now != [b or 0 for b in row["base"] or []]:
            yield row["arrival"], "conflict", names, now
            return
        after = [rev + 1 for rev in now]
        self.current.update(zip(names, after, strict=True))
        yield row["arrival"], "accepted", names, after

    def state(self) -> dict:
        return self.current


def field_revisions(root: str) -> Batch:
    """Updates (kind, vehicle_id, target, arrival, fields, base): arrival, status, fields, revisions."""
    return walked(root, ["kind", "vehicle_id", "target"], ["arrival"], FieldRevisions, "arrival long, status string, fields array<string>, revisions array<long>")


class JumpGate:
    """Fixes that can be reached from the last kept one. Gap rows come in the same stream with ``is_gap``.

    A fix without coordinates passes and is no measure for others.
    """

    def __init__(self, stored: dict | None):
        stored = stored or {}
        self.kept = tuple(stored["kept"]) if stored.get("kept") else None
        self.rejects, self.gap = stored.get("rejects", 0), stored.get("gap", -1)
        # A gap counts for the fixes after it, not for one at the same place.
        self.waiting = stored.get("waiting", -1)

    def take(self, row: dict) -> Iterator[tuple]:
        seq = row["seq"]
        if row["is_gap"]:
            self.waiting = seq
            return
        if 0 <= self.waiting < seq:
            self.gap, self.waiting = self.waiting, -1
        place = row["mono_ms"], row["lat"], row["lon"]
        if row["lat"] is None or row["lon"] is None:
            yield row["content_root"], seq, *place
            return
        if self.kept is not None:
            last, ms, lat, lon = self.kept
            far = metres(lat, lon, row["lat"], row["lon"]) > JUMP_SLACK_M + JUMP_MPS * max((row["mono_ms"] - ms) / 1000.0, 1.0)
            if far and not self.gap > last and self.rejects < MAX_REJECTS:
                self.rejects += 1
                return
        self.kept, self.rejects = (seq, *place), 0
        yield row["content_root"], seq, *place

    def state(self) -> dict:
        return {"kept": self.kept, "rejects": self.rejects, "gap": self.gap, "waiting": self.waiting}


def jump_gate(root: str) -> Batch:
    """Fixes and gaps (content_root, seq, mono_ms, lat, lon, is_gap): the fixes that are kept."""
    return walked(root, ["content_root"], ["seq", "is_gap"], JumpGate, "content_root string, seq long, mono_ms long, lat double, lon double")


class StandbyPairs:
    """Standby windows as they close; an entry that is followed by another one closes unmatched."""

    def __init__(self, stored: dict | None):
        self.entered = (stored or {}).get("entered")

    def take(self, row: dict) -> Iterator[tuple]:
        if row["region"] != HEALTH_REGION or row["trigger_event"] != POWER_TRIGGER:
            return
        step, at = (row["from_state"], row["to_state"]), row["mono_ms"]
        if step == (AWAKE, STANDBY):
            if self.entered is not None:
                yield row["content_root"], self.entered, None, 0, None, True
            self.entered = at
        elif step == (STANDBY, AWAKE) and self.entered is not None:
            yield row["content_root"], self.entered, at, (at - self.entered) % CLOCK_WRAP, row["reason_code"], False
            self.entered = None

    def state(self) -> dict:
        return {"entered": self.entered}


def standby_windows(root: str) -> Batch:
    """Transitions of bundles: content_root, enter_ms, exit_ms, duration_ms, wake_reason, unmatched."""
    given = "content_root string, enter_ms long, exit_ms long, duration_ms long, wake_reason int, unmatched boolean"
    return walked(root, ["content_root"], ["seq"], StandbyPairs, given)
