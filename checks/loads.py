"""The batch load: bundles that come in several batches, some of them twice, leave what one load of all would."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import checks.trips  # noqa: F401  (its shared text is used)
from checks.bundles import DAILY_SPEC, TRIP_SPEC
from checks.registry import on_tables
from checks.repairs import GATE_SQL
from checks.sql import SHARED
from checks.stored import scratch
from odolake.plans import load
from odolake.schemas import COUNTED_TABLES
from odolake.session import settle
from odolake.sources.tables import Tables

NUMBER = "cast(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INT)"


# The gate comes before everything that is derived, so DuckDB derives from gated positions too.
SHARED["fix_row"] = (
    "SELECT *, row_number() OVER (PARTITION BY content_root ORDER BY seq) AS pos, "
    "(SELECT max(g.seq) FROM gap g WHERE g.content_root = position.content_root AND g.seq < position.seq) AS gap_seq "
    "FROM position WHERE lat IS NOT NULL AND lon IS NOT NULL",
    ["position", "gap"],
)
SHARED["kept_fix"] = (f"SELECT content_root, seq FROM ({GATE_SQL.replace('jumpy_row', 'fix_row').replace('moved', 'position')})", ["fix_row", "position"])
SHARED["gated"] = ("SELECT position.* FROM position SEMI JOIN kept_fix USING (content_root, seq)", ["position", "kept_fix"])
BEHIND_GATE = ("stamped", "route_step", "bundle_trip", "trip_event", "daily")


def gated(sql: str) -> str:
    """The same text over gated positions."""
    return re.sub(rf"\b({'|'.join(BEHIND_GATE)})\b", r"\1_g", re.sub(r"\bposition\b", "gated", sql))


for _n in BEHIND_GATE:
    _body, _reads = SHARED[_n]
    SHARED[f"{_n}_g"] = (gated(_body), [gated(r) for r in _reads])


def only(t: Tables, which) -> Tables:
    return t.replace(**{n: t[n].where(which) for n in (*COUNTED_TABLES, "bundles", "marker") if n in t})


def in_batches(t: Tables) -> str:
    """Every fifth bundle comes with half of its rows first, every third later than the others, and the last batch comes twice."""
    root = scratch(t.obd.sparkSession)
    t = t.replace(**{n: settle(t[n]) for n in (*COUNTED_TABLES, "bundles")})
    early, torn = F.expr(f"{NUMBER} % 3 <> 0"), F.expr(f"{NUMBER} % 5 = 2")
    first = only(t, early)
    half = first.replace(**{n: first[n].where(~torn | (F.col("seq") % 2 == 0)).withColumn(c, F.when(torn, F.col(c) + F.expr("INTERVAL 3 DAY")).otherwise(F.col(c)))
                            for n, c in ((n, load.TIME_COLUMN[n]) for n in COUNTED_TABLES)})
    load.load_bundles(half, root, 0)
    for _ in range(2):
        load.load_bundles(only(t, ~early | torn), root, 1)
    return root


def _present(t: Tables, name: str) -> DataFrame:
    return load.loaded(t.obd.sparkSession, in_batches(t), name)


on_tables("load_trips", TRIP_SPEC, "SELECT * FROM bundle_trip_g", lambda t: _present(t, "trips"))
on_tables("load_rollups", DAILY_SPEC, "SELECT * FROM daily_g", lambda t: load.rollups(t.obd.sparkSession, in_batches(t)))
on_tables(
    "load_runs",
    "content_root:s decoder_version:i " + " ".join(f"n_{n}:i" for n in COUNTED_TABLES),
    "SELECT content_root, 1 AS decoder_version, "
    + ", ".join(f"(SELECT count(*) FROM {gated(n)} x WHERE x.content_root = bundles.content_root) AS n_{n}" for n in COUNTED_TABLES)
    + " FROM bundles",
    lambda t: _present(t, "runs"),
)
on_tables(
    "load_samples",
    "content_root:s seq:i speed_kph:i rpm:i observed_at:t",
    "SELECT content_root, seq, nullif(speed_kph, CASE WHEN rpm = 0 THEN 255 END) AS speed_kph, rpm, observed_at FROM obd",
    lambda t: _present(t, "obd"),
)
