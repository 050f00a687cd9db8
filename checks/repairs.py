"""Repairs and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import testbed
from checks.registry import on_tables
from checks.sql import SHARED
from odolake.plans import repair
from odolake.schemas import TIME_COLUMN

NUMBER = "cast(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INT)"
DUCK_NUMBER = "CAST(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INTEGER)"
CORRECTIONS = [repair.Correction("dev-veh1", ["veh1-b0"], "veh1", "veh9", "lent"),
               repair.Correction("dev-veh2", ["veh2-b1", "veh2-b0"], "veh2", "veh8", "swapped")]

on_tables(
    "rep_corrections_bundles",
    "content_root:s vehicle_id:s",
    "SELECT content_root, CASE WHEN boot_id = 'veh1-b0' THEN 'veh9' WHEN boot_id IN ('veh2-b0', 'veh2-b1') THEN 'veh8' "
    "ELSE vehicle_id END AS vehicle_id FROM bundles",
    lambda t: repair.apply_corrections(t, CORRECTIONS).bundles,
)
on_tables(
    "rep_corrections_obd",
    "vehicle_id:s boot_id:s seq:i",
    "SELECT CASE WHEN boot_id = 'veh1-b0' THEN 'veh9' WHEN boot_id IN ('veh2-b0', 'veh2-b1') THEN 'veh8' "
    "ELSE vehicle_id END AS vehicle_id, boot_id, seq FROM obd",
    lambda t: repair.apply_corrections(t, CORRECTIONS).obd,
)
on_tables(
    "rep_corrections_counts",
    "correction:i bundles:i",
    "SELECT CASE WHEN boot_id = 'veh1-b0' THEN 0 ELSE 1 END AS correction, count(*) AS bundles FROM bundles "
    "WHERE boot_id IN ('veh1-b0', 'veh2-b0', 'veh2-b1') GROUP BY ALL",
    lambda t: repair.correction_counts(t.bundles, CORRECTIONS),
)


def _mixed(t):
    wrong = F.when(F.expr(NUMBER) % 5 == 0, "vehX").otherwise(F.col("vehicle_id"))
    return t.replace(**{n: t[n].withColumn("vehicle_id", wrong) for n in ("bundles", "obd", "imu", "position", "status", "transition")})


SHARED["bundles_mixed"] = (
    f"SELECT * REPLACE (CASE WHEN {DUCK_NUMBER} % 5 = 0 THEN 'vehX' ELSE vehicle_id END AS vehicle_id) FROM bundles",
    ["bundles"],
)
SHARED["last_seen_car"] = (
    """
    SELECT device_id, boot_id, last(vehicle_id ORDER BY hi, content_root) AS car, count(DISTINCT vehicle_id) AS cars
    FROM bundles_mixed LEFT JOIN (
        SELECT content_root, max(mono_ms) AS hi FROM (SELECT content_root, mono_ms FROM obd UNION ALL SELECT content_root, mono_ms FROM imu
            UNION ALL SELECT content_root, mono_ms FROM position UNION ALL SELECT content_root, mono_ms FROM status
            UNION ALL SELECT content_root, mono_ms FROM transition) GROUP BY ALL) USING (content_root)
    WHERE hi IS NOT NULL GROUP BY ALL
    """,
    ["bundles_mixed", "obd", "imu", "position", "status", "transition"],
)
on_tables(
    "rep_mixed_boots",
    "content_root:s vehicle_id:s",
    "SELECT m.content_root, CASE WHEN cars > 1 THEN car ELSE m.vehicle_id END AS vehicle_id "
    "FROM bundles_mixed m LEFT JOIN last_seen_car USING (device_id, boot_id)",
    lambda t: repair.file_mixed_boots(_mixed(t)).bundles,
)
on_tables(
    "rep_mixed_boots_obd",
    "vehicle_id:s boot_id:s seq:i",
    f"SELECT CASE WHEN cars > 1 THEN car WHEN {DUCK_NUMBER} % 5 = 0 THEN 'vehX' ELSE vehicle_id END AS vehicle_id, boot_id, seq "
    "FROM obd LEFT JOIN last_seen_car USING (boot_id)",
    lambda t: repair.file_mixed_boots(_mixed(t)).obd,
)


def _undated(t):
    """Every fifth bundle lost its clock; in some boots one bundle runs on another clock."""
    lost = F.expr(NUMBER) % 5 == 2
    odd = F.expr(NUMBER) % 35 == 4

    def stamp(frame, column):
        zero = F.expr(f"cast(timestamp_millis(unix_millis(cast({column} AS TIMESTAMP)) - {testbed.BASE_MS} - _off) AS TIMESTAMP_NTZ)")
        day = F.col(column) + F.expr("INTERVAL '1' DAY")
        return F.when(lost, zero).when(odd, day).otherwise(F.col(column))

    bundles = t.bundles.select("content_root", F.expr(f"utc_basis_ms - {testbed.BASE_MS} AS _off"))
    out = {}
    for name, column in TIME_COLUMN.items():
        frame = t[name]
        out[name] = frame.join(bundles, "content_root").withColumn(column, stamp(frame, column)).select(*frame.columns)
    return t.replace(**out)


def _undated_sql(name: str, column: str) -> tuple[str, list[str]]:
    return (
        f"SELECT t.* REPLACE (CASE WHEN {DUCK_NUMBER} % 5 = 2 THEN make_timestamp_ms(epoch_ms(t.{column}) - b.utc_basis_ms) "
        f"WHEN {DUCK_NUMBER} % 35 = 4 THEN t.{column} + INTERVAL 1 DAY ELSE t.{column} END AS {column}) "
        f"FROM {name} t JOIN (SELECT content_root, utc_basis_ms FROM bundles) b USING (content_root)",
        [name, "bundles"],
    )


for _n, _c in TIME_COLUMN.items():
    SHARED[f"{_n}_undated"] = _undated_sql(_n, _c)
SHARED["clock_span"] = (
    """
    SELECT content_root, vehicle_id, boot_id, min(mono_ms) AS lo, max(mono_ms) AS hi,
        coalesce(min(mono_ms) FILTER (WHERE drives), min(mono_ms)) AS s_lo, coalesce(max(mono_ms) FILTER (WHERE drives), max(mono_ms)) AS s_hi,
        max(year(observed_at)) < 2000 AS undated, median(epoch_ms(observed_at) - mono_ms) FILTER (WHERE plain AND year(observed_at) >= 2000) AS basis
    FROM (
    """
    + " UNION ALL ".join(
        f"SELECT content_root, vehicle_id, boot_id, mono_ms, observed_at, {str(n != 'position').lower()} AS plain, "
        f"{str(n not in ('status', 'transition')).lower()} AS drives FROM {n}_undated"
        for n in ("obd", "imu", "boost", "status", "transition", "position")
    )
    + ") GROUP BY content_root, vehicle_id, boot_id",
    [f"{n}_undated" for n in ("obd", "imu", "boost", "status", "transition", "position")],
)
SHARED["dated_span"] = (
    "SELECT *, abs(basis - boot_basis) <= 5000 AS agrees FROM (SELECT *, round_even(median(basis) OVER (PARTITION BY vehicle_id, boot_id), 0) "
    "AS boot_basis FROM clock_span WHERE NOT undated AND basis IS NOT NULL)",
    ["clock_span"],
)
SHARED["dating"] = (
    """
    SELECT u.content_root, CAST(b.boot_basis AS BIGINT) AS basis_ms
    FROM (SELECT u.*, (SELECT max(hi) FROM dated_span d WHERE d.vehicle_id = u.vehicle_id AND d.boot_id = u.boot_id AND agrees AND d.hi <= u.lo) AS before,
                 (SELECT min(lo) FROM dated_span d WHERE d.vehicle_id = u.vehicle_id AND d.boot_id = u.boot_id AND agrees AND d.lo >= u.hi) AS after
          FROM clock_span u WHERE undated) u
    JOIN (SELECT vehicle_id, boot_id, any_value(boot_basis) AS boot_basis, min(lo) FILTER (WHERE agrees) AS lo, max(hi) FILTER (WHERE agrees) AS hi
          FROM dated_span GROUP BY vehicle_id, boot_id
          HAVING sum(agrees::INTEGER) >= 2 AND 3 * sum(agrees::INTEGER) >= 2 * count(*)) b USING (vehicle_id, boot_id)
    WHERE (u.before IS NOT NULL OR u.lo + 600000 >= b.lo) AND (u.after IS NOT NULL OR u.hi - 600000 <= b.hi)
      AND (SELECT count(*) FROM dated_span d WHERE d.vehicle_id = u.vehicle_id AND d.boot_id = u.boot_id AND NOT agrees
           AND d.s_hi >= coalesce(u.before, u.lo - 600000) AND d.s_lo <= coalesce(u.after, u.hi + 600000)) = 0
    """,
    ["clock_span", "dated_span"],
)
on_tables(
    "rep_basis",
    "content_root:s basis_ms:i",
    "SELECT * FROM dating",
    lambda t: repair.basis_repairs(_undated(t)),
)
for _n, _c in (("obd", "observed_at"), ("gap", "started_at")):
    on_tables(
        f"rep_basis_{_n}",
        f"content_root:s seq:i {_c}:t",
        f"SELECT content_root, seq, {_c} + to_milliseconds(coalesce(basis_ms, 0)) AS {_c} FROM {_n}_undated LEFT JOIN dating USING (content_root)",
        lambda t, n=_n: repair.date_undated(_undated(t))[n],
    )
on_tables(
    "rep_obd_sentinel",
    "vehicle_id:s boot_id:s seq:i speed_kph:i rpm:i",
    "SELECT vehicle_id, boot_id, seq, rpm, nullif(speed_kph, CASE WHEN rpm = 0 THEN 255 END) AS speed_kph FROM obd",
    lambda t: repair.clear_unavailable_speed(t.obd),
)

# Every 13th fix jumps about 11 km, and bursts of seven do so together.
JUMPED = "CASE WHEN seq % 13 = 0 OR seq % 200 < 60 AND seq % 3 <> 0 THEN lat + 0.1 ELSE lat END"


SHARED["moved"] = (f"SELECT * REPLACE ({JUMPED} AS lat) FROM position", ["position"])
SHARED["jumpy"] = ("SELECT * FROM moved WHERE lat IS NOT NULL AND lon IS NOT NULL", ["moved"])
SHARED["jumpy_row"] = (
    "SELECT *, row_number() OVER (PARTITION BY content_root ORDER BY seq) AS pos, "
    "(SELECT max(g.seq) FROM gap g WHERE g.content_root = jumpy.content_root AND g.seq < jumpy.seq) AS gap_seq FROM jumpy",
    ["jumpy", "gap"],
)
GATE_SQL = """
    WITH RECURSIVE walk(content_root, pos, k_seq, k_ms, k_lat, k_lon, rejects, keep) AS (
        SELECT content_root, pos, seq, mono_ms, lat, lon, 0, true FROM jumpy_row WHERE pos = 1
        UNION ALL
        SELECT content_root, pos, CASE WHEN keep THEN seq ELSE k_seq END, CASE WHEN keep THEN mono_ms ELSE k_ms END,
               CASE WHEN keep THEN lat ELSE k_lat END, CASE WHEN keep THEN lon ELSE k_lon END,
               CASE WHEN keep THEN 0 ELSE rejects + 1 END, keep
        FROM (SELECT w.content_root, r.pos, r.seq, r.mono_ms, r.lat, r.lon, w.k_seq, w.k_ms, w.k_lat, w.k_lon, w.rejects,
                  w.rejects >= 5 OR coalesce(r.gap_seq > w.k_seq, false) OR 12742000.0 * asin(sqrt(sin(radians(r.lat - w.k_lat) / 2) ** 2
                      + cos(radians(r.lat)) * cos(radians(w.k_lat)) * sin(radians(r.lon - w.k_lon) / 2) ** 2))
                  <= 50 + 40 * greatest((r.mono_ms - w.k_ms) / 1000.0, 1) AS keep
              FROM walk w JOIN jumpy_row r ON r.content_root = w.content_root AND r.pos = w.pos + 1)
    )
    SELECT r.content_root, r.seq, r.lat, r.lon FROM walk JOIN jumpy_row r USING (content_root, pos) WHERE keep
    UNION ALL
    -- A fix without a place passes and is no measure for others.
    SELECT content_root, seq, lat, lon FROM moved WHERE lat IS NULL OR lon IS NULL
    """

on_tables(
    "rep_jump_gate",
    "content_root:s seq:i lat:d lon:d",
    GATE_SQL,
    lambda t: repair.jump_gate(t.position.withColumn("lat", F.expr(JUMPED)), t.gap),
)



def _frames(spark, sf):
    tk = testbed.ticks(spark, sf)
    f = tk.selectExpr(
        "content_root", "k % 60 AS pos", "event_id * 31 % 65521 AS crc",
        "k % 60 + CASE WHEN k % 60 >= 40 AND bundle_no % 5 = 1 THEN 1 ELSE 0 END AS seq", "event_id",
    )
    from odolake.operators.slices import neighbour

    linked = neighbour(f, ["content_root"], ["pos"], "pos", 65536, ["crc"], "b")
    return linked.selectExpr(
        "content_root", "pos", "seq", "crc",
        "CASE WHEN event_id % 211 = 0 THEN -1 ELSE coalesce(b.crc, 0) END AS prev_crc",
    )


SHARED["frames"] = (
    "SELECT content_root, k % 60 AS pos, event_id * 31 % 65521 AS crc, "
    "k % 60 + CASE WHEN k % 60 >= 40 AND bundle_no % 5 = 1 THEN 1 ELSE 0 END AS seq, CASE WHEN event_id % 211 = 0 THEN -1 "
    "ELSE coalesce(lag(event_id * 31 % 65521) OVER (PARTITION BY content_root ORDER BY k), 0) END AS prev_crc FROM tk",
    ["tk"],
)
SHARED["frame_flaw"] = (
    "SELECT *, CASE WHEN prev_crc <> coalesce(lag(crc) OVER chain, 0) THEN 'chain_break' WHEN seq <> lag(seq) OVER chain + 1 THEN 'seq_gap' "
    "END AS flaw FROM frames WINDOW chain AS (PARTITION BY content_root ORDER BY pos)",
    ["frames"],
)
from checks.registry import add  # noqa: E402

add(
    "rep_frame_chain",
    "content_root:s pos:i seq:i kept:b",
    "SELECT content_root, pos, seq, count(flaw) OVER (PARTITION BY content_root ORDER BY pos) = 0 AS kept FROM frame_flaw",
    lambda spark, sf: repair.frame_verdicts(_frames(spark, sf)),
)
add(
    "rep_chain_report",
    "content_root:s kept:i discarded:i reason:s",
    "SELECT content_root, count(*) FILTER (WHERE n = 0) AS kept, count(*) FILTER (WHERE n > 0) AS discarded, "
    "coalesce(first(flaw ORDER BY pos) FILTER (WHERE flaw IS NOT NULL), 'eof') AS reason FROM (SELECT *, count(flaw) OVER "
    "(PARTITION BY content_root ORDER BY pos) AS n FROM frame_flaw) GROUP BY content_root",
    lambda spark, sf: repair.chain_report(_frames(spark, sf)),
)

COUNTED = ["position", "imu", "obd", "boost", "status", "transition", "gap"]
SHARED["declared"] = (
    " UNION ALL ".join(f"SELECT content_root, '{n}' AS kind, n_{n} AS declared FROM bundles" for n in COUNTED),
    ["bundles"],
)
SHARED["stored"] = (
    " UNION ALL ".join(f"SELECT content_root, '{n}' AS kind, count(*) AS stored FROM {n} GROUP BY ALL" for n in COUNTED),
    COUNTED,
)
on_tables(
    "rep_count_problems",
    "content_root:s kind:s declared:i stored:i",
    "SELECT content_root, kind, declared, coalesce(stored, 0) AS stored FROM declared LEFT JOIN stored USING (content_root, kind) "
    "WHERE declared <> coalesce(stored, 0)",
    repair.count_problems,
)
on_tables(
    "rep_vehicle_problems",
    "kind:s stray_rows:i",
    " UNION ALL ".join(
        f"SELECT '{n}' AS kind, count(*) AS stray_rows FROM {n} t JOIN bundles_mixed b USING (content_root) "
        "WHERE t.vehicle_id IS DISTINCT FROM b.vehicle_id HAVING count(*) > 0"
        for n in COUNTED
    ),
    lambda t: repair.vehicle_problems(t.replace(bundles=_mixed(t).bundles)),
)
WITH_WIFI = ["position", "imu", "obd", "boost", "wifi_scan"]


def _manifest(t):
    claimed = t.bundles.selectExpr(
        "content_root", "first_seq", "CASE WHEN first_seq % 11 = 0 THEN last_seq + 1 ELSE last_seq END AS last_seq"
    )
    return repair.manifest_problems(claimed, repair.declared_counts(t.bundles, WITH_WIFI[:4]), t, WITH_WIFI)


on_tables(
    "rep_manifest",
    "content_root:s problem:s claimed:s found:s",
    "WITH seen AS (" + " UNION ALL ".join(f"SELECT content_root, seq, '{n}' AS kind FROM {n}" for n in WITH_WIFI) + """)
    SELECT content_root, 'seq_range' AS problem, concat(first_seq, '..', last_seq) AS claimed, concat(lo, '..', hi) AS found
    FROM (SELECT content_root, first_seq, last_seq + (first_seq % 11 = 0)::INTEGER AS last_seq FROM bundles)
    JOIN (SELECT content_root, min(seq) AS lo, max(seq) AS hi FROM seen GROUP BY ALL) USING (content_root)
    WHERE first_seq <> lo OR last_seq <> hi
    UNION ALL
    SELECT content_root, concat('count:', kind), coalesce(CAST(declared AS VARCHAR), 'none'), CAST(coalesce(n, 0) AS VARCHAR)
    FROM (SELECT * FROM declared WHERE kind IN ('position', 'imu', 'obd', 'boost'))
    FULL JOIN (SELECT content_root, kind, count(*) AS n FROM seen GROUP BY ALL) USING (content_root, kind)
    WHERE coalesce(declared, 0) <> coalesce(n, 0)
    """,
    _manifest,
)
#: Every derived table that belongs to bundles, with all its columns.
HASHED = testbed.bundle_tables()
SHARED["digests"] = (
    "SELECT content_root, n AS rows, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS output_digest FROM (SELECT content_root, count(*) AS n, "
    + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS UBIGINT)) AS s{i}" for i in range(4))
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT content_root, sha256('{n}' || " + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols) + f") AS h FROM {n}"
        for n, cols in HASHED.items()
    )
    + ") GROUP BY content_root)",
    list(HASHED),
)
on_tables("rep_digest", "content_root:s rows:i output_digest:s", "SELECT * FROM digests", lambda t: repair.bundle_digests(t, HASHED))


def _runs(t):
    digests = repair.bundle_digests(t, HASHED)
    old = digests.select("content_root", "output_digest", F.lit(3).alias("decoder_version"))
    altered = F.when(F.expr(NUMBER) % 4 == 1, F.sha2("output_digest", 256)).otherwise(F.col("output_digest"))
    return old.unionByName(old.withColumn("output_digest", altered).withColumn("decoder_version", F.lit(4)))


on_tables(
    "trp_decode_audit",
    "content_root:s first_digest:s second_digest:s",
    f"SELECT content_root, output_digest AS first_digest, sha256(output_digest) AS second_digest FROM digests WHERE {DUCK_NUMBER} % 4 = 1",
    lambda t: repair.changed_between_versions(_runs(t), 3, 4),
)
