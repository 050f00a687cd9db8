"""Ledger, decode queue, audit, counters, assignments, sync log."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import testbed
from checks.registry import add, on_tables
from checks.sql import SHARED
from odolake.plans import ledger as led
from odolake.plans import registry as reg
from odolake.plans import synclog as syn
from odolake.sources.bundles import first_source

LEDGER_SPEC = "event_id:i content_root:s device_id:s event:s bytes:i path:s reason:s"


def on_ledger(name, spec, sql, fn):
    add(name, spec, sql, lambda spark, sf: fn(testbed.ledger(spark, sf)))


on_ledger(
    "led_filter",
    LEDGER_SPEC,
    "SELECT * FROM ledger WHERE device_id = 'dev-7' AND event = 'offer_rejected'",
    lambda df: led.ledger_entries(df, device="DEV-7", problems_only=True),
)
on_ledger(
    "led_bundle",
    LEDGER_SPEC,
    "SELECT * FROM ledger WHERE content_root = 'bundle-5' OR bundle_id = 'bundle-5'",
    lambda df: led.ledger_entries(df, bundle="Bundle-5"),
)
on_ledger(
    "led_tally",
    "event:s n:i problem:b",
    "SELECT event, count(*) AS n, event = 'offer_rejected' AS problem FROM ledger GROUP BY event",
    led.ledger_tally,
)
on_ledger(
    "led_missing_reason",
    LEDGER_SPEC,
    "SELECT * FROM ledger WHERE event LIKE '%rejected' AND reason = ''",
    led.missing_reasons,
)
on_ledger(
    "src_arrival_metadata",
    "content_root:s path:s size_bytes:i duration_ms:i received_at:t",
    """
    SELECT c.content_root, coalesce(c.path, o.path) AS path, greatest(c.bytes, 0) AS size_bytes,
        CASE WHEN epoch_us(c.at_ts) // 1000 >= epoch_us(o.at_ts) // 1000 THEN epoch_us(c.at_ts) // 1000 - epoch_us(o.at_ts) // 1000 ELSE 0 END AS duration_ms,
        c.at_ts AS received_at
    FROM (SELECT DISTINCT ON (content_root) * FROM ledger WHERE event = 'committed' ORDER BY content_root, event_id) c
    LEFT JOIN (SELECT DISTINCT ON (content_root) * FROM ledger WHERE event = 'offered' ORDER BY content_root, event_id) o
        ON o.content_root = c.content_root AND o.event_id < c.event_id
    """,
    lambda df: led.arrival_metadata(df.withColumn("utc_ms", F.unix_millis(F.col("at_ts").cast("timestamp"))), "event_id"),
)


def _queue(df):
    entries = df.where("event = 'committed'").selectExpr("event_id AS seq", "device_id", "content_root", "bytes AS bytes_stored")
    acks = entries.where("seq % 3 = 0").select("seq")
    failures = entries.where("seq % 4 = 1").select("seq", F.explode(F.sequence(F.lit(1), (F.col("seq") % 9 + 1).cast("int"))).alias("nth"))
    return entries, acks, failures


on_ledger(
    "led_pending",
    "seq:i device_id:s content_root:s bytes_stored:i",
    "SELECT event_id AS seq, device_id, content_root, bytes AS bytes_stored FROM ledger WHERE event = 'committed' AND event_id % 3 > 0",
    lambda df: led.pending(*_queue(df)[:2]),
)
on_ledger(
    "led_parked",
    "seq:i device_id:s attempts:i",
    "SELECT event_id AS seq, device_id, event_id % 9 + 1 AS attempts FROM ledger WHERE event = 'committed' AND event_id % 3 > 0 "
    "AND event_id % 4 = 1 AND event_id % 9 >= 4",
    lambda df: led.parked(*_queue(df)),
)
on_ledger(
    "led_backlog",
    "device_id:s entries:i pending:i parked:i bytes_stored:i",
    "SELECT device_id, count(*) AS entries, count(*) FILTER (WHERE event_id % 3 > 0) AS pending, count(*) FILTER (WHERE event_id % 3 > 0 "
    "AND event_id % 4 = 1 AND event_id % 9 >= 4) AS parked, sum(bytes) AS bytes_stored FROM ledger WHERE event = 'committed' GROUP BY ALL",
    lambda df: led.backlog(*_queue(df)),
)
ROUTES = "CASE user_id % 4 WHEN 0 THEN 'GET /v1/health' WHEN 1 THEN 'GET /v1/pull' WHEN 2 THEN 'POST /v1/ops' ELSE 'GET /v1/trips' END"


def _audit(spark, sf):
    return testbed.read(spark, sf, "events").selectExpr(
        "event_id", "cast(ts AS timestamp) AS ts", "'client' AS actor_type", "'lan' AS transport", f"{ROUTES} AS route",
        "'' AS target_id", "200 AS status", "'' AS reason", "CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('c', cast(user_id AS STRING)) END AS client_id",
        "concat('a', cast(user_id AS STRING)) AS actor_id",
    )


add(
    "led_recent_activity",
    "ts:t route:s status:i client_id:s",
    f"SELECT ts, route, 200 AS status, concat(CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'c' END, user_id) AS client_id FROM (SELECT *, {ROUTES} AS route FROM events) "
    "WHERE route <> 'GET /v1/health' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 300",
    lambda spark, sf: led.recent_activity(_audit(spark, sf), "2024-01-05", 300, tie="event_id"),
)


def _offers(spark, sf):
    """Offers, some of them sent twice, some with a counter of zero."""
    rows = testbed.offers(spark, sf)
    once = rows.selectExpr("device_id", "CASE WHEN o_orderkey % 401 = 0 THEN 0 ELSE counter END AS counter", "content_root", "o_orderkey * 2 AS arrival")
    again = once.where("arrival % 10 = 4").withColumn("arrival", F.col("arrival") + 1)
    return once.unionByName(again)


SHARED["offers"] = (
    "SELECT device_id, CASE WHEN o_orderkey % 401 = 0 THEN 0 ELSE counter END AS counter, content_root, o_orderkey * 2 AS arrival FROM offer_rows "
    "UNION ALL SELECT device_id, CASE WHEN o_orderkey % 401 = 0 THEN 0 ELSE counter END, content_root, o_orderkey * 2 + 1 FROM offer_rows WHERE o_orderkey * 2 % 10 = 4",
    ["offer_rows"],
)
SHARED["offer_verdict"] = (
    """
    SELECT *, CASE WHEN counter = 0 THEN 'conflict' WHEN arrival = owner_at THEN 'new' WHEN content_root = owner THEN 'duplicate' ELSE 'conflict' END AS verdict
    FROM (SELECT *, min(arrival) OVER same AS owner_at, first_value(content_root) OVER (same ORDER BY arrival) AS owner,
              coalesce(max(counter) OVER (PARTITION BY device_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high_water
          FROM offers WINDOW same AS (PARTITION BY device_id, counter))
    """,
    ["offers"],
)
add(
    "reg_counter_verdicts",
    "device_id:i counter:i content_root:s arrival:i verdict:s high_water:i gap:i",
    "SELECT *, CASE WHEN verdict = 'new' THEN greatest(counter - high_water - 1, 0) ELSE 0 END AS gap FROM offer_verdict",
    lambda spark, sf: reg.counter_verdicts(_offers(spark, sf)),
)


def _floors(offers):
    return offers.groupBy("device_id").agg((F.max("device_id") % 4 * 10).alias("floor"))


add(
    "reg_missing_counters",
    "device_id:i counter:i",
    "SELECT device_id, counter FROM (SELECT device_id, unnest(range(greatest(1, device_id % 4 * 10), max(counter) + 1)) AS counter FROM offers "
    "GROUP BY device_id) WHERE (device_id, counter) NOT IN (SELECT device_id, counter FROM offers)",
    lambda spark, sf: (lambda o: reg.missing_counters(o, _floors(o)))(_offers(spark, sf)),
)
ASSIGN = ["concat('a', cast(device_id AS VARCHAR(20)), '-', cast(n AS VARCHAR(20))) AS assignment_id", "device_id",
          "(device_id + n - 1) % 4 AS vehicle_id", "n AS seq", "n = 2 AS is_open", "CASE WHEN n = 1 THEN 1 ELSE 100 END AS first_counter"]
CLAIM = [
    "o_orderkey", "device_id", "counter",
    "CASE WHEN o_orderkey % 29 = 0 THEN 'zzz' ELSE concat('a', cast(device_id AS VARCHAR(20)), '-', cast(o_orderkey % 2 + 1 AS VARCHAR(20))) END AS assignment_id",
    "(device_id + o_orderkey % 2 + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END) % 4 AS vehicle_id",
]


def _claims(spark, sf):
    rows = testbed.offers(spark, sf)
    claims = rows.selectExpr(*[testbed.spark_text(c) for c in CLAIM])
    devices = rows.select("device_id").distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assignments = devices.selectExpr(*[testbed.spark_text(c) for c in ASSIGN])
    vehicles = assignments.select("vehicle_id").distinct().withColumn("archived", F.col("vehicle_id") == 3)
    return claims, assignments, vehicles


SHARED["claims"] = (f"SELECT {', '.join(CLAIM)} FROM offer_rows", ["offer_rows"])
SHARED["assignments"] = (
    f"SELECT {', '.join(ASSIGN)} FROM (SELECT DISTINCT device_id FROM offer_rows), (VALUES (1), (2)) v(n)",
    ["offer_rows"],
)
add(
    "reg_assignment_check",
    "o_orderkey:i device_id:i vehicle_id:i counter:i assignment_id:s verdict:s",
    """
    SELECT c.*, CASE WHEN a.assignment_id IS NULL THEN 'unknown'
        WHEN a.device_id <> c.device_id OR a.vehicle_id <> c.vehicle_id THEN 'mismatch' WHEN a.vehicle_id = 3 THEN 'archived'
        WHEN NOT a.is_open AND EXISTS (SELECT 1 FROM assignments l WHERE l.device_id = c.device_id AND l.seq > a.seq
            AND l.first_counter <> 0 AND c.counter > l.first_counter) THEN 'superseded' ELSE 'ok' END AS verdict
    FROM claims c LEFT JOIN assignments a USING (assignment_id)
    """,
    lambda spark, sf: reg.assignment_verdicts(*_claims(spark, sf)),
)
add(
    "reg_assignment_ranges",
    "assignment_id:s first_counter:i last_counter:i",
    "SELECT assignment_id, min(nullif(counter, 0)) AS first_counter, max(counter) AS last_counter FROM claims GROUP BY ALL",
    lambda spark, sf: reg.assignment_ranges(_claims(spark, sf)[0]),
)

# --- sync log ---------------------------------------------------------------------------------

CENTS = "cast(floor(c_acctbal * 100 + 0.5) AS BIGINT)"


def _entities(spark, sf, new: bool):
    rows = testbed.read(spark, sf, "customer")
    rows = rows.where("c_custkey % 17 <> 0" if new else "c_custkey % 19 <> 0")
    cents = f"{CENTS} + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END" if new else CENTS
    rows = rows.selectExpr("c_custkey", "c_nationkey", "c_name AS name", f"{cents} AS cents")
    state = syn.entity_state(rows, "customer", "c_custkey", "c_nationkey", ["name", "cents"])
    if not new:  # some entities are buried already
        buried = F.col("entity_id").cast("long") % 23 == 0
        state = state.withColumn("digest", F.when(buried, syn.TOMBSTONE).otherwise(F.col("digest")))
    return state


FEED_SPEC = "entity_type:s entity_id:s vehicle_id:s change:s digest:s data:s"
SHARED["customer_old"] = (
    f"SELECT c_custkey AS id, c_nationkey AS veh, CASE WHEN c_custkey % 23 = 0 THEN 'tombstone' ELSE sha256(CAST(to_json({{name: c_name, cents: {CENTS}}}) AS VARCHAR)) END AS d "
    "FROM customer WHERE c_custkey % 19 <> 0",
    [],
)
SHARED["customer_new"] = (
    f"SELECT c_custkey AS id, c_nationkey AS veh, CAST(to_json({{name: c_name, cents: {CENTS} + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END}}) AS VARCHAR) AS j "
    "FROM customer WHERE c_custkey % 17 <> 0",
    [],
)
SHARED["feed"] = (
    """
    SELECT 'customer' AS entity_type, id AS entity_id, coalesce(n.veh, o.veh) AS vehicle_id, n.j AS data, coalesce(sha256(n.j), 'tombstone') AS digest,
        CASE WHEN n.j IS NULL THEN 'tombstone' WHEN o.d IS NULL OR o.d = 'tombstone' THEN 'new' ELSE 'changed' END AS change
    FROM customer_old o FULL JOIN customer_new n USING (id) WHERE coalesce(sha256(n.j), 'tombstone') IS DISTINCT FROM o.d
    """,
    ["customer_old", "customer_new"],
)
add("syn_change_feed", FEED_SPEC, "SELECT * FROM feed", lambda spark, sf: syn.change_feed(_entities(spark, sf, False), _entities(spark, sf, True)))
add(
    "syn_pull",
    "seq:i vehicle_id:s change:s",
    "SELECT entity_id AS seq, vehicle_id, change FROM feed WHERE entity_id > 40 AND vehicle_id IN (3, 5, 7, 11) ORDER BY entity_id LIMIT 100",
    lambda spark, sf: syn.pull(
        syn.change_feed(_entities(spark, sf, False), _entities(spark, sf, True)).withColumn("seq", F.col("entity_id").cast("long")),
        40, ["3", "5", "7", "11"], 100,
    ),
)

OPS = [
    "conv_id * 1000 + turn AS arrival",
    "concat('client', cast(conv_id % 3 AS VARCHAR(20))) AS client_id",
    "concat('op', cast(conv_id * 1000 + turn - CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS VARCHAR(20))) AS operation_id",
    "CASE WHEN turn % 4 = 0 THEN '' ELSE concat('k', cast(conv_id AS VARCHAR(20)), '-', cast((turn) // 3 AS VARCHAR(20))) END AS idem_key",
    "CASE WHEN conv_id % 2 = 0 THEN role ELSE cast(turn AS VARCHAR(20)) END AS content_hash",
]


def _ops(spark, sf):
    return testbed.read(spark, sf, "conversations").selectExpr(*[testbed.spark_text(c) for c in OPS])


# Ids and keys only meet inside a conversation, so DuckDB walks each one with its list of accepted operations.
SHARED["op_row"] = (f"SELECT {', '.join(OPS)}, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations", [])
add(
    "syn_dedupe",
    "arrival:i client_id:s operation_id:s idem_key:s content_hash:s status:s",
    """
    WITH RECURSIVE walk(conv_id, n, ids, id_hashes, slots, slot_hashes, status) AS (
        SELECT conv_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '' FROM (SELECT DISTINCT conv_id FROM op_row)
        UNION ALL
        SELECT conv_id, n, CASE WHEN verdict = 'accepted' THEN list_append(ids, operation_id) ELSE ids END,
            CASE WHEN verdict = 'accepted' THEN list_append(id_hashes, content_hash) ELSE id_hashes END,
            CASE WHEN verdict = 'accepted' THEN list_append(slots, idem_key) ELSE slots END,
            CASE WHEN verdict = 'accepted' THEN list_append(slot_hashes, content_hash) ELSE slot_hashes END, verdict
        FROM (SELECT w.conv_id, r.n, ids, id_hashes, slots, slot_hashes, r.operation_id, r.content_hash, r.idem_key,
                CASE WHEN list_contains(ids, r.operation_id) THEN
                        CASE WHEN id_hashes[list_position(ids, r.operation_id)] = r.content_hash THEN 'duplicate' ELSE 'reused_id' END
                     WHEN r.idem_key <> '' AND list_contains(slots, r.idem_key) THEN
                        CASE WHEN slot_hashes[list_position(slots, r.idem_key)] = r.content_hash THEN 'duplicate' ELSE 'reused_key' END
                     ELSE 'accepted' END AS verdict
              FROM walk w JOIN op_row r ON r.conv_id = w.conv_id AND r.n = w.n + 1)
    )
    SELECT r.*, w.status FROM walk w JOIN op_row r USING (conv_id, n)
    """,
    lambda spark, sf: syn.dedupe_operations(_ops(spark, sf)),
)
# Two conversations share ids, each has a target with two fields, and a base revision is a guess that is often out of date.
INTAKE = [
    "conv_id * 1000 + turn AS arrival",
    "CASE WHEN turn % 9 = 8 THEN 'CLIENT' ELSE 'client' END AS client_id",
    "CASE WHEN turn % 4 = 1 THEN concat('op-', cast(conv_id // 2 AS VARCHAR(20)), '-', cast(turn AS VARCHAR(20))) "
    "ELSE concat('op', cast(conv_id * 1000 + turn - CASE WHEN turn % 5 = 4 THEN 2 ELSE 0 END AS VARCHAR(20))) END AS operation_id",
    "CASE WHEN turn % 4 = 0 THEN '' ELSE concat('k', cast(conv_id AS VARCHAR(20)), '-', cast((turn) // 3 AS VARCHAR(20))) END AS idem_key",
    "CASE WHEN conv_id % 3 = 0 THEN role ELSE cast((turn) // 2 AS VARCHAR(20)) END AS content_hash",
    "'vehicle_note' AS kind",
    "concat('v', cast(conv_id % 4 AS VARCHAR(20))) AS vehicle_id",
    "cast(conv_id AS VARCHAR(20)) AS target",
    "(turn + 1) // 3 + CASE WHEN turn % 7 = 3 THEN 1 ELSE 0 END AS guess",
    "CASE WHEN turn % 13 = 7 THEN 'out_of_scope' END AS refused",
    "CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN 'vehicle_archived' END AS unfit",
    "turn",
    "conv_id",
]


def _intake(spark, sf):
    rows = testbed.read(spark, sf, "conversations").selectExpr(*[testbed.spark_text(c) for c in INTAKE])
    both = F.col("turn") % 6 == 5
    fields = F.when(both, F.array(F.lit("f1"), F.lit("f2"))).otherwise(F.array(F.concat(F.lit("f"), (F.col("turn") % 2 + 1).cast("string"))))
    guess = F.col("guess").cast("long")
    ops = rows.withColumn("fields", fields).withColumn("base", F.when(both, F.array(guess, guess)).otherwise(F.array(guess)))
    return syn.intake(ops).withColumn("revision", F.col("revisions")[0])


SHARED["intake_row"] = (
    f"SELECT *, (conv_id // 2) AS pair, (conv_id % 2) * 2 AS skip, CASE WHEN turn % 6 = 5 THEN [1, 2] ELSE [turn % 2 + 1] END AS f, "
    f"row_number() OVER (PARTITION BY conv_id // 2 ORDER BY arrival) AS n FROM (SELECT {', '.join(INTAKE)} FROM conversations)",
    [],
)
add(
    "syn_intake",
    "arrival:i status:s reason:s original:i revision:i",
    """
    WITH RECURSIVE walk(pair, n, ids, keys, revs, status, reason, original, revision) AS (
        SELECT DISTINCT pair, 0::BIGINT, []::STRUCT(name VARCHAR, hash VARCHAR, arrival BIGINT, rev BIGINT)[],
            []::STRUCT(name VARCHAR, hash VARCHAR, arrival BIGINT, rev BIGINT)[], [0, 0, 0, 0]::BIGINT[], '', NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM intake_row
        UNION ALL
        SELECT pair, n, CASE WHEN verdict = 'accepted' THEN list_append(ids, {name: operation_id, hash: content_hash, arrival: arrival, rev: rev + 1}) ELSE ids END,
            CASE WHEN verdict = 'accepted' AND idem_key <> '' THEN list_append(keys, {name: idem_key, hash: content_hash, arrival: arrival, rev: rev + 1}) ELSE keys END,
            CASE WHEN verdict = 'accepted' THEN list_transform(revs, lambda r, i: r + list_contains(f, i - skip)::BIGINT) ELSE revs END,
            CASE WHEN verdict IN ('accepted', 'duplicate', 'conflict') THEN verdict ELSE 'rejected' END,
            CASE WHEN verdict NOT IN ('accepted', 'duplicate', 'conflict') THEN verdict END,
            CASE WHEN verdict = 'duplicate' THEN coalesce(by_id.arrival, by_key.arrival) END,
            CASE verdict WHEN 'accepted' THEN rev + 1 WHEN 'conflict' THEN rev WHEN 'duplicate' THEN coalesce(by_id.rev, by_key.rev) END
        FROM (SELECT *, CASE WHEN refused IS NOT NULL THEN refused
                WHEN by_id IS NOT NULL THEN CASE WHEN by_id.hash = content_hash THEN 'duplicate' ELSE 'reused_id' END
                WHEN by_key IS NOT NULL THEN CASE WHEN by_key.hash = content_hash THEN 'duplicate' ELSE 'reused_key' END
                WHEN unfit IS NOT NULL THEN unfit
                WHEN len(list_filter(f, lambda x: revs[x + skip] <> guess)) > 0 THEN 'conflict' ELSE 'accepted' END AS verdict
              FROM (SELECT w.pair, r.* EXCLUDE (pair), ids, keys, revs, list_filter(ids, lambda x: x.name = r.operation_id)[1] AS by_id,
                        CASE WHEN r.idem_key <> '' THEN list_filter(keys, lambda x: x.name = r.idem_key)[1] END AS by_key, revs[f[1] + skip] AS rev
                    FROM walk w JOIN intake_row r ON r.pair = w.pair AND r.n = w.n + 1))
    )
    SELECT r.arrival, w.status, w.reason, w.original, w.revision FROM walk w JOIN intake_row r USING (pair, n)
    """,
    _intake,
)
UPDATES = ["'vehicle_note' AS kind", "conv_id % 4 AS vehicle_id", "conv_id AS target", "conv_id * 1000 + turn AS arrival", "role",
           "(turn) // 2 - CASE WHEN turn % 7 = 3 THEN 1 ELSE 0 END AS base_revision", "length(text) AS said"]


def _updates(spark, sf):
    rows = testbed.read(spark, sf, "conversations").selectExpr(*[testbed.spark_text(c) for c in UPDATES])
    return rows.withColumns({"fields": F.array("role"), "base": F.array(F.col("base_revision").cast("long"))})


SHARED["revision_walk"] = (
    """
    WITH RECURSIVE steps AS (SELECT conv_id, role, turn, length(text) AS said, turn // 2 - (turn % 7 = 3)::INTEGER AS base,
            row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
    walk(conv_id, role, n, revision, ok) AS (
        SELECT DISTINCT conv_id, role, 0::BIGINT, 0::BIGINT, false FROM steps
        UNION ALL
        SELECT w.conv_id, w.role, s.n, w.revision + (s.base = w.revision)::BIGINT, s.base = w.revision
        FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.role = w.role AND s.n = w.n + 1)
    SELECT conv_id * 1000 + turn AS arrival, conv_id, role, said, revision, CASE WHEN ok THEN 'accepted' ELSE 'conflict' END AS status
    FROM walk JOIN steps USING (conv_id, role, n)
    """,
    [],
)
add(
    "syn_field_revisions",
    "arrival:i status:s revision:i",
    "SELECT * FROM revision_walk",
    lambda spark, sf: syn.field_revisions(_updates(spark, sf)).withColumn("revision", F.col("revisions")[0]),
)


def _current(spark, sf):
    updates = _updates(spark, sf)
    done = syn.field_revisions(updates).where("status = 'accepted'")
    each = done.select("arrival", F.explode(F.arrays_zip("fields", "revisions")).alias("f"))
    rows = each.join(updates, "arrival").select(
        "kind", "vehicle_id", "target", F.col("f.fields").alias("field"), F.col("f.revisions").alias("revision"), F.col("said").alias("value")
    )
    return syn.current_fields(rows)


add(
    "syn_current_fields",
    "vehicle_id:i target:i field:s revision:i value:i",
    "SELECT conv_id % 4 AS vehicle_id, conv_id AS target, role AS field, max(revision) AS revision, arg_max(said, revision) AS value "
    "FROM revision_walk WHERE status = 'accepted' GROUP BY conv_id, role",
    _current,
)


def _sources(t):
    n = F.expr("cast(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INT)")
    rows = t.bundles.select("content_root", "vehicle_id", "decoder_ver")
    return first_source(
        rows.where(n % 3 != 0).withColumn("origin", F.lit("server")), rows.where(n % 2 == 0).withColumn("origin", F.lit("card"))
    )


on_tables(
    "src_first_source",
    "content_root:s vehicle_id:s origin:s",
    "SELECT content_root, vehicle_id, CASE WHEN n % 3 > 0 THEN 'server' ELSE 'card' END AS origin FROM (SELECT *, "
    "CAST(regexp_extract(content_root, 'r([0-9]+)$', 1) AS INTEGER) AS n FROM bundles) WHERE n % 3 > 0 OR n % 2 = 0",
    _sources,
)
