"""The sync log: change feed of published rows, pulls, and operations with field revisions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.operators.groups import connected
from odolake.session import settle

TOMBSTONE = "tombstone"


def entity_state(rows: DataFrame, entity_type: str, entity_id: str, vehicle_id: str, data: Sequence[str]) -> DataFrame:
    """Published form of rows: id, vehicle, JSON of the data columns and its digest."""
    payload = F.to_json(F.struct(*data))
    return rows.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(entity_id).cast("string").alias("entity_id"),
        F.lower(F.col(vehicle_id).cast("string")).alias("vehicle_id"),
        payload.alias("data"),
        F.sha2(payload, 256).alias("digest"),
    )


def change_feed(last: DataFrame, now: DataFrame) -> DataFrame:
    """What to append to the log so that it describes ``now``: new and changed rows, and tombstones.

    ``last`` holds the newest digest per entity; an entity that is gone already is not
    buried twice.
    """
    key = ["entity_type", "entity_id"]
    old = last.select(*key, F.col("digest").alias("_old"), F.col("vehicle_id").alias("_vehicle"))
    both = now.join(old, key, "full")
    gone = F.col("digest").isNull()
    change = (
        F.when(gone & (F.col("_old") != TOMBSTONE), "tombstone")
        .when(~gone & (F.col("_old").isNull() | (F.col("_old") == TOMBSTONE)), "new")
        .when(~gone & (F.col("_old") != F.col("digest")), "changed")
    )
    return (
        both.withColumn("change", change)
        .where("change IS NOT NULL")
        .select(
            *key,
            F.coalesce("vehicle_id", "_vehicle").alias("vehicle_id"),
            "change",
            F.coalesce("digest", F.lit(TOMBSTONE)).alias("digest"),
            "data",
        )
    )


def next_state(last: DataFrame, feed: DataFrame) -> DataFrame:
    """Newest digest per entity after the feed was appended."""
    key = ["entity_type", "entity_id"]
    kept = last.join(feed.select(*key), key, "left_anti").select(*key, "vehicle_id", "digest")
    return kept.unionByName(feed.select(*key, "vehicle_id", "digest"))


def pull(log: DataFrame, cursor: int, vehicles: Sequence[str], limit: int) -> DataFrame:
    """The next records after a cursor that a client may see."""
    return log.where((F.col("seq") > cursor) & F.col("vehicle_id").isin(list(vehicles))).orderBy("seq").limit(limit)


DECISIONS = "arrival bigint, status string, reason string, original bigint, fields array<string>, revisions array<bigint>"
#: What an operation may bring besides arrival, client_id, operation_id and content_hash, and its type.
_MAY_HAVE = {
    "idem_key": "string", "kind": "string", "vehicle_id": "string", "target": "string", "fields": "array<string>", "base": "array<bigint>",
    "refused": "string", "unfit": "string",
}


def intake(ops: DataFrame) -> DataFrame:
    """Decide operations as if they came one by one in arrival order: arrival, status, reason, original, fields, revisions.

    In this order: what is ``refused`` anyway (malformed, out of scope) is rejected with that reason. An operation whose id
    was accepted before is a duplicate if client and content are the same, else rejected as reused_id; the same holds for
    the idempotency key of its client, with reused_key. What is ``unfit`` (archived vehicle, content that doesn't check) is
    rejected with that reason. If a base revision (none: 0) of any of its fields isn't the field's current one, it is a conflict and
    changes nothing; ``revisions`` are the current ones. Otherwise it is accepted, and each field moves on by one. Only accepted
    operations are remembered, so an id or key may be sent again after a rejection or conflict. A duplicate names its
    ``original`` by arrival and repeats that one's fields and revisions.

    Input: arrival (unique), client_id, operation_id, content_hash and, where given, idem_key, kind, vehicle_id, target, fields
    (names), base (a revision for each), refused, unfit. Ids, clients and vehicles are compared without regard to case.

    Fates are linked through ids, keys and fields, so operations are gathered in connected groups, and each group is
    read once in order as a stream. Memory holds the current revisions of a group and those ids and keys that occur again.
    """
    given = ops.select(
        "arrival", F.lower("client_id").alias("client_id"), F.lower("operation_id").alias("operation_id"), "content_hash",
        *[(F.col(c) if c in ops.columns else F.lit(None)).cast(t).alias(c) for c, t in _MAY_HAVE.items()],
    )
    slot = F.when(F.coalesce("idem_key", F.lit("")) != "", F.to_json(F.array("client_id", "idem_key")))
    field = F.to_json(F.array("kind", F.lower("vehicle_id"), "target"), {"ignoreNullFields": "false"})
    fields = F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.concat(field, F.to_json(F.array(f))))
    rows = given.select("*", slot.alias("_slot"), fields.alias("_fields"))
    # What is refused anyway touches nothing.
    live = rows.where("refused IS NULL")
    meets = F.array(F.concat(F.lit("i"), "operation_id"), F.concat(F.lit("k"), "_slot"))
    met = live.select("arrival", F.explode(F.concat(meets, F.transform("_fields", lambda f: F.concat(F.lit("f"), f)))).alias("_at")).where("_at IS NOT NULL")
    shared = settle(met.groupBy("_at").agg(F.min("arrival").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    links = met.join(shared, "_at").select(F.col("_first").alias("a"), F.col("arrival").alias("b"))
    roots = connected(links).toDF("arrival", "_root")
    again = [shared.where(F.col("_at").startswith(k)).select(F.expr("substring(_at, 2)").alias(c), F.lit(True).alias(r)) for k, c, r in (("i", "operation_id", "_id_again"), ("k", "_slot", "_key_again"))]
    placed = rows.join(roots, "arrival", "left").join(again[0], "operation_id", "left").join(again[1], "_slot", "left")
    placed = placed.withColumn("_root", F.coalesce("_root", "arrival"))
    return placed.repartition("_root").sortWithinPartitions("_root", "arrival").mapInPandas(_decide, DECISIONS)


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root, ids, keys, current = None, {}, {}, {}
    for batch in batches:
        out = []
        for op in batch.itertuples(index=False, name="Op"):
            # Names that begin with an underscore are renamed by position in a named tuple, so columns go by place.
            row = dict(zip(batch.columns, op, strict=True))
            if row["_root"] != root:
                root, ids, keys, current = row["_root"], {}, {}, {}
            out.append((row["arrival"], *_decision(row, ids, keys, current)))
        yield pd.DataFrame(out, columns=["arrival", "status", "reason", "original", "fields", "revisions"]).astype({"original": "Int64"})


def _decision(row: dict, ids: dict, keys: dict, current: dict) -> tuple:
    """status, reason, original, fields, revisions; remembers what is accepted."""

    def known(name: str) -> bool:
        return isinstance(row[name], str)

    names = [] if row["fields"] is None else list(row["fields"])
    if known("refused"):
        return "rejected", row["refused"], None, names, None
    mine = row["client_id"], row["content_hash"]
    for seen, at, reason, same in ((ids, row["operation_id"], "reused_id", slice(0, 2)), (keys, row["_slot"], "reused_key", slice(1, 2))):
        if at is not None and at in seen:
            who, original, fields, revisions = seen[at]
            return ("duplicate", None, original, fields, revisions) if who[same] == mine[same] else ("rejected", reason, None, names, None)
    if known("unfit"):
        return "rejected", row["unfit"], None, names, None
    at = list(row["_fields"])
    now = [current.get(f, 0) for f in at]
    base = [] if row["base"] is None else [0 if b is None or b != b else int(b) for b in row["base"]]
    if base + [0] * (len(now) - len(base)) != now:
        return "conflict", None, None, names, now
    after = [rev + 1 for rev in now]
    current.update(zip(at, after, strict=True))
    kept = mine, row["arrival"], names, after
    if row["_id_again"] is True:
        ids[row["operation_id"]] = kept
    if row["_key_again"] is True:
        keys[row["_slot"]] = kept
    return "accepted", None, None, names, after


def dedupe_operations(ops: DataFrame) -> DataFrame:
    """accepted / duplicate / reused_id / reused_key per operation, as if judged one by one in arrival order.

    The part of ``intake`` that looks at ids and idempotency keys only. Input: arrival, client_id,
    operation_id, idem_key, content_hash.
    """
    decided = intake(ops.select("arrival", "client_id", "operation_id", "idem_key", "content_hash"))
    status = F.coalesce("reason", "status").alias("_status")
    return ops.join(decided.select("arrival", status), "arrival").select(*ops.columns, F.col("_status").alias("status"))


REVISION_COLUMNS = "arrival bigint, status string, fields array<string>, revisions array<bigint>"


def field_revisions(ops: DataFrame) -> DataFrame:
    """Accept or refuse updates of several fields at once by their base revisions.

    Input: kind, vehicle_id, target, arrival, fields (sorted names), base (revision per
    field, 0 or NULL where none). An operation applies only if every base equals the
    field's current revision; then each field moves on by one. Each decision rests on
    the one before, so a target's operations are read in order as a stream: memory
    holds the current revisions of one target, not its operations.
    """
    key = ["kind", "vehicle_id", "target"]
    ordered = ops.select(*key, "arrival", "fields", "base").repartition(*key).sortWithinPartitions(*key, "arrival")
    return ordered.mapInPandas(_walk_revisions, REVISION_COLUMNS)


def _walk_revisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    target, current = None, {}
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if target != row[:3]:
                target, current = row[:3], {}
            _, _, _, arrival, fields, base = row
            fields = list(fields)
            wanted = [0 if b is None or b != b else int(b) for b in base]
            if any(current.get(f, 0) != b for f, b in zip(fields, wanted, strict=True)):
                out.append((arrival, "conflict", fields, [current.get(f, 0) for f in fields]))
                continue
            for f in fields:
                current[f] = current.get(f, 0) + 1
            out.append((arrival, "accepted", fields, [current[f] for f in fields]))
        yield pd.DataFrame(out, columns=["arrival", "status", "fields", "revisions"])


def current_fields(updates: DataFrame) -> DataFrame:
    """Latest accepted revision of every field: kind, vehicle_id, target, field, revision, value."""
    key = ["kind", "vehicle_id", "target", "field"]
    return updates.groupBy(*key).agg(F.max("revision").alias("revision"), F.max_by("value", "revision").alias("value"))
