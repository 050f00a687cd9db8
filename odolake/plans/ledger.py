"""The server's own records: lifecycle ledger, decode queue, audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.functions.timecols import from_millis

# Ledger event names.
LISTED_PROBLEMS = (
    "offer_rejected", "chunk_rejected", "commit_failed", "decode_failed", "quota_refused", "device_unknown",
)
LATER_REFUSALS = ("assignment_refused", "quarantined", "key_missing")
NEEDS_REASON = (*LISTED_PROBLEMS, *LATER_REFUSALS, "counter_gap")
HEALTH_PROBE = "GET /v1/health"
MAX_ATTEMPTS = 5


def is_problem(later: bool = False) -> Column:
    return F.col("event").isin(*LISTED_PROBLEMS, *(LATER_REFUSALS if later else ()))


def ledger_entries(
    ledger: DataFrame, bundle: str | None = None, device: str | None = None, problems_only: bool = False, later: bool = False
) -> DataFrame:
    """Entries of a bundle (by bundle id or content root), of a device, or refusals only.

    ``later`` counts the refusals added after the first list of problems was made.
    """
    out = ledger
    if problems_only:
        out = out.where(is_problem(later))
    if bundle:
        out = out.where((F.lower("bundle_id") == bundle.lower()) | (F.lower("content_root") == bundle.lower()))
    if device:
        out = out.where(F.lower("device_id") == device.lower())
    return out


def ledger_tally(ledger: DataFrame, later: bool = False) -> DataFrame:
    """Entries per event and whether the event is a problem."""
    return ledger.groupBy("event").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", is_problem(later))


def missing_reasons(ledger: DataFrame) -> DataFrame:
    """Refusals that do not say why."""
    return ledger.where(F.col("event").isin(*NEEDS_REASON) & (F.coalesce("reason", F.lit("")) == ""))


def arrival_metadata(ledger: DataFrame, order: str = "seq") -> DataFrame:
    """How each bundle reached the server: the first commit, with the first offer's path and time.

    ``order`` is the entry's place in the ledger. Both picks are mergeable
    aggregates, so a bundle with very many entries costs no extra memory.
    """
    rows = ledger.where("content_root <> ''")

    def first(event: str) -> Column:
        return F.min(F.when(F.col("event") == event, F.struct(F.col(order).alias("n"), "utc_ms", "path", "bytes")))

    both = rows.groupBy("content_root").agg(first("committed").alias("c"), first("offered").alias("o"))
    offered = F.col("o.n") < F.col("c.n")
    took = F.col("c.utc_ms") - F.col("o.utc_ms")
    path = F.when(F.coalesce("c.path", F.lit("")) != "", F.col("c.path")).otherwise(F.when(offered, F.col("o.path")))
    return both.where("c IS NOT NULL").select(
        "content_root",
        F.nullif(path, F.lit("")).alias("path"),
        F.when(F.col("c.bytes") > 0, F.col("c.bytes")).otherwise(0).alias("size_bytes"),
        F.when(offered & (took >= 0), took).otherwise(0).alias("duration_ms"),
        from_millis("c.utc_ms").alias("received_at"),
    )


# --- decode queue -----------------------------------------------------------------------------


def pending(entries: DataFrame, acks: DataFrame) -> DataFrame:
    """Queue entries not acknowledged."""
    return entries.join(acks.select("seq"), "seq", "left_anti")


def parked(entries: DataFrame, acks: DataFrame, failures: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Pending entries that failed ``limit`` times or more."""
    tried = failures.groupBy("seq").agg(F.count(F.lit(1)).alias("attempts"))
    return pending(entries, acks).join(tried.where(F.col("attempts") >= limit), "seq")


def backlog(entries: DataFrame, acks: DataFrame, failures: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Per device: entries, pending, parked and bytes ever stored (the figure a quota looks at)."""
    tried = failures.groupBy("seq").agg((F.count(F.lit(1)) >= limit).alias("stuck"))
    done = acks.select("seq", F.lit(True).alias("done")).distinct()
    rows = entries.join(done, "seq", "left").join(tried, "seq", "left")
    waits = F.col("done").isNull()
    return rows.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(waits).alias("pending"),
        F.count_if(waits & F.coalesce("stuck", F.lit(False))).alias("parked"),
        F.sum("bytes_stored").alias("bytes_stored"),
    )


# --- audit ------------------------------------------------------------------------------------


def recent_activity(audit: DataFrame, since: str, limit: int, tie: str | None = None) -> DataFrame:
    """Audited requests from ``since`` on, newest first, without health probes."""
    order = [F.desc("ts"), *([F.desc(tie)] if tie else [])]
    seen = audit.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("route") != HEALTH_PROBE))
    client = F.when(F.coalesce("client_id", F.lit("")) != "", F.col("client_id")).otherwise(F.col("actor_id"))
    cols = ["ts", "actor_type", "transport", "route", "target_id", "status", "reason"]
    return seen.orderBy(*order).limit(limit).select(*cols, client.alias("client_id"))
