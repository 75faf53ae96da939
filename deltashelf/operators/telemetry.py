"""Runs as they are planned, logged and summed, and the delivery of notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ("written", "unchanged", "skipped", "invalid")
RUN_HEALTH = ("ok", "degraded", "failed")


def planned(registry: DataFrame, only: str | None = None) -> DataFrame:
    """Sources (source, enabled) that a run takes: those enabled, or of them the one named."""
    rows = registry.filter(F.coalesce(F.col("enabled"), F.lit(False)))
    return rows if only is None else rows.filter(F.col("source") == only)


def run_stats(observations: DataFrame) -> DataFrame:
    """Counts of a run per source from what happened to each reference: source, fetched, result, n_events, error."""
    counts = [F.count_if(F.col("result") == r).alias(r) for r in RESULTS]
    return observations.groupBy("source").agg(F.count(F.lit(1)).alias("discovered"), F.count_if("fetched").alias("fetched"), *counts, F.sum(F.coalesce("n_events", F.lit(0))).cast("long").alias("events"), F.count("error").alias("errors"))


def run_totals(stats: DataFrame) -> DataFrame:
    """One row over all sources of a run."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return stats.agg(F.count(F.lit(1)).alias("sources"), total("written").alias("snapshots"), total("events").alias("events"), total("errors").alias("errors"))


def run_log(starts: DataFrame, ends: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Runs (id, source, started_at) with finished_at, status and the counts as JSON; all three are null for runs that have not ended."""
    done = ends.select("id", "finished_at", "status", F.to_json(F.struct(*stats)).alias("stats_json"))
    return starts.join(done, "id", "left")


def run_errors(ends: DataFrame) -> DataFrame:
    """A row per message of an ended run (id, errors)."""
    return ends.select(F.col("id").alias("run_id"), F.posexplode("errors").alias("nth", "message"))


def coverage(registry: DataFrame, latest_runs: DataFrame) -> DataFrame:
    """Per engine the number of sources (source, engine, oem), the makers, and how the sources' latest runs (source, health) fared."""
    rows = registry.join(latest_runs.select("source", "health"), "source", "left")
    fared = [F.count_if(F.col("health") == h).alias(h) for h in RUN_HEALTH]
    return rows.groupBy("engine").agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("oem").alias("oems"), *fared, F.count_if(F.col("health").isNull()).alias("never"))


def drained(outbox: DataFrame, answers: DataFrame, most: int = 5) -> DataFrame:
    """The outbox after a delivery of its pending rows in order of id.

    answers holds what the receiver says to each id: ok, error, at. A row that fails is tried again until it has
    failed `most` times before; the first answer of 429 ends the delivery, and later rows stay untouched. Rows
    without an answer were not reached.
    """
    rows = outbox.join(answers.select("id", "ok", "error", "at"), "id", "left")
    tried = (F.col("status") == "pending") & F.col("ok").isNotNull()
    limited = tried & ~F.col("ok") & F.coalesce(F.col("error").contains("429"), F.lit(False))
    stop = rows.agg(F.min(F.when(limited, F.col("id"))).alias("stop"))
    rows = rows.crossJoin(F.broadcast(stop))
    reached = tried & F.coalesce(F.col("id") <= F.col("stop"), F.lit(True))
    again = limited | (F.col("attempts") < most)
    status = F.when(~reached, F.col("status")).when(F.col("ok"), "sent").when(again, "pending").otherwise("failed")
    return rows.select(
        *(c for c in outbox.columns if c not in ("status", "attempts", "sent_at", "last_error")),
        status.alias("status"),
        (F.col("attempts") + reached.cast("int")).alias("attempts"),
        F.when(reached & F.col("ok"), F.col("at")).otherwise(F.col("sent_at")).alias("sent_at"),
        F.when(reached, F.when(~F.col("ok"), F.col("error"))).otherwise(F.col("last_error")).alias("last_error"),
    )
