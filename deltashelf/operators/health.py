"""Collectors' health over their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import share
from ..schema import HealthThresholds
from .state import latest

BY_TIME = ("started_at", "id")


def catalogue_health(runs: DataFrame, limits: HealthThresholds = HealthThresholds(), strict: bool = False) -> DataFrame:
    """ok, degraded or failed of each run against the source's previous run that did not fail, with the reason.

    runs: id, source, started_at, status, discovered. strict keeps runs that were degraded from becoming the baseline.
    """
    past = Window.partitionBy("source").orderBy(*BY_TIME).rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("status") == "ok" if strict else F.col("status") != "failed", F.col("discovered"))
    out = runs.withColumn("previous", F.last(good, ignorenulls=True).over(past))
    n, before = F.col("discovered"), F.col("previous")
    part = n / F.nullif(before, F.lit(0))
    zero_bad = F.lit(limits.zero_fails) & (before.isNull() | (before > 0))
    health = F.when(n == 0, F.when(zero_bad, "failed").otherwise("ok")).when(part < limits.least_share, "failed").when(part < limits.warn_share, "degraded").otherwise("ok")
    reason = (
        F.when(n == 0, F.when(zero_bad, F.when(before > 0, "UNEXPECTED_ZERO").otherwise("NO_PREVIOUS_BASELINE")).otherwise("HEALTHY_CATALOG"))
        .when(part < limits.least_share, "CATALOG_FAILURE_THRESHOLD")
        .when(part < limits.warn_share, "CATALOG_WARN_THRESHOLD")
        .when(before.isNull(), "NO_PREVIOUS_BASELINE")
        .when((before > 0) & (before != n), "RECOVERED")
        .otherwise("HEALTHY_CATALOG")
    )
    return out.withColumn("catalog_share", F.round(part, 4)).withColumn("health", health).withColumn("health_reason", reason)


def latest_run(runs: DataFrame, status: str | None = None) -> DataFrame:
    rows = runs if status is None else runs.filter(F.col("status") == status)
    return latest(rows, ["source"], [F.col(c).desc() for c in BY_TIME])


def run_metrics(runs: DataFrame) -> DataFrame:
    """One row: run counts, failure rate, health of the latest runs, average catalogue and duration."""
    totals = runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"), F.round(F.avg((F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6), 2).alias("average_duration_s"))
    now = latest_run(runs).agg(*(F.count_if(F.col("health") == h).alias(f"currently_{h}") for h in ("ok", "degraded", "failed")), F.round(F.avg("discovered"), 1).alias("average_catalog_size"))
    return totals.crossJoin(F.broadcast(now)).withColumn("run_failure_rate", share(F.col("failed_runs"), F.col("total_runs")))


def stability(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of an engine's sources whose latest run was ok; sources that the registry lacks are left out."""
    return latest_run(runs).join(registry.select("source", "engine"), "source").groupBy("engine").agg(F.count(F.lit(1)).alias("sources"), F.round(F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)), 4).alias("stability"))


def due(registry: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Adds last_ok and is_due: never ok, or not since the source's interval."""
    last = runs.filter("status = 'ok'").groupBy("source").agg(F.max("started_at").alias("last_ok"))
    return registry.join(last, "source", "left").withColumn("is_due", F.col("last_ok").isNull() | (F.col("last_ok") <= now - F.make_dt_interval(secs=F.col("interval_s"))))


def signal_rates(events: DataFrame) -> DataFrame:
    """Events per day over the span of the log, one day at least."""
    span = F.greatest(F.lit(1.0), (F.unix_micros(F.max("detected_at").cast("timestamp")) - F.unix_micros(F.min("detected_at").cast("timestamp"))) / 86_400e6)
    one = events.agg(F.count(F.lit(1)).alias("total"), F.count_if("baseline").alias("baseline"), F.count_if("unseen").alias("unseen"), span.alias("days"))
    return one.select("total", "baseline", "unseen", F.round("days", 2).alias("span_days"), *(F.round(F.col(c) / F.col("days"), 2).alias(f"{c}_per_day") for c in ("total", "unseen")))


def runtime_state(runs: DataFrame | None, writable: bool) -> DataFrame:
    """One row: id, source, status and end of the last finished run whatever its status, the state by whether the run log exists and its folder can be written, and reasons.

    Neither is failed, one of them degraded; how the last run ended, or how long ago, doesn't count. Of runs that ended at once the last is that of
    the greatest id; without a finished run its columns are null.
    """
    state = F.lit("healthy" if runs is not None and writable else "failed" if runs is None and not writable else "degraded").alias("state")
    why = [] if writable else ["folder not writable"]
    if runs is None:
        none = (F.lit(None).cast(kind).alias(name) for name, kind in (("id", "bigint"), ("source", "string"), ("status", "string"), ("last_finished_run", "timestamp_ntz")))
        return SparkSession.active().range(1).select(*none, state, F.array(*map(F.lit, ["no run log", *why])).alias("reasons"))
    last = runs.filter("finished_at is not null").agg(F.max_by(F.struct("id", "source", "status", "finished_at"), F.struct("finished_at", "id")).alias("last"))
    reasons = F.array_compact(F.array(*map(F.lit, why), F.when(F.lit(not why) & F.col("last").isNull(), "no finished run")))
    return last.select("last.id", "last.source", "last.status", F.col("last.finished_at").alias("last_finished_run"), state, reasons.alias("reasons"))
