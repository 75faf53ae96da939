"""The reviewers' desk: reason codes, suggestions written by hand, list and feed filters, product briefs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import key_of
from ..functions.text import clip, six_digits
from ..schema import REASON_CODES, SUGGESTION_STATUSES
from .feedback import confidence_bucket, outcome
from .state import latest

NO_CODES = "array<string>"


def ordered_reasons(codes: Column) -> Column:
    """Reason codes once each in the order of the taxonomy; null gives none, an unknown code is an error."""
    known, codes = F.array(*map(F.lit, REASON_CODES)), F.coalesce(codes, F.array().cast(NO_CODES))
    odd = F.array_except(codes, known)
    error = F.raise_error(F.concat(F.lit("unknown reason code: "), F.coalesce(F.get(odd, F.lit(0)), F.lit("null")))).cast(NO_CODES)
    return F.when(F.size(odd) > 0, error).otherwise(F.filter(known, lambda c: F.array_contains(codes, c)))


def reasons_json(codes: Column) -> Column:
    return F.to_json(ordered_reasons(codes))


def reasons_of_json(raw: Column) -> Column:
    """Codes of a stored list; null and empty text give none, text that is no JSON list is an error."""
    parsed = F.from_json(raw, NO_CODES, {"mode": "FAILFAST"})
    return F.when(raw.isNull() | (raw == ""), F.array().cast(NO_CODES)).otherwise(ordered_reasons(parsed))


def one_of(c: Column, allowed: Sequence[str], what: str) -> Column:
    """The value, or an error where it is not among those allowed."""
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(c, F.lit("null")))).cast("string"))


def required(c: Column, most: int, what: str) -> Column:
    """The stripped text, or an error where it is missing or too long."""
    return F.coalesce(clip(c, most), F.raise_error(F.lit(f"{what} is required")).cast("string"))


def manual_suggestions(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Suggestions written by hand (collector, alert_type, reason_code, suggested_rule, status, created_at), checked and named by content; those the table has are left out.

    An empty reason code is none, a missing status PROPOSED; anything invalid is an error.
    """
    reason = F.nullif("reason_code", F.lit(""))
    rows = incoming.select(
        required(F.col("collector"), 128, "collector").alias("collector"),
        required(F.col("alert_type"), 64, "alert_type").alias("alert_type"),
        F.when(reason.isNotNull(), one_of(reason, REASON_CODES, "reason_code")).alias("reason_code"),
        required(F.col("suggested_rule"), 2000, "suggested_rule").alias("suggested_rule"),
        one_of(F.coalesce("status", F.lit("PROPOSED")), SUGGESTION_STATUSES, "status").alias("status"),
        "created_at",
    )
    rows = rows.withColumn("fingerprint", key_of(*map(F.col, ("collector", "alert_type", "reason_code", "suggested_rule"))))
    first = rows.groupBy("fingerprint").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "fingerprint")), F.struct("created_at", "status")).alias("r")).select("fingerprint", "r.*")
    return first.join(table.select("fingerprint"), "fingerprint", "left_anti")


def suggestion_list(rows: DataFrame, status: str | None = None, collector: str | None = None, alert_type: str | None = None, limit: int = 100, newest: Sequence[str] = ("id",)) -> DataFrame:
    """The newest suggestions that meet every filter given."""
    if status is not None and status not in SUGGESTION_STATUSES:
        raise ValueError(f"invalid rule suggestion status: {status!r}")
    for name, value in (("status", status), ("collector", collector), ("alert_type", alert_type)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(*(F.desc(c) for c in newest)).limit(limit)


def review_history(changes: DataFrame) -> DataFrame:
    """Each review change (id, alert_id, changed_at, outcome) with the outcome before it, in order of (changed_at, id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("alert_id").orderBy("changed_at", "id")
    return changes.withColumn("previous_outcome", F.lag("outcome").over(w)).withColumn("step", F.row_number().over(w))


def _has(words: str, *fields: str) -> Column:
    """Whether the fields, joined by blanks, hold the words, case aside; missing fields read empty."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))).contains(words.lower().strip())


def feed(rows: DataFrame, manufacturer: str | None = None, kind: str | None = None, severity: int = 0, review: str | None = None, words: str = "") -> DataFrame:
    """Alerts (manufacturer, change_type, severity, review_status, model, cpu, gpu, label) that meet every filter given.

    Severity 5 asks for just that, less for at least that; alerts without a review count as UNREVIEWED.
    """
    if manufacturer:
        rows = rows.filter(F.col("manufacturer") == manufacturer)
    if kind:
        rows = rows.filter(F.col("change_type") == kind)
    if severity:
        rows = rows.filter((F.col("severity") == 5) if severity == 5 else (F.col("severity") >= severity))
    if review:
        rows = rows.filter(F.coalesce("review_status", F.lit("UNREVIEWED")) == review)
    return rows.filter(_has(words, "model", "manufacturer", "cpu", "gpu", "label")) if words.strip() else rows


def signals(rows: DataFrame) -> DataFrame:
    """Alerts of severity 4 or more, or of a part not seen before."""
    return rows.filter((F.col("severity") >= 4) | F.coalesce(F.col("unseen"), F.lit(False)))


def evidence_feed(rows: DataFrame, manufacturer: str | None = None, kind: str | None = None, words: str = "") -> DataFrame:
    """Evidence (manufacturer, evidence_kind, model, title, family, external_id) that meets every filter given."""
    if manufacturer:
        rows = rows.filter(F.col("manufacturer") == manufacturer)
    if kind:
        rows = rows.filter(F.col("evidence_kind") == kind)
    return rows.filter(_has(words, "model", "title", "family", "external_id", "manufacturer")) if words.strip() else rows


def product_brief(snapshots: DataFrame, order: Sequence[str]) -> DataFrame:
    """Display facts of each product_key's latest snapshot (records of schema.PRODUCT): first price and image, number of configurations, whether its processor is new."""
    now = latest(snapshots, ["product_key"], [F.col(c).desc() for c in order])
    price = F.get("prices", F.lit(0))
    return now.select(
        "product_key", "manufacturer", "model", F.col("cpu.raw").alias("cpu"), F.coalesce(F.col("cpu.known") == F.lit(False), F.lit(False)).alias("cpu_unseen"), F.col("gpu.raw").alias("gpu"), "memory", "storage",
        F.concat(six_digits(price["amount"]), F.lit(" "), price["currency"]).alias("price"), price["region"].alias("region"), F.get("images", F.lit(0)).alias("image"), "url", "confidence", F.coalesce(F.size("configurations"), F.lit(0)).alias("configs"),
    )


def by_confidence(alerts: DataFrame, reviews: DataFrame, snapshots: DataFrame, order: Sequence[str]) -> DataFrame:
    """Alerts, reviewed or not, by the confidence of their product's latest snapshot (product_key, confidence), unknown without one."""
    now = latest(snapshots, ["product_key"], [F.col(c).desc() for c in order]).select("product_key", "confidence")
    rows = alerts.join(now, "product_key", "left").join(reviews.select(F.col("alert_id").alias("id"), "outcome"), "id", "left")
    return rows.groupBy(confidence_bucket(F.col("confidence")).alias("key")).agg(F.count(F.lit(1)).alias("total"), F.count("outcome").alias("reviewed"), *(outcome(x).alias(x.lower()) for x in ("HIT", "INTERESTING", "NOISE", "BUG")))
