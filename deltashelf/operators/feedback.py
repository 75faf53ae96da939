"""What reviewers made of alerts: summary, breakdowns, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import collector_of
from ..functions.text import share
from ..schema import OUTCOMES

SIGNAL = ("HIT", "INTERESTING")


def outcome(name: str) -> Column:
    return F.count_if(F.col("outcome") == name)


def tallies() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *(outcome(x).alias(x.lower()) for x in OUTCOMES), F.count_if(F.col("outcome").isin(*SIGNAL)).alias("signal")]


def summary(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Totals, outcome counts, rates to four places (null over nothing), and signal to noise with a flag for no noise."""
    both = alerts.join(reviews.select(F.col("alert_id").alias("id"), "outcome"), "id", "left")
    one = both.agg(F.count(F.lit(1)).alias("total_alerts"), F.count("outcome").alias("reviewed"), *(outcome(x).alias(x.lower()) for x in OUTCOMES))
    signal = F.col("hit") + F.col("interesting")
    return one.select(
        "total_alerts",
        "reviewed",
        (F.col("total_alerts") - F.col("reviewed")).alias("unreviewed"),
        *(x.lower() for x in OUTCOMES),
        share(F.col("reviewed"), F.col("total_alerts")).alias("review_rate"),
        share(F.col("hit"), F.col("reviewed")).alias("hit_rate"),
        share(F.col("noise"), F.col("reviewed")).alias("noise_rate"),
        share(F.col("bug"), F.col("reviewed")).alias("bug_rate"),
        share(signal, F.col("reviewed")).alias("signal_rate"),
        share(signal, F.col("noise")).alias("signal_to_noise"),
        ((F.col("noise") == 0) & (signal > 0)).alias("signal_to_noise_infinite"),
    )


def with_manufacturer(alerts: DataFrame, listings: DataFrame) -> DataFrame:
    """Alerts with what the listing of their product says (manufacturer, model, url and more); the collector stands for an unknown manufacturer.

    listings: one row a product_key.
    """
    rows = alerts.join(listings, "product_key", "left")
    return rows.withColumn("manufacturer", F.coalesce("manufacturer", collector_of(F.col("product_key"))))


def breakdown(reviewed: DataFrame, by: Column, limit: int | None = None) -> DataFrame:
    """Tallies per value, largest first, ties by value."""
    out = reviewed.groupBy(by.alias("key")).agg(*tallies())
    out = out.withColumn("noise_rate", share(F.col("noise"), F.col("total")))
    return out.orderBy(F.desc("total"), "key").limit(limit) if limit else out


def by_reason(reviewed: DataFrame) -> DataFrame:
    """Each reason of a review counts once; reviews without any count under (none)."""
    codes = F.array_distinct(F.coalesce("reasons", F.array().cast("array<string>")))
    return breakdown(reviewed.withColumn("code", F.explode(F.when(F.size(codes) == 0, F.array(F.lit("(none)"))).otherwise(codes))), F.col("code"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < 0.2, "0.0-0.2").when(c < 0.4, "0.2-0.4").when(c < 0.6, "0.4-0.6").when(c < 0.8, "0.6-0.8").otherwise("0.8-1.0")


def ranking(groups: DataFrame, rate: Column, min_samples: int, top: int, ascending: bool = False) -> DataFrame:
    """The groups with enough samples by a rate, ties by total and key."""
    out = groups.filter(F.col("total") >= min_samples).withColumn("rate", rate)
    return out.orderBy(F.col("rate").asc() if ascending else F.col("rate").desc(), F.desc("total"), "key").limit(top)


def unreviewed(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    return alerts.join(reviews.select(F.col("alert_id").alias("id")), "id", "left_anti")
