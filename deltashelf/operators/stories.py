"""Events that several manufacturers show within a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import key_of
from ..schema import StoryRule
from .rules import matches


def matching(events: DataFrame, rules: Sequence[StoryRule], timed: bool = False) -> DataFrame:
    """The events of each enabled rule that match it and have a value to group by: rule_id, key, manufacturer, product_key, detected_at, id, and the rule's window.

    timed ties the test to the time, so that it stays behind a watermark and that sees all events.
    """
    parts = None
    for rule in (r for r in rules if r.enabled):
        attributes = {c: F.col(c) for c in events.columns}
        key = F.col(rule.group_by).cast("string")
        test = matches(rule.match, attributes) & key.isNotNull() & (key != "")
        got = events.filter(F.when(test, F.col("detected_at")).isNotNull() if timed else test).select(F.lit(rule.id).alias("rule_id"), key.alias("key"), "manufacturer", "product_key", "detected_at", "id", F.lit(rule.window_days).alias("window_days"))
        parts = got if parts is None else parts.unionByName(got)
    return parts


def evidence(events: DataFrame, rules: Sequence[StoryRule], now: Column) -> DataFrame:
    """The earliest event of each (rule, key, manufacturer) inside the rule's window.

    events: id, product_key, manufacturer, detected_at and the attributes that rules name.
    """
    inside = matching(events, rules).filter(F.col("detected_at") >= now - F.make_dt_interval("window_days")).drop("window_days")
    first = F.row_number().over(Window.partitionBy("rule_id", "key", "manufacturer").orderBy("detected_at", "id"))
    return inside.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def scored(groups: DataFrame, rules: Sequence[StoryRule]) -> DataFrame:
    """Of groups (rule_id, key, n_manufacturers, manufacturers and more) those that make a story, with score (100 at most) and dedup key."""
    score = least = F.lit(None).cast("int")
    for r in rules:
        n = F.col("n_manufacturers")
        least = F.when(F.col("rule_id") == r.id, r.min_manufacturers).otherwise(least)
        score = F.when(F.col("rule_id") == r.id, F.least(F.lit(100), r.base_score + (n - r.min_manufacturers) * r.per_extra)).otherwise(score)
    return groups.filter(F.col("n_manufacturers") >= least).withColumn("score", score.cast("long")).withColumn("dedup_key", key_of(F.col("rule_id"), F.col("key"), F.col("manufacturers")))


def detect(events: DataFrame, rules: Sequence[StoryRule], now: Column) -> DataFrame:
    """Stories: rule, key, manufacturers, number, score (100 at most), first and last evidence, dedup key."""
    groups = evidence(events, rules, now).groupBy("rule_id", "key").agg(F.count(F.lit(1)).alias("n_manufacturers"), F.array_join(F.array_sort(F.collect_set("manufacturer")), ",").alias("manufacturers"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"))
    return scored(groups, rules)
