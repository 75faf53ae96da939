"""What is new against what was known, region by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_items(current: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return current.join(known.select(*key), key, "left_anti")


def elsewhere(current: DataFrame, known: DataFrame, identity: str, region: str) -> DataFrame:
    """Adds seen_elsewhere: whether the identity is known in another region.

    The least and greatest known region of an identity decide, so no pairs are made.
    """
    spans = known.groupBy(identity).agg(F.min(region).alias("_lo"), F.max(region).alias("_hi"))
    other = (F.col("_lo") != F.col(region)) | (F.col("_hi") != F.col(region))
    return current.join(spans, identity, "left").withColumn("seen_elsewhere", F.coalesce(other, F.lit(False))).drop("_lo", "_hi")


def token(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[ -]", "")


def presence(items: DataFrame, name: str, known: list[str]) -> DataFrame:
    """Adds presence: yes if a known token holds the item's or is held by it; unknown without tokens or text. known is a configured list."""
    own = token(F.col(name))
    hit = F.lit(False)
    for k in known:
        t = k.upper().replace(" ", "").replace("-", "")
        hit = hit | own.contains(t) | F.lit(t).contains(own)
    return items.withColumn("presence", F.when(F.lit(not known) | own.isNull() | (own == ""), "unknown").when(hit, "yes").otherwise("no"))


def guarded(counts: DataFrame, key: list[str], order: list[str], least: float = 0.35) -> DataFrame:
    """Adds previous (the last safe count before) and unsafe: nothing found, or too little of the previous run's."""
    past = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("previous", F.last(F.when(F.col("n") > 0, F.col("n")), ignorenulls=True).over(past))
    return out.withColumn("unsafe", (F.col("n") == 0) | F.coalesce(F.col("n") / F.col("previous") < least, F.lit(False)))


def removed(listings: DataFrame, runs: DataFrame, passes: int = 2) -> DataFrame:
    """Extension: listings that none of the source's last full passes saw. listings: source, product_key, last_seen."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id")))
    since = runs.filter("status = 'ok'").withColumn("_rn", nth).filter(F.col("_rn") == passes).select("source", F.col("started_at").alias("since"))
    return listings.join(since, "source").filter("last_seen < since")
