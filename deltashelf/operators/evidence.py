"""Official facts: what is new, what it may mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_type(kind: Column, withdrawn: Column, is_new: Column, region: Column, sku: Column, model: Column, linked: Column) -> Column:
    """Only new, current entries of a product database: a known product's region, a configuration, or an unknown model."""
    full = lambda c: c.isNotNull() & (c != "")
    current = (kind == "product_database") & ~F.coalesce(withdrawn, F.lit(False)) & F.coalesce(is_new, F.lit(False))
    return F.when(~F.coalesce(current, F.lit(False)), None).when(full(region) & linked.isNotNull(), "regional_product_evidence").when(full(sku), "new_configuration_evidence").when(linked.isNull() & full(model), "new_model_evidence")


def recent(published: Column, now: Column, days: int = 14) -> Column:
    """Published within the days before now, not in the future."""
    return F.coalesce((published > now - F.make_dt_interval(F.lit(days))) & (published <= now), F.lit(False))


def run_stats(items: DataFrame) -> DataFrame:
    """Per source: new, updated, unchanged, linked, unlinked, and events (all but unchanged)."""
    kind = F.col("change_kind")
    return items.groupBy("source").agg(*(F.count_if(kind == k).alias(f"n_{k}") for k in ("new", "updated", "unchanged")), F.count_if((kind != "unchanged") & F.col("linked_key").isNotNull()).alias("n_linked"), F.count_if((kind != "unchanged") & F.col("linked_key").isNull()).alias("n_unlinked"), F.count_if(kind != "unchanged").alias("n_events"))
