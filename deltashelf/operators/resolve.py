"""Which earlier product or listing a record belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import same_product
from ..shared import dropped, release, stored
from .state import latest

NEWEST = ("last_seen", "id")


def resolve_prior(incoming: DataFrame, listings: DataFrame) -> DataFrame:
    """Same listing, else another listing with the vendor SKU, else one with the coarse model key unless vetoed.

    incoming: product_key, model, model_key, vendor_sku. listings: id, product_key, model, model_key,
    vendor_sku, last_seen, of which the newest per key counts (ties to the larger id). The model key is
    vetoed by two different SKUs or a differing tier word. Adds prior_key and relation.
    """
    newest = [F.col(c).desc() for c in NEWEST]
    same = listings.select("product_key", F.lit(True).alias("same")).distinct()
    sku = listings.filter("vendor_sku is not null and vendor_sku <> ''")
    # the two newest listings of a SKU suffice: at most one of them is the record's own
    ranked = sku.withColumn("rn", F.row_number().over(Window.partitionBy("vendor_sku").orderBy(*newest))).filter("rn <= 2")
    by_sku = ranked.groupBy("vendor_sku").agg(F.sort_array(F.collect_list(F.struct("rn", F.col("product_key").alias("k")))).alias("sku_keys"))
    by_model = latest(listings, ["model_key"], newest).select("model_key", F.col("product_key").alias("model_prior"), F.col("model").alias("prior_model"), F.col("vendor_sku").alias("prior_sku"))
    both = incoming.join(same, "product_key", "left").join(by_sku, "vendor_sku", "left").join(by_model, "model_key", "left")
    sku_prior = F.get(F.filter("sku_keys", lambda x: x["k"] != F.col("product_key")), F.lit(0))["k"]
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    veto = full("vendor_sku") & full("prior_sku") & (F.col("vendor_sku") != F.col("prior_sku"))
    model_prior = F.when(~F.coalesce(veto, F.lit(False)) & same_product(F.col("prior_model"), F.col("model")), F.col("model_prior"))
    prior = F.when(F.col("same"), F.col("product_key")).otherwise(F.coalesce(sku_prior, model_prior))
    relation = F.when(F.col("same"), "same_listing").when(prior.isNotNull(), "existing_product").otherwise("none")
    return both.select(*incoming.columns, prior.alias("prior_key"), relation.alias("relation"))


def link_evidence(items: DataFrame, listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact SKU, exact MPN, exact model, alias, within one manufacturer; else deliberately unlinked.

    items: manufacturer, sku, mpn, model. listings: manufacturer, vendor_sku, model, product_key,
    last_seen, id. aliases: manufacturer, alias, product_key. Adds linked_key and method.
    """
    newest = [F.col(c).desc() for c in NEWEST]
    norm = lambda c: F.lower(F.trim(c))
    by_sku = latest(listings.filter("vendor_sku <> ''"), ["manufacturer", "vendor_sku"], newest).select("manufacturer", "vendor_sku", F.col("product_key").alias("k"))
    by_model = latest(listings.withColumn("norm", norm("model")), ["manufacturer", "norm"], [F.col("id").asc()]).select("manufacturer", "norm", F.col("product_key").alias("model_k"))
    by_alias = aliases.groupBy("manufacturer", F.lower("alias").alias("norm")).agg(F.min("product_key").alias("alias_k"))
    out = items.withColumn("norm", norm("model"))
    out = out.join(by_sku.select("manufacturer", F.col("vendor_sku").alias("sku"), F.col("k").alias("sku_k")), ["manufacturer", "sku"], "left")
    out = out.join(by_sku.select("manufacturer", F.col("vendor_sku").alias("mpn"), F.col("k").alias("mpn_k")), ["manufacturer", "mpn"], "left")
    out = out.join(by_model, ["manufacturer", "norm"], "left").join(by_alias, ["manufacturer", "norm"], "left")
    method = F.when(F.col("sku_k").isNotNull(), "exact_sku").when(F.col("mpn_k").isNotNull(), "exact_mpn").when(F.col("model_k").isNotNull(), "exact_model_id").when(F.col("alias_k").isNotNull(), "alias").otherwise("none")
    return out.select(*items.columns, F.coalesce("sku_k", "mpn_k", "model_k", "alias_k").alias("linked_key"), method.alias("method"))


def unseen(components: DataFrame, known: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds is_unseen: the first sighting, in processing order, of a component that is not known. A null name can't be judged."""
    flags = known.select(name).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(name).orderBy(*order)) == 1
    return components.join(flags, name, "left").withColumn("is_unseen", F.when(F.col(name).isNotNull(), F.col("_known").isNull() & first)).drop("_known")


#: Rows of a key that one window holds at most. A key with more is cut into spans of so many orders, as a power of two.
HOT, SPAN = 1 << 20, 16
#: Rows that are sent to all tasks at most.
FEW = 50_000


def windowed(rows: DataFrame, key: list[str], order: Column, values: dict[str, Column]) -> DataFrame:
    """Adds, by name, each value's last one, nulls aside, of the key's rows of smaller order (a whole number, one row each)."""
    window = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.last(v, ignorenulls=True).over(window) for name, v in values.items()})


def earlier(rows: DataFrame, key: list[str], order: Column, values: dict[str, Column]) -> DataFrame:
    """As `windowed`, for keys of any number of rows.

    Windows hold at most 2^16 orders; what stands before each is handed on from one to the next, so no task takes a key.
    """
    of, ends = {n: f"_value_{n}" for n in values}, {n: f"_end_{n}" for n in values}
    rows = rows.withColumns({"_order": order} | {of[n]: v for n, v in values.items()}).withColumn("_span", F.shiftright("_order", SPAN))
    inside = Window.partitionBy(*key, "_span").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*key, "_span").agg(*(F.max_by(of[n], F.when(F.col(of[n]).isNotNull(), F.col("_order"))).alias(ends[n]) for n in values))
    last = last.withColumns({e: F.last(e, ignorenulls=True).over(along) for e in ends.values()})
    out = rows.withColumns({n: F.last(v, ignorenulls=True).over(inside) for n, v in of.items()}).join(last, [*key, "_span"], "left")
    return out.withColumns({n: F.coalesce(n, e) for n, e in ends.items()}).drop("_order", "_span", *of.values(), *ends.values())


def by_key(rows: DataFrame, key: str, steps: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """What steps make of a stored table's rows, by one window a key (`windowed`), but for keys of over HOT rows (`earlier`).

    Keys are counted one by one only in buckets with so many rows, and hot ones are so few that all tasks get them.
    """
    dealt = rows.select(key, F.pmod(F.xxhash64(key), F.lit(1 << 16)).alias("_bucket"))
    full = dealt.groupBy("_bucket").count().filter(F.col("count") > HOT).select("_bucket")
    if full.isEmpty():
        return steps(rows, windowed)
    hot = stored(dealt.join(F.broadcast(full), "_bucket", "left_semi").groupBy(key).count().filter(F.col("count") > HOT).select(key), "resolve-hot")
    plain = steps(rows.join(F.broadcast(hot), key, "left_anti"), windowed)
    return plain.unionByName(steps(rows.join(F.broadcast(hot), key, "left_semi"), earlier))


def resolve_in_order(incoming: DataFrame, listings: DataFrame) -> DataFrame:
    """What each record of a batch belongs to if records come one after the other and each sees the table and all before it.

    incoming: at (whole number, one a record), product_key, model, model_key, vendor_sku. listings as for
    resolve_prior, one row a product_key. Adds prior_key, relation, and prior_at: the record of the batch that was
    the prior's last one, null if that is the table's. A listing keeps the model key of its first record; its SKU is
    the last one that wasn't null; the prior's own SKU and model decide on vetoes. Empty SKUs lead nowhere.

    A record looks up what came just before it under its SKU, and under its model key. What has changed its
    SKU meanwhile is stepped over, to what came before that, until no such step is left. By listing, by SKU and by model key
    the records go through one exchange each, with no more columns than the step needs, and its files are let go before the next.
    """
    spark, own = incoming.sparkSession, ["at", "product_key", "model", "model_key", "vendor_sku"]

    def keep(rows: DataFrame, name: str) -> DataFrame:
        out = stored(rows, f"resolve-{name}", "zstd")
        release(spark)
        return out

    known = listings.select("product_key", F.col("model").alias("t_model"), F.col("model_key").alias("t_key"), F.col("vendor_sku").alias("t_sku"), "last_seen", "id")
    at = F.col("at")

    def listed(rows: DataFrame, look: Callable) -> DataFrame:
        rows = rows.join(known.select("product_key", "t_key", "t_sku", F.lit(True).alias("in_table")), "product_key", "left")
        rows = look(rows, ["product_key"], at, {"old_sku": F.col("vendor_sku"), "own_at": at})
        first = F.col("own_at").isNull()
        rows = look(rows, ["product_key"], at, {"_first": F.when(first, F.struct(F.col("model_key").alias("key")))})
        old = F.coalesce("old_sku", "t_sku")
        rows = rows.withColumn("sku", F.coalesce("vendor_sku", old)).withColumn("moved", F.when(~F.col("sku").eqNullSafe(old) & (F.col("in_table") | ~first), at))
        rows = look(rows, ["product_key"], -at, {"until": F.col("moved")})
        key = F.coalesce("t_key", F.when(first, F.col("model_key")).otherwise(F.col("_first.key")))
        leaves = F.when(F.col("in_table") & first, F.coalesce("moved", "until"))
        return rows.select(*own, "sku", key.alias("key"), "own_at", "until", leaves.alias("leaves"), (F.col("in_table").isNull() & first).alias("fresh"))

    batch = keep(incoming.select(own).filter("product_key is not null and at is not null"), "batch")
    rows = keep(by_key(batch, "product_key", listed), "rows")
    dropped(batch)

    # under each SKU: records, listings of the table that change theirs in this batch, and of the others the newest; of listings, only the first record of one that the table lacks looks elsewhere
    leaving = rows.filter("leaves is not null").select("product_key", F.col("leaves").alias("until"))
    table = known.filter("t_sku <> ''").join(leaving, "product_key", "left")
    nth = F.row_number().over(Window.partitionBy("t_sku").orderBy(F.desc("last_seen"), F.desc("id")))
    stays = table.filter("until is null").groupBy("t_sku").agg(F.max_by(F.struct("product_key", "last_seen", "id", "until"), F.struct("last_seen", "id")).alias("x")).select("t_sku", "x.*")
    table = table.filter("until is not null").select(*stays.columns).unionByName(stays).select(F.col("t_sku").alias("sku"), (-nth.cast("long")).alias("at"), "product_key", "until", F.lit(False).alias("asks"))
    under_sku = rows.filter("sku <> ''").select("sku", "at", "product_key", "until", (F.col("fresh") & F.coalesce(F.col("vendor_sku") != "", F.lit(False))).alias("asks")).unionByName(table)

    def followed(rows: DataFrame, look: Callable) -> DataFrame:
        rows = look(rows, ["sku"], at, {"back": at})
        rows = look(rows, ["sku"], at, {"before": F.struct("at", F.col("product_key").alias("k"), "until", "back")})
        return rows.withColumn("before", F.when(F.col("asks"), F.col("before")))

    placed = keep(by_key(under_sku, "sku", followed), "sku")
    open_, found = placed.filter("before is not null").select("sku", "at", "before"), None
    over = F.coalesce(F.col("before.until") <= at, F.lit(False))
    steps = []
    while True:
        done = open_.filter(~over).select("at", F.struct("before.at", "before.k").alias("by_sku"))
        found = done if found is None else found.unionByName(done)
        open_ = keep(open_.filter(over & F.col("before.back").isNotNull()).select("sku", "at", F.col("before.back").alias("_at")), "open")
        steps.append(open_)
        n = open_.count()
        if not n:
            break
        back = placed.select("sku", F.col("at").alias("_at"), F.struct("at", F.col("product_key").alias("k"), "until", "back").alias("before"))
        open_ = back.join(F.broadcast(open_) if n <= FEW else open_, ["sku", "_at"]).select("sku", "at", "before")
        if n > FEW:
            open_ = keep(open_, "open")
            steps.append(open_)
    found = keep(found, "found")
    dropped(placed, *steps)

    place = lambda k, sku, model: F.struct(at.alias("at"), k.alias("k"), sku.alias("sku"), model.alias("model"))
    names = ["key", *own, "fresh"]
    newest = known.filter("t_key is not null").groupBy(F.col("t_key").alias("key")).agg(F.max_by(F.struct("product_key", F.col("t_model").alias("model"), F.col("t_key").alias("model_key"), F.col("t_sku").alias("vendor_sku")), F.struct("last_seen", "id")).alias("x"))
    newest = newest.select("key", "x.*", F.lit(-1).cast("long").alias("at"), F.lit(False).alias("fresh"))
    under_key = rows.filter("key is not null").select(names).unionByName(newest.select(names))
    compared = lambda rows, look: look(rows, ["key"], at, {"by_key": place(F.col("product_key"), F.col("vendor_sku"), F.col("model"))}).filter("fresh").select(*own, "by_key")
    fresh = by_key(under_key, "key", compared)
    fresh = fresh.unionByName(rows.filter("fresh and key is null").select(own), allowMissingColumns=True).join(found, "at", "left")

    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    veto = full("vendor_sku") & full("by_key.sku") & (F.col("vendor_sku") != F.col("by_key.sku"))
    named = F.when(~veto & same_product(F.col("by_key.model"), F.col("model")), F.col("by_key"))
    prior = F.coalesce("by_sku.k", named["k"])
    prior_at = F.when(F.col("by_sku").isNotNull(), F.col("by_sku.at")).otherwise(named["at"])
    relation = F.when(prior.isNotNull(), "existing_product").otherwise("none")
    fresh = fresh.select(*own, prior.alias("prior_key"), relation.alias("relation"), F.when(prior_at >= 0, prior_at).alias("prior_at"))
    out = rows.filter(~F.col("fresh")).select(*own, F.col("product_key").alias("prior_key"), F.lit("same_listing").alias("relation"), F.col("own_at").alias("prior_at")).unionByName(fresh)
    added = ["prior_key", "relation", "prior_at"]
    return out.select(*incoming.columns, *added) if set(incoming.columns) <= set(own) else incoming.join(out.select("at", *added), "at")
