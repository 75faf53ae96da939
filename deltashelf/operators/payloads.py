"""Whole payloads: an alert or a piece of evidence with all that belongs to it, cards, and the summary of everything."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import collector_of
from .resolve import SPAN
from .state import neighbours

#: What a receiver of cards takes at most.
TITLE, VALUE, FOOTER, FIELDS = 256, 1024, 2048, 25


def before(rows: DataFrame, key: str, order: str, value: Column, most: int, name: str) -> DataFrame:
    """Adds the values of the key's last rows before each (order: whole numbers, one a row), the latest first, `most` of them.

    Windows hold at most 2^16 orders of a key; the last rows of those before are handed on, so no task takes a key.
    """
    rows = rows.withColumns({"_value": value, "_span": F.shiftright(order, SPAN)})
    inside = Window.partitionBy(key, "_span").orderBy(order)
    last = F.row_number().over(Window.partitionBy(key, "_span").orderBy(F.desc(order)))
    own = F.reverse(F.collect_list("_value").over(inside.rowsBetween(-most, -1)))
    along = Window.partitionBy(key).orderBy("_span").rowsBetween(-most, -1)
    tails = rows.withColumn("_rn", last).filter(F.col("_rn") <= most).groupBy(key, "_span").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_value").alias("v"))), asc=False).alias("_tail"))
    # of each span before the last rows, so that of as many spans as rows are asked for enough come together
    tails = tails.withColumn("_past", F.slice(F.sort_array(F.flatten(F.collect_list("_tail").over(along)), asc=False), 1, most)).select(F.col(key).alias("_key"), F.col("_span").alias("_at"), F.transform("_past", lambda x: x["v"]).alias("_past"))
    out = rows.withColumn("_own", own).join(tails, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at")), "left")
    return out.withColumn(name, F.slice(F.concat("_own", F.coalesce("_past", F.array().cast(out.schema["_own"].dataType))), 1, most)).drop("_value", "_span", "_own", "_past", "_key", "_at")


def alert_details(events: DataFrame, briefs: DataFrame, sources: DataFrame, reviews: DataFrame, history: DataFrame, related: int = 10) -> DataFrame:
    """Each alert with its product's facts, its source, the last alerts of its product before it, its review and that one's history, and its neighbours.

    events: id, product_key, change_type and more. briefs: desk.product_brief. sources: source, engine, base_url. reviews: alert_id, outcome
    and more, one an alert. history: alert_id, changed_at, id and more. Adds collector, engine, source_base_url, related_events (latest first), review, review_status,
    history (by time), prev_id, next_id.
    """
    told = [c for c in events.columns if c != "product_key"]
    rows = before(events, "product_key", "id", F.struct(*told), related, "related_events")
    packed = lambda d, key: F.struct(*(F.col(c) for c in d.columns if c != key))
    past = history.groupBy(F.col("alert_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("changed_at", "id", packed(history, "alert_id").alias("entry")))).alias("h")).select("id", F.transform("h", lambda x: x["entry"]).alias("history"))
    now = reviews.select(F.col("alert_id").alias("id"), packed(reviews, "alert_id").alias("review"))
    rows = rows.withColumn("collector", collector_of(F.col("product_key"))).join(briefs.drop(*(set(briefs.columns) & (set(events.columns) - {"product_key"}))), "product_key", "left")
    rows = rows.join(sources.select(F.col("source").alias("collector"), "engine", F.col("base_url").alias("source_base_url")), "collector", "left")
    rows = rows.join(now, "id", "left").join(past, "id", "left").join(neighbours(events, "id"), "id", "left")
    empty = F.array().cast(past.schema["history"].dataType)
    return rows.withColumns({"history": F.coalesce("history", empty), "review_status": F.coalesce("review.outcome", F.lit("UNREVIEWED"))})


def evidence_details(items: DataFrame, links: DataFrame, briefs: DataFrame, events: DataFrame) -> DataFrame:
    """Each piece of evidence with its links to products, and their facts, the events it had, and its neighbours; no severity and no review.

    items: id and more. links: id, item_id, product_key, method and more. events: id, item_id, event_type and more. Adds links, history (both by id), prev_id, next_id.
    """
    facts = links.join(briefs.select("product_key", "model", "manufacturer", "url"), "product_key", "left")
    listed = lambda d, name: d.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", F.struct(*(F.col(c) for c in d.columns if c not in ("id", "item_id"))).alias("x")))).alias(name))
    rows = items.join(neighbours(items, "id"), "id", "left")
    for d, name in ((facts, "links"), (events, "history")):
        own = listed(d, name).withColumn(name, F.transform(name, lambda x: x["x"]))
        rows = rows.join(own, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return rows


def recorded(events: DataFrame, kinds: Sequence[str] = ("added", "updated"), kind: str = "event_type") -> DataFrame:
    """Evidence events as they are; an error for a type that isn't one."""
    return events.withColumn(kind, F.when(F.col(kind).isin(*kinds), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown evidence event: "), F.coalesce(F.col(kind), F.lit("null")))).cast("string")))


def product_evidence(bodies: DataFrame, source: str, manufacturer: str, withdrawn: bool = False) -> DataFrame:
    """Records of a product database (url, body) as evidence; malformed ones, those without key or id, and withdrawn ones (unless asked for) are left out."""
    v = F.try_parse_json("body")
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    rows = bodies.select("url", get("ProductKey").alias("key"), get("ProductID").alias("external_id"), get("ProductName").alias("model"), get("_series").alias("family"), F.coalesce(get("Withdraw").isin("1", "true"), F.lit(False)).alias("withdrawn"))
    rows = rows.filter((F.coalesce("key", F.lit("")) != "") & F.col("external_id").isNotNull())
    rows = rows if withdrawn else rows.filter(~F.col("withdrawn"))
    state = F.when(F.col("withdrawn"), "discontinued").otherwise("current")
    return rows.select(F.lit(manufacturer).alias("manufacturer"), F.lit(source).alias("source_id"), F.lit("product_database").alias("evidence_kind"), F.col("url").alias("canonical_url"), "external_id", "model", "family", F.col("model").alias("title"), state.alias("state"))


def decorated(events: DataFrame, seen_before: DataFrame, hidden: DataFrame, unseen: DataFrame, relation: str = "relation") -> DataFrame:
    """Events as they are told: baseline for sources without a finished run, and of new products whether the listing was hidden or a part unseen, and a second listing of a known product as such.

    events: source, product_key, change_type, severity, relation. seen_before: source. hidden, unseen: product_key. A relabelled listing has severity 2.
    """
    flag = lambda d, key, name: d.select(key).distinct().withColumn(name, F.lit(True))
    rows = events.join(flag(seen_before, "source", "_known"), "source", "left").join(flag(hidden, "product_key", "_hidden"), "product_key", "left").join(flag(unseen, "product_key", "_unseen"), "product_key", "left")
    new = F.col("change_type") == "new_product"
    second = new & (F.col(relation) == "existing_product")
    marks = {"baseline": F.col("_known").isNull(), "hidden": new & F.col("_hidden").isNotNull(), "unseen_component": new & F.col("_unseen").isNotNull(), "severity": F.when(second, 2).otherwise(F.col("severity")), "change_type": F.when(second, "duplicate_listing").otherwise(F.col("change_type"))}
    return rows.withColumns(marks).drop("_known", "_hidden", "_unseen")


def in_range(at: Column, start: str | None, end: str | None) -> Column:
    """Whether a time lies at or after start and before end, each an ISO date or time or open; a start or end of another form is an error here."""
    import datetime as dt

    test = F.lit(True)
    for value, compare in ((start, lambda x: at >= x), (end, lambda x: at < x)):
        if value:
            try:
                t = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
            except (ValueError, AttributeError) as e:
                raise ValueError(f"not an ISO date or time: {value!r}") from e
            t = t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t
            test = test & compare(F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz"))
    return F.coalesce(test, F.lit(False))


def stars(severity: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), severity), F.repeat(F.lit("☆"), 5 - severity))


def cards(alerts: DataFrame, review_url: str | None = None) -> DataFrame:
    """Cards of alerts (id, change_type, field, old_value, new_value, severity, product_key, hidden, manufacturer, model, cpu, cpu_known, gpu, memory, storage, price, confidence): id, title, fields, footer.

    fields are structs of name and value in a fixed order; those without a value are left out. Longer texts and more fields than a receiver takes are cut.
    """
    c = F.col
    line = lambda name, value, test=None: F.when(value.isNotNull() if test is None else test & value.isNotNull(), F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.left(value, F.lit(VALUE)).alias("value")))
    percent = F.concat(F.bround(c("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    cpu = F.concat(c("cpu"), F.when(c("cpu_known") == F.lit(False), " (unseen before)").when(c("cpu_known").isNull(), " (not recognized)").otherwise(""))
    change = F.concat(c("old_value"), F.lit(" → "), F.coalesce("new_value", F.lit("None")))
    fields = F.array_compact(F.array(
        line("CPU", cpu), line("GPU", c("gpu")), line("Memory", c("memory")), line("Storage", c("storage")), line("Price", c("price")), line(F.concat(F.lit("Changed: "), c("field")), change, c("field").isNotNull()), line("Severity", stars(c("severity"))),
        line("Discovery", F.lit("hidden listing"), F.coalesce("hidden", F.lit(False))), line("Parse confidence", percent, c("confidence") < 0.8), line("Collector", collector_of(c("product_key"))), line("Alert type", c("change_type")), line("Confidence", percent),
    ))
    title = F.concat_ws(" — ", F.upper(F.replace("change_type", F.lit("_"), F.lit(" "))), F.nullif(F.concat_ws(" ", "manufacturer", "model"), F.lit("")))
    link = F.lit(None).cast("string") if review_url is None else F.concat(F.lit(f"Review: {review_url.rstrip('/')}/alerts/"), c("id").cast("string"))
    footer = F.concat_ws(" · ", F.concat(F.lit("Alert ID: "), c("id").cast("string")), link)
    return alerts.select("id", F.left(title, F.lit(TITLE)).alias("title"), F.slice(fields, 1, FIELDS).alias("fields"), F.left(footer, F.lit(FOOTER)).alias("footer"))


def summary(counts: Mapping[str, DataFrame], last_run: DataFrame) -> DataFrame:
    """One row: the number of rows of each named table, and the start of the last good run (runs: id, started_at, status)."""
    parts = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", F.lit(None).cast("timestamp_ntz").alias("at"))
        parts = one if parts is None else parts.unionByName(one)
    run = last_run.filter("status = 'ok'").agg(F.max_by("started_at", "id").alias("at")).select(F.lit("last_run").alias("name"), F.lit(None).cast("long").alias("n"), F.col("at").cast("timestamp_ntz").alias("at"))
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
    return parts.unionByName(run).agg(*map(value, counts), F.max("at").alias("last_run"))
