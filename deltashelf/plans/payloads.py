"""Payloads of alerts and evidence, cards, the summary, and small reports over runs and stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import desk, health, normalize, payloads, state
from ..schema import SUGGESTION_STATUSES
from ..shared import scratch
from ..sources import captured
from ..streaming import ingest
from . import intake, reviews, views
from .views import Queries, sql, table

Q = Queries()

BRIEF_SQL = "b AS (SELECT 'src-' || (c_custkey % 12) || ':p' || c_custkey AS product_key, c_name AS model, c_mktsegment AS manufacturer FROM customer)"


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    key = F.concat(F.lit("src-"), (k % 12).cast("string"), F.lit(":p"), k.cast("string"))
    rows = table(spark, sf_dir, "customer").select(key.alias("product_key"), "c_name", "c_mktsegment", "c_acctbal")
    record = intake.record(product_key=F.col("product_key"), model=F.col("c_name"), manufacturer=F.col("c_mktsegment"), url=F.concat(F.lit("https://x.test/"), "product_key"), confidence=F.lit(1.0))
    return desk.product_brief(rows.select(record.alias("r"), F.lit(1).alias("seq")).select("r.*", "seq"), ["seq"])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.events(spark, sf_dir).filter("id % 3 = 0")
    each = e.select(F.col("id").alias("alert_id"), "detected_at", F.explode(F.sequence(F.lit(1), F.col("id") % 4 + 1)).alias("n"))
    return each.select("alert_id", (F.col("alert_id") * 10 + F.col("n")).alias("id"), (F.col("detected_at") + F.make_dt_interval(hours=(F.col("n") * 7 % 5).cast("int"))).alias("changed_at"), F.concat(F.lit("o"), F.col("n").cast("string")).alias("new_outcome"))


@Q.add(sql(f"""SELECT e.id, b.model, b.manufacturer, e.collector, 'engine-' || (e.user_id % 12 % 5) AS engine, coalesce(list_aggregate(r.ids, 'string_agg', ','), '') AS related, coalesce(v.outcome, 'UNREVIEWED') AS review_status, coalesce(h.said, '') AS history, lag(e.id) OVER (ORDER BY e.id) AS prev_id, lead(e.id) OVER (ORDER BY e.id) AS next_id
FROM v_events e LEFT JOIN b USING (product_key) LEFT JOIN v_reviews v ON v.alert_id = e.id
LEFT JOIN (SELECT id, [x FOR x IN list_reverse(list(id) OVER (PARTITION BY product_key ORDER BY id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))] AS ids FROM v_events) r ON r.id = e.id
LEFT JOIN (SELECT id, string_agg('o' || n, ',' ORDER BY detected_at + INTERVAL 1 HOUR * (n * 7 % 5), n) AS said FROM (SELECT id, detected_at, unnest(range(1, id % 4 + 2)) AS n FROM v_events WHERE id % 3 = 0) GROUP BY id) h ON h.id = e.id""", "v_events", "v_reviews").replace("\nSELECT e.id, b.model", f", {BRIEF_SQL}\nSELECT e.id, b.model", 1))
def alert_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.events(spark, sf_dir)
    n = F.substring("source", 5, 10).cast("int")
    sources = e.select(F.col("collector").alias("source")).distinct().select("source", F.concat(F.lit("engine-"), (n % 5).cast("string")).alias("engine"), F.concat(F.lit("https://"), "source").alias("base_url"))
    got = payloads.alert_details(e.select("id", "product_key", "change_type", "detected_at"), briefs(spark, sf_dir), sources, views.reviews(spark, sf_dir), history(spark, sf_dir))
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return got.select("id", "model", "manufacturer", "collector", "engine", joined("related_events", "id").alias("related"), "review_status", joined("history", "new_outcome").alias("history"), "prev_id", "next_id")


@Q.add(f"""WITH {BRIEF_SQL}, l AS (SELECT page_id, string_agg(m, ',' ORDER BY j) AS links FROM (SELECT page_id, j, CASE j WHEN 0 THEN 'exact_sku' ELSE 'alias' END || '=' || coalesce(model, '') AS m FROM (SELECT page_id, unnest([0, 1]) AS j, page_id % 1000 AS k FROM pages WHERE page_id % 3 > 0) LEFT JOIN b ON b.product_key = 'src-' || ((k + j) % 12) || ':p' || (k + j)) GROUP BY page_id)
SELECT page_id AS id, url, coalesce(links, '') AS links, 'added' || CASE WHEN page_id % 4 = 0 THEN ',updated' ELSE '' END AS history, lag(page_id) OVER (ORDER BY page_id) AS prev_id, lead(page_id) OVER (ORDER BY page_id) AS next_id FROM pages LEFT JOIN l USING (page_id)""")
def evidence_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    k = F.col("item_id") % 1000 + F.col("j")
    links = p.filter("id % 3 > 0").select(F.col("id").alias("item_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    links = links.select((F.col("item_id") * 2 + F.col("j")).alias("id"), "item_id", F.concat(F.lit("src-"), (k % 12).cast("string"), F.lit(":p"), k.cast("string")).alias("product_key"), F.when(F.col("j") == 0, "exact_sku").otherwise("alias").alias("method"))
    told = p.select(F.col("id").alias("item_id"), F.explode(F.when(F.col("id") % 4 == 0, F.array(F.lit("added"), F.lit("updated"))).otherwise(F.array(F.lit("added")))).alias("event_type"))
    told = payloads.recorded(told.select((F.col("item_id") * 2 + (F.col("event_type") == "updated").cast("int")).alias("id"), "item_id", "event_type"))
    got = payloads.evidence_details(p, links, briefs(spark, sf_dir), told)
    shown = F.transform("links", lambda x: F.concat(x["method"], F.lit("="), F.coalesce(x["model"], F.lit(""))))
    return got.select("id", "url", F.array_join(shown, ",").alias("links"), F.array_join(F.transform("history", lambda x: x["event_type"]), ",").alias("history"), "prev_id", "next_id")


@Q.add(sql("""SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM v_events WHERE NOT baseline) AS events, (SELECT count(*) FROM v_events WHERE baseline) AS baseline_events, (SELECT count(*) FROM v_snapshots) AS snapshots, (SELECT count(*) FROM pages) AS evidence_items, (SELECT count(*) FROM part WHERE p_size > 45) AS unseen_components,
 (SELECT count(DISTINCT p_brand) FROM part) AS manufacturers, (SELECT count(*) FROM v_events WHERE NOT baseline AND k % 9 = 1) AS pending_notifications, (SELECT count(*) FROM v_events e WHERE NOT baseline AND NOT EXISTS (SELECT 1 FROM v_reviews r WHERE r.alert_id = e.id)) AS unreviewed_events, (SELECT count(DISTINCT source) FROM v_runs) AS enabled_sources,
 (SELECT count(*) FROM h2 WHERE health = 'degraded') AS degraded_collectors, (SELECT count(*) FROM h2 WHERE health = 'failed') AS failed_collectors, (SELECT count(*) FROM v_events WHERE k = 5) AS proposed_suggestions, (SELECT count(*) FROM st) AS stories, (SELECT arg_max(started_at, id) FROM v_runs WHERE status = 'ok') AS last_run""", "v_events", "v_reviews", "v_snapshots", "v_runs").replace("\nSELECT (SELECT", f", {reviews.STORY_SQL}, {reviews.HEALTH_SQL}, h2 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1)\nSELECT (SELECT", 1))
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the summary, each over its own table."""
    e, part, runs = views.events(spark, sf_dir), table(spark, sf_dir, "part"), views.runs(spark, sf_dir)
    shown = e.filter("not baseline")
    latest = health.latest_run(health.catalogue_health(runs))
    return payloads.summary({
        "products": part, "events": shown, "baseline_events": e.filter("baseline"), "snapshots": views.snapshots(spark, sf_dir), "evidence_items": table(spark, sf_dir, "pages"), "unseen_components": part.filter("p_size > 45"), "manufacturers": part.select("p_brand").distinct(),
        "pending_notifications": shown.filter("k % 9 = 1"), "unreviewed_events": shown.join(views.reviews(spark, sf_dir), F.col("id") == F.col("alert_id"), "left_anti"), "enabled_sources": runs.select("source").distinct(), "degraded_collectors": latest.filter("health = 'degraded'"),
        "failed_collectors": latest.filter("health = 'failed'"), "proposed_suggestions": e.filter("k = 5"), "stories": reviews.stories.detect(reviews.story_events(spark, sf_dir), reviews.STORY_RULES, reviews.now()),
    }, runs)


@Q.add(sql("""SELECT id, left(upper(replace(change_type, '_', ' ')) || ' — ' || product_key || ' ' || repeat('long name ', k), 256) AS title, len(f)::INTEGER AS n_fields, array_to_string(f, '|') AS fields, 'Alert ID: ' || id || ' · Review: http://r/alerts/' || id AS footer FROM (SELECT *, list_filter([CASE WHEN k % 3 > 0 THEN 'CPU=c' || CASE k % 3 WHEN 1 THEN ' (unseen before)' ELSE ' (not recognized)' END END,
 CASE WHEN k % 2 = 0 THEN 'Changed: memory=' || left(repeat('8 GB,', k * 5) || ' → ' || '16 GB', 1024) END, 'Severity=' || repeat('★', s) || repeat('☆', 5 - s), CASE WHEN k % 7 = 0 THEN 'Discovery=hidden listing' END, CASE WHEN k < 80 THEN 'Parse confidence=' || k || '%' END, 'Collector=' || collector, 'Alert type=' || change_type, 'Confidence=' || k || '%'], lambda x: x IS NOT NULL) AS f
FROM (SELECT *, k % 5 + 1 AS s FROM v_events))""", "v_events"))
def notification_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    none = F.lit(None).cast("string")
    alerts = views.events(spark, sf_dir).select("id", "change_type", F.when(k % 2 == 0, "memory").alias("field"), F.repeat(F.lit("8 GB,"), k * 5).alias("old_value"), F.lit("16 GB").alias("new_value"), (k % 5 + 1).alias("severity"), "product_key", (k % 7 == 0).alias("hidden"), F.col("product_key").alias("manufacturer"), F.repeat(F.lit("long name "), k).alias("model"), F.when(k % 3 > 0, "c").alias("cpu"), F.when(k % 3 == 1, False).alias("cpu_known"), none.alias("gpu"), none.alias("memory"), none.alias("storage"), none.alias("price"), (k / 100).alias("confidence"))
    shown = F.transform("fields", lambda x: F.concat(x["name"], F.lit("="), x["value"]))
    return payloads.cards(alerts, "http://r/").select("id", "title", F.size("fields").alias("n_fields"), F.array_join(shown, "|").alias("fields"), "footer")


@Q.add("""WITH c AS (SELECT 'c' || (p_partkey % 500) AS handle, min(p_partkey) AS first_id FROM part WHERE p_size > 20 GROUP BY 1), m AS (SELECT DISTINCT 'c' || (p_partkey % 700) AS handle FROM part)
SELECT handle, first_id, false AS hidden FROM c UNION ALL SELECT handle, NULL, true FROM m WHERE handle NOT IN (SELECT handle FROM c)""")
def hidden_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    handle = lambda n: F.concat(F.lit("c"), (F.col("p_partkey") % n).cast("string")).alias("handle")
    return captured.with_hidden(p.filter("p_size > 20").groupBy(handle(500)).agg(F.min("p_partkey").alias("first_id")), p.select(handle(700)).distinct())


@Q.add("SELECT o_custkey AS key, arg_max(o_totalprice, (s, o_orderkey)) AS amount, arg_max(s, (s, o_orderkey)) AS batch FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS s FROM orders) GROUP BY o_custkey")
def upsert_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = lambda d, n: d.select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("amount"), F.lit(n).alias("batch"))
    old = state.latest(rows(o.filter("o_orderstatus = 'F'"), 0), ["key"], [F.desc("o_orderkey")])
    return state.upsert(old, rows(o.filter("o_orderstatus <> 'F'"), 1), ["key"], ["o_orderkey"]).select("key", "amount", "batch")


@Q.add("""WITH s AS (SELECT p_name AS canonical_name, p_partkey AS seen_at, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS batch FROM part WHERE p_partkey % 8 > 0)
SELECT canonical_name, arg_min(seen_at, (batch, seen_at)) AS seen_at, min(batch)::BIGINT AS batch FROM s GROUP BY 1""")
def components_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in the batch that first saw them, over three batches of which the second comes twice."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 8 > 0, F.col("p_name")).alias("canonical_name"), F.col("p_partkey").alias("seen_at"), "p_size")
    tables = ingest.Tables(spark, scratch(spark, "components"))
    parts = [p.filter("p_size < 10"), p.filter("p_size >= 10 and p_size < 30"), p.filter("p_size >= 30")]
    for n in (0, 1, 1, 2):
        ingest.learned(tables, parts[n].drop("p_size"), n)
    return tables.read("components").select("canonical_name", "seen_at", F.col("batch").cast("long").alias("batch"))


@Q.add("""WITH b AS (SELECT s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, s_suppkey FROM supplier), p AS (SELECT *, pos // 3 + 1 AS page FROM b WHERE NOT (n % 4 = 0 AND pos % 3 = 2 AND pos // 3 = 0)), short AS (SELECT n, min(page) AS stop FROM (SELECT n, page FROM p GROUP BY ALL HAVING count(*) < 3) GROUP BY n)
SELECT n::VARCHAR AS source, page::INTEGER AS page, s_suppkey AS id FROM p LEFT JOIN short USING (n) WHERE page <= 20 AND (stop IS NULL OR page <= stop)""")
def pages_to_the_first_short_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three, each fourth nation with a gap on its first page, which ends it there."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    rows = table(spark, sf_dir, "supplier").withColumn("pos", pos).withColumn("page", F.floor(F.col("pos") / 3).cast("int") + 1).filter(~((F.col("s_nationkey") % 4 == 0) & (F.col("pos") == 2)))
    bodies = rows.groupBy(F.col("s_nationkey").cast("string").alias("source"), "page").agg(F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias("id")))).alias("body"))
    return captured.list_pages(bodies, None, per_page=3).select("source", "page", F.try_variant_get("item", "$.id", "long").alias("id"))


@Q.add(reviews._health_sql(", r AS (SELECT * FROM h ORDER BY started_at DESC, id DESC LIMIT 40) SELECT source, id, health, health_reason FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1").replace(") ,", "),"))
def recent_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's feature: each source's last run among the last 40 of all."""
    checked = health.catalogue_health(views.runs(spark, sf_dir))
    last = checked.orderBy(F.desc("started_at"), F.desc("id")).limit(40)
    return health.latest_run(last).select("source", "id", "health", "health_reason")


@Q.add(reviews._story_sql("SELECT rule_id, key, score, row_number() OVER (ORDER BY score DESC, rule_id, key)::INTEGER AS place FROM (" + reviews.STORY_COLUMNS + ") QUALIFY place <= 50"))
def story_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's feature: the 50 best stories, ties by rule and key."""
    from pyspark.sql import Window

    order = [F.desc("score"), "rule_id", "key"]
    best = reviews.stories.detect(reviews.story_events(spark, sf_dir), reviews.STORY_RULES, reviews.now()).orderBy(*order).limit(50)
    return best.select("rule_id", "key", "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


@Q.add(sql("""SELECT e.id, e.collector AS source, CASE WHEN change_type = 'new_product' AND k % 3 = 0 THEN 'duplicate_listing' ELSE change_type END AS change_type, CASE WHEN change_type = 'new_product' AND k % 3 = 0 THEN 2 WHEN change_type = 'new_product' THEN 5 ELSE 3 END AS severity, user_id % 12 % 4 = 0 AS baseline, change_type = 'new_product' AND user_id % 5 = 0 AS hidden, change_type = 'new_product' AND user_id % 7 = 0 AS unseen_component FROM v_events e
WHERE detected_at >= TIMESTAMP '2024-01-05 06:00:00' AND detected_at < TIMESTAMP '2024-01-20'""", "v_events"))
def events_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.events(spark, sf_dir).filter(payloads.in_range(F.col("detected_at"), "2024-01-05T08:00:00+02:00", "2024-01-20"))
    rows = e.select("id", "user_id", F.col("collector").alias("source"), "product_key", "change_type", F.when(F.col("change_type") == "new_product", 5).otherwise(3).alias("severity"), F.when(F.col("k") % 3 == 0, "existing_product").otherwise("none").alias("relation"))
    n = F.substring("source", 5, 10).cast("int")
    got = payloads.decorated(rows.drop("user_id"), rows.filter(n % 4 > 0), rows.filter("user_id % 5 = 0"), rows.filter("user_id % 7 = 0"))
    return got.select("id", "source", "change_type", "severity", "baseline", "hidden", "unseen_component")


@Q.add("""SELECT 'https://x.test/' || s_suppkey AS canonical_url, s_suppkey::VARCHAR AS external_id, s_name AS model, 'series ' || s_nationkey AS family, CASE WHEN s_suppkey % 3 = 0 THEN 'discontinued' ELSE 'current' END AS state FROM supplier WHERE s_suppkey % 10 > 1""")
def product_evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    whole = F.to_json(F.struct(k.alias("ProductID"), F.when(k % 10 > 0, "key").otherwise("").alias("ProductKey"), F.col("s_name").alias("ProductName"), F.concat(F.lit("series "), F.col("s_nationkey").cast("string")).alias("_series"), (k % 3 == 0).cast("int").alias("Withdraw")))
    bodies = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://x.test/"), k.cast("string")).alias("url"), F.when(k % 10 == 1, "{cut").otherwise(whole).alias("body"))
    return payloads.product_evidence(bodies, "database", "Maker", withdrawn=True).select("canonical_url", "external_id", "model", "family", "state")


# ---- references of pages

@Q.add("""WITH i AS (SELECT p_brand AS source, p_partkey AS k, p_size AS nth, CASE WHEN p_partkey % 3 = 0 THEN 'M' || (p_partkey % 90) END AS mpn, CASE WHEN p_partkey % 5 > 0 THEN 'https://x.test/' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '-SKU-np' || (p_partkey % 70) ELSE '' END END AS own FROM part),
h AS (SELECT *, coalesce(mpn, CASE WHEN k % 3 = 1 AND own IS NOT NULL THEN 'NP' || (k % 70) END) AS sku, coalesce(mpn, CASE WHEN k % 3 = 1 AND own IS NOT NULL THEN 'NP' || (k % 70) END, own) AS handle FROM i)
SELECT source, handle, sku, coalesce(own, 'https://x.test/list/' || nth) AS url FROM h WHERE handle IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, handle ORDER BY nth, k) = 1""")
def category_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category pages with lists of items, some without a SKU but with a code in their address, some with neither."""
    k = F.col("p_partkey")
    n = k.cast("string")
    url = F.when(k % 5 > 0, F.concat(F.lit("https://x.test/"), n, F.when(k % 3 == 1, F.concat(F.lit("-SKU-np"), (k % 70).cast("string"))).otherwise("")))
    item = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.lit("").alias("sku"), F.when(k % 3 == 0, F.concat(F.lit("M"), (k % 90).cast("string"))).alias("mpn"), url.alias("url"))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source"), F.col("p_size").alias("nth")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: F.struct(x["item"].alias("item"))).alias("itemListElement"))
    html = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("ItemList").alias("@type"), "itemListElement")), F.lit("</script>"))
    pages = rows.select("source", "nth", F.concat(F.lit("https://x.test/list/"), F.col("nth").cast("string")).alias("url"), html.alias("html"))
    return normalize.category_refs(pages).select("source", "handle", "sku", "url")


@Q.add("""SELECT p_brand AS source, p_partkey AS id, x AS pos, CASE x WHEN 0 THEN 'AB' ELSE 'CD' END || lpad(p_partkey::VARCHAR, 6, '0') AS sku, CASE WHEN x = 0 AND p_size % 3 > 0 THEN 1000 + p_partkey + 0.5 WHEN x = 0 AND p_size % 3 = 0 THEN 7.0 WHEN x = 1 THEN 7.0 END::DOUBLE AS amount, 'USD' AS currency, CASE WHEN x = 0 AND p_size % 2 = 0 THEN '15.6"' END AS display FROM part, (VALUES (0), (1)) v(x)""")
def listing_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages without JSON-LD: two models each, the first of which takes the second's price where it has none of its own."""
    k, size = F.col("p_partkey"), F.col("p_size")
    code = F.lpad(k.cast("string"), 6, "0")
    body = F.concat(
        F.lit("<p>Model\n AB"), code, F.lit("</p> "), F.when(size % 2 == 0, 'Display <b>15.6</b> " ').otherwise("Display none "), F.when(size % 3 > 0, F.concat(F.lit("Starting at <i>$"), F.format_number(k + 1000.5, 2), F.lit("</i>"))).otherwise(""),
        F.lit(" Model ab123456 Model AB12 Model CD"), code, F.lit(" Starting at $7.00"),
    )
    got = normalize.listing_items(table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), k.cast("string").alias("url"), body.alias("body")))
    return got.select("source", F.col("url").cast("long").alias("id"), "pos", "sku", "amount", "currency", "display")


# ---- small checks

STATUSES = "[" + ", ".join(f"'{x}'" for x in SUGGESTION_STATUSES) + "]"


@Q.add(sql(f"""SELECT a AS current, b AS new, count(*) AS n, (a = 'PROPOSED' AND b IN ('ACCEPTED', 'REJECTED')) OR (a = 'ACCEPTED' AND b IN ('IMPLEMENTED', 'REJECTED')) OR (a = 'IMPLEMENTED' AND b = 'REVERTED') OR (a = 'REVERTED' AND b = 'ACCEPTED') AS legal FROM (SELECT ({STATUSES})[k % 5 + 1] AS a, ({STATUSES})[user_id % 5 + 1] AS b FROM v_events) GROUP BY ALL""", "v_events"))
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of suggestions' status that alerts ask for, and whether they are allowed; the allowed ones are made."""
    all_ = F.array(*map(F.lit, SUGGESTION_STATUSES))
    at = lambda c: F.element_at(all_, (F.col(c) % 5 + 1).cast("int"))
    rows = views.events(spark, sf_dir).select(at("k").alias("current"), at("user_id").alias("new"))
    rows = rows.withColumn("legal", state.legal(F.col("current"), F.col("new")))
    made = rows.filter("legal").withColumn("new", state.checked_transition(F.col("current"), F.col("new")))
    return made.unionByName(rows.filter("not legal")).groupBy("current", "new", "legal").agg(F.count(F.lit(1)).alias("n"))


@Q.add("""SELECT sha256('{"brand":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',"name":"' || p_name || '","size":' || p_size % 3 || '}') AS content_hash, min(p_partkey) AS first_id, count(*) AS n_seen FROM part GROUP BY 1""")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of equal content, missing values included, whatever their ids."""
    whole = F.struct(F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).alias("brand"), F.col("p_name").alias("name"), (F.col("p_size") % 3).alias("size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", identity.content_hash(whole).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("p_partkey").alias("first_id"), F.count(F.lit(1)).alias("n_seen"))


@Q.add("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 'beta' WHEN p_size % 3 = 1 THEN 'ok' END AS support_status FROM part""")
def unwrapped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that wrap their product, or don't, or are cut off, and what the comments before a descriptor say."""
    k, name = F.col("p_partkey"), F.concat(F.lit('{"title": "'), F.col("p_name"), F.lit('"}'))
    body = F.when(k % 4 == 3, F.expr("left('{\"product\": {', 12)")).when(k % 2 == 0, F.concat(F.lit('{"product": '), name, F.lit("}"))).otherwise(name)
    note = F.when(F.col("p_size") % 3 == 0, "# made\n#  Support_Status: beta (soon)\nid: x").when(F.col("p_size") % 3 == 1, "# support_status: ok\n").otherwise("id: x\nsupport_status: no")
    files = table(spark, sf_dir, "part").select(k.alias("url"), captured.payload(body, "product").alias("v"), note.alias("body"))
    told = captured.support_status(files.select("url", "body"))
    return files.select(F.col("url").alias("p_partkey"), F.try_variant_get("v", "$.title", "string").alias("name")).join(told.withColumnRenamed("url", "p_partkey"), "p_partkey")
