"""Storefront items, page facts, the reviewers' desk, run telemetry and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import desk, health, normalize, pages, state, telemetry
from ..schema import REASON_CODES
from . import catalogue, views
from .views import Queries, sql, table

Q = Queries()
EV = ("v_events", "v_reviews")


# ---- items of storefronts

NAME = """p_name || ' ' || CASE p_size % 6 WHEN 0 THEN 'XPS ' || p_size WHEN 1 THEN 'dell pro max ' || p_size WHEN 2 THEN 'Dell Pro' WHEN 3 THEN 'LATITUDE ' || p_partkey ELSE 'Box' END
 || CASE p_size % 5 WHEN 0 THEN ' 14.5-inch' WHEN 1 THEN ' 16"' ELSE '' END"""
PROSE = """CASE p_size % 9 WHEN 0 THEN 'With Intel Core Ultra 9 ' || (200 + p_partkey % 90) || 'H and Radeon ' || (600 + p_partkey % 300) || 'M' WHEN 1 THEN 'AMD Ryzen AI 7 ' || (300 + p_partkey % 99) || ' inside' WHEN 2 THEN 'a snapdragon x elite, ' || p_size || ' inch'
 WHEN 3 THEN 'Core i7-' || (10000 + p_partkey % 5000) || 'U, GeForce RTX ' || (4000 + p_partkey % 1000) || ' Ti' WHEN 4 THEN 'Intel Core Ultra Processors, 13.4-inch' WHEN 5 THEN 'NVIDIA RTX 50 Series' WHEN 6 THEN 'AMD Ryzen AI, Intel Arc' ELSE 'plain' END"""
SPEC = """'<ul><li>' || CASE p_size % 4 WHEN 0 THEN 'Intel&reg; Core Ultra 7 ' || (100 + p_partkey % 800) || 'V' WHEN 1 THEN 'NVIDIA GeForce RTX ' || (4000 + p_partkey % 1000) || ' Laptop GPU' ELSE 'none' END || '</li><li>' || p_size || ' GB, LPDDR5x, 7467 MT/s</li>'
 || CASE WHEN p_size % 3 > 0 THEN '<li>' || (50 - p_size % 40) || ' GB, 2 x, DDR5</li><li>' || (1 + p_partkey % 900) || ' GB, M.2, SSD</li>' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '<li>' || (1 + p_partkey % 4) || ' tb, PCIe NVMe</li><li>1' || (p_size % 7) || '.2-inch, OLED, touch </li>' ELSE '' END || '</ul>'"""
CATEGORY_NAME = """p_name || CASE p_size % 7 WHEN 0 THEN ' Snapdragon X2 Elite' WHEN 1 THEN ' Intel Core Ultra 5 ' || p_size WHEN 2 THEN ' intel core ultra x7' WHEN 3 THEN ' gift card' ELSE '' END || CASE p_size % 4 WHEN 0 THEN ' ' || p_size || ' GB' WHEN 1 THEN ', 14.' || (p_size % 10) || '-inch' ELSE '' END"""
CATEGORY_URL = """'https://x.test/' || CASE p_size % 5 WHEN 0 THEN 'amd-ryzen-ai-9-hx' || p_partkey || '-' ELSE '' END || p_partkey || 'gb-' || p_size || CASE WHEN p_size % 2 = 0 THEN 'tb' ELSE '' END"""
STOCK = "CASE p_size % 4 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'OutOfStock' WHEN 2 THEN 'http://schema.org/PreOrder' END"


def _quote(p: str) -> str:
    return p.replace("'", "''")


def _first_sql(patterns, *texts) -> str:
    cases = ", ".join(f"nullif(regexp_extract({t}, '{_quote(p)}'), '')" for t in texts for p in patterns)
    return f"trim(regexp_replace(coalesce({cases}), '\\s+', ' ', 'g'))"


STOCK_SQL = f"CASE WHEN contains(coalesce({STOCK}, ''), 'OutOf') THEN 'sold_out' WHEN contains(coalesce({STOCK}, ''), 'Pre') THEN 'preorder' WHEN contains(coalesce({STOCK}, ''), 'InStock') THEN 'in_stock' ELSE 'unknown' END"
SPEC_SQL = f"""(SELECT p_partkey, {_first_sql(normalize.PROSE_CPU, 't')} AS cpu, {_first_sql(normalize.PROSE_GPU, 't')} AS gpu, nullif(trim(regexp_extract(t, '(?i)\\d+(?:\\.\\d+)?[- ]inch[^<\\n]*')), '') AS display,
 list_sort([{{'gb': CAST(m[i] AS INT), 's': m[i] || ' GB ' || k[i]}} for i in range(1, len(m) + 1)])[-1].s AS memory,
 list_sort([{{'gb': CAST(a[i] AS INT) * CASE WHEN upper(u[i]) = 'TB' THEN 1024 ELSE 1 END, 's': a[i] || ' ' || upper(u[i])}} for i in range(1, len(a) + 1)])[-1].s AS storage, CAST(len(m) AS INT) AS n_memory, CAST(len(a) AS INT) AS n_storage
 FROM (SELECT *, regexp_extract_all(t, '(?i)(\\d+)\\s*GB,[^<\\n]*?(LPDDR\\w+|DDR\\d[A-Za-z]*)', 1) AS m, regexp_extract_all(t, '(?i)(\\d+)\\s*GB,[^<\\n]*?(LPDDR\\w+|DDR\\d[A-Za-z]*)', 2) AS k,
  regexp_extract_all(t, '(?i)(\\d+)\\s*(GB|TB),[^<\\n]*?(?:SSD|eMMC|NVMe)', 1) AS a, regexp_extract_all(t, '(?i)(\\d+)\\s*(GB|TB),[^<\\n]*?(?:SSD|eMMC|NVMe)', 2) AS u FROM (SELECT p_partkey, regexp_replace({SPEC}, '<[^>]+>', chr(10), 'g') AS t FROM part)))"""


@Q.add(f"SELECT * FROM {SPEC_SQL}")
def spec_page_facts(spark, sf_dir):
    s = normalize.spec_page(F.expr(SPEC)).alias("s")
    return table(spark, sf_dir, "part").select("p_partkey", s).select("p_partkey", "s.cpu", "s.gpu", "s.display", "s.memory", "s.storage", F.size("s.memory_options").alias("n_memory"), F.size("s.storage_options").alias("n_storage"))


SERIES_SQL = "CASE " + " ".join(f"WHEN contains(lower(model), '{s.lower()}') THEN '{s}'" for s in normalize.SERIES) + " END"


@Q.add(f"""SELECT url, model, {SERIES_SQL} AS series, coalesce(s.cpu, {_first_sql(normalize.PROSE_CPU, 'model', 'prose')}) AS cpu, coalesce(s.gpu, {_first_sql(normalize.PROSE_GPU, 'model', 'prose')}) AS gpu, memory, storage, coalesce(display, nullif(regexp_extract(prose, '(?i)([\\d.]+)[- ]?inch', 1), '') || '"') AS display,
 CASE WHEN p_size % 8 > 0 THEN p_retailprice END AS amount, CASE WHEN p_size % 8 > 0 THEN CASE WHEN p_size % 3 = 0 THEN 'EUR' ELSE 'USD' END END AS currency, CASE WHEN p_size % 8 > 0 THEN {STOCK_SQL} END AS availability, prose AS description, CASE WHEN coalesce(s.cpu, {_first_sql(normalize.PROSE_CPU, 'model', 'prose')}) IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence
FROM (SELECT *, 'https://x.test/' || p_partkey AS url, CASE WHEN p_size % 10 = 9 THEN 'Dell D' || p_partkey ELSE {NAME} END AS model, {PROSE} AS prose FROM part) p LEFT JOIN {SPEC_SQL} s ON s.p_partkey = p.p_partkey AND p.p_size % 2 = 1""")
def catalogue_item_facts(spark, sf_dir):
    """Items with offers as an object or a list; every other one has a specification page."""
    offer = F.struct(F.when(F.col("p_size") % 8 > 0, F.col("p_retailprice").cast("string")).alias("price"), F.when(F.col("p_size") % 3 == 0, "EUR").alias("priceCurrency"), F.expr(STOCK).alias("availability"))
    body = lambda offers: F.to_json(F.struct(F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("sku"), F.when(F.col("p_size") % 10 != 9, F.expr(NAME)).alias("name"), F.expr(PROSE).alias("description"), offers.alias("offers")))
    item = F.parse_json(F.when(F.col("p_size") % 2 == 0, body(offer)).otherwise(body(F.array(offer))))
    items = table(spark, sf_dir, "part").select(F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string")).alias("url"), item.alias("item"), F.when(F.col("p_size") % 2 == 1, normalize.spec_page(F.expr(SPEC))).alias("deep"))
    p = F.get("prices", F.lit(0))
    return normalize.catalogue_item(items, "Dell").select("url", "model", "series", F.col("cpu.raw").alias("cpu"), F.col("gpu.raw").alias("gpu"), "memory", "storage", "display", p["amount"].alias("amount"), p["currency"].alias("currency"), p["availability"].alias("availability"), "description", "confidence")


CATEGORY_CPU_SQL = "trim(regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract(h, '{_quote(p)}'), '')" for p in normalize.CATEGORY_CPU) + "), '[- ]+', ' ', 'g'))"


@Q.add(f"""SELECT url, model, CASE WHEN c IS NOT NULL THEN array_to_string([CASE WHEN i = 1 OR NOT regexp_matches(c[i - 1], '[A-Za-z]') THEN upper(c[i]) ELSE lower(c[i]) END for i in range(1, length(c) + 1)], '') END AS cpu,
 regexp_extract_all(h, '(?i)(\\d+)(tb|gb)', 1)[-1] || upper(regexp_extract_all(h, '(?i)(\\d+)(tb|gb)', 2)[-1]) AS storage, nullif(regexp_extract(model, '(?i)(\\d+)\\s*gb\\b', 1), '') || ' GB' AS memory, nullif(regexp_extract(model, '(?i)(\\d{{2}}(?:\\.\\d)?)(?:["”]|-inch)', 1), '') || '"' AS display,
 sku AS vendor_sku, CASE WHEN p_size % 8 > 0 THEN p_retailprice END AS amount, CASE WHEN contains(lower(model), 'gift card') THEN 0.0 WHEN sku IS NULL OR p_size % 8 = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence
FROM (SELECT *, {CATEGORY_CPU_SQL} AS c FROM (SELECT *, {CATEGORY_NAME} AS model, {CATEGORY_URL} AS url, model || ' ' || url AS h, CASE WHEN p_size % 11 > 0 THEN 'K' || p_partkey END AS sku FROM part))""")
def category_item_facts(spark, sf_dir):
    offer = F.struct(F.when(F.col("p_size") % 8 > 0, F.col("p_retailprice").cast("string")).otherwise("-1").alias("price"))
    body = F.to_json(F.struct(F.expr(CATEGORY_NAME).alias("name"), F.expr(CATEGORY_URL).alias("url"), F.when(F.col("p_size") % 11 > 0, F.concat(F.lit("K"), F.col("p_partkey").cast("string"))).alias("mpn"), offer.alias("offers")))
    items = table(spark, sf_dir, "part").select(F.lit("https://x.test/list").alias("url"), F.parse_json(body).alias("item"))
    return normalize.category_item(items, "Maker", ["Gift Card"]).select("url", "model", F.col("cpu.raw").alias("cpu"), "storage", "memory", "display", "vendor_sku", F.get("prices", F.lit(0))["amount"].alias("amount"), "confidence")


OPTIONS = "p_type || ' ' || CASE p_size % 7 WHEN 0 THEN 'US plug' WHEN 1 THEN 'EU UK' WHEN 2 THEN 'us' WHEN 3 THEN 'AUS CA' ELSE p_name END"


@Q.add(f"""SELECT p_partkey, [w for w in string_split_regex({OPTIONS}, '\\s+') if w IN ({', '.join(f"'{r}'" for r in normalize.REGIONS)})][1] AS region, CASE WHEN split_part(p_name, ' ', 2) = 'widget' THEN 'part' WHEN split_part(p_name, ' ', 1) = 'hot' THEN 'warm' WHEN lower(p_type) = 'economy' THEN 'cheap' END AS category FROM part""")
def region_category(spark, sf_dir):
    got = normalize.mapped_category(F.split("p_name", " "), F.col("p_type"), {"Widget": "part", "hot": "warm", "economy": "cheap"})
    return table(spark, sf_dir, "part").select("p_partkey", normalize.region_token(F.expr(OPTIONS)).alias("region"), got.alias("category"))


# ---- pages

@Q.add("SELECT 'https://x.test/' || p_partkey AS url, p_name AS model, 'S' || p_partkey AS sku, CASE WHEN p_size % 3 = 0 THEN 'https://x.test/C/' || p_size ELSE 'https://x.test/' || p_partkey END AS canonical_url, CAST(p_retailprice AS VARCHAR) AS price, 's' || p_partkey AS tail, 'high' AS confidence FROM part WHERE p_partkey % 5 <> 0".replace("'s' || p_partkey AS tail", "'sku:s' || p_partkey AS identity_key"))
def page_product_identity(spark, sf_dir):
    head = F.when(F.col("size") % 3 == 0, F.concat(F.lit("<LINK data-x rel='canonical' href='HTTPS://X.test/C/"), F.col("size").cast("string"), F.lit("/?q=1#t'>"))).otherwise("<link rel='next' href='/n'>")
    sizes = table(spark, sf_dir, "part").select(F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_size").alias("size"))
    made = catalogue.product_pages(spark, sf_dir).join(sizes, "url").select("url", F.concat(head, "html").alias("html"))
    return pages.product_identity(made).drop("availability")


HEAD_SQL = "nullif(trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+(?:property|name)=[\"'']og:title[\"''][^>]+content=[\"'']([^\"'']+)', 1), '')), '<[^>]+>', '', 'g')), '')"


@Q.add(f"""SELECT page_id, model, sku, lower(regexp_extract(b, '^([A-Za-z]+://[^/]*)', 1)) || substr(b, length(regexp_extract(b, '^([A-Za-z]+://[^/]*)', 1)) + 1) AS canonical_url,
 coalesce('m-sku:' || lower(sku), 'm-model:' || regexp_replace(regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS identity_key, CASE WHEN sku IS NULL THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT page_id, {HEAD_SQL} AS model, CASE WHEN page_id % 3 = 0 THEN 'P-' || page_id END AS sku, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS b FROM pages) WHERE model IS NOT NULL""")
def page_heading_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return pages.heading_identity(p.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<script>x = {'SKU' : \"P-"), F.col("page_id").cast("string"), F.lit("\"}</script>"))).otherwise(F.col("html"))), "m")


#: Marks put behind the pages, as plain text of SQL; most pages get none.
MARKED = """html || CASE page_id % 17 WHEN 1 THEN 'Just a Moment' WHEN 2 THEN 'by CloudFlare' WHEN 3 THEN '<script id=__NEXT_DATA__>' WHEN 4 THEN '<img src=/_nuxt/a.js data-reactroot>' WHEN 5 THEN 'https://CDN.shopify.com/x /graphql' WHEN 6 THEN 'mage-cache-storage Magento_Cloud' WHEN 7 THEN '/on/demandware.store/ captcha' WHEN 8 THEN '__next_data__ /wp-content/' ELSE '' END"""


def _any_sql(body, marks) -> str:
    return "(" + " OR ".join(f"contains({body}, '{m}')" for m in marks) + ")"


PLATFORM_SQL = " || ".join(f"CASE WHEN {_any_sql('lower(h)', pages.PLATFORMS[n])} THEN '{n},' ELSE '' END" for n in sorted(pages.PLATFORMS))
FRAME_SQL = "CASE " + " ".join(f"WHEN {_any_sql('h', marks)} THEN '{n}'" for n, marks in pages.FRAMEWORKS) + " END"


@Q.add(f"SELECT page_id, {_any_sql('lower(h)', pages.STRONG_MARKS)} OR (page_id % 3 > 0 AND {_any_sql('lower(h)', pages.WEAK_MARKS)}) AS blocked, {FRAME_SQL} AS framework, rtrim({PLATFORM_SQL}, ',') AS platforms FROM (SELECT page_id, {MARKED} AS h FROM pages)")
def page_marks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(MARKED).alias("h"), F.when(F.col("page_id") % 3 == 0, 200).when(F.col("page_id") % 3 == 1, 403).otherwise(503).alias("status"))
    return p.select("page_id", pages.blocked(F.col("status"), F.col("h")).alias("blocked"), pages.framework(F.col("h")).alias("framework"), F.array_join(pages.platforms(F.col("h")), ",").alias("platforms"))


# ---- the reviewers' desk

TAXONOMY = "[" + ", ".join(f"'{c}'" for c in REASON_CODES) + "]"


@Q.add(sql(f"""SELECT id, '[' || array_to_string(['"' || c || '"' for c in l], ',') || ']' AS stored, array_to_string(l, '|') AS codes FROM (SELECT id, [c for c in {TAXONOMY} if list_contains([({TAXONOMY})[k % 22 + 1], ({TAXONOMY})[(k * 7 + user_id) % 22 + 1], ({TAXONOMY})[id % 22 + 1]], c) AND id % 7 > 0] AS l FROM v_events)""", "v_events"))
def reason_codes_stored(spark, sf_dir):
    """Codes in any order and repeated, stored as a list of the taxonomy's order and read back."""
    all_ = F.array(*map(F.lit, REASON_CODES))
    at = lambda n: F.element_at(all_, (n % 22 + 1).cast("int"))
    given = F.when(F.col("id") % 7 > 0, F.array(at(F.col("k")), at(F.col("k") * 7 + F.col("user_id")), at(F.col("id"))))
    stored = views.events(spark, sf_dir).select("id", desk.reasons_json(given).alias("stored"))
    return stored.select("id", "stored", F.array_join(desk.reasons_of_json(F.col("stored")), "|").alias("codes"))


@Q.add(sql("""SELECT collector, alert_type, reason_code, suggested_rule, coalesce(status, 'PROPOSED') AS status FROM (SELECT collector, change_type AS alert_type, CASE WHEN k % 4 > 0 THEN 'OTHER' END AS reason_code, 'raise to ' || k AS suggested_rule, CASE WHEN id % 3 = 0 THEN 'ACCEPTED' END AS status, row_number() OVER (PARTITION BY collector, change_type, k ORDER BY detected_at, coalesce(CASE WHEN id % 3 = 0 THEN 'ACCEPTED' END, 'PROPOSED')) AS n, k FROM v_events) WHERE n = 1 AND k % 10 > 0""", "v_events"))
def suggestion_manual(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.concat(F.lit("  "), "collector", F.lit(" ")).alias("collector"), F.col("change_type").alias("alert_type"), F.when(F.col("k") % 4 > 0, "OTHER").otherwise("").alias("reason_code"), F.concat(F.lit("raise to "), F.col("k").cast("string"), F.lit("\t")).alias("suggested_rule"), F.when(F.col("id") % 3 == 0, "ACCEPTED").alias("status"), F.col("detected_at").alias("created_at"), "k")
    nothing = desk.manual_suggestions(e.limit(0).withColumn("fingerprint", F.lit("")), e.filter("k % 10 = 0"))
    return desk.manual_suggestions(nothing, e.drop("k")).select("collector", "alert_type", "reason_code", "suggested_rule", "status")


LISTED = "SELECT id, collector, change_type AS alert_type, CASE k % 5 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'IMPLEMENTED' ELSE 'REVERTED' END AS status FROM v_events"


def _suggestions(spark, sf_dir):
    names = F.array(*map(F.lit, ("PROPOSED", "ACCEPTED", "REJECTED", "IMPLEMENTED", "REVERTED")))
    return views.events(spark, sf_dir).select("id", "collector", F.col("change_type").alias("alert_type"), F.element_at(names, F.col("k") % 5 + 1).alias("status"))


@Q.add(sql(f"SELECT * FROM ({LISTED}) WHERE status = 'PROPOSED' AND alert_type = 'price_changed' ORDER BY id DESC LIMIT 100", "v_events"))
def suggestion_list(spark, sf_dir):
    return desk.suggestion_list(_suggestions(spark, sf_dir), status="PROPOSED", alert_type="price_changed")


@Q.add(sql(f"SELECT * FROM ({LISTED}) ORDER BY id DESC LIMIT 100", "v_events"))
def suggestion_list_all(spark, sf_dir):
    return desk.suggestion_list(_suggestions(spark, sf_dir))


@Q.add("SELECT event_id AS id, user_id AS alert_id, event_type AS outcome, lag(event_type) OVER w AS previous_outcome, CAST(row_number() OVER w AS INT) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def review_history(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("alert_id"), F.col("ts").alias("changed_at"), F.col("event_type").alias("outcome"))
    return desk.review_history(h).drop("changed_at")


FEED = """SELECT id, collector AS manufacturer, change_type, k % 5 + 1 AS severity, outcome AS review_status, p_name AS model, p_brand AS cpu, unseen FROM v_events e LEFT JOIN v_reviews ON alert_id = e.id LEFT JOIN part ON p_partkey = user_id"""


def feed_rows(spark, sf_dir):
    r = views.reviews(spark, sf_dir).select(F.col("alert_id").alias("id"), F.col("outcome").alias("review_status"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_name").alias("model"), F.col("p_brand").alias("cpu"))
    e = views.events(spark, sf_dir).select("id", "user_id", F.col("collector").alias("manufacturer"), "change_type", (F.col("k") % 5 + 1).alias("severity"), "unseen")
    return e.join(r, "id", "left").join(p, "user_id", "left").withColumn("gpu", F.lit(None).cast("string")).withColumn("label", F.initcap(F.replace("change_type", F.lit("_"), F.lit(" "))))


@Q.add(sql(f"SELECT id, severity FROM ({FEED}) WHERE severity >= 3 AND coalesce(review_status, 'UNREVIEWED') = 'UNREVIEWED' AND contains(lower(coalesce(model, '') || ' ' || manufacturer || ' ' || coalesce(cpu, '') || '  ' || replace(change_type, '_', ' ')), 'brand#1')", *EV))
def alert_feed_filter(spark, sf_dir):
    return desk.feed(feed_rows(spark, sf_dir), severity=3, review="UNREVIEWED", words=" Brand#1 ").select("id", "severity")


@Q.add(sql(f"SELECT id, severity FROM ({FEED}) WHERE severity = 5 AND change_type = 'price_changed' AND review_status = 'NOISE' AND manufacturer = 'src-3'", *EV))
def alert_feed_top(spark, sf_dir):
    return desk.feed(feed_rows(spark, sf_dir), "src-3", "price_changed", 5, "NOISE").select("id", "severity")


@Q.add(sql("SELECT id FROM v_events WHERE k % 5 + 1 >= 4 OR unseen", "v_events"))
def alert_signals(spark, sf_dir):
    return desk.signals(feed_rows(spark, sf_dir)).select("id")


@Q.add("SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' AND p_type = 'ECONOMY' AND contains(lower('  ' || p_name || '  x' || p_partkey || ' ' || p_brand), 'bolt')")
def evidence_feed_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("evidence_kind"), F.lit(None).cast("string").alias("model"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("family"), F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("external_id"))
    return desk.evidence_feed(rows, "Brand#3", "ECONOMY", "BOLT").select("p_partkey")


BRIEF = """SELECT 'p' || listing AS product_key, manufacturer, model, CASE WHEN l_orderkey % 3 > 0 THEN display END AS cpu, l_orderkey % 3 = 1 AS cpu_unseen, memory,
 CASE WHEN l_linenumber < 6 THEN regexp_replace(regexp_replace(CAST(CAST(CASE WHEN amount >= 100000 THEN round(CAST(amount AS DECIMAL(18,2)), 0) WHEN amount >= 10000 THEN round(CAST(amount AS DECIMAL(18,2)), 1) ELSE CAST(amount AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ' USD' END AS price,
 CASE WHEN l_linenumber < 6 THEN 'EU' END AS region, CASE WHEN l_linenumber > 1 THEN 'https://i.test/' || l_orderkey END AS image, CAST(l_linenumber AS INT) AS configs
FROM (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC, amount DESC) AS n FROM v_snapshots) WHERE n = 1"""


@Q.add(sql(BRIEF, "v_snapshots"))
def product_brief(spark, sf_dir):
    s = views.snapshots(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    price = F.struct("amount", F.lit("USD").alias("currency"), F.lit("EU").alias("region"), "availability")
    rows = s.select(
        F.concat(F.lit("p"), F.col("listing").cast("string")).alias("product_key"), "manufacturer", "model", F.when(F.col("l_orderkey") % 3 > 0, F.struct(F.col("display").alias("raw"), nothing.alias("canonical"), (F.col("l_orderkey") % 3 != 1).alias("known"))).alias("cpu"), normalize.component(nothing).alias("gpu"), "memory", nothing.alias("storage"),
        F.array_compact(F.array(F.when(F.col("l_linenumber") < 6, price))).alias("prices"), F.array_compact(F.array(F.when(F.col("l_linenumber") > 1, F.concat(F.lit("https://i.test/"), F.col("l_orderkey").cast("string"))))).alias("images"), nothing.alias("url"), F.lit(1.0).alias("confidence"),
        F.array_repeat(F.struct(F.lit("c").alias("sku")), F.col("l_linenumber")).alias("configurations"), "captured_at", "l_orderkey", "l_linenumber", "amount",
    )
    return desk.product_brief(rows, ("captured_at", "l_orderkey", "l_linenumber", "amount")).select("product_key", "manufacturer", "model", "cpu", "cpu_unseen", "memory", "price", "region", "image", "configs")


@Q.add(sql("""SELECT CASE WHEN c IS NULL THEN 'unknown' WHEN c < 0.2 THEN '0.0-0.2' WHEN c < 0.4 THEN '0.2-0.4' WHEN c < 0.6 THEN '0.4-0.6' WHEN c < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS key, count(*) AS total, count(outcome) AS reviewed, count(*) FILTER (WHERE outcome = 'HIT') AS hit, count(*) FILTER (WHERE outcome = 'INTERESTING') AS interesting, count(*) FILTER (WHERE outcome = 'NOISE') AS noise, count(*) FILTER (WHERE outcome = 'BUG') AS bug
FROM v_events e LEFT JOIN v_reviews ON alert_id = e.id LEFT JOIN (SELECT l_suppkey, l_discount * 10 AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_discount DESC) AS n FROM lineitem) s ON n = 1 AND l_suppkey = user_id GROUP BY ALL""", *EV))
def breakdown_latest_confidence(spark, sf_dir):
    """Alerts by the confidence of the latest snapshot of what they are about; some have none."""
    snaps = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src-"), (F.col("l_suppkey") % 12).cast("string"), F.lit(":p"), F.col("l_suppkey").cast("string")).alias("product_key"), (F.col("l_discount") * 10).alias("confidence"), "l_shipdate", "l_orderkey", "l_linenumber")
    return desk.by_confidence(views.events(spark, sf_dir), views.reviews(spark, sf_dir), snaps, ("l_shipdate", "l_orderkey", "l_linenumber", "confidence"))


# ---- runs and deliveries

@Q.add("SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def planned_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("src-"), F.col("c_custkey").cast("string")).alias("source"), F.when(F.col("c_acctbal") > 0, True).alias("enabled"))
    return telemetry.planned(c).select("c_custkey")


@Q.add("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def planned_only(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"), (F.col("c_acctbal") > 0).alias("enabled"))
    return telemetry.planned(c, "BUILDING").select("c_custkey")


STATS = """SELECT 'src-' || (l_suppkey % 25) AS source, count(*) AS discovered, count(*) FILTER (WHERE l_linestatus = 'F') AS fetched, count(*) FILTER (WHERE l_returnflag = 'A') AS written, count(*) FILTER (WHERE l_returnflag = 'N') AS unchanged, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber > 3) AS skipped, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber <= 3) AS invalid,
 sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END)::BIGINT AS events, count(*) FILTER (WHERE l_tax = 0.08) AS errors FROM lineitem GROUP BY ALL"""


def observations(spark, sf_dir):
    r = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src-"), (F.col("l_suppkey") % 25).cast("string")).alias("source"), (F.col("l_linestatus") == "F").alias("fetched"), F.when(r == "A", "written").when(r == "N", "unchanged").when(F.col("l_linenumber") > 3, "skipped").otherwise("invalid").alias("result"), F.when(r == "A", F.col("l_linenumber")).alias("n_events"), F.when(F.col("l_tax") == 0.08, "timeout").alias("error"))


@Q.add(STATS)
def run_stats(spark, sf_dir):
    return telemetry.run_stats(observations(spark, sf_dir))


@Q.add(f"SELECT count(*) AS sources, sum(written)::BIGINT AS snapshots, sum(events)::BIGINT AS events, sum(errors)::BIGINT AS errors FROM ({STATS})")
def run_totals(spark, sf_dir):
    return telemetry.run_totals(telemetry.run_stats(observations(spark, sf_dir)))


def _ends(spark, sf_dir):
    r = views.runs(spark, sf_dir).filter("id % 9 > 0")
    found = F.array_compact(F.array(F.when(F.col("status") == "failed", F.concat(F.lit("no answer from "), "source")), F.when(F.col("discovered") > 200, "too many")))
    return r.select("id", "finished_at", "status", "discovered", F.lit(0).alias("events"), found.alias("errors"))


@Q.add(sql("SELECT r.id, r.source, CASE WHEN id % 9 > 0 THEN finished_at END AS finished_at, CASE WHEN id % 9 > 0 THEN status END AS status, CASE WHEN id % 9 > 0 THEN '{\"discovered\":' || discovered || ',\"events\":0}' END AS stats_json FROM v_runs r", "v_runs"))
def run_log(spark, sf_dir):
    starts = views.runs(spark, sf_dir).select("id", "source", "started_at")
    return telemetry.run_log(starts, _ends(spark, sf_dir), ("discovered", "events")).drop("started_at")


@Q.add(sql("SELECT id AS run_id, 0 AS nth, 'no answer from ' || source AS message FROM v_runs WHERE id % 9 > 0 AND status = 'failed' UNION ALL SELECT id, CASE WHEN status = 'failed' THEN 1 ELSE 0 END, 'too many' FROM v_runs WHERE id % 9 > 0 AND discovered > 200", "v_runs"))
def run_errors(spark, sf_dir):
    return telemetry.run_errors(_ends(spark, sf_dir))


@Q.add(sql("""SELECT 'engine-' || (CAST(substr(source, 5) AS INT) % 5) AS engine, count(*) AS sources, count(DISTINCT CAST(substr(source, 5) AS INT) % 7) AS oems, count(*) FILTER (WHERE status = 'ok') AS ok, CAST(0 AS BIGINT) AS degraded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IS NULL) AS never
FROM (SELECT source, CASE WHEN CAST(substr(source, 5) AS INT) % 6 > 0 THEN arg_max(status, (started_at, id)) END AS status FROM v_runs GROUP BY source) GROUP BY ALL""", "v_runs"))
def coverage_status(spark, sf_dir):
    r = views.runs(spark, sf_dir)
    n = F.substring("source", 5, 10).cast("int")
    registry = r.select("source").distinct().select("source", F.concat(F.lit("engine-"), (n % 5).cast("string")).alias("engine"), (n % 7).alias("oem"))
    return telemetry.coverage(registry, health.latest_run(r.filter(n % 6 > 0).withColumn("health", F.col("status"))))


DRAIN = """WITH o AS (SELECT event_id AS id, CAST(event_id % 8 AS INT) AS attempts, CASE WHEN event_type = 'signup' THEN 'suppressed' ELSE 'pending' END AS status, ts, CASE WHEN value < 20 THEN 'gone' WHEN event_id > {least} AND value > 499 THEN 'HTTP 429' END AS error FROM events),
s AS (SELECT *, status = 'pending' AND id <= coalesce((SELECT min(id) FROM o WHERE status = 'pending' AND contains(error, '429')), 1000000000000) AS hit FROM o)
SELECT id, CASE WHEN NOT hit THEN status WHEN error IS NULL THEN 'sent' WHEN contains(error, '429') OR attempts < 5 THEN 'pending' ELSE 'failed' END AS status, attempts + CASE WHEN hit THEN 1 ELSE 0 END AS attempts, CASE WHEN hit AND error IS NULL THEN ts END AS sent_at, CASE WHEN hit THEN error END AS last_error FROM s"""


@Q.add(DRAIN.format(least=3000))
def outbox_drain(spark, sf_dir):
    """A delivery that the receiver ends by its answer to some row behind the first three thousand."""
    e = table(spark, sf_dir, "events")
    outbox = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 8).cast("int").alias("attempts"), F.when(F.col("event_type") == "signup", "suppressed").otherwise("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("sent_at"), F.lit(None).cast("string").alias("last_error"))
    error = F.when(F.col("value") < 20, "gone").when((F.col("event_id") > 3000) & (F.col("value") > 499), "HTTP 429")
    answers = e.select(F.col("event_id").alias("id"), error.isNull().alias("ok"), error.alias("error"), F.col("ts").alias("at"))
    return telemetry.drained(outbox, answers)


@Q.add("SELECT page_id, CASE WHEN length(url) > 12 THEN array_to_string([CASE WHEN i = 1 OR NOT regexp_matches(u[i - 1], '[A-Za-z]') THEN upper(u[i]) ELSE lower(u[i]) END for i in range(1, length(u) + 1)], '') END AS title FROM (SELECT page_id, url, regexp_replace(url, '[^ -~]', '', 'g') AS u FROM pages)")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.length("url") > 12, text.title_case(F.regexp_replace("url", "[^ -~]", ""))).alias("title"))


@Q.add("SELECT t AS \"table\" FROM (SELECT 'parts' AS t, count(*) AS n FROM part UNION ALL SELECT 'free', count(*) FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'orders', count(*) FROM orders) WHERE n = 0")
def archive_empty_tables(spark, sf_dir):
    tables = {"parts": table(spark, sf_dir, "part"), "free": table(spark, sf_dir, "lineitem").filter("l_quantity < 0"), "orders": table(spark, sf_dir, "orders")}
    return state.empty_tables(state.audit(tables, []))
