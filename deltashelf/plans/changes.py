"""Snapshots and their changes, identity, state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import diff, resolve, rules, state
from ..schema import Rule
from . import views
from .views import Queries, sql, table

Q = Queries()
ORDER = ("captured_at", "l_orderkey", "l_linenumber")
OVER = "PARTITION BY listing ORDER BY captured_at, l_orderkey, l_linenumber"
#: Price moves: large ones weigh more, small ones less.
PRICE_RULES = (Rule({"change_type": "price_changed", "magnitude_pct": ">= 50"}, 4), Rule({"change_type": "price_changed", "magnitude_pct": "< 5"}, 1), Rule({"change_type": "price_changed"}, 3), Rule({}, 2))


def with_previous(rows, *columns):
    w = Window.partitionBy("listing").orderBy(*ORDER)
    for c in columns:
        rows = rows.withColumn(f"old_{c}", F.lag(c).over(w))
    return rows.withColumn("n", F.row_number().over(w))


PRICE_SQL = f"""
e AS (SELECT *, lag(amount) OVER ({OVER}) AS old_amount FROM v_snapshots),
p AS (SELECT *, round(abs(amount - old_amount) / old_amount * 100, 1) AS pct FROM e WHERE old_amount IS NOT NULL AND amount <> old_amount),
x AS (SELECT *, CASE WHEN pct >= 50 THEN 4 WHEN pct < 5 THEN 1 ELSE 3 END AS severity, CASE WHEN amount > old_amount THEN 'up' ELSE 'down' END AS direction FROM p)
"""


def price_events(spark, sf_dir):
    rows = with_previous(views.snapshots(spark, sf_dir), "amount").filter("old_amount is not null and amount <> old_amount")
    pct = F.round(F.abs(F.col("amount") - F.col("old_amount")) / F.col("old_amount") * 100, 1)
    rows = rows.withColumn("pct", pct).withColumn("direction", F.when(F.col("amount") > F.col("old_amount"), "up").otherwise("down"))
    return rows.withColumn("severity", rules.severity({"change_type": F.lit("price_changed"), "magnitude_pct": F.col("pct")}, PRICE_RULES))


@Q.add(f"WITH v_snapshots AS ({views.SQL['v_snapshots']}), {PRICE_SQL} SELECT severity, manufacturer, direction, count(*) AS n_events, round(avg(pct), 4) AS avg_pct, max(pct) AS max_pct FROM x GROUP BY ALL")
def snapshot_price_diff(spark, sf_dir):
    return price_events(spark, sf_dir).groupBy("severity", "manufacturer", "direction").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("pct"), 4).alias("avg_pct"), F.max("pct").alias("max_pct"))


@Q.add(f"WITH v_snapshots AS ({views.SQL['v_snapshots']}), {PRICE_SQL} SELECT severity, count(*) AS n FROM x GROUP BY ALL")
def severity_score(spark, sf_dir):
    return price_events(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@Q.add(sql(f"SELECT listing, model, captured_at FROM (SELECT *, row_number() OVER ({OVER}) AS n FROM v_snapshots) WHERE n = 1", "v_snapshots"))
def diff_new_product(spark, sf_dir):
    return with_previous(views.snapshots(spark, sf_dir)).filter("n = 1").select("listing", "model", "captured_at")


@Q.add(sql(f"""SELECT listing, l_orderkey, l_linenumber, old_memory, memory AS new_memory, CASE WHEN CAST(split_part(memory, ' ', 1) AS INT) > CAST(split_part(old_memory, ' ', 1) AS INT) THEN 'up' ELSE 'down' END AS direction, 4 AS severity
FROM (SELECT *, lag(memory) OVER ({OVER}) AS old_memory FROM v_snapshots) WHERE old_memory <> memory""", "v_snapshots"))
def diff_spec_memory(spark, sf_dir):
    rows = with_previous(views.snapshots(spark, sf_dir), "memory").filter("n > 1").withColumn("e", diff.spec_event(F.struct(F.col("old_memory").alias("memory")), F.struct("memory"), "memory")).filter("e is not null")
    return rows.select("listing", "l_orderkey", "l_linenumber", F.col("e.old_value").alias("old_memory"), F.col("e.new_value").alias("new_memory"), "e.direction", rules.severity({"change_type": F.col("e.change_type"), "field": F.col("e.field")}).alias("severity"))


@Q.add(sql(f"""SELECT old_availability, availability AS new_availability, count(*) AS n FROM (SELECT *, lag(availability) OVER ({OVER}) AS old_availability FROM v_snapshots)
WHERE old_availability <> availability AND availability <> 'unknown' GROUP BY ALL""", "v_snapshots"))
def diff_availability(spark, sf_dir):
    record = lambda c: F.struct(F.array(F.struct(F.lit("s").alias("sku"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("region"), F.col(c).alias("availability"))).alias("configurations"))
    rows = with_previous(views.snapshots(spark, sf_dir), "availability").filter("n > 1").select(F.explode(diff.configuration_events(record("old_availability"), record("availability"))).alias("e"))
    return rows.filter("e.change_type = 'availability_changed'").groupBy(F.col("e.old_value").alias("old_availability"), F.col("e.new_value").alias("new_availability")).agg(F.count(F.lit(1)).alias("n"))


@Q.add(r"""
SELECT doc_id, length(text) <> length(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS text_differs, false AS is_event FROM documents""")
def diff_description_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("flat", F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")))
    e = diff.description_event(F.struct(F.col("text").alias("description")), F.struct(F.col("flat").alias("description")))
    return d.select("doc_id", (F.length("text") != F.length("flat")).alias("text_differs"), e.isNotNull().alias("is_event"))


#: Nested records of a listing's observations: two regional prices, processor, description, display and memory.
def records(spark, sf_dir):
    amount, region = F.col("amount"), lambda name, x: F.struct(x.alias("amount"), F.lit("USD").alias("currency"), F.lit(name).alias("region"))
    chip = F.when(F.col("l_orderkey") % 5 > 0, F.concat(F.lit("Chip "), (F.col("l_orderkey") % 3).cast("string")))
    part = F.struct(chip.alias("raw"), F.lit(None).cast("string").alias("canonical"), (F.col("l_orderkey") % 3 == 0).alias("known"))
    words = F.concat(F.lit("Listing  of "), F.col("model"), F.when(F.col("l_linenumber") % 2 == 0, "  with dock ").otherwise(" "))
    return views.snapshots(spark, sf_dir).select("listing", *ORDER, F.struct(F.array(region("EU", F.round(amount, 2)), region("US", F.round(amount * 2, 2))).alias("prices"), part.alias("cpu"), words.alias("description"), "memory").alias("record"))


RECORD_SQL = f"""r AS (SELECT *, round(amount, 2) AS eu, round(amount * 2, 2) AS us, CASE WHEN l_orderkey % 5 > 0 THEN 'Chip ' || (l_orderkey % 3) END AS cpu, l_orderkey % 3 = 0 AS known,
  'Listing of ' || trim(regexp_replace(model, '\\s+', ' ', 'g')) || CASE WHEN l_linenumber % 2 = 0 THEN ' with dock' ELSE '' END AS description FROM v_snapshots),
o AS (SELECT *, lag(eu) OVER w AS old_eu, lag(us) OVER w AS old_us, lag(cpu) OVER w AS old_cpu, lag(description) OVER w AS old_description, lag(l_orderkey) OVER w AS before FROM r WINDOW w AS ({OVER}))"""


def before_and_after(spark, sf_dir):
    w = Window.partitionBy("listing").orderBy(*ORDER)
    return records(spark, sf_dir).withColumn("old", F.lag("record").over(w)).filter("old is not null")


@Q.add(f"""WITH v_snapshots AS ({views.SQL['v_snapshots']}), {RECORD_SQL}
SELECT listing, l_orderkey, l_linenumber, CASE WHEN eu <> old_eu THEN CASE WHEN eu > old_eu THEN 'up' ELSE 'down' END ELSE CASE WHEN us > old_us THEN 'up' ELSE 'down' END END AS direction,
  round(greatest(abs(eu - old_eu) / old_eu, abs(us - old_us) / old_us) * 100, 1) AS pct FROM o WHERE before IS NOT NULL AND (eu <> old_eu OR us <> old_us)""")
def diff_price_regions(spark, sf_dir):
    """Moves of sets of prices in two regions: the largest move, and the way of the first that moved."""
    rows = before_and_after(spark, sf_dir).withColumn("e", diff.price_event(F.col("old"), F.col("record"))).filter("e is not null")
    return rows.select("listing", "l_orderkey", "l_linenumber", "e.direction", F.col("e.magnitude_pct").alias("pct"))


@Q.add(f"""WITH v_snapshots AS ({views.SQL['v_snapshots']}), {RECORD_SQL}
SELECT listing, l_orderkey, l_linenumber, old_cpu AS old_value, cpu AS new_value, NOT known AS unseen_component FROM o WHERE before IS NOT NULL AND cpu IS NOT NULL AND cpu IS DISTINCT FROM old_cpu""")
def diff_component(spark, sf_dir):
    """Processors that became other ones or appeared; that one vanished is no event."""
    rows = before_and_after(spark, sf_dir).withColumn("e", diff.component_event(F.col("old"), F.col("record"), "cpu")).filter("e is not null")
    return rows.select("listing", "l_orderkey", "l_linenumber", "e.old_value", "e.new_value", "e.unseen_component")


@Q.add(f"""WITH v_snapshots AS ({views.SQL['v_snapshots']}), {RECORD_SQL}
SELECT listing, l_orderkey, l_linenumber, description <> old_description AS is_event FROM o WHERE before IS NOT NULL""")
def diff_description(spark, sf_dir):
    """Whether the words of a description changed; white space doesn't count."""
    rows = before_and_after(spark, sf_dir)
    return rows.select("listing", "l_orderkey", "l_linenumber", diff.description_event(F.col("old"), F.col("record")).isNotNull().alias("is_event"))


@Q.add("""WITH v AS (SELECT page_id, split_part(url, '?', 1) AS bare, lag(split_part(url, '?', 1)) OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS old FROM pages)
SELECT page_id, old <> bare AS is_event FROM v WHERE old IS NOT NULL""")
def diff_images_set(spark, sf_dir):
    old = F.lag("url").over(Window.partitionBy(F.split_part("url", F.lit("/"), F.lit(3))).orderBy("page_id"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", old.alias("old")).filter("old is not null")
    record = lambda c: F.struct(F.array(F.col(c), F.concat(F.col(c), F.lit("?w=100"))).alias("images"))
    return rows.select("page_id", diff.image_event(record("old"), record("url")).isNotNull().alias("is_event"))


@Q.add("""WITH c AS (SELECT l_orderkey, list_sort(list_distinct(list('SKU-' || l_partkey) FILTER (WHERE l_linenumber <= 3))) AS a, list_sort(list_distinct(list('SKU-' || l_partkey) FILTER (WHERE l_linenumber >= 2))) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(coalesce(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), []), ',') AS added, array_to_string(coalesce(list_sort(list_filter(a, lambda x: coalesce(NOT list_contains(b, x), true))), []), ',') AS removed
FROM c WHERE a IS NOT NULL AND array_to_string(a, ',') <> array_to_string(coalesce(b, []), ',')""")
def diff_configurations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"))
    got = rows.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, key)).alias("a"), F.collect_set(F.when(F.col("l_linenumber") >= 2, key)).alias("b"))
    configs = lambda c: F.struct(F.transform(c, lambda x: F.struct(x.alias("sku"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("region"), F.lit("unknown").alias("availability"))).alias("configurations"))
    got = got.withColumn("e", F.get(F.filter(diff.configuration_events(configs("a"), configs("b")), lambda e: e["field"] == "configurations"), F.lit(0))).filter("e is not null")
    minus = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return got.select("l_orderkey", minus("b", "a").alias("added"), minus("a", "b").alias("removed"))


@Q.add("""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' GB' WHEN 1 THEN p_size || 'TB SSD' WHEN 2 THEN 'about ' || p_size || '.5 mAh' ELSE 'none' END AS t FROM part)
SELECT p_partkey, t, CASE WHEN t = 'none' THEN NULL ELSE CAST(regexp_extract(t, '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) * CASE WHEN t LIKE '%TB%' THEN 1024 ELSE 1 END END AS value FROM v""".replace("\\\\", "\\"))
def numeric_unit_parse(spark, sf_dir):
    p, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    t = F.when(p == 0, F.concat(size, F.lit(" GB"))).when(p == 1, F.concat(size, F.lit("TB SSD"))).when(p == 2, F.concat(F.lit("about "), size, F.lit(".5 mAh"))).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).withColumn("value", text.numeric(F.col("t")))


COMPONENT_SQL = """c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AMD Ryzen' || p_size || ' ' || p_size || '00HX' WHEN 1 THEN 'Intel® Core™ i' || p_size || ' (Gen)' WHEN 2 THEN 'NVIDIA GeForce RTX' || p_size || '0 Graphics' WHEN 3 THEN 'Intel Graphics' ELSE 'Snapdragon X' || p_size END AS raw FROM part),
s AS (SELECT p_partkey, raw, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(raw, '\\([^)]*\\)', ' ', 'g'), '®|™|\\b(amd|intel|nvidia|qualcomm|apple|processor|cpu|graphics|mobile)\\b', ' ', 'gi')), '[^a-z0-9+. -]', ' ', 'g'), '\\b(ryzen|core|radeon|arc|geforce|rtx|gtx|xe)([0-9])', '\\1 \\2', 'g'), ' +', ' ', 'g')) AS t FROM c)""".replace("\\\\", "\\")


def components(spark, sf_dir):
    p, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(p == 0, F.concat(F.lit("AMD Ryzen"), size, F.lit(" "), size, F.lit("00HX"))).when(p == 1, F.concat(F.lit("Intel® Core™ i"), size, F.lit(" (Gen)"))).when(p == 2, F.concat(F.lit("NVIDIA GeForce RTX"), size, F.lit("0 Graphics"))).when(p == 3, "Intel Graphics").otherwise(F.concat(F.lit("Snapdragon X"), size))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("slug", identity.component_slug(F.col("raw")))


@Q.add(f"WITH {COMPONENT_SQL} SELECT p_partkey, raw, CASE WHEN regexp_matches(t, '[0-9]') THEN replace(t, ' ', '-') END AS slug FROM s")
def component_canonicalize(spark, sf_dir):
    return components(spark, sf_dir)


@Q.add(f"""WITH {COMPONENT_SQL}, k AS (SELECT p_partkey, CASE WHEN regexp_matches(t, '[0-9]') THEN replace(t, ' ', '-') END AS slug FROM s),
r AS (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM k WHERE slug IS NOT NULL)
SELECT p_partkey, slug FROM r WHERE n = 1 AND slug NOT IN (SELECT slug FROM k WHERE p_partkey <= 50 AND slug IS NOT NULL) AND p_partkey > 50""")
def first_sighting_unseen(spark, sf_dir):
    rows = components(spark, sf_dir)
    return resolve.unseen(rows.filter("p_partkey > 50"), rows.filter("p_partkey <= 50"), "slug", ["p_partkey"]).filter("is_unseen").select("p_partkey", "slug")


MODEL_SQL = "string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9-]+', ' ', 'g')), ' ')"


@Q.add(f"""WITH t AS (SELECT p_partkey, p_brand, list_slice({MODEL_SQL.replace('lower(p_name)', "lower(p_name || ' ' || p_size || ' mini pc')")}, 1, 4) AS h FROM part),
k AS (SELECT *, list_position(list_transform(h, lambda x: regexp_matches(x, '[0-9]')), true) AS pos FROM t)
SELECT p_partkey, lower(p_brand) || '::' || array_to_string(list_slice(h, 1, CASE WHEN coalesce(pos, 0) > 0 THEN pos ELSE 2 END), '-') AS model_key FROM k""")
def model_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", identity.model_key(F.col("p_brand"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mini pc"))).alias("model_key"))


@Q.add("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_id, count(*) AS n_seen, count(*) - 1 AS n_touched FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_seen"), (F.count(F.lit(1)) - 1).alias("n_touched"))


@Q.add(sql(f"SELECT listing, captured_at, l_orderkey, l_linenumber, amount, availability FROM (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM v_snapshots) WHERE n = 1", "v_snapshots"))
def latest_snapshot(spark, sf_dir):
    return state.latest(views.snapshots(spark, sf_dir), ["listing"], [F.desc(c) for c in ORDER]).select("listing", "captured_at", "l_orderkey", "l_linenumber", "amount", "availability")


@Q.add(sql(f"SELECT availability, count(*) AS n_snapshots FROM (SELECT *, lag(availability) OVER ({OVER}) AS b FROM v_snapshots) WHERE b IS DISTINCT FROM availability GROUP BY ALL", "v_snapshots"))
def snapshot_append(spark, sf_dir):
    return state.fresh_snapshots(views.snapshots(spark, sf_dir), "listing", "availability", ORDER).groupBy("availability").agg(F.count(F.lit(1)).alias("n_snapshots"))


@Q.add(sql("SELECT listing, min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(*) AS n_seen FROM v_snapshots GROUP BY listing", "v_snapshots"))
def listing_touch(spark, sf_dir):
    return state.touched(views.snapshots(spark, sf_dir), "listing", "captured_at")


@Q.add("SELECT model, id, n_suppressed FROM (SELECT p_name AS model, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_name) - 1 AS n_suppressed FROM part) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("model"), F.col("p_partkey").alias("id"))
    counts = rows.groupBy("model").agg((F.count(F.lit(1)) - 1).alias("n_suppressed"))
    return state.keep_first(rows, ["model"], ["id"]).join(counts, "model").select("model", "id", "n_suppressed")


TIERS = "[" + ", ".join(f"'{w}'" for w in identity.TIER_WORDS) + "]"


@Q.add(sql(f"""SELECT i.product_key, coalesce(CASE WHEN same.product_key IS NOT NULL THEN i.product_key END, bysku.k, CASE WHEN bymodel.k IS NOT NULL AND NOT (coalesce(i.vendor_sku <> bymodel.s, false)) THEN bymodel.k END) AS prior_key,
  CASE WHEN same.product_key IS NOT NULL THEN 'same_listing' WHEN bysku.k IS NOT NULL OR (bymodel.k IS NOT NULL AND NOT coalesce(i.vendor_sku <> bymodel.s, false)) THEN 'existing_product' ELSE 'none' END AS relation
FROM i LEFT JOIN (SELECT DISTINCT product_key FROM known) same USING (product_key)
LEFT JOIN (SELECT a.product_key AS me, arg_max(b.product_key, (b.last_seen, b.id)) AS k FROM i a JOIN known b ON a.vendor_sku = b.vendor_sku AND a.product_key <> b.product_key GROUP BY 1) bysku ON bysku.me = i.product_key
LEFT JOIN (SELECT mk, arg_max(product_key, (last_seen, id)) AS k, arg_max(coalesce(vendor_sku, ''), (last_seen, id)) AS s0, nullif(arg_max(coalesce(vendor_sku, ''), (last_seen, id)), '') AS s FROM known GROUP BY mk) bymodel ON bymodel.mk = i.mk
""", "v_listings").replace("\nSELECT i.product_key", ", m AS (SELECT *, lower(manufacturer) || '::' || lower(model) AS mk FROM v_listings), known AS (SELECT * FROM m WHERE id % 4 <> 0), i AS (SELECT * FROM m WHERE id % 2 = 0)\nSELECT i.product_key", 1))
def resolve_prior_cascade(spark, sf_dir):
    rows = views.listings(spark, sf_dir).withColumn("model_key", F.concat(F.lower("manufacturer"), F.lit("::"), F.lower("model")))
    incoming = rows.filter("id % 2 = 0").select("product_key", "model", "model_key", "vendor_sku")
    return resolve.resolve_prior(incoming, rows.filter("id % 4 <> 0")).select("product_key", "prior_key", "relation")


@Q.add("""SELECT 'rows:orders' AS "check", count(*) AS n FROM orders UNION ALL SELECT 'rows:customer', count(*) FROM customer UNION ALL SELECT 'rows:lineitem', count(*) FROM lineitem
UNION ALL SELECT 'orphans:lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orphans:orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def archive_audit(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem")}
    return state.audit(tables, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")])


@Q.add("""WITH a AS (SELECT p_brand AS b, count(*) AS now FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), t AS (SELECT p_brand AS b, count(*) AS thn FROM part WHERE p_partkey % 7 <> 0 OR p_size > 25 GROUP BY 1)
SELECT coalesce(a.b, t.b) AS "check", now, thn AS "then", CASE WHEN thn IS NULL THEN 'added' WHEN now IS NULL THEN 'missing' WHEN now = thn THEN 'equal' ELSE 'changed' END AS state FROM a FULL JOIN t ON a.b = t.b""")
def manifest_compare(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    count = lambda d: d.groupBy(F.col("p_brand").alias("check")).agg(F.count(F.lit(1)).alias("n"))
    return state.compared(count(part.filter("p_partkey % 3 <> 0")), count(part.filter("p_partkey % 7 <> 0 or p_size > 25")))


@Q.add(sql(f"""SELECT change_type, severity, status, count(*) AS n FROM (SELECT *, CASE WHEN change_type = 'new_product' THEN 5 WHEN change_type = 'spec_changed' THEN 2 ELSE 3 END AS severity, CASE WHEN baseline OR change_type = 'spec_changed' THEN 'suppressed' ELSE 'pending' END AS status,
 row_number() OVER (PARTITION BY product_key, change_type, k ORDER BY detected_at, id) AS rn FROM v_events) e WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_events o WHERE o.id % 50 = 0 AND o.product_key = e.product_key AND o.change_type = e.change_type AND o.k = e.k) GROUP BY ALL""", "v_events"))
def outbox_enqueue(spark, sf_dir):
    e = views.events(spark, sf_dir).withColumn("dedup_key", identity.key_of(F.col("product_key"), F.col("change_type"), F.col("k"))).withColumn("severity", rules.severity({"change_type": F.col("change_type"), "field": F.lit(None).cast("string"), "unseen_component": F.lit(False)}))
    return state.enqueued(e, e.filter("id % 50 = 0"), 3).groupBy("change_type", "severity", "status").agg(F.count(F.lit(1)).alias("n"))
