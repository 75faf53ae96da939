"""Alert reviews, suggestions, stories, collector health, dashboard payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, text
from .. import shared
from ..operators import feedback, health, state, stories, suggest
from ..schema import EVIDENCE_TYPES, FeedbackThresholds, StoryRule
from . import views
from .views import Queries, sql, table

Q = Queries()
EV, RV = "v_events", ("v_events", "v_reviews", "v_reviewed")
TALLY = """count(*) AS total, count(*) FILTER (WHERE outcome = 'HIT') AS hit, count(*) FILTER (WHERE outcome = 'INTERESTING') AS interesting, count(*) FILTER (WHERE outcome = 'NOISE') AS noise, count(*) FILTER (WHERE outcome = 'BUG') AS bug, count(*) FILTER (WHERE outcome IN ('HIT', 'INTERESTING')) AS signal"""
NOISE_RATE = "round(noise / total, 4) AS noise_rate"


def grouped(key: str, source: str = "v_reviewed") -> str:
    return f"SELECT *, {NOISE_RATE} FROM (SELECT {key} AS key, {TALLY} FROM {source} GROUP BY ALL)"


SUMMARY = """SELECT total_alerts, reviewed, total_alerts - reviewed AS unreviewed, hit, interesting, noise, bug, round(reviewed / total_alerts, 4) AS review_rate, round(hit / reviewed, 4) AS hit_rate, round(noise / reviewed, 4) AS noise_rate,
 round(bug / reviewed, 4) AS bug_rate, round((hit + interesting) / reviewed, 4) AS signal_rate, round((hit + interesting) / noise, 4) AS signal_to_noise, noise = 0 AND hit + interesting > 0 AS signal_to_noise_infinite
FROM (SELECT count(*) AS total_alerts, count(outcome) AS reviewed, count(*) FILTER (WHERE outcome = 'HIT') AS hit, count(*) FILTER (WHERE outcome = 'INTERESTING') AS interesting, count(*) FILTER (WHERE outcome = 'NOISE') AS noise, count(*) FILTER (WHERE outcome = 'BUG') AS bug FROM {a} LEFT JOIN {r} ON alert_id = id {w})"""


@Q.add(sql(SUMMARY.format(a="v_events", r="v_reviews", w="WHERE NOT baseline"), "v_events", "v_reviews"))
def feedback_summary(spark, sf_dir):
    return feedback.summary(views.events(spark, sf_dir).filter("not baseline"), views.reviews(spark, sf_dir))


@Q.add(sql(SUMMARY.format(a="v_doc_alerts", r="v_doc_reviews", w=""), "v_doc_alerts", "v_doc_reviews"))
def feedback_summary_documents(spark, sf_dir):
    return feedback.summary(views.doc_alerts(spark, sf_dir), views.doc_reviews(spark, sf_dir))


@Q.add(sql(SUMMARY.format(a="v_events", r="v_reviews", w="WHERE detected_at >= TIMESTAMP '2024-01-05' AND detected_at < TIMESTAMP '2024-01-15'"), "v_events", "v_reviews"))
def feedback_summary_range(spark, sf_dir):
    e = views.events(spark, sf_dir).filter("detected_at >= timestamp_ntz'2024-01-05' and detected_at < timestamp_ntz'2024-01-15'")
    return feedback.summary(e, views.reviews(spark, sf_dir))


_breakdowns = {
    "collector": ("collector", lambda: identity.collector_of(F.col("product_key"))),
    "alert_type": ("change_type", lambda: F.col("change_type")),
    "day": ("strftime(detected_at, '%Y-%m-%d')", lambda: text.day_key(F.col("detected_at"))),
    "week": ("strftime(detected_at, '%Y-W%W')", lambda: text.week_key(F.col("detected_at"))),
    "confidence": ("CASE WHEN magnitude_pct IS NULL THEN 'unknown' WHEN magnitude_pct / 500 < 0.2 THEN '0.0-0.2' WHEN magnitude_pct / 500 < 0.4 THEN '0.2-0.4' WHEN magnitude_pct / 500 < 0.6 THEN '0.4-0.6' WHEN magnitude_pct / 500 < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END", lambda: feedback.confidence_bucket(F.col("magnitude_pct") / 500)),
}


def _make(name, key_sql, key):
    def run(spark, sf_dir):
        return feedback.breakdown(views.reviewed(spark, sf_dir), key())

    run.__name__ = f"breakdown_{name}"
    Q.add(sql(grouped(key_sql), *RV))(run)


for _name, (_sql, _key) in _breakdowns.items():
    _make(_name, _sql, _key)


OEM_SQL = "(SELECT r.*, p_brand FROM v_reviewed r LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 10) ON p_partkey = user_id)"


@Q.add(sql(grouped("coalesce(p_brand, collector)", OEM_SQL), *RV))
def breakdown_oem(spark, sf_dir):
    """The manufacturer of the alert's product, of which some are unknown: then the collector stands for it."""
    rows = feedback.with_manufacturer(views.reviewed(spark, sf_dir), listed_parts(spark, sf_dir))
    return feedback.breakdown(rows, F.col("manufacturer"))


def listed_parts(spark, sf_dir):
    """Listings of the events' products, as far as they are known: product_key, manufacturer, model, url."""
    k = F.col("p_partkey")
    key = F.concat(F.lit("src-"), (k % 12).cast("string"), F.lit(":p"), k.cast("string"))
    return table(spark, sf_dir, "part").filter("p_size > 10").select(key.alias("product_key"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"), F.concat(F.lit("https://x.test/"), k.cast("string")).alias("url"))


@Q.add(sql("SELECT id, coalesce(p_brand, collector) AS manufacturer, p_name AS model, 'https://x.test/' || p_partkey AS url, change_type FROM v_events LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = user_id WHERE detected_at >= TIMESTAMP '2024-01-17'", "v_events"))
def story_rows(spark, sf_dir):
    """The alerts that stories look at, with the manufacturer, model and address of their product."""
    e = views.events(spark, sf_dir).filter(F.col("detected_at") >= F.expr("timestamp_ntz'2024-01-17'"))
    return feedback.with_manufacturer(e, listed_parts(spark, sf_dir)).select("id", "manufacturer", "model", "url", "change_type")


REASONS = "(SELECT outcome, CASE WHEN len(reasons) = 0 THEN ['(none)'] ELSE list_distinct(reasons) END AS c FROM v_reviewed)"


@Q.add(sql(grouped("code", f"(SELECT outcome, unnest(c) AS code FROM {REASONS})"), *RV))
def breakdown_reason_code(spark, sf_dir):
    return feedback.by_reason(views.reviewed(spark, sf_dir))


def _ranking(name, of, of_sql, rate, rate_sql, least=10, top=5, where=None):
    def run(spark, sf_dir):
        groups = of(spark, sf_dir)
        return feedback.ranking(groups.filter(where) if where else groups, rate(), least, top)

    run.__name__ = f"ranking_{name}"
    Q.add(sql(f"SELECT *, {rate_sql} AS rate FROM ({of_sql}) WHERE total >= {least}{' AND ' + where if where else ''} ORDER BY rate DESC, total DESC, key LIMIT {top}", *RV))(run)


_by_collector = (lambda s, d: feedback.breakdown(views.reviewed(s, d), F.col("collector")), grouped("collector"))
_by_type = (lambda s, d: feedback.breakdown(views.reviewed(s, d), F.col("change_type")), grouped("change_type"))
_by_reason = (lambda s, d: feedback.by_reason(views.reviewed(s, d)), grouped("code", f"(SELECT outcome, unnest(c) AS code FROM {REASONS})"))
_ranking("noisiest", *_by_collector, lambda: text.share(F.col("noise"), F.col("total")), "round(noise / total, 4)")
_ranking("hit_rate", *_by_collector, lambda: text.share(F.col("hit"), F.col("total")), "round(hit / total, 4)")
_ranking("low_value_types", *_by_type, lambda: text.share(F.col("noise"), F.col("total")), "round(noise / total, 4)", 10, 3)
_ranking("high_hit_types", *_by_type, lambda: text.share(F.col("hit"), F.col("total")), "round(hit / total, 4)", 10, 3)
_ranking("noise_reasons", *_by_reason, lambda: F.col("noise"), "noise", 1, 10, "key <> '(none)'")
_ranking("bug_reasons", *_by_reason, lambda: F.col("bug"), "bug", 1, 10, "key <> '(none)'")


@Q.add(sql("SELECT collector AS key, count(*) AS total FROM v_events WHERE id NOT IN (SELECT alert_id FROM v_reviews) AND NOT baseline GROUP BY ALL ORDER BY total DESC, key LIMIT 5", "v_events", "v_reviews"))
def ranking_unreviewed(spark, sf_dir):
    rows = feedback.unreviewed(views.events(spark, sf_dir).filter("not baseline"), views.reviews(spark, sf_dir))
    return rows.groupBy(F.col("collector").alias("key")).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "key").limit(5)


@Q.add(sql("SELECT id, product_key, change_type, detected_at FROM v_events WHERE id NOT IN (SELECT alert_id FROM v_reviews) AND NOT baseline ORDER BY detected_at, id LIMIT 20", "v_events", "v_reviews"))
def ranking_oldest_unreviewed(spark, sf_dir):
    return feedback.unreviewed(views.events(spark, sf_dir).filter("not baseline"), views.reviews(spark, sf_dir)).select("id", "product_key", "change_type", "detected_at").orderBy("detected_at", "id").limit(20)


# ---- suggestions

ALERT_SQL = "(SELECT id, collector, change_type AS alert_type, magnitude_pct / 20 AS magnitude_pct, detected_at, k, ['u' || k || '?a'] AS old_urls, CASE WHEN k % 5 = 0 THEN ['u' || k || '?b'] ELSE ['v' || k] END AS new_urls FROM v_events)"


def alerts(spark, sf_dir, only_reviewed):
    e = views.events(spark, sf_dir)
    k = F.col("k").cast("string")
    rows = e.select(
        "id", "collector", F.col("change_type").alias("alert_type"), (F.col("magnitude_pct") / 20).alias("magnitude_pct"), "detected_at", F.array(F.concat(F.lit("u"), k, F.lit("?a"))).alias("old_urls"),
        F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("u"), k, F.lit("?b")))).otherwise(F.array(F.concat(F.lit("v"), k))).alias("new_urls"),
        F.struct(k.alias("content_hash_before"), F.when(F.col("k") % 2 == 0, k).otherwise("x").alias("content_hash_after"), F.lit(None).cast("boolean").alias("identical_content_hash")).alias("meta"),
    )
    r = views.reviews(spark, sf_dir).select(F.col("alert_id").alias("id"), "outcome", "reasons")
    return rows.join(r, "id", "inner" if only_reviewed else "left")


def candidate_sql(rows: str, rule: str, reason: str, parameters: str) -> str:
    return f"""SELECT '{rule}' AS rule_type, collector, alert_type, {reason} AS reason_code, '{parameters}' AS parameters, count(*) AS samples, count(*) FILTER (WHERE outcome = 'HIT') AS hit, count(*) FILTER (WHERE outcome = 'INTERESTING') AS interesting, count(*) FILTER (WHERE outcome = 'NOISE') AS noise, count(*) FILTER (WHERE outcome = 'BUG') AS bug,
 round(count(*) FILTER (WHERE outcome = 'NOISE') / count(*), 4) AS noise_reduction, round(count(*) FILTER (WHERE outcome = 'HIT') / count(*), 4) AS hit_loss, round(count(*) FILTER (WHERE outcome = 'INTERESTING') / count(*), 4) AS interesting_loss, round(count(*) FILTER (WHERE outcome IN ('HIT', 'INTERESTING')) / count(*), 4) AS signal_loss, min(detected_at) AS sample_start, max(detected_at) AS sample_end
FROM ({rows}) GROUP BY collector, alert_type HAVING count(*) >= 10 AND count(*) FILTER (WHERE outcome = 'NOISE') / count(*) >= 0.75"""


REV_SQL = f"(SELECT a.*, r.outcome, r.reasons FROM {ALERT_SQL} a JOIN v_reviews r ON r.alert_id = a.id)"
CHURN_SQL = "['CDN_URL_CHURN', 'ROUTINE_IMAGE_CHANGE', 'MARKETING_ASSET_REFRESH']"
DETECTOR_SQL = {
    "temporary_404": candidate_sql(f"SELECT * FROM (SELECT *, bool_or(list_contains(reasons, 'TEMPORARY_404')) OVER (PARTITION BY collector, alert_type) AS cited FROM {REV_SQL} WHERE alert_type IN ('product_removed', 'availability_changed')) WHERE NOT cited OR list_contains(reasons, 'TEMPORARY_404')", "require_consecutive_missing", "'TEMPORARY_404'", '{"minimum_elapsed_hours":24,"minimum_observations":2}'),
    "duplicates": candidate_sql(f"SELECT * FROM (SELECT *, bool_or(list_contains(reasons, 'DUPLICATE_ALERT')) OVER (PARTITION BY collector, alert_type) AS cited FROM {REV_SQL}) WHERE CASE WHEN cited THEN list_contains(reasons, 'DUPLICATE_ALERT') ELSE outcome = 'NOISE' END", "suppress_exact_duplicate", "'DUPLICATE_ALERT'", '{"window_hours":24}'),
    "image_churn": candidate_sql(f"SELECT * FROM {REV_SQL} WHERE alert_type = 'images_changed' AND (list_has_any(reasons, {CHURN_SQL}) OR k % 5 = 0)", "normalize_image_url", "CASE WHEN bool_or(list_contains(reasons, 'CDN_URL_CHURN')) THEN 'CDN_URL_CHURN' WHEN bool_or(list_contains(reasons, 'ROUTINE_IMAGE_CHANGE')) THEN 'ROUTINE_IMAGE_CHANGE' WHEN bool_or(list_contains(reasons, 'MARKETING_ASSET_REFRESH')) THEN 'MARKETING_ASSET_REFRESH' ELSE 'CDN_URL_CHURN' END", '{"normalize_cdn_host":true,"strip_query":true}'),
    "unchanged_document": candidate_sql(f"SELECT * FROM {REV_SQL} WHERE list_has_any(reasons, ['UNCHANGED_DOCUMENT', 'DOCUMENT_METADATA_ONLY']) AND k % 2 = 0", "compare_content_hash", "'UNCHANGED_DOCUMENT'", "{}"),
    "minor_price": candidate_sql(f"SELECT * FROM {REV_SQL} WHERE alert_type = 'price_changed' AND magnitude_pct < 5", "minimum_price_change_percent", "'MINOR_PRICE_FLUCTUATION'", '{"minimum_pct":5.0}'),
}


def _suggest(name):
    def run(spark, sf_dir):
        return suggest.candidates(alerts(spark, sf_dir, True), FeedbackThresholds(), [name])

    run.__name__ = f"suggest_{name}"
    Q.add(sql(DETECTOR_SQL[name], "v_events", "v_reviews"))(run)


for _name in DETECTOR_SQL:
    _suggest(_name)

ALL_SQL = " UNION ALL ".join(DETECTOR_SQL.values())
FINGERPRINT = "substr(sha256(rule_type || '|' || collector || '|' || alert_type || '|' || reason_code || '|' || parameters), 1, 32)"


@Q.add(sql(f"SELECT action, status, count(*) AS n FROM (SELECT CASE CAST(substr(collector, 5) AS INT) % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'left' ELSE 'inserted' END AS action, CASE CAST(substr(collector, 5) AS INT) % 3 WHEN 1 THEN 'REJECTED' ELSE 'PROPOSED' END AS status FROM ({ALL_SQL})) GROUP BY ALL", "v_events", "v_reviews"))
def suggestion_merge(spark, sf_dir):
    got = suggest.suggestions(alerts(spark, sf_dir, True))
    m = F.split_part("collector", F.lit("-"), F.lit(2)).cast("int") % 3
    stored = got.filter(m != 2).withColumn("status", F.when(m == 1, "REJECTED").otherwise("PROPOSED"))
    return state.merged_suggestions(stored, got).groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))


@Q.add(sql(f"SELECT {FINGERPRINT} AS fingerprint, rule_type, collector, alert_type FROM ({ALL_SQL})", "v_events", "v_reviews"))
def suggestion_fingerprints(spark, sf_dir):
    return suggest.suggestions(alerts(spark, sf_dir, True)).select("fingerprint", "rule_type", "collector", "alert_type")


SIM_TEST = "CASE rule_type WHEN 'require_consecutive_missing' THEN a.alert_type IN ('product_removed', 'availability_changed') WHEN 'suppress_exact_duplicate' THEN true WHEN 'normalize_image_url' THEN a.alert_type = 'images_changed' WHEN 'compare_content_hash' THEN k % 2 = 0 ELSE a.alert_type = 'price_changed' AND magnitude_pct < 5 END"


@Q.add(sql(f"""SELECT rule_type, collector, alert_type, matched, reviewed, matched - reviewed AS unreviewed, hit, interesting, noise, bug, round(reviewed / matched, 4) AS review_coverage, round(noise / reviewed, 4) AS noise_reduction, round((hit + interesting) / reviewed, 4) AS signal_loss,
 round((hit + interesting) / reviewed, 4) AS precision_before, CASE WHEN hit + interesting > 0 THEN 1.0::DOUBLE END AS recall_before, CASE WHEN reviewed < 10 OR round(reviewed / matched, 4) < 0.5 THEN 'INSUFFICIENT_EVIDENCE' WHEN round((hit + interesting) / reviewed, 4) > 0.05 THEN 'RISKY' ELSE 'SAFE_CANDIDATE' END AS assessment
FROM (SELECT rule_type, a.collector, a.alert_type, count(*) AS matched, count(outcome) AS reviewed, count(*) FILTER (WHERE outcome = 'HIT') AS hit, count(*) FILTER (WHERE outcome = 'INTERESTING') AS interesting, count(*) FILTER (WHERE outcome = 'NOISE') AS noise, count(*) FILTER (WHERE outcome = 'BUG') AS bug
FROM {ALERT_SQL} a LEFT JOIN v_reviews r ON r.alert_id = a.id JOIN (SELECT rule_type, collector, alert_type FROM ({ALL_SQL})) s ON s.collector = a.collector AND s.alert_type = a.alert_type WHERE {SIM_TEST} GROUP BY ALL)""", "v_events", "v_reviews"))
def simulate_rule(spark, sf_dir):
    return suggest.simulate(alerts(spark, sf_dir, False), suggest.suggestions(alerts(spark, sf_dir, True)))


@Q.add("SELECT user_id AS alert_id, event_id AS id, event_type AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def review_latest_state(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("id"), F.col("ts").alias("changed_at"), F.col("event_type").alias("outcome"))
    return state.review_state(h).select("alert_id", "id", "outcome")


# ---- stories

STORY_RULES = (StoryRule("shared-type", {"change_type": "price_changed"}, "k", 8, 7, 60, 5), StoryRule("unseen", {"unseen": True}, "change_type", 3, 14, 70, 10), StoryRule("off", {}, "k", 1, 30, 10, 1, False))
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
STORY_SQL = f"""ev AS (SELECT 'shared-type' AS rule_id, CAST(k AS VARCHAR) AS key, collector AS manufacturer, product_key, detected_at, id FROM v_events WHERE change_type = 'price_changed' AND detected_at >= {NOW_SQL} - INTERVAL 7 DAY
 UNION ALL SELECT 'unseen', change_type, collector, product_key, detected_at, id FROM v_events WHERE unseen AND detected_at >= {NOW_SQL} - INTERVAL 14 DAY),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, key, manufacturer ORDER BY detected_at, id) AS n FROM ev) WHERE n = 1),
st AS (SELECT rule_id, key, count(*) AS n_manufacturers, string_agg(manufacturer, ',' ORDER BY manufacturer) AS manufacturers, min(detected_at) AS first_at, max(detected_at) AS last_at FROM f GROUP BY ALL
 HAVING count(*) >= CASE rule_id WHEN 'unseen' THEN 3 ELSE 8 END)"""


def _story_sql(body):
    return f"WITH v_events AS ({views.SQL['v_events']}), {STORY_SQL} {body}"


def story_events(spark, sf_dir):
    return views.events(spark, sf_dir).withColumn("manufacturer", F.col("collector"))


def now():
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")


STORY_COLUMNS = "SELECT *, least(100, CASE rule_id WHEN 'unseen' THEN 70 + (n_manufacturers - 3) * 10 ELSE 60 + (n_manufacturers - 8) * 5 END) AS score, substr(sha256(rule_id || '|' || key || '|' || manufacturers), 1, 32) AS dedup_key FROM st"


@Q.add(_story_sql(STORY_COLUMNS))
def story_detect(spark, sf_dir):
    return stories.detect(story_events(spark, sf_dir), STORY_RULES, now())


@Q.add(_story_sql("SELECT rule_id, key, manufacturer, id FROM f"))
def story_evidence(spark, sf_dir):
    return stories.evidence(story_events(spark, sf_dir), STORY_RULES, now()).select("rule_id", "key", "manufacturer", "id")


@Q.add(_story_sql("SELECT CASE WHEN product_key IN (SELECT product_key FROM f SEMI JOIN st USING (rule_id, key)) AND severity < 4 THEN 'demoted' WHEN severity < 4 THEN 'pending' ELSE 'sent' END AS status, count(*) AS n FROM (SELECT product_key, CASE WHEN k % 2 = 0 THEN 3 ELSE 5 END AS severity FROM v_events) GROUP BY ALL"))
def story_demotions(spark, sf_dir):
    e = story_events(spark, sf_dir)
    told = stories.evidence(e, STORY_RULES, now()).join(stories.detect(e, STORY_RULES, now()).select("rule_id", "key"), ["rule_id", "key"], "left_semi")
    outbox = e.select("product_key", F.when(F.col("k") % 2 == 0, "pending").otherwise("sent").alias("status"))
    return state.demoted(outbox, told).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@Q.add(_story_sql("SELECT rule_id, key FROM st WHERE rule_id <> 'unseen'"))
def story_dedup(spark, sf_dir):
    got = stories.detect(story_events(spark, sf_dir), STORY_RULES, now())
    return state.new_rows(got, got.filter("rule_id = 'unseen'"), ["dedup_key"], ["first_at"]).select("rule_id", "key")


# ---- health

HEALTH_SQL = """p AS (SELECT *, last_value(CASE WHEN status <> 'failed' THEN discovered END IGNORE NULLS) OVER (PARTITION BY source ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM v_runs),
h AS (SELECT *, round(discovered / nullif(previous, 0), 4) AS catalog_share,
 CASE WHEN discovered = 0 THEN CASE WHEN previous IS NULL OR previous > 0 THEN 'failed' ELSE 'ok' END WHEN discovered / nullif(previous, 0) < 0.35 THEN 'failed' WHEN discovered / nullif(previous, 0) < 0.7 THEN 'degraded' ELSE 'ok' END AS health,
 CASE WHEN discovered = 0 THEN CASE WHEN previous IS NULL THEN 'NO_PREVIOUS_BASELINE' WHEN previous > 0 THEN 'UNEXPECTED_ZERO' ELSE 'HEALTHY_CATALOG' END WHEN discovered / nullif(previous, 0) < 0.35 THEN 'CATALOG_FAILURE_THRESHOLD' WHEN discovered / nullif(previous, 0) < 0.7 THEN 'CATALOG_WARN_THRESHOLD'
  WHEN previous IS NULL THEN 'NO_PREVIOUS_BASELINE' WHEN previous > 0 AND previous <> discovered THEN 'RECOVERED' ELSE 'HEALTHY_CATALOG' END AS health_reason FROM p)"""


def _health_sql(body):
    return f"WITH v_runs AS ({views.SQL['v_runs']}), {HEALTH_SQL} {body}"


def checked(spark, sf_dir):
    return health.catalogue_health(views.runs(spark, sf_dir))


@Q.add(_health_sql("SELECT id, source, discovered, previous, catalog_share, health, health_reason FROM h"))
def catalog_health(spark, sf_dir):
    return checked(spark, sf_dir).select("id", "source", "discovered", "previous", "catalog_share", "health", "health_reason")


LATEST_SQL = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM h) WHERE n = 1)"


@Q.add(_health_sql(f", {LATEST_SQL} SELECT t.*, u.*, round(failed_runs / total_runs, 4) AS run_failure_rate FROM (SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'ok') AS ok_runs, count(*) FILTER (WHERE status = 'failed') AS failed_runs, round(avg(epoch(finished_at) - epoch(started_at)), 2) AS average_duration_s FROM h) t, (SELECT count(*) FILTER (WHERE health = 'ok') AS currently_ok, count(*) FILTER (WHERE health = 'degraded') AS currently_degraded, count(*) FILTER (WHERE health = 'failed') AS currently_failed, round(avg(discovered), 1) AS average_catalog_size FROM l) u").replace(") ,", "),"))
def run_health(spark, sf_dir):
    return health.run_metrics(checked(spark, sf_dir))


@Q.add(_health_sql(f", {LATEST_SQL} SELECT 'engine-' || (CAST(substr(source, 5) AS INT) % 5) AS engine, count(*) AS sources, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 4) AS stability FROM l WHERE CAST(substr(source, 5) AS INT) < 20 GROUP BY ALL").replace(") ,", "),"))
def engine_stability(spark, sf_dir):
    rows = checked(spark, sf_dir)
    n = F.substring("source", 5, 10).cast("int")
    registry = rows.select("source").distinct().filter(n < 20).withColumn("engine", F.concat(F.lit("engine-"), (n % 5).cast("string")))
    return health.stability(rows, registry)


@Q.add(sql("SELECT source, max(started_at) FILTER (WHERE status = 'ok') AS last_ok, coalesce(max(started_at) FILTER (WHERE status = 'ok') <= TIMESTAMP '1998-08-01' - INTERVAL 1 DAY * (1 + CAST(substr(source, 5) AS INT)), true) AS is_due FROM v_runs GROUP BY source", "v_runs"))
def source_due(spark, sf_dir):
    rows = views.runs(spark, sf_dir)
    registry = rows.select("source").distinct().withColumn("interval_s", 86400 * (1 + F.substring("source", 5, 10).cast("int")))
    return health.due(registry, rows, F.expr("timestamp_ntz'1998-08-01'")).select("source", "last_ok", "is_due")


@Q.add(sql("SELECT *, round(total / d, 2) AS total_per_day, round(unseen / d, 2) AS unseen_per_day FROM (SELECT count(*) AS total, count(*) FILTER (WHERE baseline) AS baseline, count(*) FILTER (WHERE unseen) AS unseen, greatest(1.0, (epoch_us(max(detected_at)) - epoch_us(min(detected_at))) / 86400000000.0) AS d, round(d, 2) AS span_days FROM v_events)", "v_events").replace("SELECT *, round(total", "SELECT total, baseline, unseen, span_days, round(total"))
def signal_rates_per_day(spark, sf_dir):
    return health.signal_rates(views.events(spark, sf_dir))


@Q.add("SELECT p_type AS engine, count(*) AS sources, count(DISTINCT p_brand) AS oems, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS oem_list FROM part GROUP BY p_type")
def coverage(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("engine")).agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("p_brand").alias("oems"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("oem_list"))


@Q.add(sql("SELECT CASE WHEN baseline THEN 'suppressed' WHEN k % 9 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'sent' ELSE 'pending' END AS status, count(*) AS n, sum(CASE WHEN baseline OR k % 3 <> 0 THEN 0 ELSE 1 END)::BIGINT AS attempts FROM v_events GROUP BY ALL", "v_events"))
def outbox_status(spark, sf_dir):
    e = views.events(spark, sf_dir)
    outbox = e.select("id", "k", F.when(F.col("baseline"), "suppressed").otherwise("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("sent_at"))
    results = e.filter("not baseline and k % 3 = 0").select("id", F.when(F.col("k") % 9 == 0, "failed").otherwise("sent").alias("result"), F.col("detected_at").alias("at"))
    return state.marked(outbox, results).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@Q.add(sql("SELECT r.id, r.source, r.status, r.finished_at AS last_finished_run, 'healthy' AS state, CASE WHEN r IS NULL THEN 'no finished run' ELSE '' END AS reasons FROM (SELECT arg_max({'id': id, 'source': source, 'status': status, 'finished_at': finished_at}, (finished_at, id)) FILTER (WHERE finished_at IS NOT NULL) AS r FROM v_runs)", "v_runs"))
def runtime_state(spark, sf_dir):
    return health.runtime_state(views.runs(spark, sf_dir), shared.writable(spark, shared.folder(spark))).withColumn("reasons", F.array_join("reasons", ","))


# ---- dashboard

@Q.add(sql("SELECT e.id, detected_at, product_key, change_type, CASE WHEN k % 3 = 0 THEN 'sent' END AS status, outcome FROM v_events e LEFT JOIN v_reviews ON alert_id = e.id WHERE NOT baseline ORDER BY detected_at DESC, e.id DESC LIMIT 300", "v_events", "v_reviews"))
def dashboard_feed(spark, sf_dir):
    e = views.events(spark, sf_dir)
    sent = e.filter("k % 3 = 0").select("id", F.lit("sent").alias("status"))
    r = views.reviews(spark, sf_dir).select(F.col("alert_id").alias("id"), "outcome")
    plain = ~F.col("change_type").isin(*EVIDENCE_TYPES) & ~F.col("product_key").startswith("evidence:")
    return e.filter("not baseline").filter(plain).join(sent, "id", "left").join(r, "id", "left").select("id", "detected_at", "product_key", "change_type", "status", "outcome").orderBy(F.desc("detected_at"), F.desc("id")).limit(300)


@Q.add(sql("SELECT count(*) AS alerts, count(*) FILTER (WHERE NOT baseline) AS shown, count(*) FILTER (WHERE baseline) AS baseline, count(*) FILTER (WHERE unseen AND NOT baseline) AS unseen, count(DISTINCT product_key) AS products, count(DISTINCT collector) AS collectors, count(outcome) AS reviewed, count(*) FILTER (WHERE outcome IS NULL AND NOT baseline) AS new_alerts, max(detected_at) AS last_at FROM v_events LEFT JOIN v_reviews ON alert_id = id", "v_events", "v_reviews"))
def dashboard_summary(spark, sf_dir):
    r = views.reviews(spark, sf_dir).select(F.col("alert_id").alias("id"), "outcome")
    shown = ~F.col("baseline")
    return views.events(spark, sf_dir).join(r, "id", "left").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(shown).alias("shown"), F.count_if("baseline").alias("baseline"), F.count_if(F.col("unseen") & shown).alias("unseen"), F.count_distinct("product_key").alias("products"),
        F.count_distinct("collector").alias("collectors"), F.count("outcome").alias("reviewed"), F.count_if(F.col("outcome").isNull() & shown).alias("new_alerts"), F.max("detected_at").alias("last_at"),
    )


@Q.add("SELECT n_name AS manufacturer, count(DISTINCT s_suppkey) AS products, min(r_name) AS region FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def manufacturer_registry(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier")
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("manufacturer")).agg(F.count_distinct("s_suppkey").alias("products"), F.min("r_name").alias("region")).orderBy(F.lower("manufacturer"))


@Q.add(sql("SELECT id, related_id FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.id DESC) AS n FROM v_events a JOIN v_events b ON a.product_key = b.product_key AND b.id < a.id) WHERE n <= 10", "v_events"))
def alert_related(spark, sf_dir):
    """The ten most recent earlier events of the same product, by offsets in one window instead of a self-join."""
    w = Window.partitionBy("product_key").orderBy("id")
    return views.events(spark, sf_dir).withColumn("near", F.collect_list("id").over(w.rowsBetween(-10, -1))).select("id", F.explode("near").alias("related_id"))


NEIGHBOURS = sql("SELECT id, lag(id) OVER (ORDER BY id) AS prev_id, lead(id) OVER (ORDER BY id) AS next_id FROM v_events", "v_events")


@Q.add(NEIGHBOURS)
def alert_prev_next(spark, sf_dir):
    """The alerts before and after each alert, over the alerts of all collectors."""
    return state.neighbours(views.events(spark, sf_dir), "id")


@Q.add(NEIGHBOURS)
def alert_prev_next_all(spark, sf_dir):
    """The name that alert_prev_next had while it kept to one collector."""
    return alert_prev_next(spark, sf_dir)


@Q.add(sql("SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM v_events WINDOW w AS (PARTITION BY product_key ORDER BY id)", "v_events"))
def alert_prev_next_product(spark, sf_dir):
    """The alerts of the same product before and after each alert."""
    w = Window.partitionBy("product_key").orderBy("id")
    return views.events(spark, sf_dir).select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


@Q.add(sql("SELECT DISTINCT change_type FROM v_events", "v_events"))
def change_types_seen(spark, sf_dir):
    return views.events(spark, sf_dir).select("change_type").distinct()


@Q.add(sql("SELECT id, repeat('*', severity) AS stars, change_type || ': ' || product_key AS title, substr('Move of ' || CAST(round(magnitude_pct, 1) AS VARCHAR) || ' %', 1, 64) AS body FROM (SELECT *, CASE WHEN unseen THEN 5 ELSE 3 END AS severity FROM v_events WHERE NOT baseline AND (unseen OR change_type = 'new_product'))", "v_events"))
def alert_cards(spark, sf_dir):
    e = views.events(spark, sf_dir).filter("not baseline and (unseen or change_type = 'new_product')")
    severity = F.when(F.col("unseen"), 5).otherwise(3)
    return e.select("id", F.repeat(F.lit("*"), severity).alias("stars"), F.concat_ws(": ", "change_type", "product_key").alias("title"), F.substring(F.concat(F.lit("Move of "), F.round("magnitude_pct", 1).cast("string"), F.lit(" %")), 1, 64).alias("body"))
