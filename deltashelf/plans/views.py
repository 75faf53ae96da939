"""Domain views over the driver's tables: a DataFrame function and the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REASON_CODES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CODES = "[" + ", ".join(f"'{c}'" for c in REASON_CODES) + "]"

SQL = {
    "v_events": """
      SELECT event_id AS id, ts AS detected_at, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        'src-' || (user_id % 12) AS collector, 'src-' || (user_id % 12) || ':p' || user_id AS product_key,
        CASE event_type WHEN 'signup' THEN 'new_product' WHEN 'purchase' THEN 'price_changed' WHEN 'click' THEN 'spec_changed'
          WHEN 'view' THEN 'images_changed' ELSE 'availability_changed' END AS change_type,
        value AS magnitude_pct,
        CAST(json_extract_string(props, '$.k') AS INT) = 0 AS baseline,
        CAST(json_extract_string(props, '$.k') AS INT) % 10 = 7 AS unseen,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'up' ELSE 'down' END AS direction
      FROM events""",
    "v_reviews": f"""
      SELECT id AS alert_id, detected_at + INTERVAL 1 HOUR AS changed_at,
        CASE WHEN user_id % 3 = 0 THEN CASE WHEN k < 90 THEN 'NOISE' WHEN k < 94 THEN 'INTERESTING' WHEN k < 97 THEN 'HIT' ELSE 'BUG' END
          ELSE CASE WHEN k % 10 < 5 THEN 'NOISE' WHEN k % 10 < 7 THEN 'INTERESTING' WHEN k % 10 < 9 THEN 'HIT' ELSE 'BUG' END END AS outcome,
        CASE WHEN k % 11 = 0 THEN [] WHEN k % 3 = 0 THEN [({_CODES})[k % 22 + 1], ({_CODES})[(k * 7 + 1) % 22 + 1]] ELSE [({_CODES})[k % 22 + 1]] END AS reasons
      FROM v_events WHERE id % 4 <> 0""",
    "v_reviewed": "SELECT e.*, r.outcome, r.reasons FROM v_events e JOIN v_reviews r ON r.alert_id = e.id",
    "v_snapshots": """
      SELECT l_partkey AS listing, l_shipdate AS captured_at, l_orderkey, l_linenumber, l_extendedprice AS amount,
        CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'N' THEN 'preorder' ELSE 'sold_out' END AS availability,
        CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' GB' AS memory, p_name AS model, p_brand AS manufacturer, p_type AS display
      FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "v_runs": """
      SELECT o_orderkey AS id, 'src-' || (o_custkey % 25) AS source, o_orderdate AS started_at,
        o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 600 + 5 AS INT) AS finished_at,
        CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'ok' END AS status, CAST(floor(o_totalprice / 1000) AS INT) AS discovered
      FROM orders""",
    "v_listings": """
      SELECT p_partkey AS id, 'src-' || (p_partkey % 25) || ':' || p_partkey AS product_key, p_brand AS manufacturer, p_name AS model,
        CASE WHEN p_partkey % 3 = 0 THEN 'SKU-' || (p_partkey % 700) END AS vendor_sku, p_size AS last_seen
      FROM part""",
    "v_doc_alerts": "SELECT doc_id AS id, source AS collector, lang AS change_type, n_chars FROM documents",
    "v_doc_reviews": """
      SELECT doc_id AS alert_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'HIT' WHEN quality = 1 THEN 'INTERESTING' WHEN toxic = 0 THEN 'NOISE' ELSE 'BUG' END AS outcome
      FROM labels""",
}


def sql(body: str, *views: str) -> str:
    """The query with the CTEs that it names, in order."""
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views) + "\n" + body


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def as_events(rows: DataFrame) -> DataFrame:
    """Rows of the events table as alerts."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = {"signup": "new_product", "purchase": "price_changed", "click": "spec_changed", "view": "images_changed"}
    kind = F.lit("availability_changed")
    for a, b in names.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    source = F.concat(F.lit("src-"), (F.col("user_id") % 12).cast("string"))
    return rows.select(
        F.col("event_id").alias("id"), F.col("ts").alias("detected_at"), "user_id", k.alias("k"), source.alias("collector"), F.concat(source, F.lit(":p"), F.col("user_id").cast("string")).alias("product_key"),
        kind.alias("change_type"), F.col("value").alias("magnitude_pct"), (k == 0).alias("baseline"), (k % 10 == 7).alias("unseen"), F.when(k % 2 == 0, "up").otherwise("down").alias("direction"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("k"), F.col("k") % 10
    skewed = F.when(k < 90, "NOISE").when(k < 94, "INTERESTING").when(k < 97, "HIT").otherwise("BUG")
    plain = F.when(m < 5, "NOISE").when(m < 7, "INTERESTING").when(m < 9, "HIT").otherwise("BUG")
    codes = F.array(*map(F.lit, REASON_CODES))
    one, two = F.element_at(codes, (k % 22 + 1).cast("int")), F.element_at(codes, ((k * 7 + 1) % 22 + 1).cast("int"))
    reasons = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    return events(spark, sf_dir).filter("id % 4 <> 0").select(F.col("id").alias("alert_id"), (F.col("detected_at") + F.expr("INTERVAL 1 HOUR")).alias("changed_at"), F.when(F.col("user_id") % 3 == 0, skewed).otherwise(plain).alias("outcome"), reasons.alias("reasons"))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select(F.col("alert_id").alias("id"), "outcome", "reasons")
    return events(spark, sf_dir).join(r, "id")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing"), F.col("p_name").alias("model"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("display"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("listing"), F.col("l_shipdate").alias("captured_at"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "A", "in_stock").when(F.col("l_returnflag") == "N", "preorder").otherwise("sold_out").alias("availability"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" GB")).alias("memory"),
    )
    return rows.join(part, "listing")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("src-"), (F.col("o_custkey") % 25).cast("string")).alias("source"), F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 600 + 5))).alias("finished_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("discovered"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), F.concat(F.lit("src-"), (p % 25).cast("string"), F.lit(":"), p.cast("string")).alias("product_key"), F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"),
        F.when(p % 3 == 0, F.concat(F.lit("SKU-"), (p % 700).cast("string"))).alias("vendor_sku"), F.col("p_size").alias("last_seen"),
    )


def doc_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collector"), F.col("lang").alias("change_type"), "n_chars")


def doc_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("alert_id"), F.when(q & t, "HIT").when(q, "INTERESTING").when(t, "NOISE").otherwise("BUG").alias("outcome"))


class Queries:
    """Queries by name, each with its SQL where there is one."""

    def __init__(self):
        self.run, self.sql = {}, {}

    def add(self, oracle: str | None = None, name: str | None = None):
        def put(f):
            self.run[name or f.__name__] = f
            if oracle:
                self.sql[name or f.__name__] = oracle
            return f

        return put
