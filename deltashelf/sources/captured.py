"""Captured vendor responses as DataFrames of references and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import checkpointed


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: url (the path) and body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def payload(body: Column, unwrap: str | None = None) -> Column:
    """The body as VARIANT, null if malformed; a wrapper member is taken off where there is one."""
    v = F.try_parse_json(body)
    return v if unwrap is None else F.coalesce(F.try_variant_get(v, f"$.{unwrap}", "variant"), v)


def list_pages(pages: DataFrame, member: str | None, per_page: int | None = None, most: int = 20) -> DataFrame:
    """Items of numbered pages (source, page, body), up to the first empty (or short) page of each source.

    Gives source, page, pos, item. Pages beyond the stop, or beyond the cap, are not read.
    """
    path = "$" if member is None else f"$.{member}"
    rows = pages.filter(F.col("page") <= most).withColumn("items", F.try_variant_get(F.try_parse_json("body"), path, "array<variant>"))
    n = F.coalesce(F.size("items"), F.lit(0))
    ends = n < (per_page if per_page else 1)
    stop = F.min(F.when(ends, F.col("page"))).over(Window.partitionBy("source"))
    return rows.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("page") <= F.col("stop"))).select("source", "page", F.posexplode("items").alias("pos", "item"))


def with_hidden(catalogue: DataFrame, sitemap: DataFrame, key: str = "handle") -> DataFrame:
    """References of both; those only the sitemap has are hidden."""
    more = sitemap.join(catalogue.select(key), key, "left_anti").withColumn("hidden", F.lit(True))
    return catalogue.withColumn("hidden", F.lit(False)).unionByName(more, allowMissingColumns=True)


def sitemap_urls(body: Column) -> Column:
    """The <loc> entries of a sitemap or a sitemap index."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_index(body: Column) -> Column:
    return F.coalesce(body.rlike("(?i)<sitemapindex"), F.lit(False))


def walk_sitemaps(maps: DataFrame, roots: DataFrame, most_maps: int | None = 50, most_urls: int | None = 3000) -> DataFrame:
    """URLs of all sitemaps reachable from the roots, breadth first; a missing or broken one counts as empty.

    maps: url, body. roots: source, url. The walk joins one level at a time until a level is empty; caps are by
    (depth, url) order per source, and None lifts them.
    """
    level = roots.select("source", "url").distinct()
    seen = level.withColumn("depth", F.lit(0))
    depth = 0
    while True:
        inner = level.join(maps.filter(is_index(F.col("body"))), "url").select("source", F.explode(sitemap_urls(F.col("body"))).alias("url")).distinct()
        level = checkpointed(inner.join(seen.select("source", "url"), ["source", "url"], "left_anti"))
        if level.isEmpty():
            break
        depth += 1
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
    if most_maps is not None:
        order = F.row_number().over(Window.partitionBy("source").orderBy("depth", "url"))
        seen = seen.withColumn("rn", order).filter(F.col("rn") <= most_maps)
    urls = seen.join(maps.filter(~is_index(F.col("body"))), "url").select("source", "depth", F.col("url").alias("map"), F.explode(sitemap_urls(F.col("body"))).alias("url"))
    if most_urls is None:
        return urls.select("source", "url").distinct()
    first = urls.groupBy("source", "url").agg(F.min(F.struct("depth", "map")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("at", "url"))
    return first.withColumn("rn", nth).filter(F.col("rn") <= most_urls).select("source", "url")


def catalogue_tree(trees: DataFrame) -> DataFrame:
    """A four-level product tree (column body) as rows with their ancestors' names; entries without a stable id are left out."""
    schema = "data struct<ProductClassificationList: array<struct<ClassificationName: string, ProductLineList: array<struct<ProductLine: string, ProductSeriesList: array<struct<SeriesName: string, ProductList: array<struct<ProductID: long, ProductName: string, ProductKey: string, Withdraw: int, IsNewProduct: int>>>>>>>>>"
    rows = trees.select(F.explode(F.from_json("body", schema)["data"]["ProductClassificationList"]).alias("c"))
    rows = rows.select(F.col("c.ClassificationName").alias("classification"), F.explode("c.ProductLineList").alias("l"))
    rows = rows.select("classification", F.col("l.ProductLine").alias("line"), F.explode("l.ProductSeriesList").alias("s"))
    rows = rows.select("classification", "line", F.col("s.SeriesName").alias("series"), F.explode("s.ProductList").alias("p"))
    return rows.select("classification", "line", "series", F.col("p.ProductID").alias("external_id"), F.col("p.ProductName").alias("model"), F.col("p.ProductKey").alias("product_key"), (F.col("p.Withdraw") == 1).alias("withdrawn"), (F.col("p.IsNewProduct") == 1).alias("is_new")).filter("external_id is not null")


def vendor_catalogue(responses: DataFrame) -> DataFrame:
    """Products and configurations of a vendor's catalogue (category, body); a status other than success is an error.

    Products without id are left out; a configuration without id takes its product's.
    """
    schema = "status string, data array<struct<id: string, spu: string, title: string, detailUrl: string, configurations: array<struct<id: string, CPU: string, RAM: string, Storage: string, price: double>>>>"
    rows = responses.withColumn("r", F.from_json("body", schema))
    good = F.when(F.col("r.status") == "success", F.col("r.data")).otherwise(F.raise_error(F.concat(F.lit("catalogue status "), F.coalesce("r.status", F.lit("missing")))).cast(rows.schema["r"].dataType["data"].dataType))
    products = rows.select("category", F.explode(good).alias("p")).filter("p.id is not null")
    flat = products.select("category", F.col("p.id").alias("product_id"), F.col("p.title").alias("title"), F.explode_outer("p.configurations").alias("c"))
    return flat.select("category", "product_id", "title", F.coalesce("c.id", "product_id").alias("config_id"), F.col("c.CPU").alias("cpu"), F.col("c.RAM").alias("memory"), F.col("c.Storage").alias("storage"), F.col("c.price").alias("price"))


def support_status(files: DataFrame) -> DataFrame:
    """The support_status noted in a descriptor's leading comments (url, body)."""
    return files.select("url", F.nullif(F.regexp_extract("body", r"(?im)^#\s*support_status:\s*(\S+)", 1), F.lit("")).alias("support_status"))
