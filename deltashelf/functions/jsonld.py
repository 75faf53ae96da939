"""JSON-LD in pages, by VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))


def nodes(pages: DataFrame, html: str = "html", of_type: str | None = None) -> DataFrame:
    """A row per node (columns block, pos, node VARIANT): plain objects, arrays and @graph; malformed blocks are skipped."""
    keep = [c for c in pages.columns if c != html]
    raw = pages.select(*keep, F.posexplode(blocks(F.col(html))).alias("block", "raw")).withColumn("v", F.expr("try_parse_json(trim(raw))")).filter("v is not null")
    kind = F.expr("schema_of_variant(v)")
    listed = F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')")).when(F.expr("schema_of_variant(try_variant_get(v, '$[\"@graph\"]', 'variant')) like 'ARRAY%'"), F.expr("try_variant_get(v, '$[\"@graph\"]', 'array<variant>')")).when(kind.startswith("OBJECT"), F.array("v"))
    out = raw.select(*keep, "block", F.posexplode(listed).alias("pos", "node")).filter(F.expr("schema_of_variant(node) like 'OBJECT%'"))
    return out if of_type is None else out.filter(is_type("node", of_type))


def node_list(html: Column) -> Column:
    """The nodes of a page as an array of VARIANT objects, as `nodes` finds them."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_a = lambda v, kind: F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))

    def of_block(raw: Column) -> Column:
        v = F.try_parse_json(F.trim(raw))
        graph = get(v, '$["@graph"]', "variant")
        none = F.array().cast("array<variant>")
        return F.when(is_a(v, "ARRAY"), get(v, "$", "array<variant>")).when(is_a(graph, "ARRAY"), get(graph, "$", "array<variant>")).when(is_a(v, "OBJECT"), F.array(v)).otherwise(none)

    return F.filter(F.flatten(F.transform(blocks(html), of_block)), lambda v: is_a(v, "OBJECT"))


def is_product(node: Column) -> Column:
    """As is_type for Product, of a column."""
    one, many = F.lower(F.try_variant_get(node, '$["@type"]', "string")), F.try_variant_get(node, '$["@type"]', "array<string>")
    return F.coalesce(one == "product", F.lit(False)) | F.coalesce(F.exists(many, lambda t: F.lower(t) == "product"), F.lit(False))


def is_type(node: str, name: str) -> Column:
    """Whether the node's @type, a text or a list of them, is the name, case aside."""
    one = F.lower(F.expr(f"try_variant_get({node}, '$[\"@type\"]', 'string')"))
    many = F.expr(f"try_variant_get({node}, '$[\"@type\"]', 'array<string>')")
    return F.coalesce(one == name.lower(), F.lit(False)) | F.coalesce(F.exists(many, lambda t: F.lower(t) == name.lower()), F.lit(False))


def text(node: str, path: str) -> Column:
    return F.expr(f"try_variant_get({node}, '$.{path}', 'string')")


def products(pages: DataFrame, html: str = "html") -> DataFrame:
    """Product nodes of a page: items of an ItemList that look like products, then products of their own with another URL."""
    keep = [c for c in pages.columns if c != html]
    items = nodes(pages, html, "ItemList").select(*keep, "block", "pos", F.posexplode(F.expr("try_variant_get(node, '$.itemListElement', 'array<variant>')")).alias("item", "el"))
    items = items.withColumn("node", F.coalesce(F.expr("try_variant_get(el, '$.item', 'variant')"), F.col("el"))).filter(F.expr("schema_of_variant(node) like 'OBJECT%'"))
    looks = is_type("node", "Product") | F.expr("try_variant_get(node, '$.sku', 'variant') is not null or try_variant_get(node, '$.offers', 'variant') is not null")
    items = items.filter(looks).select(*keep, "block", "pos", "item", "node")
    seen = items.select(*keep, text("node", "url").alias("seen_url")).filter("seen_url is not null").distinct()
    own = nodes(pages, html, "Product").withColumn("seen_url", text("node", "url")).join(seen, [*keep, "seen_url"], "left_anti")
    return items.unionByName(own.select(*keep, "block", "pos", F.lit(-1).alias("item"), "node"))
