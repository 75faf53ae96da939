"""What a captured page tells: product identity, marks of its platform, and whether a wall against robots answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.jsonld import blocks
from ..shared import stored

#: What tells a wall at any status, what does so only beside 403 or 503, and marks of platforms.
STRONG_MARKS = ("checking your browser", "cf-chl", "just a moment", "attention required", "are you a human", "verify you are human", "solve the captcha")
WEAK_MARKS = ("access denied", "unusual traffic", "cloudflare", "captcha")
FRAMEWORKS = (("Next.js", ("__NEXT_DATA__", "/_next/static/")), ("Nuxt", ("__NUXT__", "/_nuxt/")), ("React (generic)", ("__REACT_DEVTOOLS_GLOBAL_HOOK__", "data-reactroot")))
PLATFORMS = {
    "shopify": ("cdn.shopify.com",),
    "woocommerce": ("woocommerce", "/wp-content/"),
    "graphql": ("graphql",),
    "magento": ("magento_", "mage-cache-storage", "requirejs-config.js", "/static/version"),
    "adobe_commerce": ("adobe commerce", "magento_cloud", "commerce-cloud"),
    "salesforce_commerce": ("demandware", "dwsid", "/on/demandware.store/", "salesforce commerce"),
}


def blocked(status: Column, body: Column) -> Column:
    """Whether a robot wall answered; null bodies are no wall."""
    body = F.coalesce(body, F.lit(""))
    return text.contains_any(body, STRONG_MARKS) | (F.coalesce(status.isin(403, 503), F.lit(False)) & text.contains_any(body, WEAK_MARKS))


def framework(body: Column) -> Column:
    """The first framework with a mark in the page, letters as they are; null if none."""
    cases = F.lit(None).cast("string")
    for name, marks in reversed(FRAMEWORKS):
        found = F.lit(False)
        for m in marks:
            found = found | body.contains(m)
        cases = F.when(found, name).otherwise(cases)
    return cases


def platforms(body: Column) -> Column:
    """Names of all platforms that a page has marks of, by name."""
    return F.array_compact(F.array(*(F.when(text.contains_any(body, PLATFORMS[n]), n) for n in sorted(PLATFORMS))))


def canonical(html: Column, url: Column) -> Column:
    """The target of the page's canonical link, else its own address, in normal form."""
    tag = F.regexp_extract(html, r"(?i)<link\b[^>]*\brel=[\"']canonical[\"'][^>]*>", 0)
    return text.url_normal(F.coalesce(F.nullif(F.regexp_extract(tag, r"(?i)\bhref=[\"']([^\"']+)", 1), F.lit("")), url))


def _kind(text_: Column, kinds: Column) -> Column:
    return F.zip_with(text_, kinds, lambda t, k: F.struct(t.alias("text"), F.substring_index(F.substring_index(k, "<", 1), "(", 1).alias("kind")))


def _inside(text_: str, kind: str) -> Column:
    """The members of an object, or elements of a list, in the order in which they are written: an array of (text, kind)."""
    parts = lambda f, to: f(F.from_json(text_, to))
    same = lambda c: c
    kinds = lambda values: F.transform(values, F.schema_of_variant)
    members = _kind(parts(F.map_values, "map<string,string>"), kinds(parts(F.map_values, "map<string,variant>")))
    return F.when(F.col(kind) == "OBJECT", members).otherwise(_kind(parts(same, "array<string>"), kinds(parts(same, "array<variant>"))))


def first_products(texts: DataFrame) -> DataFrame:
    """Of each row of JSON texts (id, raw: array of texts) the first object of @type Product at any depth, in reading order: id, product.

    Texts that are no JSON are skipped. All rows go down one level at a time, with the place of each part, until no objects or lists are left; what
    is found is not entered.
    """
    level = texts.select("id", F.posexplode("raw").alias("block", "text")).withColumn("v", F.try_parse_json("text"))
    level = level.select("id", F.array("block").alias("place"), "text", F.substring_index(F.substring_index(F.schema_of_variant("v"), "<", 1), "(", 1).alias("kind"))
    found = None
    while True:
        level = stored(level.filter(F.col("kind").isin("OBJECT", "ARRAY")), "json-level")
        if level.isEmpty():
            break
        v = F.try_parse_json("text")
        named = F.coalesce(F.try_variant_get(v, '$["@type"]', "string") == "Product", F.lit(False)) | F.coalesce(F.array_contains(F.try_variant_get(v, '$["@type"]', "array<string>"), "Product"), F.lit(False))
        hit = (F.col("kind") == "OBJECT") & named
        got = level.filter(hit).select("id", "place", "text")
        found = got if found is None else found.unionByName(got)
        level = level.filter(~hit).select("id", "place", F.posexplode(_inside("text", "kind")).alias("at", "x")).select("id", F.concat("place", F.array("at")).alias("place"), "x.text", "x.kind")
    if found is None:
        return texts.select("id", F.lit(None).cast("string").alias("product")).limit(0)
    return found.groupBy("id").agg(F.min_by("text", "place").alias("product"))


def product_identity(pages: DataFrame) -> DataFrame:
    """Identity of pages (url, html) that state a Product in JSON-LD: by SKU with high confidence, else by the last part of the address."""
    rows = pages.select("url", canonical(F.col("html"), F.col("url")).alias("canonical_url"), F.transform(blocks(F.col("html")), F.trim).alias("raw"))
    rows = stored(rows.filter(F.size("raw") > 0).withColumn("id", F.monotonically_increasing_id()), "json-pages")
    p = F.from_json("product", "map<string,string>")
    full = lambda c: F.nullif(c, F.lit(""))
    offers = F.try_variant_get(F.try_parse_json("product"), "$.offers", "variant")
    offer = F.coalesce(F.try_variant_get(offers, "$[0]", "variant"), offers)
    of = lambda k: F.try_variant_get(offer, f"$.{k}", "string")
    got = first_products(rows).withColumns({"model": F.try_element_at(p, F.lit("name")), "sku": F.coalesce(full(F.try_element_at(p, F.lit("sku"))), full(F.try_element_at(p, F.lit("mpn")))), "price": of("price"), "availability": of("availability")}).drop("product")
    got = rows.drop("raw").join(got, "id")
    key = F.coalesce(F.concat(F.lit("sku:"), F.lower("sku")), F.concat(F.lit("url:"), F.lower(text.url_slug(F.col("url")))))
    return got.select("url", "model", "sku", "canonical_url", "price", "availability", key.alias("identity_key"), F.when(F.col("sku").isNotNull(), "high").otherwise("medium").alias("confidence"))


def heading_identity(pages: DataFrame, maker: str) -> DataFrame:
    """Identity of pages (page_id, url, html) by heading, or the title for sharing, and a SKU anywhere in the page; pages without a heading have none."""
    some = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    heading = F.coalesce(some(r"(?is)<h1[^>]*>(.*?)</h1>"), some(r"(?i)<meta[^>]+(?:property|name)=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)"))
    rows = pages.withColumn("model", F.nullif(F.trim(F.regexp_replace(heading, r"<[^>]+>", "")), F.lit(""))).withColumn("sku", some(r"(?i)[\"']sku[\"']\s*:\s*[\"']?([A-Za-z0-9_-]+)")).filter("model is not null")
    slug = F.regexp_replace(F.regexp_replace(F.lower("model"), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    key = F.coalesce(F.concat(F.lit(f"{maker}-sku:"), F.lower("sku")), F.concat(F.lit(f"{maker}-model:"), slug))
    return rows.select("page_id", "model", "sku", canonical(F.col("html"), F.col("url")).alias("canonical_url"), key.alias("identity_key"), F.when(F.col("sku").isNotNull(), "high").otherwise("medium").alias("confidence"))
