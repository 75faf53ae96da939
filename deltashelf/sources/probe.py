"""What a site's captured answers tell of its platform: independent checks of a few paths, folded per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld, text
from ..operators import normalize, pages

#: The paths that are asked besides the root.
BULK, STORE, SITEMAP, ROBOTS = "/products.json", "/wp-json/wc/store/v1/products", "/sitemap.xml", "/robots.txt"
RULES = "array<struct<agents:array<string>,allow:boolean,path:string>>"


def robots(body: Column) -> Column:
    """struct(rules, sitemaps) of a robots.txt: rules are allowed or disallowed paths with the agents of their group, in lower case.

    Agents that follow one another make one group, which the first rule closes; rules before any agent hold for none; comments and
    unknown fields are passed over; Sitemap directives stand outside of groups.
    """
    lines = F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n")
    at = r"^\s*([A-Za-z-]+)\s*:\s*([^#]*?)\s*(?:#.*)?$"
    fields = F.filter(F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, at, 1)).alias("name"), F.regexp_extract(x, at, 2).alias("value"))), lambda f: f["name"].isin("user-agent", "allow", "disallow", "sitemap"))
    first = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("closed"), F.array().cast(RULES).alias("rules"))

    def step(state: Column, f: Column) -> Column:
        agent = F.lower(f["value"])
        agents = F.when(state["closed"], F.array(agent)).otherwise(F.concat(state["agents"], F.array(agent)))
        rule = F.struct(state["agents"].alias("agents"), (f["name"] == "allow").alias("allow"), f["value"].alias("path"))
        named = F.struct(agents.alias("agents"), F.lit(False).alias("closed"), state["rules"].alias("rules"))
        # an empty Disallow forbids nothing, but is a rule all the same
        ruled = F.struct(state["agents"].alias("agents"), F.lit(True).alias("closed"), F.concat(state["rules"], F.array(rule)).cast(RULES).alias("rules"))
        return F.when(f["name"] == "user-agent", named).when(f["name"] == "sitemap", state).otherwise(ruled)

    folded = F.aggregate(fields, first, step)
    maps = F.transform(F.filter(fields, lambda f: (f["name"] == "sitemap") & (f["value"] != "")), lambda f: f["value"])
    return F.struct(folded["rules"].alias("rules"), maps.alias("sitemaps"))


def allowed(rules: Column, agent: Column, path: Column) -> Column:
    """Whether the rules let an agent fetch a path: its own group's rules if it has any, else those of *; the longest path decides, allowing ones over forbidding ones of its length."""
    low = F.lower(agent)
    own = F.filter(rules, lambda r: F.array_contains(r["agents"], low))
    used = F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: F.array_contains(r["agents"], "*")))
    # * stands for anything, $ for the end
    pattern = lambda p: F.concat(F.lit("^"), F.replace(F.regexp_replace(F.regexp_replace(p, r"([.\\+?^{}()|\[\]])", r"\\$1"), r"\*", ".*"), F.lit("$"), F.lit("\\z")))
    hits = F.transform(F.filter(used, lambda r: (r["path"] != "") & F.regexp_like(path, pattern(r["path"]))), lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))


def _answers(captures: DataFrame) -> DataFrame:
    """Each capture as the few facts that its check gives; a broken or missing answer gives none."""
    root, ok = F.col("path").isin("", "/"), F.coalesce(F.col("status") == 200, F.lit(False))
    at = lambda p: F.col("path") == p
    body = F.coalesce("body", F.lit(""))
    v = F.try_parse_json("body")
    low = F.lower(body)
    nodes = F.filter(jsonld.node_list(body), jsonld.is_product)
    directive = F.nullif(F.regexp_extract(body, r"(?i)Sitemap:\s*(\S+)", 1), F.lit(""))
    return captures.select(
        "site", F.when(root, F.struct(F.col("status").alias("status"), pages.blocked(F.col("status"), body).alias("blocked"), pages.framework(body).alias("framework"), pages.platforms(body).alias("marks"), F.size(nodes).alias("jsonld_products"), normalize.richness(nodes).alias("richness"))).alias("root"),
        F.when(at(BULK) & ok, F.size(F.try_variant_get(v, "$.products", "array<variant>"))).alias("bulk_items"), F.when(at(STORE) & ok, F.size(F.try_variant_get(v, "$", "array<variant>"))).alias("store_items"),
        F.when(at(SITEMAP) & ok & F.contains(F.left(body, F.lit(200)), F.lit("<")), F.struct(F.contains(low, F.lit("<sitemapindex")).alias("index"), F.contains(low, F.lit("product")).alias("product"))).alias("map"),
        F.when(at(ROBOTS) & ok, directive).alias("directive"), F.when(at(ROBOTS) & ok, robots(body)).alias("robots"),
    )


def site_facts(captures: DataFrame) -> DataFrame:
    """One row per site of captures (site, path, status, body): what normalize.probe scores, and public_apis, sitemap_url, root_allowed.

    Of several captures of one check any that answers counts. Sites without a root's answer have null marks.
    """
    one = lambda c: F.any_value(c, ignoreNulls=True) if isinstance(c, str) else c
    got = _answers(captures).groupBy("site").agg(F.max("root").alias("root"), F.max("bulk_items").alias("bulk_items"), F.max("store_items").alias("store_items"), F.max("map").alias("map"), F.min("directive").alias("directive"), one("robots").alias("robots"))
    bulk, store = F.coalesce(F.col("bulk_items") >= 0, F.lit(False)), F.coalesce(F.col("store_items") >= 0, F.lit(False))
    mark = lambda n: F.coalesce(F.array_contains("root.marks", n), F.lit(False))
    hint = F.when(mark("shopify"), "bulk_store").when(mark("woocommerce"), "store_api_hinted").when(mark("magento") | mark("adobe_commerce"), "magento/adobe_commerce").when(mark("salesforce_commerce"), "salesforce_commerce")
    own = F.concat(F.lit("https://"), F.col("site"), F.lit(SITEMAP))
    url = F.when(F.col("map").isNotNull(), own).otherwise(F.col("directive"))
    products = F.coalesce("root.jsonld_products", F.lit(0))
    return got.select(
        "site", F.col("root.status").alias("status"), F.coalesce("root.blocked", F.lit(False)).alias("blocked"), bulk.alias("bulk_api"), store.alias("store_api"), "bulk_items", "store_items", products.alias("jsonld_products"), F.coalesce("root.richness", F.lit(0)).cast("int").alias("richness"),
        url.isNotNull().alias("sitemap"), F.coalesce(F.lower(url).endswith(".gz"), F.lit(False)).alias("sitemap_gz"), F.coalesce("map.product", F.lit(False)).alias("product_sitemap"), F.coalesce("map.index", F.lit(False)).alias("sitemap_index"), url.alias("sitemap_url"), F.col("root.framework").alias("framework"), mark("graphql").alias("graphql"), hint.alias("commerce_hint"),
        (bulk.cast("int") + store.cast("int") + mark("graphql").cast("int") + (products > 0).cast("int")).alias("public_apis"), allowed(F.coalesce("robots.rules", F.array().cast(RULES)), F.lit("*"), F.lit("/")).alias("root_allowed"),
    )


def report(facts: DataFrame) -> DataFrame:
    """The scored facts with what they rest on: evidence (kind, value), deductions (kind, points), risks and missing, as codes."""
    c = F.col
    bulk, some, thin = c("bulk_api") | c("store_api"), c("jsonld_products") > 0, (c("jsonld_products") > 0) & (c("richness") < 60)
    seen = lambda kind, value, test: F.when(test, F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))
    evidence = F.array_compact(F.array(
        seen("status", c("status"), c("status").isNotNull()), seen("bulk_api", c("bulk_items"), c("bulk_api")), seen("store_api", c("store_items"), c("store_api")), seen("sitemap", c("sitemap_url"), c("sitemap")), seen("no_sitemap", F.lit(None), ~c("sitemap")),
        seen("jsonld", F.concat_ws("/", c("jsonld_products").cast("string"), c("richness").cast("string")), some), seen("framework", c("framework"), c("framework").isNotNull()), seen("graphql", F.lit(None), c("graphql")), seen("platform", c("commerce_hint"), c("commerce_hint").isNotNull()), seen("wall", F.lit(None), c("blocked")),
    ))
    lost = lambda kind, points, test: F.when(test & (points > 0), F.struct(F.lit(kind).alias("kind"), points.cast("int").alias("points")))
    gap = F.bround((100 - c("richness")) * 0.15).cast("int")
    sitemap = F.when(~c("sitemap") & ~bulk, 15).when(c("sitemap_gz"), 5).when(c("sitemap") & ~c("product_sitemap") & ~bulk & ~some, 8).otherwise(0)
    deductions = F.array_compact(F.array(lost("anti_bot", F.lit(50), c("blocked")), lost("sitemap", sitemap, F.lit(True)), lost("data_availability", F.lit(25), ~bulk & ~some & ~c("graphql")), lost("jsonld_richness", gap, some & ~bulk), lost("js_hydration", F.lit(20), c("framework").isNotNull() & ~some & ~bulk)))
    listed = lambda *pairs: F.array_compact(F.array(*(F.when(test, kind) for kind, test in pairs)))
    risks = listed(("wall", c("blocked")), ("needs_script", c("framework").isNotNull() & ~some), ("incomplete_jsonld", thin), ("needs_denylist", bulk | some), ("unconfirmed_graphql", c("graphql") & ~bulk), ("no_sitemap", ~c("sitemap") & ~bulk))
    missing = listed(("sitemap_url", ~c("sitemap")), ("product_page", ~some & ~bulk), ("public_api", c("framework").isNotNull() & ~some), ("richness_elsewhere", thin))
    return normalize.probe(facts).withColumns({"evidence": evidence, "deductions": deductions, "risks": risks, "missing": missing})
