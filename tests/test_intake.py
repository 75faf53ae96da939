"""Keyed streams, resolution inside a batch, published batches, terms, quarantine, probes, budgets and archives."""

import datetime as dt
import glob
import html
import json
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from deltashelf.functions import text
from deltashelf.operators import diff, normalize, redact, resolve, state, stories, terms
from deltashelf.schema import PRODUCT, TIER_WORDS, StoryRule
from deltashelf.sources import probe, quarantine
from deltashelf.streaming import batches, ingest, keyed

T0 = dt.datetime(2024, 1, 1)


def product(**more):
    base = {f.name: None for f in PRODUCT} | {"product_key": "k", "model": "K12"}
    return tuple((base | more)[f.name] for f in PRODUCT)


OBSERVED = f"product_key string, captured_at timestamp, seq int, record {PRODUCT.simpleString()}"


def values(spark, column, inputs, kind="string"):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i long, x {kind}")
    return [r.y for r in d.select("i", column.alias("y")).orderBy("i").collect()]


# ---- keyed streams

def test_state_of_listings_equals_one_diff(spark, tmp_path):
    """Observations in split, repeated and restarted batches, the first from the table, tell the events of one diff over all."""
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(6)}", T0 + dt.timedelta(hours=i), i, product(memory=rng.choice(["8 GB", "16 GB"]), prices=[(rng.choice([9.5, 10.25]), "USD", None, "in_stock")], confidence=rng.random())) for i in range(120)]
    known, path, tables = spark.createDataFrame(rows[:20], OBSERVED), str(tmp_path / "in"), ingest.Tables(spark, str(tmp_path / "tables"))
    for part in (rows[20:55], rows[40:70], rows[20:21], rows[70:]):
        spark.createDataFrame(part, OBSERVED).repartition(3).write.mode("append").parquet(path)
        keyed.catch_up(spark, path, known.schema, tables, str(tmp_path / "ck"), known=known)
    names = ["product_key", "captured_at", "seq", "change_type", "field", "old_value", "new_value", "direction", "magnitude_pct", "severity"]
    whole = diff.diff(spark.createDataFrame(rows, OBSERVED)).filter("seq >= 20")
    show = lambda d: sorted(map(str, d.select(names).collect()))
    assert show(tables.read("events")) == show(whole)
    # a repeat that comes after its listing has gone on is late, not news
    assert {r.product_key for r in tables.read("late").collect()} <= {r[0] for r in rows}
    assert tables.read("snapshots").count() == len({(r.product_key, r.seq) for r in whole.collect()})


def test_stories_as_they_happen(spark, tmp_path):
    """After every run, late events and expired evidence included, the stories are those of one detection over all events."""
    rng = random.Random(3)
    rules = [StoryRule("a", {"change_type": "p"}, "v", 2, 3, 60, 5), StoryRule("b", {"v": "x"}, "v", 2, 7, 60, 5), StoryRule("off", {}, "v", 1, 1, 1, 1, False)]
    rows = [(i, f"k{i}", rng.choice("ABCD"), T0 + dt.timedelta(hours=i * 3 + rng.choice([0, 0, -30]), microseconds=rng.randrange(10**6)), rng.choice("pqq"), rng.choice(["x", "y", "", None])) for i in range(200)]
    schema = "id int, product_key string, manufacturer string, detected_at timestamp, change_type string, v string"
    tables, path = ingest.Tables(spark, str(tmp_path / "tables")), str(tmp_path / "in")
    names = ["rule_id", "key", "n_manufacturers", "manufacturers", "first_at", "last_at", "score", "dedup_key"]
    for n in (60, 130, 200):
        seen = spark.createDataFrame(rows[:n], schema)
        spark.createDataFrame(rows[{60: 0, 130: 60, 200: 130}[n] : n], schema).write.mode("append").parquet(path)
        keyed.follow_stories(spark, path, seen.schema, rules, tables, str(tmp_path / "ck"))
        want = stories.detect(seen, rules, F.lit(max(r[3] for r in rows[:n]))).select(names).collect()
        assert want and sorted(keyed.current_stories(tables, rules).select(names).collect()) == sorted(want)


# ---- resolution inside a batch

def one_by_one(incoming, table):
    """The records in order, each against what stands there by then."""
    words = lambda m: {t for t in re.split("[^a-z0-9]+", m.lower()) if t}
    at = {t[1]: {"key": t[3], "sku": t[4], "seen": (0, t[5], t[0]), "snap": (t[4], t[2]), "at": None} for t in table}
    out = {}
    for n, k, model, key, sku in sorted(incoming):
        prior, relation = (k, "same_listing") if k in at else (None, "none")
        if prior is None:
            newest = lambda test: max((x for x in at if test(at[x])), key=lambda x: at[x]["seen"], default=None)
            prior = newest(lambda x: x["sku"] == sku) if sku else None
            if prior is None and (c := newest(lambda x: x["key"] == key)) is not None:
                s, m = at[c]["snap"]
                prior = c if not (sku and s and sku != s) and not (words(m) ^ words(model)) & set(TIER_WORDS) else None
            relation = "existing_product" if prior else "none"
        out[n] = (prior, relation, at[prior]["at"] if prior else None)
        old = at.get(k)
        at[k] = {"key": old["key"] if old else key, "sku": sku if sku is not None or not old else old["sku"], "seen": (1, n, 0), "snap": (sku, model), "at": n}
    return out


LISTED, COMING = "id long, product_key string, model string, model_key string, vendor_sku string, last_seen int", "at long, product_key string, model string, model_key string, vendor_sku string"


def resolved(spark, incoming, table):
    return {r.at: (r.prior_key, r.relation, r.prior_at) for r in resolve.resolve_in_order(spark.createDataFrame(incoming, COMING), spark.createDataFrame(table, LISTED)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_resolution_sees_the_records_before(spark, monkeypatch, seed):
    monkeypatch.setattr(resolve, "SPAN", 3)
    rng = random.Random(seed)
    sku, models = lambda: rng.choice([None, "", "s1", "s2", "s3"]), ["a 1", "a 1 pro", "b 2"]
    table = [(i, f"k{i}", m, m[:3], sku(), rng.randrange(3)) for i in range(6) for m in [rng.choice(models)]]
    coming = [(n, f"k{rng.randrange(25)}", m, m[:3], sku()) for n in rng.sample(range(300), 80) for m in [rng.choice(models)]]
    assert resolved(spark, coming, table) == one_by_one(coming, table)


def test_a_chain_of_five_and_skus_that_leave(spark):
    coming = [(n, f"n{n}", "m 1", "m-1", f"s{n % 2}" if n < 5 else None) for n in range(5)]
    coming += [(10 + n, f"n{n}", "m 1", "m-1", "gone") for n in (4, 2)] + [(20, "late", "z 9", "z-9", "s0"), (21, "later", "z 9", "z-9", "s1")]
    want = one_by_one(coming, [])
    assert resolved(spark, coming, []) == want
    assert want[20] == ("n0", "existing_product", 0) and want[2] == ("n0", "existing_product", 0)


@pytest.mark.parametrize("hot", [3, 9])
def test_resolution_of_keys_with_many_rows(spark, monkeypatch, hot):
    """Listings, SKUs and model keys of more rows than a window takes are cut into spans, beside others that aren't."""
    monkeypatch.setattr(resolve, "SPAN", 3)
    monkeypatch.setattr(resolve, "HOT", hot)
    monkeypatch.setattr(resolve, "FEW", 0 if hot == 3 else 2)
    rng = random.Random(hot)
    sku, models = lambda: rng.choice([None, "", "s1", "s2", "s2", "s2", f"t{rng.randrange(9)}"]), ["a 1", "a 1 pro", "b 2", "c 3"]
    table = [(i, f"k{i}", m, m[:3], sku(), rng.randrange(3)) for i in range(6) for m in [rng.choice(models)]]
    coming = [(n, f"k{min(rng.randrange(40), rng.randrange(40))}", m, rng.choice([m[:3], m[:3], None]), sku()) for n in rng.sample(range(400), 120) for m in [rng.choice(models)]]
    assert resolved(spark, coming, table) == {k: v for k, v in one_by_one([(n, k, m, key or f"none-{n}", s) for n, k, m, key, s in coming], table).items()}


def test_resolution_deals_each_record_out_few_times(spark):
    """Bytes of shuffle a record stay low, other columns are handed on, and the tables made on the way are gone but the last two."""
    n = 60_000
    k = F.xxhash64("id") % 9_000
    coming = spark.range(n).select(F.col("id").alias("at"), F.concat(F.lit("src:"), k.cast("string")).alias("product_key"), F.concat(F.lit("model of many words "), (k % 90).cast("string")).alias("model"), F.concat(F.lit("maker::model-of-many-words-"), (k % 90).cast("string")).alias("model_key"), F.concat(F.lit("S"), (F.col("id") * 7919 % 600).cast("string")).alias("vendor_sku"), (F.col("id") + 1).alias("more"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = written()
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    here = set(glob.glob(f"{folder}/resolve-*"))
    got = resolve.resolve_in_order(coming, spark.createDataFrame([], LISTED))
    got.drop("more").write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert (written() - before) / n < 250
    assert {p.split("/")[-1].split("-")[1] for p in set(glob.glob(f"{folder}/resolve-*")) - here} == {"rows", "found"}
    assert got.filter("more = at + 1").count() == n


# ---- published batches

def observed(spark, day, *rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(days=day), i, product(product_key=k, **more)) for i, (k, more) in enumerate(rows)], OBSERVED)


def contents(published):
    names = ("products", "listings", "snapshots", "prices", "aliases")
    return {n: sorted(map(str, published.read(n).collect())) for n in names if published.read(n) is not None}


def test_a_batch_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    first = observed(spark, 0, ("a", {"manufacturer": "M", "vendor_sku": "S", "aliases": ["x"], "prices": [(1.0, "USD", None, "in_stock")]}), ("b", {"manufacturer": "M", "aliases": ["x", "y"]}))
    second = observed(spark, 1, ("a", {"manufacturer": "M", "aliases": ["x", "z"], "region": "eu"}), ("c", {"manufacturer": "N"}))
    whole = batches.Published(spark, str(tmp_path / "whole"))
    assert batches.append_batch(whole, first, 0) and batches.append_batch(whole, second, 1)

    torn = batches.Published(spark, str(tmp_path / "torn"))
    batches.append_batch(torn, first, 0)
    before = contents(torn)
    # an error after some tables are written
    with pytest.raises(Exception, match="lost"):
        torn.publish(1, lambda: batches.appended(torn, second, 1) | {"zz": second.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))})
    assert contents(torn) == before
    assert [(r.batch, r.status) for r in torn.runs().orderBy("status").collect()] == [(1, "failed"), (0, "ok")]

    # a process that ends between the last table and the marker says nothing at all
    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    monkeypatch.setattr(batches.Published, "_mark", killed)
    with pytest.raises(Killed):
        batches.append_batch(torn, second, 1)
    monkeypatch.undo()
    assert contents(torn) == before
    assert batches.append_batch(torn, second, 1) and not batches.append_batch(torn, second, 1)
    assert contents(torn) == contents(whole)
    a = batches.current_listings(torn).filter("product_key = 'a'").first()
    assert (a.vendor_sku, a.region, a.first_seen, a.last_seen) == ("S", "eu", T0, T0 + dt.timedelta(days=1))
    assert {(r.alias, r.batch) for r in torn.read("aliases").collect()} == {("x", 0), ("y", 0), ("z", 1)}


def test_delta_runs(spark, tmp_path):
    p = batches.Published(spark, str(tmp_path / "d"))
    page = lambda *rows: spark.createDataFrame(rows, "url string, identity_key string")
    batches.save_delta(p, 0, "de", page(("u1", "url:1"), ("u2", "url:2"), ("u2", "url:2")), page(("u1", "sku:1")), "t0")
    batches.save_delta(p, 1, "de", page(("u1", "url:1"), ("u3", "url:3")), page(("u1", "sku:9"), ("u3", "url:3")), "t1")
    now = {r.url: (r.identity_key, r.first_seen, r.last_seen) for r in state.latest(p.read("items"), ["region", "url"], [F.desc("batch")]).collect()}
    assert now == {"u1": ("sku:9", "t0", "t1"), "u2": ("url:2", "t0", "t0"), "u3": ("url:3", "t1", "t1")}
    assert {(r.url, r.identity_key, r.first_seen) for r in p.read("candidates").collect()} == {("u1", "sku:1", "t0"), ("u3", "url:3", "t1")}


# ---- terms

def test_terms(spark):
    rng = random.Random(1)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, some(rng.randrange(60), "abC é")) for i in range(60)] + [(99, None), (98, "")]
    words = sorted({some(rng.randint(1, 4), "aBcé ") for _ in range(300)}) + ["", None, "ABC", "x" * 200]
    d, w = spark.createDataFrame(texts, "i long, t string").repartition(3), spark.createDataFrame([(x,) for x in words], "w string")
    want = sorted((i, x) for i, t in texts if t for x in {x.lower() for x in words if x} if x in t.lower())
    for most in (1 << 20, 300, 1):
        got = terms.matches(d, "t", w if most > 1 else w.filter("length(w) < 3"), "w", most)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == (want if most > 1 else [x for x in want if len(x[1]) < 3])
    assert terms.matches(d, "t", w.limit(0), "w").count() == 0
    known = spark.createDataFrame([("Zen-5 X",), ("abc",)], "k string")
    items = spark.createDataFrame([("ZEN5",), ("xx zen5x yy",), ("q",), ("",), (None,)], "n string")
    assert [r.presence for r in terms.presence(items, "n", known, "k").orderBy("n").collect()] == ["unknown", "unknown", "yes", "no", "yes"]
    assert {r.presence for r in terms.presence(items, "n", known.limit(0), "k").collect()} == {"unknown"}


def test_terms_of_all_lengths_and_repeated_rows(spark, monkeypatch):
    """Long words and terms beside short ones, a term in two words of a text, letters that lower by what follows, rows that are equal."""
    monkeypatch.setattr(terms, "SHORT", 5)
    monkeypatch.setattr(terms, "SPELT", 12)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aBİσΣ\t") for _ in range(rng.choice([1, 3, 8, 11, 12, 13, 30])))
    texts = [(i % 40, {"k": i % 40}, " ".join(word() for _ in range(rng.randrange(8)))) for i in range(60)] + [(98, {}, "aB xaB  aB " * 40), (99, None, None)] * 2
    low = lambda said: values(spark, F.lower("x"), said)
    said = [t for _, _, t in texts if t]
    w = sorted(({t[a : a + rng.randrange(1, 9)] for t in said for a in range(0, len(t), 5)} | {t[3:30].replace(" ", "") for t in said} | {"ab", "zz"}) - {""})
    held = {t: x for t, x in zip(said, low(said), strict=True)}
    small = dict(zip(w, low(w), strict=True))
    want = sorted((i, x) for i, _, t in texts if t for x in set(small.values()) if x in held[t])
    d = spark.createDataFrame(texts, "i long, m map<string,int>, t string").repartition(3)
    for some in (w, [x for x in w if " " not in x and len(x) <= 5], [x for x in w if len(x) > 5], [x for x in w if " " in x]):
        got = terms.matches(d, "t", spark.createDataFrame([(x,) for x in some], "w string"), "w", 1_500)
        asked = {small[x] for x in some}
        assert got.columns == ["i", "m", "term"]
        assert sorted((r.i, r.term) for r in got.collect()) == [x for x in want if x[1] in asked]


def test_many_terms_are_not_passed_by_all_texts(spark, monkeypatch):
    """Forty blocks of terms: words meet them by a join instead of forty readings of the texts."""
    monkeypatch.setattr(terms, "_scan", lambda *_: pytest.fail("texts are read past an automaton"))
    d = spark.range(3_000).select("id", F.concat(F.lit("some Word"), F.col("id") % 900, F.lit(" and sword"), F.col("id") % 70).alias("t"))
    w = d.select(F.explode(F.split("t", " ")).alias("w")).filter("length(w) > 4")
    got = terms.matches(d, "t", w, "w", 200).groupBy("term").count()
    said = [(i, f"some word{i % 900} and sword{i % 70}") for i in range(3_000)]
    words = {x for _, t in said for x in t.split() if len(x) > 4}
    assert {r.term: r["count"] for r in got.collect()} == {x: sum(x in t for _, t in said) for x in words}


def test_references_as_html_reads_them(spark):
    said = [x for n in html5 for x in ("&" + n, f"&{n}x", f"a&{n.rstrip(';')} b", *("&" + n[:k] for k in range(1, len(n))))]
    said += [f"&#{i};" for i in (*range(300), *range(0xD7F0, 0xE010), *range(0xFDC0, 0xFE00), 0xFFFE, 0x1FFFE, 0x10FFFF, 0x110000, 10**30)]
    said += [f"&#x{i:X}" for i in (*range(200), 0xFFFF, 0x10FFFD)] + ["&#00065", "&#", "&#xg;", "&&amp;amp;", "&" + "a" * 40 + ";", "&;", "", "no"]
    assert values(spark, text.unescape(F.col("x")), said) == [html.unescape(x) for x in said]


def test_long_runs_keep_their_letters(spark):
    assert values(spark, text.title_case(F.col("x")), ["a" * 1_000_100 + " b"])[0] == "A" + "a" * 1_000_099 + " B"


# ---- sources judged apart, probes

def test_quarantine(spark):
    good = json.dumps({"status": "success", "data": [{"id": "1"}]})
    rows = [("a", 1, good), ("a", 2, '{"status": "error"}'), ("a", 3, "{cut"), ("b", 1, good), ("c", 1, None), (None, 1, good), ("d", 1, '{"status": "success"}')]
    kept, notes = quarantine.isolated(spark.createDataFrame(rows, "source string, page int, body string"), quarantine.vendor_checks(), ["page"])
    assert {r.source for r in kept.collect()} == {"b", None}
    assert {r.source: r.reason for r in notes.collect()} == {"a": "status error", "c": "malformed", "d": "no products"}


ROBOTS = """# all
User-agent: Fast
User-Agent: slow # two
Disallow: /private
Allow: /private/open
Crawl-delay: 9
sitemap: https://x.test/a.xml
User-agent: *
Disallow: /*.pdf$
Disallow:
Nonsense
Sitemap:
"""


def test_robots(spark):
    d = spark.createDataFrame([(ROBOTS,)], "b string").select(probe.robots(F.col("b")).alias("r"))
    r = d.first().r
    assert [(x.agents, x.allow, x.path) for x in r.rules] == [(["fast", "slow"], False, "/private"), (["fast", "slow"], True, "/private/open"), (["*"], False, "/*.pdf$"), (["*"], False, "")]
    assert r.sitemaps == ["https://x.test/a.xml"]
    asked = [("SLOW", "/private/x"), ("slow", "/private/open/1"), ("slow", "/a.pdf"), ("other", "/a.pdf"), ("other", "/a.pdf?x"), ("other", "/private")]
    got = d.crossJoin(spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i int, a string, p string")).orderBy("i").select(probe.allowed(F.col("r.rules"), F.col("a"), F.col("p")).alias("ok")).collect()
    assert [x.ok for x in got] == [False, True, True, False, True, True]
    assert values(spark, probe.robots(F.col("x"))["rules"], [None, "", "Disallow: /x"]) == [[], [], [([], False, "/x")]]


def test_probe_folds_checks_that_may_be_missing(spark):
    node = '<script type="application/ld+json">{"@type":"Product","name":"n","sku":"s","offers":{"price":1}}</script>'
    rows = [("a", "", 200, node + "/_next/static/"), ("a", "/robots.txt", 200, "Sitemap: https://a/m.xml.GZ"), ("a", "/products.json", 200, "{broken"), ("b", "/products.json", 200, '{"products":[1,2]}'), ("c", "/", 503, "captcha"), ("c", "/sitemap.xml", 200, "no markup"), ("d", "/other", None, None)]
    got = {r.site: r for r in probe.report(probe.site_facts(spark.createDataFrame(rows, "site string, path string, status int, body string"))).collect()}
    a = got["a"]
    assert (a.platform, a.richness, a.sitemap_url, a.framework, a.effort, [(x.kind, x.points) for x in a.deductions], a.risks) == ("static_jsonld", 50, "https://a/m.xml.GZ", "Next.js", "Medium", [("sitemap", 5), ("jsonld_richness", 8)], ["incomplete_jsonld", "needs_denylist"])
    assert (got["b"].platform, got["b"].bulk_items, got["b"].quality) == ("bulk_store", 2, 100)
    assert (got["c"].platform, got["c"].sitemap, got["c"].pursue) == ("BLOCKED_BOT", False, False)
    assert (got["d"].platform, got["d"].status, [x.kind for x in got["d"].evidence]) == ("unknown", None, ["no_sitemap"])


# ---- budgets, archives, storefronts

def test_budget(spark):
    rng = random.Random(4)
    items = [(f"s{rng.randrange(9)}", rng.choice([f"k{i % 30}", None]), i, 0, None) for i in range(300)]
    items = [(s, k, i, int(s[1]) % 3, 1 if s == "s4" else None) for s, k, i, *_ in items]
    got = [(r.source, r.key, r.turn) for r in state.dealt_budget(spark.createDataFrame(items, "source string, key string, pos long, priority int, most int").repartition(4), 20, limit="most").orderBy("turn").collect()]
    own, seen = {}, set()
    for s, k, i, *_ in sorted(items, key=lambda x: x[2]):
        if k is not None and (s, k) not in seen:
            seen.add((s, k))
            own.setdefault(s, []).append(k)
    dealt = sorted((n, -(int(s[1]) % 3), s, k) for s, ks in own.items() for n, k in enumerate(ks[:1] if s == "s4" else ks, 1))
    assert got == [(s, k, n) for n, (_, _, s, k) in enumerate(dealt[:20], 1)]


def test_archive(spark):
    rows = [(i, f"t{i % 50}", [float(i), None]) for i in range(5000)] + [(7, "t7", None)] * 2
    t = spark.createDataFrame(rows, "a long, b string, c array<double>")
    then = state.manifest_of({"t": t})
    assert state.archive_problems({"t": t.repartition(9, "b").select("c", "b", "a")}, then).count() == 0
    one = t.withColumn("b", F.when(F.col("a") == 4321, "x").otherwise(F.col("b")))
    less, more = t.dropDuplicates(["a"]), t.union(t.filter("a = 1"))
    for broken, what in ((one, "content"), (less, "rows"), (more, "rows"), (t.withColumn("a", F.col("a").cast("int")), "schema")):
        assert [r.problem for r in state.archive_problems({"t": broken}, then).collect()] == [what]
    with pytest.raises(ValueError, match="map"):
        state.content_digest(t.select(F.create_map("b", "a").alias("m")), "m")


def test_storefront_rules(spark):
    item = {"handle": "h", "title": " Maker Box  Ryzen 5 3550H", "vendor": "MAKER", "product_type": "PC", "variants": [{"title": "x", "option1": "128GB + 8GB", "price": "0", "sku": ""}, {"title": "y", "option1": "", "option2": "EU", "price": "no"}], "images": [{"src": f"i{n}?v=1"} for n in range(12)] + [{}]}
    r = normalize.bulk_store(spark.createDataFrame([("s", json.dumps(item))], "source string, j string").select("source", F.parse_json("j").alias("item")), "maker", "b").first()
    assert (r.model, r.memory, r.storage, [p.amount for p in r.prices], len(r.images), r.images[0], r.vendor_sku, r.confidence) == ("Box Ryzen 5 3550H", "8 GB", "128 GB", [0.0], 10, "i0", None, 1.0)
    node = {"@type": "Product", "name": "N", "Offers": [{"Price": "3", "PriceCurrency": "EUR"}, {"price": "0"}, "x"], "image": [{"contentUrl": "c"}, {"url": "u"}, "t", {}], "mpn": "M"}
    r = normalize.jsonld(spark.createDataFrame([("s", "http://p/cable", json.dumps(node)), ("s", "http://p", json.dumps(node))], "source string, url string, j string").select("source", "url", F.parse_json("j").alias("node")), "m").orderBy("url").collect()
    assert ([(p.amount, p.currency) for p in r[0].prices], r[0].images, r[0].vendor_sku, r[0].aliases, r[0].confidence, r[1].confidence) == ([(3.0, "EUR")], ["c", "u", "t"], "M", ["M"], 1.0, 0.0)
    scoped = lambda **k: values(spark, normalize.scoped(F.col("x"), **k), [["Mini PCs"], ["Docks"], [], None], "array<string>")
    assert scoped(include=["pc"]) == [True, False, False, False] and scoped(exclude=["DOCK"]) == [True, False, True, True]
    nodes = spark.createDataFrame([('[{"url":"http://a"},{"@id":"http://b/","url":"http://a"}]',)], "j string").select(F.expr("cast(parse_json(j) as array<variant>)").alias("n"))
    pick = lambda url: nodes.select(F.to_json(normalize.pick_node(F.col("n"), F.lit(url)))).first()[0]
    assert "@id" in pick("http://b") and "@id" not in pick("http://a/") and "@id" not in pick("http://c")


def test_redaction_takes_whole_values(spark):
    body = '{"log":{"entries":[{"password":{"v":"secretvalue"},"tokens":["abc","def"],"cookies":[{"name":"a","value":"b"}],"x":1}]}}'
    out = values(spark, redact.redact_har(F.col("x"), strict=True), [body, None])
    assert json.loads(out[0])["log"]["entries"] == [{"password": "[redacted]", "tokens": "[redacted]", "cookies": [], "x": 1}] and out[1] is None
    with pytest.raises(Exception, match="not a HAR"):
        values(spark, redact.redact_har(F.col("x"), strict=True), ['{"log":{}}'])
