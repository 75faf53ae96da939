"""Small cases of the desk, page and telemetry operators: errors, nulls, ties, empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from deltashelf.functions import text
from deltashelf.operators import desk, normalize, pages, state, telemetry
from deltashelf.schema import REASON_CODES


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_reasons(spark):
    last, first = REASON_CODES[-1], REASON_CODES[0]
    got = values(spark, desk.ordered_reasons(F.col("x")), [[last, first, last], [], None], "x array<string>")
    assert got == [[first, last], [], []]
    for bad in (["NOPE"], [None]):
        with pytest.raises(Exception, match="unknown reason code"):
            values(spark, desk.ordered_reasons(F.col("x")), [bad], "x array<string>")
    assert values(spark, desk.reasons_of_json(F.col("x")), [None, "", f'["{first}"]']) == [[], [], [first]]
    with pytest.raises(Exception):
        values(spark, desk.reasons_of_json(F.col("x")), ["[oops"])


def test_clip_and_six_digits(spark):
    assert values(spark, text.clip(F.col("x"), 3), [" a\n", "  ", None, "abc "]) == ["a", None, None, "abc"]
    with pytest.raises(Exception, match="text longer than 3"):
        values(spark, text.clip(F.col("x"), 3), ["abcd"])
    shown = values(spark, text.six_digits(F.col("x")), [900.0, 899.99, 12345.67, 123456.7, 0.5, 1200.0, 100.0, None], "x double")
    assert shown == ["900", "899.99", "12345.7", "123457", "0.5", "1200", "100", None]
    assert values(spark, text.title_case(F.col("x")), ["amd ryzen ai 9 hx370b", "", None]) == ["Amd Ryzen Ai 9 Hx370B", "", None]


def test_manual_suggestions(spark):
    schema = "collector string, alert_type string, reason_code string, suggested_rule string, status string, created_at int"
    made = lambda *rows: spark.createDataFrame(list(rows), schema)
    none = made().withColumn("fingerprint", F.lit(""))
    stored = desk.manual_suggestions(none, made((" c ", "t", "", "r", None, 2), ("c", "t", None, "r ", "ACCEPTED", 1), ("c", "t", "OTHER", "r", None, 3)))
    assert sorted((r.collector, r.reason_code or "", r.status) for r in stored.collect()) == [("c", "", "ACCEPTED"), ("c", "OTHER", "PROPOSED")]
    assert desk.manual_suggestions(stored, made(("c", "t", "OTHER", " r", "REJECTED", 9))).count() == 0
    for row, message in (((" ", "t", "", "r", None, 1), "collector is required"), (("c", "t", "X", "r", None, 1), "invalid reason_code"), (("c", "t", "", "r", "DONE", 1), "invalid status"), (("c", "t" * 65, "", "r", None, 1), "text longer than 64")):
        with pytest.raises(Exception, match=message):
            desk.manual_suggestions(none, made(row)).collect()
    with pytest.raises(ValueError):
        desk.suggestion_list(stored, status="DONE")


def test_delivery_stops_at_the_limit_of_the_receiver(spark):
    outbox = spark.createDataFrame([(1, 0, "pending"), (2, 5, "pending"), (3, 4, "pending"), (4, 9, "sent"), (5, 7, "pending"), (6, 0, "pending")], "id long, attempts int, status string").withColumn("sent_at", F.lit(None).cast("int")).withColumn("last_error", F.lit(None).cast("string"))
    answers = spark.createDataFrame([(1, True, None, 10), (2, False, "boom", 11), (3, False, "boom", 12), (4, False, "429", 13), (5, False, "HTTP 429", 14), (6, True, None, 15)], "id long, ok boolean, error string, at int")
    got = {r.id: (r.status, r.attempts, r.sent_at, r.last_error) for r in telemetry.drained(outbox, answers).collect()}
    assert got == {1: ("sent", 1, 10, None), 2: ("failed", 6, None, "boom"), 3: ("pending", 5, None, "boom"), 4: ("sent", 9, None, None), 5: ("pending", 8, None, "HTTP 429"), 6: ("pending", 0, None, None)}
    nothing = telemetry.drained(outbox, answers.filter("id < 0")).collect()
    assert {(r.id, r.attempts) for r in nothing} == {(1, 0), (2, 5), (3, 4), (4, 9), (5, 7), (6, 0)}
    assert telemetry.drained(outbox.filter("id < 0"), answers).count() == 0


def test_product_at_any_depth(spark):
    script = "<script type='application/ld+json'>%s</script>"
    deep = script % "{oops" + script % '{"a":[{"b":{"@type":["Thing","Product"],"name":"N","mpn":7,"offers":[]}}],"@type":"x"}' + "<link href='https://X.test/C/?q' rel=\"canonical\">"
    rows = [("https://x.test/One/", deep), ("https://x.test/Two", script % '{"@type":"Product","offers":{"price":5}}'), ("https://x.test/3", script % '{"@type":"product"}'), ("https://x.test/4", None), (None, "")]
    got = {r.url: r for r in pages.product_identity(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == {"https://x.test/One/", "https://x.test/Two"}
    one, two = got["https://x.test/One/"], got["https://x.test/Two"]
    assert (one.model, one.sku, one.canonical_url, one.identity_key, one.confidence, one.price) == ("N", "7", "https://x.test/C", "sku:7", "high", None)
    assert (two.sku, two.price, two.identity_key, two.confidence, two.canonical_url) == (None, "5", "url:two", "medium", "https://x.test/Two")


def test_walls_and_marks(spark):
    rows = [(200, "Just A Moment"), (200, "cloudflare"), (403, "CloudFlare"), (None, "captcha"), (503, None)]
    d = spark.createDataFrame(rows, "s int, b string").select(pages.blocked(F.col("s"), F.col("b")).alias("w"))
    assert [r.w for r in d.collect()] == [True, False, True, False, False]
    assert values(spark, pages.framework(F.col("x")), ["/_nuxt/ data-reactroot", "__next_data__", None]) == ["Nuxt", None, None]


@pytest.mark.parametrize(
    ("title", "cpu"),
    [("Mini PC Ryzen 9 7940HS", "Ryzen 9 7940HS"), ("Core Ultra 7 155H laptop", "Core Ultra 7 155H"), ("Intel Core i5-12450H", "Intel Core i5-12450H"), ("Wildcat Lake 304 box", "Wildcat Lake 304"), ("Core 3 304", "Core 3 304"), ("Snapdragon X1E 80", "Snapdragon X1E 80"), ("Core Ultra 7 inside", "Core Ultra 7"), ("AMD Ryzen 5 box", "AMD Ryzen 5"), ("a plain box", None)],
)
def test_processors(spark, title, cpu):
    assert values(spark, text.first_match(normalize.CPU, F.col("x")), [title]) == [cpu]


def test_planning_and_totals(spark):
    r = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "source string, enabled boolean")
    assert [x.source for x in telemetry.planned(r).collect()] == ["a"] and telemetry.planned(r, "b").count() == 0
    none = spark.createDataFrame([], "source string, fetched boolean, result string, n_events int, error string")
    assert telemetry.run_totals(telemetry.run_stats(none)).collect()[0] == (0, 0, 0, 0)


def test_file_digests(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.n_bytes, r.sha256) for r in state.digests(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a"] == (3, hashlib.sha256(b"abc").hexdigest()) and got.get("b", (0, ""))[0] == 0
