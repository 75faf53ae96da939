"""Details of alerts and evidence, cards, decorated events and ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deltashelf.operators import desk, payloads
from deltashelf.schema import PRODUCT

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("span", [1, 2, 16])
def test_last_rows_before_each(spark, monkeypatch, span):
    monkeypatch.setattr(payloads, "SPAN", span)
    rng = random.Random(span)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in rng.sample(range(400), 120)]
    got = {r.id: list(r.last) for r in payloads.before(spark.createDataFrame(rows, "id long, k string"), "k", "id", F.col("id"), 3, "last").collect()}
    want = {i: sorted((j for j, x in rows if x == k and j < i), reverse=True)[:3] for i, k in rows}
    assert got == want


def test_alert_details(spark):
    events = spark.createDataFrame([(1, "s:a", "x"), (2, "s:a", "y"), (5, "t:b", "z"), (7, None, "w")], "id long, product_key string, change_type string")
    record = tuple({"product_key": "s:a", "model": "M", "manufacturer": "O", "prices": [(9.5, "USD", "us", "in_stock")]}.get(f.name) for f in PRODUCT)
    briefs = desk.product_brief(spark.createDataFrame([(record, 1)], f"r {PRODUCT.simpleString()}, n int").select("r.*", "n"), ["n"])
    sources = spark.createDataFrame([("s", "e", "u")], "source string, engine string, base_url string")
    reviews = spark.createDataFrame([(2, "HIT")], "alert_id long, outcome string")
    history = spark.createDataFrame([(2, 11, T0, "NOISE"), (2, 10, T0, "BUG"), (2, 9, T0 + dt.timedelta(1), "HIT")], "alert_id long, id long, changed_at timestamp, new_outcome string")
    got = {r.id: r for r in payloads.alert_details(events, briefs, sources, reviews, history).collect()}
    two = got[2]
    assert (two.model, two.price, two.engine, [x.id for x in two.related_events], two.review_status, [h.new_outcome for h in two.history], two.prev_id, two.next_id) == ("M", "9.5 USD", "e", [1], "HIT", ["BUG", "NOISE", "HIT"], 1, 5)
    assert (got[7].collector, got[7].review_status, got[7].history, got[7].prev_id, got[7].next_id, got[5].engine) == (None, "UNREVIEWED", [], 5, None, None)


def test_evidence_events_and_items(spark):
    with pytest.raises(Exception, match="unknown evidence event: gone"):
        payloads.recorded(spark.createDataFrame([("gone",)], "event_type string")).collect()
    bodies = [("u1", '{"ProductKey":"k","ProductID":7,"ProductName":"N","Withdraw":1}'), ("u2", '{"ProductKey":"k","ProductID":0}'), ("u3", '{"ProductKey":"","ProductID":1}'), ("u4", "[1]"), ("u5", None), ("u6", '{"ProductKey":"k"}')]
    d = spark.createDataFrame(bodies, "url string, body string")
    assert [(r.canonical_url, r.external_id, r.state) for r in payloads.product_evidence(d, "s", "m").collect()] == [("u2", "0", "current")]
    assert {r.external_id: r.state for r in payloads.product_evidence(d, "s", "m", withdrawn=True).collect()} == {"7": "discontinued", "0": "current"}


def test_ranges_are_half_open(spark):
    d = spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in range(4)], "t timestamp").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert d.filter(payloads.in_range(F.col("t"), "2024-01-01T01:00:00Z", "2024-01-01 03:00")).count() == 2
    assert d.filter(payloads.in_range(F.col("t"), None, "")).count() == 4
    for bad in ("yesterday", "2024-13-01"):
        with pytest.raises(ValueError, match="not an ISO"):
            payloads.in_range(F.col("t"), bad, None)


def test_decorated(spark):
    e = spark.createDataFrame([("s", "p", "new_product", 5, "existing_product"), ("s", "q", "new_product", 5, "none"), ("t", "q", "price_changed", 3, "existing_product")], "source string, product_key string, change_type string, severity int, relation string")
    one = lambda name, *xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = sorted((r.source, r.product_key, r.change_type, r.severity, r.baseline, r.hidden, r.unseen_component) for r in payloads.decorated(e, one("source", "s", "s"), one("product_key", "q"), one("product_key", "p")).collect())
    assert got == [("s", "p", "duplicate_listing", 2, False, False, True), ("s", "q", "new_product", 5, False, True, False), ("t", "q", "price_changed", 3, True, False, False)]
