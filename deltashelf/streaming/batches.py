"""Batches of many tables that become visible at once, or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import model_key
from ..operators import state
from .ingest import hashed

RUN = "batch long, status string, error string, parts map<string, string>, at string"


class Published:
    """Tables under one folder. A batch stages a part of each table, and one marker that names them publishes all.

    Readers take the parts that markers name, so what a run that failed or was killed has written is never seen; a
    batch that is published already is left as it is. Markers are the log of runs, failed ones included. The driver
    reads one small marker a run.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> DataFrame:
        """batch, status (ok or failed), error, parts, at: one row a run."""
        if not self._fs().exists(self._path("_runs")):
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).json(f"{self.root}/_runs")

    def _parts(self) -> dict[int, dict[str, str]]:
        return {r.batch: r.parts for r in self.runs().filter("status = 'ok'").collect()}

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The published rows of a table with their batch, or those of its batches before one; None if there are none."""
        paths = [parts[name] for batch, parts in self._parts().items() if name in parts and (before is None or batch < before)]
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in sorted(paths))) if paths else None

    def _mark(self, batch: int, status: str, error: str | None, parts: Mapping[str, str], at: str | None) -> None:
        name = f"{batch}-{uuid.uuid4().hex}.json"
        fs, waiting = self._fs(), self._path(f"_waiting/{name}")
        out = fs.create(waiting, True)
        out.write(bytearray(json.dumps({"batch": batch, "status": status, "error": error, "parts": dict(parts), "at": at}).encode()))
        out.close()
        # a marker appears whole: it is moved to where readers look
        fs.mkdirs(self._path("_runs"))
        if not fs.rename(waiting, self._path(f"_runs/{name}")):
            raise OSError(f"the marker of batch {batch} could not be put in place")

    def publish(self, batch: int, tables: Mapping[str, DataFrame | None] | Callable[[], Mapping[str, DataFrame | None]], at: str | None = None) -> bool:
        """Writes a part of each table and publishes them together; False if the batch is published already.

        An error on the way is logged as a failed run and raised again; the tables stay as they were.
        """
        if batch in self._parts():
            return False
        parts = {}
        try:
            for name, rows in (tables() if callable(tables) else tables).items():
                if rows is not None:
                    parts[name] = f"{name}/{batch}-{uuid.uuid4().hex}"
                    rows.withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{self.root}/{parts[name]}")
        except Exception as e:
            self._mark(batch, "failed", str(e)[:500], {}, at)
            raise
        self._mark(batch, "ok", None, parts, at)
        return True


def current_listings(published: Published, before: int | None = None) -> DataFrame | None:
    """The listings as the last batch that saw them left them."""
    rows = published.read("listings", before)
    return None if rows is None else state.latest(rows, ["product_key"], [F.desc("batch")]).drop("batch")


def appended(published: Published, observed: DataFrame, batch: int, order: Sequence[str] = ("captured_at", "seq")) -> dict[str, DataFrame]:
    """The parts that a batch of observations (product_key, order, record) adds: products, listings, snapshots, prices, aliases.

    Products and aliases are added where they are new; a listing keeps the model key of its first record, its SKU
    and region are the last that weren't null. Snapshots are those whose content differs from the listing's one before, and each
    gives its prices. Listings that were seen unchanged only have a later last_seen.
    """
    rows = hashed(observed).withColumn("_old", F.lit(False))
    past = published.read("snapshots", batch)
    if past is not None:
        last = state.latest(past.drop("batch"), ["product_key"], [F.desc(c) for c in order])
        rows = rows.unionByName(last.join(rows.select("product_key").distinct(), "product_key", "left_semi").withColumn("_old", F.lit(True)))
    fresh = state.fresh_snapshots(rows, "product_key", "content_hash", order).filter("not _old").drop("_old")
    r = lambda f: F.col(f"record.{f}")
    named = fresh.select("*", r("manufacturer").alias("manufacturer"), model_key(r("manufacturer"), r("model")).alias("model_key"), r("category").alias("category"))
    first = list(order)
    products = state.keep_first(named.select("manufacturer", "model_key", "category", *order), ["manufacturer", "model_key"], first).drop(*order)
    aliases = named.select("manufacturer", "model_key", F.explode(r("aliases")).alias("alias")).distinct()
    for name, key in (("products", ["manufacturer", "model_key"]), ("aliases", ["manufacturer", "model_key", "alias"])):
        known = published.read(name, batch)
        if known is not None:
            products, aliases = (products.join(known.select(*key), key, "left_anti"), aliases) if name == "products" else (products, aliases.join(known.select(*key), key, "left_anti"))
    at = F.struct(*order)
    after = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    seen = observed.groupBy("product_key").agg(F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen"), F.min_by(r("manufacturer"), at).alias("manufacturer"), F.min_by(model_key(r("manufacturer"), r("model")), at).alias("model_key"), F.max_by(r("url"), at).alias("url"), after(r("vendor_sku")).alias("vendor_sku"), after(r("region")).alias("region"))
    known = current_listings(published, batch)
    if known is not None:
        old = known.select("product_key", *(F.col(c).alias(f"_{c}") for c in known.columns if c != "product_key"))
        kept = {c: F.coalesce(f"_{c}", c) for c in ("first_seen", "manufacturer", "model_key")} | {c: F.coalesce(c, f"_{c}") for c in ("vendor_sku", "region")}
        seen = seen.join(old, "product_key", "left").withColumns(kept).select(*seen.columns)
    prices = fresh.select("product_key", *order, F.explode(r("prices")).alias("p")).select("product_key", *order, "p.*")
    return {"products": products, "listings": seen, "snapshots": fresh, "prices": prices, "aliases": aliases}


def append_batch(published: Published, observed: DataFrame, batch: int, at: str | None = None, order: Sequence[str] = ("captured_at", "seq")) -> bool:
    return published.publish(batch, lambda: appended(published, observed, batch, order), at)


def save_delta(published: Published, batch: int, region: str, current: DataFrame, candidates: DataFrame, now: str) -> bool:
    """A run of a region: its items (url, identity_key) ever seen with first and last time, and candidates that are new, together.

    candidates: url, identity_key and more; a candidate's own identity key replaces that of its item; urls that were
    candidates before stay as they are.
    """

    def parts() -> dict[str, DataFrame]:
        seen = current.select(F.lit(region).alias("region"), "url", "identity_key").dropDuplicates(["url"])
        own = state.keep_first(candidates.select("url", F.col("identity_key").alias("_own")), ["url"], ["_own"])
        seen = seen.join(own, "url", "left").withColumn("identity_key", F.coalesce("_own", "identity_key")).drop("_own")
        old, known = published.read("items", batch), published.read("candidates", batch)
        seen = seen.withColumns({"first_seen": F.lit(now), "last_seen": F.lit(now)})
        if old is not None:
            before = state.latest(old, ["region", "url"], [F.desc("batch")]).select("region", "url", F.col("first_seen").alias("_first"), F.col("identity_key").alias("_key"))
            seen = seen.join(before, ["region", "url"], "left").join(own.select("url", "_own"), "url", "left")
            seen = seen.withColumns({"first_seen": F.coalesce("_first", "first_seen"), "identity_key": F.coalesce("_own", "_key", "identity_key")}).drop("_first", "_key", "_own")
        new = state.keep_first(candidates, ["url"], ["identity_key"]).withColumns({"region": F.lit(region), "first_seen": F.lit(now)})
        if known is not None:
            new = new.join(known.filter(F.col("region") == region).select("url"), "url", "left_anti")
        return {"items": seen, "candidates": new}

    return published.publish(batch, parts, now)
