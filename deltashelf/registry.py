"""Extension points: what a platform, a rule set or an evidence source must offer, and where it is looked up by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import normalize, payloads
from .sources import captured


class Normalizer(Protocol):
    """Maps parsed items of a platform (source, item or node) to product records."""

    def __call__(self, items: DataFrame, manufacturer: str) -> DataFrame: ...


class EvidenceSource(Protocol):
    """Maps captured official records to evidence items."""

    def __call__(self, bodies: DataFrame) -> DataFrame: ...


class Discovery(Protocol):
    """Maps captured answers (source, page or url, body) to references of items."""

    def __call__(self, answers: DataFrame) -> DataFrame: ...


class SnapshotStore(Protocol):
    """Says what a listing was last, and takes what it is now."""

    def read(self, name: str, before: int | None = None) -> DataFrame | None: ...

    def publish(self, batch: int, tables) -> bool: ...


class Notifier(Protocol):
    """Takes outbox rows that are due and returns (id, result, at)."""

    def __call__(self, due: DataFrame) -> DataFrame: ...


class Registry:
    """Names to functions; a name is taken once."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def add(self, name: str, f: Callable) -> Callable:
        if name in self.known:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.known[name] = f
        return f

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


normalizers = Registry("normalizer")
normalizers.add("bulk_store", lambda items, manufacturer: normalize.bulk_store(items, manufacturer, ""))
normalizers.add("store_api", normalize.store_api)
normalizers.add("jsonld", normalize.jsonld)
normalizers.add("listing_items", lambda pages, manufacturer: normalize.listing_items(pages).withColumn("manufacturer", F.lit(manufacturer)))
normalizers.add("catalogue_item", normalize.catalogue_item)
normalizers.add("category_item", normalize.category_item)

discoveries = Registry("discovery")
discoveries.add("category_pages", normalize.category_refs)
discoveries.add("numbered_pages", lambda answers: captured.list_pages(answers, None))
discoveries.add("vendor_catalogue", captured.vendor_catalogue)
discoveries.add("catalogue_tree", captured.catalogue_tree)

evidence_sources = Registry("evidence source")
evidence_sources.add("product_database", lambda bodies: payloads.product_evidence(bodies, "product_database", ""))
