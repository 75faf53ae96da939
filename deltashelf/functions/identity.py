"""Identity keys: components, models, configurations, content and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TIER_WORDS
from .text import squeeze


def component_slug(raw: Column) -> Column:
    """A component's name without marks and makers, as a slug; null if no digit is left."""
    s = F.regexp_replace(raw, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"(?i)®|™|\b(amd|intel|nvidia|qualcomm|apple|processor|cpu|graphics|mobile)\b", " ")
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9+\-. ]", " ")
    s = F.regexp_replace(s, r"\b(ryzen|core|radeon|arc|geforce|rtx|gtx|xe)(\d)", "$1 $2")
    s = squeeze(s)
    return F.when(s.rlike(r"\d"), F.replace(s, F.lit(" "), F.lit("-")))


def model_tokens(model: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(model), r"[^a-z0-9\-]+", " "), " "), lambda t: t != "")


def model_key(manufacturer: Column, model: Column) -> Column:
    """Manufacturer and the model's words up to the first with a digit among four, else the first two."""
    head = F.slice(model_tokens(model), 1, 4)
    at = F.array_position(F.transform(head, lambda t: t.rlike(r"\d")), True)
    words = F.when(at > 0, F.slice(head, F.lit(1), F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.slice(head, 1, 2))
    return F.concat(F.lower(manufacturer), F.lit("::"), F.array_join(words, "-"))


def words(model: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(model), "[^a-z0-9]+"), lambda t: t != ""))


def same_product(a: Column, b: Column) -> Column:
    """False if the names differ by a word that tells variants apart."""
    x, y = words(a), words(b)
    odd = F.array_union(F.array_except(x, y), F.array_except(y, x))
    return ~F.arrays_overlap(odd, F.array(*map(F.lit, TIER_WORDS)))


def configuration_key(sku: Column, label: Column, region: Column) -> Column:
    """The SKU, else label and region; a missing part reads None."""
    none = F.lit("None")
    return F.coalesce(F.nullif(sku, F.lit("")), F.concat(F.coalesce(label, none), F.lit("|"), F.coalesce(region, none)))


def key_of(*parts: Column, length: int = 32) -> Column:
    """First hex digits of the SHA-256 of the parts; a missing part reads None, so it keeps its place."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, length)


def content_hash(record: Column) -> Column:
    """SHA-256 of a struct as JSON, nulls kept."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def collector_of(key: Column) -> Column:
    """The part of a key before its first colon; the whole key without one."""
    return F.substring_index(key, ":", 1)
