"""Types, enumerations and rule tables of the product-change model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

COMPONENT = T.StructType([T.StructField("raw", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("known", T.BooleanType())])
PRICE = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType()), T.StructField("region", T.StringType()), T.StructField("availability", T.StringType())])
CONFIGURATION = T.StructType([T.StructField(n, T.StringType()) for n in ("sku", "label", "region", "memory", "storage", "availability")] + [T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType())])

#: One normalized product record; a snapshot is such a record with its listing, time and order.
PRODUCT = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("source_id", "product_key", "manufacturer", "model", "series", "category", "url", "vendor_sku", "status")),
        *(T.StructField(n, COMPONENT) for n in ("cpu", "gpu", "npu")),
        *(T.StructField(n, T.StringType()) for n in ("memory", "storage", "display", "battery", "wireless", "operating_system", "description", "region")),
        T.StructField("configurations", T.ArrayType(CONFIGURATION)),
        T.StructField("prices", T.ArrayType(PRICE)),
        *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("images", "aliases", "ports")),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("raw_data", T.StringType()),
    ]
)

COMPONENT_FIELDS = ("cpu", "gpu", "npu")
SPEC_FIELDS = ("memory", "storage", "display", "battery", "wireless", "operating_system")
#: Fields that say when and how a record was seen, not what it says (fixed values).
OBSERVATION_FIELDS = ("first_seen", "last_seen", "raw_data", "confidence")

#: Fixed values of the alert model.
OUTCOMES = ("HIT", "INTERESTING", "NOISE", "BUG")
SUGGESTION_STATUSES = ("PROPOSED", "ACCEPTED", "REJECTED", "IMPLEMENTED", "REVERTED")
TRANSITIONS = {"PROPOSED": ("ACCEPTED", "REJECTED"), "ACCEPTED": ("IMPLEMENTED", "REJECTED"), "IMPLEMENTED": ("REVERTED",), "REVERTED": ("ACCEPTED",), "REJECTED": ()}
EVIDENCE_TYPES = ("official_evidence_added", "official_evidence_updated")
REASON_CODES = (
    "ROUTINE_IMAGE_CHANGE", "MARKETING_ASSET_REFRESH", "CDN_URL_CHURN", "MINOR_PRICE_FLUCTUATION", "TEMPORARY_404", "TEMPORARY_STOCK_CHANGE",
    "DUPLICATE_SKU", "REGIONAL_DUPLICATE", "UNCHANGED_DOCUMENT", "DOCUMENT_METADATA_ONLY", "SPEC_FORMATTING_ONLY", "IRRELEVANT_PRODUCT",
    "OLD_PRODUCT_REDISCOVERED", "ACCESSORY_OR_COMPONENT", "PARSER_ERROR", "ENTITY_MATCH_ERROR", "BAD_BASELINE", "DUPLICATE_ALERT",
    "LOW_EDITORIAL_VALUE", "VALID_BUT_TOO_EARLY", "VALID_CONFIRMATION_SIGNAL", "OTHER",
)
TIER_WORDS = ("pro", "max", "plus", "ultra", "air", "lite", "se", "gt", "gtx", "ti", "mini", "nano", "prime", "elite", "advanced", "super", "x")


@dataclass(frozen=True)
class Rule:
    """Attributes an event must have (equal, or compared as "< 5"), and the severity it then gets."""

    match: dict
    severity: int


#: First match wins (fixed values).
SEVERITY_RULES = (
    Rule({"change_type": "component_changed", "unseen_component": True}, 5),
    Rule({"change_type": "new_product"}, 5),
    Rule({"change_type": "spec_changed", "field": "memory"}, 4),
    Rule({"change_type": "spec_changed", "field": "display"}, 4),
    Rule({"change_type": "spec_changed", "field": "battery"}, 4),
    Rule({"change_type": "component_changed"}, 4),
    Rule({"change_type": "spec_changed", "field": "configurations"}, 3),
    Rule({"change_type": "price_changed"}, 3),
    Rule({"change_type": "images_changed"}, 3),
    Rule({"change_type": "availability_changed"}, 3),
    Rule({"change_type": "description_changed"}, 2),
    Rule({}, 2),
)
FALLBACK_SEVERITY = 2


@dataclass(frozen=True)
class StoryRule:
    """Events that match, grouped by a value, make a story once enough manufacturers show them within the window."""

    id: str
    match: dict = field(default_factory=dict)
    group_by: str = "new_value"
    min_manufacturers: int = 2
    window_days: int = 7
    base_score: int = 60
    per_extra: int = 10
    enabled: bool = True


@dataclass(frozen=True)
class HealthThresholds:
    least_share: float = 0.35
    warn_share: float = 0.70
    zero_fails: bool = True


@dataclass(frozen=True)
class FeedbackThresholds:
    min_samples: int = 10
    min_noise: float = 0.75
    max_signal_loss: float = 0.05
    min_coverage: float = 0.5
