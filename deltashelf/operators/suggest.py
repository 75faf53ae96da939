"""Tuning rules that reviews suggest, and what each would have suppressed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import key_of
from ..functions.text import share
from ..schema import OUTCOMES, FeedbackThresholds

CHURN = ("CDN_URL_CHURN", "ROUTINE_IMAGE_CHANGE", "MARKETING_ASSET_REFRESH")
UNCHANGED = ("UNCHANGED_DOCUMENT", "DOCUMENT_METADATA_ONLY")


def cites(*codes: str) -> Column:
    return F.arrays_overlap("reasons", F.array(*map(F.lit, codes)))


def only_query_differs(old: Column, new: Column) -> Column:
    """Lists of URLs that are equal but for what follows the question mark."""
    bare = lambda x: F.transform(x, lambda u: F.substring_index(u, "?", 1))
    return F.coalesce((F.size(old) > 0) & (F.size(old) == F.size(new)) & (bare(old) == bare(new)) & (old != new), F.lit(False))


def same_content(row: str = "meta") -> Column:
    """Evidence that content is unchanged: two equal hashes, or where they are missing an explicit flag."""
    a, b = F.col(f"{row}.content_hash_before"), F.col(f"{row}.content_hash_after")
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(F.col(f"{row}.identical_content_hash").isNotNull()), F.lit(False))


@dataclass(frozen=True)
class Detector:
    """A rule that reviews may suggest: which reviews speak for it, which of them are preferred where a group has any, and what it is called."""

    rule: str
    parameters: str
    takes: Column
    wanted: Column | None = None
    reason: str | None = None


def detectors(least_price: float = 5.0) -> dict[str, Detector]:
    kind = F.col("alert_type")
    return {
        "temporary_404": Detector("require_consecutive_missing", '{"minimum_elapsed_hours":24,"minimum_observations":2}', kind.isin("product_removed", "availability_changed"), cites("TEMPORARY_404"), "TEMPORARY_404"),
        "duplicates": Detector("suppress_exact_duplicate", '{"window_hours":24}', cites("DUPLICATE_ALERT") | (F.col("outcome") == "NOISE"), cites("DUPLICATE_ALERT"), "DUPLICATE_ALERT"),
        # its reason is the first of the three that the group cites
        "image_churn": Detector("normalize_image_url", '{"normalize_cdn_host":true,"strip_query":true}', (kind == "images_changed") & (cites(*CHURN) | only_query_differs(F.col("old_urls"), F.col("new_urls")))),
        "unchanged_document": Detector("compare_content_hash", "{}", cites(*UNCHANGED) & same_content(), None, "UNCHANGED_DOCUMENT"),
        "minor_price": Detector("minimum_price_change_percent", f'{{"minimum_pct":{least_price}}}', (kind == "price_changed") & (F.col("magnitude_pct") < least_price), None, "MINOR_PRICE_FLUCTUATION"),
    }


def candidates(rows: DataFrame, limits: FeedbackThresholds = FeedbackThresholds(), names: Sequence[str] | None = None) -> DataFrame:
    """What the named detectors, or all, make of the reviews, in one pass: each review is counted under each rule that it speaks for.

    Reviews that a rule prefers are counted apart, and where a group has any, they alone count; so groups are sums, and no task takes one.
    """
    some = {k: d for k, d in detectors().items() if names is None or k in names}
    yes = lambda c: F.coalesce(c, F.lit(False))
    spoken = F.explode(F.array_compact(F.array(*(F.when(yes(d.takes), F.struct(F.lit(d.rule).alias("rule_type"), (F.lit(True) if d.wanted is None else yes(d.wanted)).alias("wanted"))) for d in some.values())))).alias("spoken")
    counts = [F.count(F.lit(1)).alias("samples"), *(F.count_if(F.col("outcome") == x).alias(x.lower()) for x in OUTCOMES), F.min("detected_at").alias("sample_start"), F.max("detected_at").alias("sample_end"), *(F.max(yes(cites(c))).alias(f"churn{i}") for i, c in enumerate(CHURN))]
    sums = rows.select("collector", "alert_type", "outcome", "detected_at", "reasons", spoken).groupBy("spoken.rule_type", "collector", "alert_type", "spoken.wanted").agg(*counts)
    names_ = [c for c in sums.columns if c not in ("rule_type", "collector", "alert_type", "wanted")]
    out = sums.groupBy("rule_type", "collector", "alert_type").agg(F.max_by(F.struct(*names_), "wanted").alias("x")).select("rule_type", "collector", "alert_type", "x.*")
    out = out.filter((F.col("samples") >= limits.min_samples) & (F.col("noise") / F.col("samples") >= limits.min_noise))
    of_rule = lambda value: F.coalesce(*(F.when(F.col("rule_type") == d.rule, value(d)) for d in some.values()))
    churn = F.when(F.col("churn0"), CHURN[0]).when(F.col("churn1"), CHURN[1]).when(F.col("churn2"), CHURN[2]).otherwise(CHURN[0])
    ratio = lambda *of: F.round(sum((F.col(x) for x in of), F.lit(0)) / F.col("samples"), 4)
    return out.select(
        "rule_type", "collector", "alert_type", of_rule(lambda d: churn if d.reason is None else F.lit(d.reason)).alias("reason_code"), of_rule(lambda d: F.lit(d.parameters)).alias("parameters"), "samples", "hit", "interesting", "noise", "bug",
        ratio("noise").alias("noise_reduction"), ratio("hit").alias("hit_loss"), ratio("interesting").alias("interesting_loss"), ratio("hit", "interesting").alias("signal_loss"), "sample_start", "sample_end",
    )


def suggestions(rows: DataFrame, limits: FeedbackThresholds = FeedbackThresholds()) -> DataFrame:
    """All detectors' candidates with their fingerprints; each rule gives one of a group.

    rows: collector, alert_type, outcome, reasons, detected_at, magnitude_pct, old_urls, new_urls, meta.
    """
    return candidates(rows, limits).withColumn("fingerprint", key_of(*map(F.col, ("rule_type", "collector", "alert_type", "reason_code", "parameters"))))


def rule_matches(rule_type: str, minimum_pct: float = 5.0, strict: bool = False) -> Column:
    """Which alerts a rule would touch. Parity is coarse; strict also asks for what the rule's name promises."""
    kind = F.col("alert_type")
    tests = {
        "require_consecutive_missing": kind.isin("product_removed", "availability_changed"),
        "suppress_exact_duplicate": cites("DUPLICATE_ALERT") if strict else F.lit(True),
        "normalize_image_url": (kind == "images_changed") & (cites(*CHURN) | only_query_differs(F.col("old_urls"), F.col("new_urls")) if strict else F.lit(True)),
        "compare_content_hash": same_content(),
        "minimum_price_change_percent": (kind == "price_changed") & (F.col("magnitude_pct") < minimum_pct),
        "compare_normalized_specs": kind == "spec_changed",
    }
    return F.coalesce(tests.get(rule_type, F.lit(False)), F.lit(False))


def simulate(alerts: DataFrame, rules: DataFrame, limits: FeedbackThresholds = FeedbackThresholds(), minimum_pct: float = 5.0, strict: bool = False) -> DataFrame:
    """Outcome counts, coverage, losses and an assessment of each rule (rule_type, collector, alert_type) over all alerts, reviewed or not."""
    test = F.lit(False)
    for name in ("require_consecutive_missing", "suppress_exact_duplicate", "normalize_image_url", "compare_content_hash", "minimum_price_change_percent", "compare_normalized_specs"):
        test = test | ((F.col("rule_type") == name) & rule_matches(name, minimum_pct, strict))
    out = alerts.join(rules.select("rule_type", "collector", "alert_type"), ["collector", "alert_type"]).filter(test).groupBy("rule_type", "collector", "alert_type").agg(F.count(F.lit(1)).alias("matched"), F.count("outcome").alias("reviewed"), *(F.count_if(F.col("outcome") == x).alias(x.lower()) for x in ("HIT", "INTERESTING", "NOISE", "BUG")))
    signal = F.col("hit") + F.col("interesting")
    coverage, loss = share(F.col("reviewed"), F.col("matched")), share(signal, F.col("reviewed"))
    thin = (F.col("reviewed") < limits.min_samples) | (coverage < limits.min_coverage)
    return out.select(
        "rule_type", "collector", "alert_type", "matched", "reviewed", (F.col("matched") - F.col("reviewed")).alias("unreviewed"), "hit", "interesting", "noise", "bug",
        coverage.alias("review_coverage"), share(F.col("noise"), F.col("reviewed")).alias("noise_reduction"), loss.alias("signal_loss"), loss.alias("precision_before"), F.when(signal > 0, 1.0).alias("recall_before"),
        F.when(F.coalesce(thin, F.lit(True)), "INSUFFICIENT_EVIDENCE").when(loss > limits.max_signal_loss, "RISKY").otherwise("SAFE_CANDIDATE").alias("assessment"),
    )
