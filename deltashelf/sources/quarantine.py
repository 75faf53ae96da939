"""Sources judged apart: one that is broken is put aside with a reason, and ends no other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE = "source string, reason string, body_hash string"


def judged(responses: DataFrame, checks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Adds reason: what the first check (failed, reason) that failed says, null if none did. A check that gives null has not failed."""
    found = F.coalesce(*(F.when(F.coalesce(failed, F.lit(False)), F.coalesce(reason, F.lit("unknown"))) for failed, reason in checks))
    return responses.withColumn("reason", found)


def isolated(responses: DataFrame, checks: Sequence[tuple[Column, Column]], order: Sequence[str], source: str = "source", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """The responses of sources of which every response is sound, and one note for each other source: its first bad response by order.

    Notes are (source, reason, body_hash), the hash null for a missing body. A null source is one of its own.
    """
    seen = judged(responses, checks)
    bad = seen.filter("reason is not null").groupBy(source).agg(F.min_by(F.struct("reason", F.sha2(F.col(body).cast("string"), 256).alias("body_hash")), F.struct(*order, F.sha2(F.coalesce(F.col(body).cast("string"), F.lit("")), 256).alias("_hash"))).alias("x"))
    notes = bad.select(F.col(source).cast("string").alias("source"), "x.reason", "x.body_hash")
    marks = notes.select(F.col("source").alias("_source"))
    good = responses.join(marks, F.col(source).cast("string").eqNullSafe(F.col("_source")), "left_anti")
    return good, notes


def vendor_checks(body: str = "body") -> list[tuple[Column, Column]]:
    """What makes a vendor catalogue's response unsound: no JSON, a status other than success, no list of products."""
    v = F.try_parse_json(body)
    status = F.try_variant_get(v, "$.status", "string")
    return [
        (F.col(body).isNull() | v.isNull(), F.lit("malformed")),
        (~status.eqNullSafe(F.lit("success")), F.concat(F.lit("status "), F.coalesce(status, F.lit("missing")))),
        (F.try_variant_get(v, "$.data", "array<variant>").isNull(), F.lit("no products")),
    ]


def tried(responses: DataFrame, parse: Callable[[DataFrame], DataFrame], checks: Sequence[tuple[Column, Column]], order: Sequence[str], source: str = "source", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """What parse makes of the sound sources, and the notes of the others."""
    good, notes = isolated(responses, checks, order, source, body)
    return parse(good), notes
