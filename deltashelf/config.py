"""Settings that come as text: intervals and source descriptors."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str | int) -> int:
    """90s, 30m, 6h or 1d; a bare number is seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", str(text))
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * UNITS.get(m[2], 1)


def sources(spark: SparkSession, descriptors: Sequence[Mapping]) -> DataFrame:
    """The registry of sources; all problems are named at once."""
    problems, rows, seen = [], [], set()
    for d in descriptors:
        for s in d.get("sources", ()):
            name = s.get("id")
            if not name:
                problems.append(f"{d.get('manufacturer')}: source without id")
            elif name in seen:
                problems.append(f"{name}: id used twice")
            else:
                seen.add(name)
                try:
                    rows.append((name, d["manufacturer"], s["engine"], bool(s.get("enabled", True)), seconds(s.get("interval", "1d"))))
                except (KeyError, ValueError) as e:
                    problems.append(f"{name}: {e}")
    if problems:
        raise ValueError("; ".join(problems))
    return spark.createDataFrame(rows, "source string, manufacturer string, engine string, enabled boolean, interval_s int")
