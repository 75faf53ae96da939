"""Redaction of recorded HTTP traffic: unbounded nesting, so a pandas UDF over the JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECRET = re.compile(r"(?i)auth|cookie|token|secret|passw|session|api[-_]?key|csrf|signature|e-?mail|bearer")
#: Names and values of URL queries and of form bodies; credentials inside any text.
PAIR = re.compile(r"(^|[?&;#])([^=&?#;\s]+)=([^&#;\s]*)")
CREDENTIAL = re.compile(r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{6,}")


def cleaned_text(x: str) -> str:
    """A text with the values of telling names in URL queries and form bodies, and credentials, blanked; JSON is cleaned as such."""
    if x[:1] in ("{", "["):
        try:
            return json.dumps(cleaned(json.loads(x)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            pass
    x = PAIR.sub(lambda m: f"{m[1]}{m[2]}=[redacted]" if SECRET.search(m[2]) else m[0], x)
    return CREDENTIAL.sub(lambda m: f"{m[1]} [redacted]", x)


def cleaned(x):
    """The value with everything under a telling name, every name-value pair of such a name, and telling parts of texts blanked."""
    if isinstance(x, str):
        return cleaned_text(x)
    if isinstance(x, dict):
        if isinstance(x.get("name"), str) and "value" in x and SECRET.search(x["name"]):
            return {**{k: cleaned(v) for k, v in x.items() if k != "value"}, "value": "[redacted]"}
        # the cookies of a record are a list that stays one; anything else under a telling name goes whole
        return {k: [] if k == "cookies" and isinstance(v, list) else "[redacted]" if SECRET.search(k) else cleaned(v) for k, v in x.items()}
    if isinstance(x, list):
        return [cleaned(v) for v in x]
    return x


def _redacted(body: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(cleaned(json.loads(text)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return body.map(one)


def is_har(body: Column) -> Column:
    """Whether a text is JSON with a list of log.entries."""
    return F.try_variant_get(F.try_parse_json(body), "$.log.entries", "array<variant>").isNotNull()


def redact_har(body: Column, strict: bool = False) -> Column:
    """Redacted JSON with sorted keys; null for malformed input. strict: an error for what isn't a recording with log.entries."""
    out = F.pandas_udf(_redacted, T.StringType())(body)
    return F.when(is_har(body) | body.isNull(), out).otherwise(F.raise_error(F.lit("not a HAR file: log.entries is missing")).cast("string")) if strict else out
