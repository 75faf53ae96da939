"""Text, number, URL and calendar expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references of HTML 5, by their first two letters; those whose name ends without a semicolon also stand before other letters.
ENTITIES: dict[str, dict[str, str]] = {}
for _name, _value in sorted(html5.items()):
    ENTITIES.setdefault(_name[:2], {})[_name] = _value
BARE = sorted({len(name) for name in html5 if not name.endswith(";")}, reverse=True)
#: Characters of the second control block, as Windows has them; five places stay controls.
WINDOWS = [x if (x := bytes([n]).decode("cp1252", "replace")) != "\ufffd" else chr(n) for n in range(0x80, 0xA0)]
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def squeeze(c: Column) -> Column:
    """White space (Unicode's) collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def code_point(number: Column) -> Column:
    """The character that a numeric reference stands for: those of Windows for the second control block, none for other controls and non-characters, the replacement character where there is none."""
    old = F.try_element_at(F.array(*map(F.lit, WINDOWS)), (number - 0x7F).cast("int"))
    nothing = number.between(1, 8) | number.isin(11, 127) | number.between(14, 31) | number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    fine = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(number.between(0x80, 0x9F), old).when(fine & nothing, "").when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")


def unescape(c: Column) -> Column:
    """Numeric and named character references, each decoded once, as HTML 5 reads them; unknown names stay.

    Of a name that isn't known the longest known start is decoded, if that needs no semicolon.
    """
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,map<string,string>>")

    def decoded(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2))
        digits = lambda at: F.regexp_replace(F.rtrim(F.substr(body, F.lit(at)), F.lit(";")), "^0+(?=.)", "")
        plain = F.when(F.length(digits(2)) <= 7, digits(2).try_cast("long")).otherwise(0x110000)
        hexed = F.when(F.length(digits(3)) <= 6, F.conv(digits(3), 16, 10).try_cast("long")).otherwise(0x110000)
        own = F.try_element_at(names, F.left(body, F.lit(2)))
        starts = [F.when(F.length(body) > n, F.concat(F.try_element_at(own, F.left(body, F.lit(n))), F.substr(body, F.lit(n + 1)))) for n in BARE]
        named = F.coalesce(F.try_element_at(own, body), *starts, ref)
        return F.when(F.lower(F.left(body, F.lit(2))) == "#x", code_point(hexed)).when(F.left(body, F.lit(1)) == "#", code_point(plain)).otherwise(named)

    between = F.split(c, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), decoded)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(c)


def strip_html(c: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed; null gives empty text."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs, case aside."""
    low = F.lower(c)
    found = F.lit(False)
    for t in terms:
        found = found | low.contains(t.lower())
    return found


def first_match(patterns: Sequence[str], *texts: Column) -> Column:
    """The first pattern that matches in the first text that has any; marks stripped; null if none."""
    cases = [F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), p, 0), F.lit("")) for t in texts for p in patterns]
    return squeeze(F.regexp_replace(F.coalesce(*cases), "[®™]", ""))


def numeric(c: Column) -> Column:
    """The first number in a text, sizes in GB, energy and charge as they stand; null if none."""
    at = r"(?i)(\d+(?:\.\d+)?)\s*(TB|GB|MB|WH|MAH)?"
    number = F.regexp_extract(c, at, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, at, 2))
    return number * F.when(unit == "tb", 1024.0).when(unit == "mb", 1.0 / 1024).otherwise(1.0)


def direction(old: Column, new: Column) -> Column:
    """up or down between two values with numbers; null where they can't be compared or are equal."""
    a, b = numeric(old), numeric(new)
    return F.when(b > a, "up").when(b < a, "down")


def availability(c: Column) -> Column:
    """schema.org availability, bare or as a URL."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.contains("outofstock"), "sold_out").when(low.contains("preorder"), "preorder").when(low.contains("instock"), "in_stock").otherwise("unknown")


def url_normal(c: Column) -> Column:
    """Scheme and host in lower case; no query, fragment or last slash."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z]+://[^/]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def url_slug(c: Column) -> Column:
    return F.regexp_extract(url_normal(c), r"([^/]+)$", 1)


def without_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_key(ts: Column) -> Column:
    """Year and week, weeks from Monday, days before the year's first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded ratio; null over nothing."""
    return F.round(F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0)).cast("double")), digits)


def general(c: Column) -> Column:
    """A number as `%g` shows it where six digits suffice."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), r"0+$", ""), r"\.$", "")


def six_digits(c: Column) -> Column:
    """A number of less than a million by at most six significant digits, rounded half up, without trailing zeros."""
    exact = c.cast("decimal(18,6)")
    cases = F.round(exact, 5)
    for whole in range(2, 7):
        cases = F.when(F.abs(exact) >= 10 ** (whole - 1), F.round(exact, 6 - whole).cast("decimal(18,5)")).otherwise(cases)
    return F.regexp_replace(F.regexp_replace(cases.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def title_case(c: Column) -> Column:
    """Each run of letters with its first letter large and the others small; runs also start behind digits and marks."""
    parts = F.split(F.lower(c), r"(?<=[^a-z])(?=[a-z])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def clip(c: Column, most: int) -> Column:
    """The stripped text, null if empty, or an error when it is longer than allowed."""
    bare = F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    return F.when(F.length(bare) > most, F.raise_error(F.lit(f"text longer than {most}")).cast("string")).otherwise(bare)
