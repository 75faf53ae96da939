"""Which texts hold which of many terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import release, stored

#: Bytes of terms that go into one automaton, which takes some dozens of times as much memory.
MOST = 4 << 20
#: Matches that are handed on at once.
ROWS = 1 << 16
#: Letters of a term, and of a word, up to which a word's substrings are spelt out.
SHORT, SPELT = 64, 1_000


def _scan(terms: list[str], names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                hits = sorted({i for _, i in automaton.iter(text.as_py())}) if text.is_valid and len(terms) else []
                rows += [k] * len(hits)
                found += hits
                if len(rows) >= ROWS or k + 1 == batch.num_rows:
                    at = pa.array(rows, pa.int64())
                    columns = [batch.column(c).take(at) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([terms[i] for i in found], pa.string())], schema=schema)
                    rows, found = [], []

    return run


def matches(texts: DataFrame, text: str, terms: DataFrame, term: str, most: int = MOST) -> DataFrame:
    """The other columns of texts, and term: one row for each text and distinct term that it holds, letters' case aside.

    Terms of at most `most` bytes together go into one automaton, past which the texts are read once. Of more, a term without
    blanks stands inside a word (a run without blanks): each distinct word is looked at once, and its substrings of the lengths
    that terms have meet these by a join, so work grows with words and not with words times terms. Words of over SPELT letters and
    terms of over SHORT meet by automata of at most `most` bytes of terms (a longer term is a block of its own), as do terms with
    blanks and the texts, which are read once a block. Only a block's terms pass through the driver. Null texts hold nothing; null
    and empty terms are held by nothing; without terms there are no rows.
    """
    lowered = terms.select(F.lower(F.col(term).cast("string")).alias("term")).filter("term <> ''").distinct()
    total = lowered.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("n")).first().n
    rest = [c for c in texts.columns if c != text]
    rows = texts.select(*rest, F.lower(F.col(text).cast("string")).alias("_text"))
    if total <= most:
        return _passed(rows, lowered, total, most)
    spark = texts.sparkSession
    lowered = stored(lowered, "terms", "zstd")
    blank, letters, size = F.col("term").contains(" "), F.length("term"), F.octet_length("term")
    own = lambda test: F.coalesce(F.sum(F.when(test, size)), F.lit(0))
    long = ~blank & (letters > SHORT)
    told = lowered.agg(own(blank).alias("blank"), own(long).alias("long"), own(~blank & ~long).alias("short"), F.min(F.when(~blank, letters)).alias("least"), F.sort_array(F.collect_set(F.when(~blank & ~long, letters))).alias("lengths")).first()
    out = _passed(rows, lowered.filter(blank), told.blank, most)
    if told.least is None:
        return out

    words = F.array_distinct(F.filter(F.split("_text", " "), lambda w: F.length(w) >= told.least))
    held = stored(rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *rest, F.explode(words).alias("_text")), "words", "zstd")
    release(spark)
    each = held.select("_text").distinct()
    n = F.length("_text")
    inside = F.flatten(F.transform(F.filter(F.array(*map(F.lit, told.lengths)).cast("array<int>"), lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substr("_text", at, k))))
    pairs = each.filter(n <= SPELT).select("_text", F.explode(F.array_distinct(inside)).alias("term")).join(lowered.filter(~blank & ~long), "term") if told.lengths else None
    words_of = lambda test: each.filter(test).select("_text", F.col("_text").alias("_word"))
    named = lambda found: found.select(F.col("_word").alias("_text"), "term")
    parts = [pairs.select("_text", "term")] if pairs is not None else []
    if told.short and not held.filter(n > SPELT).isEmpty():
        parts.append(named(_passed(words_of(n > SPELT), lowered.filter(~blank & ~long), told.short, most)))
    if told.long:
        parts.append(named(_passed(words_of(n > SHORT), lowered.filter(long), told.long, most)))
    found = stored(reduce(DataFrame.unionByName, parts), "found", "zstd")
    release(spark)
    # two words of a text may hold one term
    return out.unionByName(held.join(found, "_text").select("_row", *rest, "term").dropDuplicates(["_row", "term"]).drop("_row"))


def _passed(rows: DataFrame, terms: DataFrame, total: int, most: int) -> DataFrame:
    """The columns of rows but _text, and each term that it holds, by automata of at most `most` of the terms' `total` bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in rows.columns if c != "_text"]
    rows = rows.select(*rest, "_text")
    schema = rows.drop("_text").schema.add("term", "string")
    # twice as many blocks as the bytes ask for, as hashes deal them out unevenly; a block that is too large all the same is dealt out again
    blocks = max(1, -(-2 * total // most)) if total > most else 1
    out = rows.sparkSession.createDataFrame([], schema)
    for block in range(blocks if total else 0):
        own = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        for part in _bounded(own, most):
            out = out.unionByName(rows.mapInArrow(_scan(part, rest, to_arrow_schema(schema)), schema))
    return out


def _bounded(terms: DataFrame, most: int) -> Iterator[list[str]]:
    """A block's terms in order, in lists of at most `most` bytes."""
    part, size = [], 0
    for row in terms.orderBy("term").toLocalIterator():
        n = len(row.term.encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(row.term)
        size += n
    if part:
        yield part


def presence(items: DataFrame, name: str, known: DataFrame, token: str, most: int = MOST) -> DataFrame:
    """Adds presence: yes if a known token holds the item's token or is held by it, else no; unknown without known tokens or a text.

    Tokens are upper-cased and without blanks and hyphens. Either side may be a large table: distinct tokens meet by `matches`, both
    ways.
    """
    from .deltas import token as tokened

    own = items.withColumn("_own", F.lower(tokened(F.col(name))))
    theirs = known.select(F.lower(tokened(F.col(token))).alias("_known")).filter("_known <> ''").distinct()
    mine = own.select("_own").filter("_own <> ''").distinct()
    held = matches(mine.withColumn("_text", F.col("_own")), "_text", theirs, "_known", most).select("_own")
    holding = matches(theirs.select(F.col("_known").alias("_text")), "_text", mine, "_own", most).select(F.col("term").alias("_own"))
    hits = held.unionByName(holding).distinct().withColumn("_hit", F.lit(True))
    out = own.join(hits, "_own", "left")
    return out.withColumn("presence", F.when(F.lit(theirs.isEmpty()) | F.col("_own").isNull() | (F.col("_own") == ""), "unknown").when(F.col("_hit"), "yes").otherwise("no")).drop("_own", "_hit")
