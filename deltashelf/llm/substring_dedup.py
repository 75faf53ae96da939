"""Removal of repeated word windows by level-wise doubling.

A window of 20 words is named by its first least 5-gram (its anchor); equal windows have equal anchors at
equal places. Level 5: anchors whose 5-gram stands at one place only leave, with all their windows.
Level 10: what survives is extended to the 10 words that begin at, or around, the anchor and lie in each
window concerned; what is unique now leaves. Level 20: runs of windows that share an anchor are compared
whole, so that only the first of equal runs, and runs without an equal, are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, between, dropped, families, hashed_words, listed, repeated, signed, spans, staged_texts, stored, words_of

#: Words that are joined at once.
MANY = 100_000


class Words:
    """Identifiers of any stretch of words of a batch of texts, made of those of its halves; two independent ones give 128 bits."""

    def load(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of each text's first word (len + 1)."""
        self.a, self.b, at = hashed_words(body, offsets, 11)
        return at

    def one(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return signed(spans(self.a, start, end, 12))

    def two(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.one(start, end), signed(spans(self.b, start, end, 13))


def _record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _anchors(base: int, length: int):
    """Level 1: runs of windows that share an anchor, with the anchor's base-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                at = words.load(body, offsets)
                total = int(at[-1])
                if total < length:
                    continue
                i = np.arange(total - base + 1)
                grams = words.one(i, i + base).view(np.uint64)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                valid = np.zeros(len(grams), bool)
                whole = np.arange(total - length + 1)
                valid[: len(whole)] = whole + length <= at[doc[whole] + 1]
                i0, i1, p = families(grams, length - base + 1, valid)
                own = doc[i0]
                yield _record("rid i0 i1 p key", part.column("rid").take(pa.array(own)), *((x - at[own]).astype(np.int32) for x in (i0, i1, p)), signed(grams[p]))

    return run


def _doubled(base: int, length: int):
    """Level 2: each run split by whether its windows hold the doubled gram that begins at the anchor or the one around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                at = words.load(body, offsets)
                row, i0, i1, p = listed(part.column("runs"), "i0", "i1", "p")
                i0, i1, p = i0 + at[row], i1 + at[row], p + at[row]
                for side, a, b, start in ((0, np.maximum(i0, p - (length - 2 * base)), i1, p), (1, i0, np.minimum(i1, p - (length - 2 * base) - 1), p - base)):
                    ok = a <= b
                    a, b, start, own = a[ok], b[ok], start[ok], row[ok]
                    u, v = words.two(a, b + length)
                    yield _record("rid a b side key u v", part.column("rid").take(pa.array(own)), (a - at[own]).astype(np.int32), (b - at[own]).astype(np.int32), np.full(len(a), side, np.int32), words.one(start, start + 2 * base), u, v)

    return run


def _windows(length: int):
    """Last level: a row for each window of the runs that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                at = words.load(body, offsets)
                row, a, b = listed(part.column("runs"), "a", "b")
                many = b - a + 1
                own = np.repeat(row, many)
                i = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                u, v = words.two(i + at[own], i + at[own] + length)
                yield _record("rid doc_id i u v", part.column("rid").take(pa.array(own)), part.column("doc_id").take(pa.array(own)), i.astype(np.int32), u, v)

    return run


def _kept(length: int):
    """Removes the words that the ranges cover; of a later copy of a whole text all, if it holds a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b = listed(batch.column("ranges"), "a", "b")
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            total, gone, sha, texts = [], [], [], []
            for k, (text, copy) in enumerate(zip(batch.column("text"), batch.column("copy").to_pylist(), strict=True)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
                starts, stops, _ = words_of(data, np.array([0, len(data)]))
                n = len(starts)
                if copy:
                    kept = [] if n >= length else [(0, n)]
                else:
                    kept = list(between(a[ends[k] : ends[k + 1]], b[ends[k] : ends[k + 1]] + length, n))
                body = b" ".join(b" ".join(data[starts[i] : stops[j - 1]].tobytes().split()) for x, y in kept for i, j in ((i, min(i + MANY, y)) for i in range(x, y, MANY)))
                total.append(n)
                gone.append(n - sum(y - x for x, y in kept))
                sha.append(hashlib.sha256(body).hexdigest())
                texts.append(body.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, length: int = 20, base: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    A word goes if a window of `length` words that covers it also starts earlier: in a row of smaller id
    (null ids last, rows that repeat an id in stored order), or earlier in the same row. Windows are
    judged on the input. Null and empty texts have no words; words of any length count, and very long texts
    are worked on in pieces; an empty table gives an empty result; further columns, whatever their names,
    play no part. length is four times base; lengths double from base on. Equal stands for equal in two
    independent 64-bit identifiers, which go down to the words' bytes.
    """
    if length != 4 * base:
        raise ValueError("length must be four times base")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows, first = staged_texts(docs, id_col, text_col, "words")
    texts = rows.select("rid", "doc_id", "text")
    distinct = texts.join(first.select("rid"), "rid", "left_semi")

    level1 = stored(distinct.mapInArrow(_anchors(base, length), "rid long, i0 int, i1 int, p int, key long"), "words-level1")
    runs = repeated(level1, ["key"], "words-keys1").groupBy("rid").agg(F.collect_list(F.struct("i0", "i1", "p")).alias("runs"))
    level2 = stored(distinct.join(runs, "rid").mapInArrow(_doubled(base, length), "rid long, a int, b int, side int, key long, u long, v long"), "words-level2")
    dropped(level1)
    alive = repeated(level2, ["side", "key"], "words-keys2").join(rows.select("rid", "doc_id"), "rid")
    alive = stored(alive.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "a")).select("rid", "a", "b", "u", "v", "place"), "words-alive")
    dropped(level2)
    heads = stored(alive.groupBy("u", "v", F.expr("b - a").alias("span")).agg(F.min("place").alias("head")), "words-heads")
    alive = alive.withColumn("span", F.expr("b - a")).join(heads, ["u", "v", "span"])
    settled = alive.filter(F.col("place") != F.col("head")).select("rid", "a", "b")
    left = alive.filter(F.col("place") == F.col("head")).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("runs"))

    windows = stored(distinct.join(left, "rid").mapInArrow(_windows(length), f"rid long, doc_id {id_type}, i int, u long, v long"), "words-windows")
    windows = windows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "i"))
    earliest = stored(windows.groupBy("u", "v").agg(F.min("place").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("u", "v", "head"), "words-earliest")
    later = windows.join(earliest, ["u", "v"]).filter(F.col("place") != F.col("head")).select("rid", F.col("i").alias("a"), F.col("i").alias("b"))

    ranges = settled.unionByName(later).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    flags = first.select("rid", F.lit(False).alias("copy"))
    every = texts.join(flags, "rid", "left").join(ranges, "rid", "left").select("doc_id", "text", F.coalesce("copy", F.lit(True)).alias("copy"), "ranges")
    return every.mapInArrow(_kept(length), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
