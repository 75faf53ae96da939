"""Best-fit-decreasing packing of token sequences into windows of one size.

Documents are tokenised where they lie and cut into full windows and a rest. Which rests share a window
depends on their lengths alone, so the plan is made from the histogram of rest lengths (one counter for
each length below the window size, whatever the corpus): windows that are filled alike are one run of
window numbers, and a segment tree over remaining capacities finds the tightest run that still fits.
The k-th rest of each length then finds its place in the plan by binary search, in parallel.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: White space from which on a run counts as long, in characters.
LONG_RUN = 2000
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


class Capacities:
    """Segment tree over remaining capacities 0..size: which of them have an open window; finds the least that fits."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.some = bytearray(2 * self.width)

    def put(self, capacity: int, open_: bool) -> None:
        i = self.width + capacity
        self.some[i] = open_
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The least open capacity >= least, or -1."""
        i = self.width + least
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts[length] items: rows (length, first item, items a window, first window, offset), and the number of windows.

    A row says that the items of this length from `first item` on go to the windows from `first window`
    on, so many to a window, one behind the other from `offset`.
    """
    tree, open_, rows, windows = Capacities(size), {}, [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        done, total = 0, counts[length]
        while done < total:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, per = size, size // length
                first, many = windows, -(-(total - done) // per)
                windows += many
            else:
                first, many = open_[capacity].pop()
                if not open_[capacity]:
                    tree.put(capacity, False)
                per = capacity // length
            whole = min(many, (total - done) // per)
            rest = 0 if whole == many else total - done - whole * per
            rows.append((length, done, per, first, size - capacity))
            done += whole * per + rest
            for start, n, used in ((first, whole, per), (first + whole, 1 if rest else 0, rest), (first + whole + bool(rest), many - whole - bool(rest), 0)):
                left = capacity - used * length
                if n and left:
                    open_.setdefault(left, []).append((start, n))
                    tree.put(left, True)
    return rows, windows


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level vocabulary of a tokenizers file as a tiktoken encoding: same merges, same ids, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the bijection between bytes and printable characters of byte-level vocabularies
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_of(text: str, tokenizer: str) -> list[int]:
    """Token ids. Long runs of white space, over which the fast encoder's pattern recurses, are left to the library itself."""
    if len(text) > LONG_RUN and LONG_SPACE.search(text):
        return library(tokenizer).encode(text, add_special_tokens=False).ids
    enc = encoder(tokenizer)
    return enc.encode(text, allowed_special=set(enc.special_tokens_set)) if "<|" in text else enc.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows and rests of each row: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*ids_of(text or "", tokenizer), end_id], "<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    who.append(i)
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            got = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *(pa.array(got[:, k]) for k in range(4))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty, and an empty one still has its end token; repeated rows are packed each
    for itself; very long texts are tokenised whole; an empty table gives an empty result; further columns,
    whatever their names, play no part. Ties between equal lengths go by stored order. Windows are numbered without gaps, the packed ones before the full ones.
    """
    spark = docs.sparkSession
    # cut: the place of a piece among those of its length, by partition of the stored table and place there
    rows = stored(pieces(docs, tokenizer, size, end_id, id_col, text_col).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    per_part = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    rest = {x: n for x, n in counts.items() if x < size}
    steps, windows = plan(rest, size)

    # numbers of the pieces of each length before each partition: partitions x lengths rows, ranked by length
    from pyspark.sql import Window

    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    order = np.array(steps, np.int64).reshape(-1, 5)
    by_length = {int(x): order[order[:, 0] == x] for x in np.unique(order[:, 0])}
    shared = spark.sparkContext.broadcast(by_length)  # at most size**2 rows, whatever the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            sequence, offset = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
            full = length == size
            sequence[full] = windows + rank[full]
            for x in np.unique(length[~full]):
                own, t = length == x, table[int(x)]
                k = np.searchsorted(t[:, 1], rank[own], side="right") - 1
                behind = rank[own] - t[k, 1]
                sequence[own] = t[k, 3] + behind // t[k, 2]
                offset[own] = t[k, 4] + behind % t[k, 2] * x
            keep = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # a salt by place in the partition keeps one length from being one task
    inside = Window.partitionBy("length", "part").orderBy("row")
    ranked = rows.withColumn("k", F.row_number().over(inside) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("k") + F.col("before"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
