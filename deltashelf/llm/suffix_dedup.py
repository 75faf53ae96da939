"""Removal of repeated byte strings by bucket refinement over anchored offsets.

Sorting all suffixes would order every byte; strings of 400 bytes are found from far fewer offsets. Each
string of that length is named by its first least q-gram (its anchor, q = 32), which depends on its bytes
alone. Anchors fall into initial buckets by q-gram; a bucket of one leaves. The rest is refined: the
strings of an anchor, told apart by how far before it they start, are put into blocks of 64, 8 and 1
starts, and a block's bucket is split by the identifiers of the buckets at the offsets that follow.
An identifier is two independent 64-bit hashes of a bucket's bytes, so offsets learn their bucket where
they lie, and only counts of buckets are shuffled. A block whose common part is alone leaves; blocks that
are equal as a whole are settled at once, and one of them stands for all in the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, between, byte_grams, byte_spans, dropped, families, flat, listed, long_and_short, repeated, signed, slices, staged_texts, stored
from .substring_dedup import _record

#: Bytes of an initial gram, and starts per block in each round of refinement.
GRAM, BLOCKS = 32, (64, 8, 1)
#: Bytes of text whose offsets are looked at at once.
PIECE = 256 << 10


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, low, body, offsets in long_and_short(batch, PIECE, length - 1):
                if len(body) < length:
                    continue
                grams = byte_grams(body, 21)
                # a string may start where it still ends inside its text
                valid = np.zeros(len(grams), bool)
                for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                    if e - s >= length:
                        valid[s : e - length + 1] = True
                i0, i1, p = families(grams, length - GRAM + 1, valid)
                own = np.searchsorted(offsets, i0, side="right") - 1
                u, v = byte_spans(body, i0, i1 + length, 22)
                yield _record("rid i0 i1 p key u v", part.column("rid").take(pa.array(own)), *((x - offsets[own] + low).astype(np.int32) for x in (i0, i1, p)), signed(grams[p]), u, v)

    return run


def blocks(i0: np.ndarray, i1: np.ndarray, p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts i0..i1 of each anchor cut by distance to it into aligned blocks: which row, first start, last start, distance of the block."""
    low, high = (p - i1) // size, (p - i0) // size
    many = high - low + 1
    row = np.repeat(np.arange(len(p)), many)
    k = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    near = k * size
    return row, np.maximum(i0[row], p[row] - near - size + 1), np.minimum(i1[row], p[row] - near), near


def _keys(body: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, near: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifier of the part that all strings of the block have in common, and of the stretch that they cover together."""
    common, _ = byte_spans(body, p - near, p - near - size + 1 + length, 23, both=False)
    return common, *byte_spans(body, a, b + length, 24)


def _first_blocks(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                row, i0, i1, p = listed(part.column("runs"), "i0", "i1", "p")
                own = offsets[row]
                k, a, b, near = blocks(i0 + own, i1 + own, p + own, size)
                key, u, v = _keys(body, a, b, (p + own)[k], near, size, length)
                start = own[k]
                yield _record("rid a b p key u v", part.column("rid").take(pa.array(row[k])), *((x - start).astype(np.int32) for x in (a, b, (p + own)[k])), key, u, v)

    return run


def _cut(length: int):
    """The bytes that the strings of each block cover, for the rounds that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                row, a, b, p = listed(part.column("runs"), "a", "b", "p")
                data = body.tobytes()
                own = offsets[row]
                cut = [data[s:e] for s, e in zip((a + own).tolist(), (b + own + length).tolist(), strict=True)]
                yield _record("rid base a b p body", part.column("rid").take(pa.array(row)), *(x.astype(np.int32) for x in (a, a, b, p)), pa.array(cut, pa.binary()))

    return run


def _next_blocks(length: int, size: int):
    """Blocks of the next size, keyed, out of the cut bytes (which start at `base`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = _flat_binary(batch.column("body"))
            for i, j in slices(offsets):
                part, cut, at = batch.slice(i, j - i), body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                base, i0, i1, p = (np.asarray(part.column(n)).astype(np.int64) for n in ("base", "a", "b", "p"))
                shift = at[:-1] - base
                k, a, b, near = blocks(i0 + shift, i1 + shift, p + shift, size)
                key, u, v = _keys(cut, a, b, (p + shift)[k], near, size, length)
                rows = pa.array(k)
                yield _record("rid base a b p key u v body", part.column("rid").take(rows), base[k].astype(np.int32), *((x - shift[k]).astype(np.int32) for x in (a, b)), p[k].astype(np.int32), key, u, v, part.column("body").take(rows) if size > 1 else pa.nulls(len(k), pa.binary()))

    return run


def _flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    body = np.frombuffer(data, np.uint8, int(at[-1])) if data is not None else np.zeros(0, np.uint8)
    return body[int(at[0]) :], at - at[0]


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b = listed(batch.column("ranges"), "a", "b")
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            body, offsets = flat(batch.column("text"))
            rows = []
            kept = []
            for k, copy in enumerate(batch.column("copy").to_pylist()):
                data = body[offsets[k] : offsets[k + 1]]
                n = len(data)
                if copy:
                    left = [] if n >= length else [(0, n)][: min(n, 1)]
                else:
                    left = list(between(a[ends[k] : ends[k + 1]], b[ends[k] : ends[k + 1]] + length, n))
                rest = b"".join(data[x:y].tobytes() for x, y in left)
                # removed runs lie before, between and after what is left
                spans = len(left) - 1 + (left[0][0] > 0) + (left[-1][1] < n) if left else int(n > 0)
                rows.append((n, n - len(rest), spans))
                kept.append((hashlib.sha256(rest).hexdigest(), rest))
            got = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[:, i]) for i in range(3)), pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return run


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Splits blocks into those that are equal to another as a whole, and those to refine: one of each kind of equal blocks, and the others."""
    span = F.expr("b - a")
    heads = stored(rows.groupBy("u", "v", span.alias("span")).agg(F.min(F.struct("rid", "a")).alias("head"), F.count(F.lit(1)).alias("n")), name)
    both = rows.withColumn("span", span).join(heads, ["u", "v", "span"])
    return both.filter("n > 1").select("rid", "a", "b"), both.filter((F.col("head.rid") == F.col("rid")) & (F.col("head.a") == F.col("a"))).drop("u", "v", "span", "head", "n", "key")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    A byte of a text's UTF-8 form goes if a string of `length` bytes that covers it also starts anywhere
    else, in the same row too; matches never cross rows and are judged on the input. Null and empty texts
    have no bytes; rows that repeat an id or a text count each; very long texts are worked on in pieces that
    overlap; an empty table gives an empty result; further columns, whatever their names, play no part.
    Equal stands for equal in 128 bits that are taken from the bytes themselves.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows, first = staged_texts(docs, id_col, text_col, "bytes")
    texts = rows.select("rid", "doc_id", "text")
    distinct = texts.join(first.select("rid"), "rid", "left_semi")

    anchors = stored(distinct.mapInArrow(_anchors(length), "rid long, i0 int, i1 int, p int, key long, u long, v long"), "bytes-anchors")
    alive = stored(repeated(anchors, ["key"], "bytes-grams").withColumnsRenamed({"i0": "a", "i1": "b"}), "bytes-alive")
    dropped(anchors)
    settled, left = _settle(alive, "bytes-heads")
    done = [stored(settled, "bytes-done")]

    runs = left.groupBy("rid").agg(F.collect_list(F.struct(F.col("a").alias("i0"), F.col("b").alias("i1"), "p")).alias("runs"))
    found = stored(distinct.join(runs, "rid").mapInArrow(_first_blocks(length, BLOCKS[0]), "rid long, a int, b int, p int, key long, u long, v long"), "bytes-blocks")
    alive = stored(repeated(found, ["key"], "bytes-keys"), "bytes-alive")
    settled, left = _settle(alive, "bytes-heads")
    done.append(stored(settled, "bytes-done"))

    runs = left.groupBy("rid").agg(F.collect_list(F.struct("a", "b", "p")).alias("runs"))
    cut = distinct.join(runs, "rid").mapInArrow(_cut(length), "rid long, base int, a int, b int, p int, body binary")
    for size in BLOCKS[1:]:
        found = stored(cut.mapInArrow(_next_blocks(length, size), "rid long, base int, a int, b int, p int, key long, u long, v long, body binary"), "bytes-blocks")
        # a block of one start is its string, so all 128 bits tell its bucket
        alive = stored(repeated(found, ["key"] if size > 1 else ["u", "v"], "bytes-keys"), "bytes-alive")
        if size == 1:
            done.append(alive.select("rid", "a", "b"))
        else:
            settled, cut = _settle(alive, "bytes-heads")
            done.append(stored(settled, "bytes-done"))

    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    ranges = every.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    # a text that other rows repeat is a repeat as a whole
    copies = first.select("rid", (F.col("copies") > 1).alias("copy"))
    out = texts.join(copies, "rid", "left").join(ranges, "rid", "left").select("doc_id", "text", F.coalesce("copy", F.lit(True)).alias("copy"), "ranges")
    return out.mapInArrow(_kept(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
