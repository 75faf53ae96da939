"""Exact deduplication screened by static binary-fuse filters.

A snapshot is immutable: its distinct digests and, for each shard of them, a binary-fuse filter of about
nine bits a digest are published once to a folder and only read from then on. The digests of a batch are
grouped among themselves, then meet the filters of each snapshot. Negatives are new for certain;
positives join the snapshot's exact bucket, where the bytes of both sides are compared. The query takes
the documents before a split in id order as the snapshot, the others as the batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, placed, scratch, stored

#: Digests a filter shard is planned for; a shard and its filter fit a task many times over.
SHARD_KEYS = 200_000


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Binary-fuse filter with 8-bit fingerprints over distinct uint64 keys: seed, segment length, segments, slots.

    Slots are peeled in rounds: all keys that alone hold some slot leave together, and are set in the
    reverse order of their rounds.
    """
    n = len(keys)
    length = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    length = min(length, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-int(round(n * factor)) // length) - 2)
    for seed in range(1, 200):
        slots = fuse_slots(keys, seed, length, segments)
        size = (segments + 2) * length
        left, rounds = np.arange(n), []
        while len(left):
            flat_slots = slots[left].ravel()
            alone = np.bincount(flat_slots, minlength=size) == 1
            hit = alone[slots[left]]
            goes = hit.any(axis=1)
            if not goes.any():
                break
            rounds.append((left[goes], hit[goes].argmax(axis=1)))
            left = left[~goes]
        if not len(left):
            table, prints = np.zeros(size, np.uint8), fuse_prints(keys, seed)
            for which, own in reversed(rounds):
                s = slots[which]
                others = np.bitwise_xor.reduce(table[s], axis=1) ^ table[s[np.arange(len(s)), own]]
                table[s[np.arange(len(s)), own]] = prints[which] ^ others
            return seed, length, segments, table
        if seed % 20 == 0:
            segments += max(1, segments // 8)
    raise ValueError("no seed peels these keys; are they distinct?")


def fuse_slots(keys: np.ndarray, seed: int, length: int, segments: int) -> np.ndarray:
    h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    low = np.uint64(length - 1)
    g = mix(h)
    return np.stack([first * np.uint64(length) + (g & low), (first + np.uint64(1)) * np.uint64(length) + ((g >> np.uint64(20)) & low), (first + np.uint64(2)) * np.uint64(length) + ((g >> np.uint64(40)) & low)], axis=1).astype(np.int64)


def fuse_prints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(seed * 0x2545F491)) >> np.uint64(17)).astype(np.uint8)


def fuse_has(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(table[fuse_slots(keys, seed, length, segments)], axis=1) == fuse_prints(keys, seed)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x)[8:16] for x in digests), dtype="<u8")


def _build(group: pd.DataFrame) -> pd.DataFrame:
    seed, length, segments, table = fuse_build(np.unique(_keys(group["digest"])))
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "seed": [seed], "length": [length], "segments": [segments], "slots": [table.tobytes()]})


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(incoming):
        return pd.DataFrame({"digest": pd.Series([], dtype=object), "positive": pd.Series([], dtype=bool)})
    positive = np.zeros(len(incoming), bool)
    for f in filters.itertuples():
        positive |= fuse_has(_keys(incoming["digest"]), f.seed, f.length, f.segments, np.frombuffer(f.slots, np.uint8))
    return pd.DataFrame({"digest": incoming["digest"], "positive": positive})


@dataclass
class Snapshot:
    """Published digests: groups (digest, first, n, shard) and filters by shard; texts (kf, kr, body) are where bodies are looked up."""

    groups: DataFrame
    filters: DataFrame
    shards: int
    texts: DataFrame


def shard_of(shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def normal(text_col: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, first row (null ids last) and number of rows, of rows (doc_id, digest, kf, kr)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kf", "kr")).alias("first")
    return rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))


def publish(rows: DataFrame, folder: str) -> None:
    """Writes a snapshot of rows (doc_id, digest, kf, kr): its groups and its filters."""
    spark = rows.sparkSession
    grouped(rows).write.option("compression", "zstd").parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    shards = max(1, math.ceil(groups.count() / SHARD_KEYS))
    made = groups.select(shard_of(shards).alias("shard"), "digest").groupBy("shard").applyInPandas(_build, "shard int, seed int, length int, segments int, slots binary")
    made.withColumn("shards", F.lit(shards)).write.option("compression", "none").parquet(f"{folder}/filters")


def snapshot(texts: DataFrame, folder: str) -> Snapshot:
    """A published snapshot, read back."""
    spark = texts.sparkSession
    filters = spark.read.parquet(f"{folder}/filters")
    found = filters.select("shards").first()
    shards = found[0] if found else 1
    return Snapshot(spark.read.parquet(f"{folder}/groups").withColumn("shard", shard_of(shards)), filters.drop("shards"), shards, texts)


def known(batch: DataFrame, texts: DataFrame, old: Snapshot) -> DataFrame:
    """The groups of a batch (digest, first, n) whose text the snapshot holds: digest, old_first, new_n.

    texts (kf, kr, body) are those of the batch. The filters screen; positives join the snapshot's buckets,
    and the bytes of the first text of both sides are compared.
    """
    pieces = max(1, math.ceil(batch.count() / old.shards / SHARD_KEYS))
    salt = F.pmod(F.xxhash64("digest"), F.lit(pieces)).cast("int").alias("salt")
    incoming = batch.select(shard_of(old.shards).alias("shard"), salt, "digest").groupBy("shard", "salt")
    filters = old.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).groupBy("shard", "salt")
    positive = stored(incoming.cogroup(filters).applyInPandas(_screen, "digest binary, positive boolean").filter("positive").select("digest"), "exact-positive")
    met = old.groups.select("digest", F.col("first").alias("old_first")).join(positive.hint("merge"), "digest")
    pairs = stored(met.join(batch.select("digest", F.col("first").alias("new_first"), F.col("n").alias("new_n")).hint("merge"), "digest"), "exact-pairs")

    # planned alike at every size: the texts' side grows, the pairs' side does too
    def bodies_of(where: DataFrame, *sides: str) -> DataFrame:
        at = F.explode(F.array(*(F.struct(F.col(f"{x}.kf"), F.col(f"{x}.kr")) for x in sides))).alias("at")
        return where.join(pairs.select("digest", at).select("digest", "at.kf", "at.kr").hint("merge"), ["kf", "kr"]).select("digest", "body")

    one_table = texts is old.texts
    bodies = bodies_of(texts, "new_first", "old_first") if one_table else bodies_of(texts, "new_first").union(bodies_of(old.texts, "old_first"))
    same = bodies.groupBy("digest").agg(F.min("body").alias("one"), F.max("body").alias("other")).filter("one = other").select("digest")
    return stored(pairs.join(same, "digest").select("digest", "old_first", "new_n"), "exact-known")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the row's key kf, kr (see common.placed).

    Texts are equal when identical after each run of white space (space, tab to carriage return) became
    one space. Null texts count as empty, and empty texts are equal to each other. Of equal texts the
    row with the smallest id stays (null ids last); of rows that repeat an id, exactly one. Very long texts
    are hashed and compared whole. An empty table gives an empty result; further columns, whatever their
    names, play no part.
    """
    spark = docs.sparkSession
    texts = placed(docs, F.col(id_col).alias("doc_id"), normal(text_col).alias("body"), name="exact-texts")
    rows = stored(texts.select("doc_id", "kf", "kr", F.unhex(F.sha2("body", 256)).alias("digest")), "exact-rows")
    split = rows.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    before = F.coalesce(F.col("doc_id") <= F.lit(split), F.lit(False))

    folder = scratch(spark, "exact-snapshot")
    publish(rows.filter(before), folder)
    old, batch = snapshot(texts, folder), stored(grouped(rows.filter(~before)), "exact-batch")
    same = known(batch, texts, old)

    held = old.groups.select("digest", "first", "n").join(same.select("digest", "new_n").hint("merge"), "digest", "left").select("digest", "first", (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("size"))
    fresh = batch.join(same.select("digest").hint("merge"), "digest", "left_anti").select("digest", "first", F.col("n").alias("size"))
    members = stored(held.unionByName(fresh), "exact-members")
    return rows.join(members.hint("merge"), "digest").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        ((F.col("kf") == F.col("first.kf")) & (F.col("kr") == F.col("first.kr"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "kf",
        "kr",
    )
