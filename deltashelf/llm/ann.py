"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its nearest pivots in order of nearness and posted in the inverted files of
the first few of them; the files hold the whole table. A query visits the files of its nearest pivots, each
a group of its own, however many tasks there are: what stands there is ranked by the footrule distance
between the two orders, what lies within the query's bound is scored exactly, and the file's k best leave
it. The bound is the footrule distance within which a fixed share of a sample of the index lies. Files and
the queries that visit one are split where they are large, so that a dense cluster isn't one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Least and most pivots; between them their number is the root of the number of vectors. They are taken by hash.
LEAST_PIVOTS, MOST_PIVOTS = 256, 1024
#: Cosine from which two vectors are too close to be pivots both, while there are others.
ALIKE = 0.8
#: How many nearest pivots make a vector's order, and a query's.
ORDER, ASKED = 128, 64
#: In how many files a vector is posted; the share of all files that a query visits, and the least number of them.
POSTED, VISITED, LEAST_VISITED = 4, 3 / 16, 48
#: Share of the vectors that lie within a query's footrule bound, and the least number of them.
SCORED, LEAST_SCORED = 0.05, 256
#: What is nearer than this share of the median distance, as in a dense cluster whose orders are much alike, lies within the bound too.
CLOSE = 0.6
#: Postings and queries of one group at most, about.
POSTINGS, QUERIES = 16384, 16384


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def orders(vectors: np.ndarray, pivots: np.ndarray, many: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first; ties to the smaller number."""
    return np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :many].astype(np.int16)


def table_of(column) -> np.ndarray:
    """The vectors of an Arrow column, one a row, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def apart(rows: np.ndarray, many: int) -> np.ndarray:
    """The first `many` unit rows that are not close to one taken before, so that a dense cluster doesn't take most pivots; then any."""
    taken: list[int] = []
    for i in range(len(rows)):
        if len(taken) == many:
            break
        if not taken or float((rows[taken] @ rows[i]).max()) < ALIKE:
            taken.append(i)
    rest = [i for i in range(len(rows)) if i not in set(taken)]
    return rows[[*taken, *rest[: many - len(taken)]]]


def places(order: np.ndarray, pivots: int) -> np.ndarray:
    """Place of each pivot in each order; a pivot that is missing counts as placed last. One row per pivot."""
    out = np.full((len(order), pivots), order.shape[1], np.int16)
    np.put_along_axis(out, order.astype(np.int64), np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return np.ascontiguousarray(out.T)


def footrule(query: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sum over the query's pivots of the difference in place, for each of the orders."""
    steps = np.arange(len(query), dtype=np.int16)[:, None]
    return np.abs(place[query] - steps).sum(axis=0, dtype=np.int32)


def bound(far: np.ndarray, vectors: int) -> int:
    """The footrule distance up to which vectors are scored, by the distances of a sample of the index."""
    share = min(1.0, max(SCORED, LEAST_SCORED / vectors))
    return int(max(np.sort(far)[math.ceil(share * len(far)) - 1], CLOSE * np.median(far)))


def visits(pivots: int) -> int:
    return min(pivots, max(LEAST_VISITED, math.ceil(VISITED * pivots)))


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and vectors that can be compared; floats stay floats until they are computed with."""
    v = F.col(vector_col)
    kind = table.schema[vector_col].dataType
    v = v if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.coalesce(v.isNotNull() & fine, F.lit(False)))


def posted(rows: DataFrame, files: DataFrame, own: str, own_parts: str, other_parts: str) -> DataFrame:
    """A row per file of `pivots`; a row stands in one of its own side's parts of a file, by hash of `own`, and meets all parts of the other side."""
    at = rows.withColumn("pivot", F.explode("pivots")).drop("pivots").join(F.broadcast(files), "pivot")  # at most MOST_PIVOTS files
    part = F.pmod(F.xxhash64(own), F.col(own_parts)).cast("int").alias(own_parts)
    every = F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)).alias(other_parts)
    return at.select(*rows.drop("pivots").columns, "pivot", part, every)


def file_parts(indexed: DataFrame, asked: DataFrame) -> DataFrame:
    """pivot, and the parts that its postings and its queries are split into."""
    count = lambda rows, name: rows.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.count("*").alias(name))
    both = count(indexed, "n_posted").join(count(asked, "n_asked"), "pivot")
    return stored(both.select("pivot", F.ceil(F.col("n_posted") / POSTINGS).cast("int").alias("split"), F.ceil(F.col("n_asked") / QUERIES).cast("int").alias("lot")), "ann-files")


def represented(rows: DataFrame, length: int, shared, many: int, sample=None, vectors: int = 0) -> DataFrame:
    """Rows with their order, the `many` pivots whose files they go to, and for queries their footrule bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                full = orders(table_of(b.column("vector")), shared.value, max(length, many))
                out = {n: b.column(n) for n in b.schema.names}
                out["order"] = pa.array([o.tobytes() for o in np.ascontiguousarray(full[:, :length])], pa.binary())
                out["pivots"] = pa.array(list(full[:, :many].astype(np.int32)), pa.list_(pa.int32()))
                if sample is not None:
                    out["within"] = pa.array([bound(footrule(o, sample.value), vectors) for o in full[:, :length].astype(np.int64)], pa.int32())
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([*rows.schema.fields, T.StructField("order", T.BinaryType()), T.StructField("pivots", T.ArrayType(T.IntegerType())), *([T.StructField("within", T.IntegerType())] if sample is not None else [])])
    return rows.mapInArrow(run, schema)


def nearest(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other vectors found for each query row, by cosine.

    Null ids, vectors that are null, zero or hold null or non-finite components take no part. Equal
    vectors are indexed once, under all their ids: of a group only its k + 1 smallest ids can be results.
    Fewer than k other vectors give that many rows, ties go to smaller ids, a query id that repeats counts
    once, an empty table gives an empty result; further columns, whatever their names, play no part.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col).filter("vec_id is not null")
    # equal vectors: one posting with the k + 1 smallest ids (sorted, merged pairwise, so bounded)
    salted = rows.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    distinct = stored(salted.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")).withColumn("key", F.col("ids")[0]), "ann-distinct")
    queries = stored(rows.filter(is_query).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id"]), "ann-queries")

    n = distinct.count()
    many = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)))
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(2 * many).select("vector").collect()  # at most 2 * MOST_PIVOTS rows
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sampled = np.array([r[0] for r in sample], np.float64)
    chosen = apart(unit(sampled), many)
    pivot_count = len(chosen)
    length, asks = min(ORDER, pivot_count), min(ASKED, pivot_count)
    shared = spark.sparkContext.broadcast(chosen)  # at most MOST_PIVOTS vectors
    spread = spark.sparkContext.broadcast(places(orders(sampled, chosen, length), pivot_count))  # at most 2 * MOST_PIVOTS orders

    indexed = stored(represented(distinct, length, shared, min(POSTED, pivot_count)), "ann-index")
    asked = stored(represented(queries, asks, shared, visits(pivot_count), spread, n), "ann-asked")
    files = file_parts(indexed, asked)

    def visit(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            vectors = np.stack(v["vector"].to_numpy()).astype(np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            place = places(np.frombuffer(b"".join(v["order"]), np.int16).reshape(len(v), length), pivot_count)
            ids = v["ids"].to_numpy()
            for query_id, vector, own, within in zip(q["query_id"], q["vector"], q["order"], q["within"], strict=True):
                far = footrule(np.frombuffer(own, np.int16).astype(np.int64), place)
                best = np.flatnonzero(far <= within)
                if len(best) <= k:
                    # a file gives k all the same, so that no query goes without
                    best = np.argsort(far, kind="stable")[: k + 1]
                x = np.asarray(vector, np.float64)
                size = np.sqrt((x * x).sum())
                score = (vectors[best] @ x) / (norms[best] * size)
                top = best[np.argpartition(-score, k)[: k + 1]] if len(best) > k + 1 else best
                # the scores that count are taken one by one, so that equal vectors score alike everywhere
                near = [(-float((vectors[i] * x).sum() / (norms[i] * size)), int(j)) for i in top for j in ids[i] if j != query_id]
                out += [(query_id, j, -far_off) for far_off, j in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    by = ("pivot", "split", "lot")
    left = posted(asked, files, "query_id", "lot", "split").groupBy(*by)
    right = posted(indexed, files, "key", "split", "lot").select("vector", "ids", "order", *by).groupBy(*by)
    # a vector that stands in several of the files is found in each
    found = left.cogroup(right).applyInPandas(visit, "query_id long, vec_id long, score double").repartition("query_id").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
