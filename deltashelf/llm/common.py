"""Shared pieces of the training-data operators: scratch tables, row keys and flat text buffers."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it (fixed values).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: Bytes of text that one numpy step works on; temporaries stay at a few dozen times this.
SLICE_BYTES = 2 << 20
#: Bytes, words or grams handled at once inside one long text.
STEP = 1 << 20
#: Words up to this many bytes are told apart by their bytes, longer ones by a 128-bit digest.
SHORT_WORD = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables once all that was made of them is stored itself."""
    for t in tables:
        jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that are over: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = True) -> DataFrame:
    """df written as a table bucketed by key in the shared folder, so that later joins on key leave it in place.

    Rows are dealt out by key first, so that a bucket is one file; few and large ones can go as they are.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"llm_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, key) if dealt else df).write.option("compression", "zstd").option("path", scratch(spark, name)).bucketBy(n, key).format("parquet").saveAsTable(table)
    release(spark)
    return spark.table(table)


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and len + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(at))
        if (sizes != np.diff(at)).any():
            return flat(column.fill_null(""))
    body = np.frombuffer(data, dtype=np.uint8, count=int(at[-1])) if data is not None else np.zeros(0, np.uint8)
    return body[int(at[0]) :], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Rolling:
    """Polynomial fingerprints modulo 2**64 of any stretch of a sequence, by prefix sums.

    The multiplier is odd, so its powers can be undone and equal stretches have equal fingerprints
    wherever they stand. Two instances of different seeds give 128 bits.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.undo = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            for name, x in (("powers", self.base), ("undo", self.inverse)):
                steps = np.full(n, np.uint64(x))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums over uint64 symbols (or bytes, put through the table); one longer than the input."""
        values = self.table[symbols] if symbols.dtype == np.uint8 else symbols
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the stretches [start, end), well mixed."""
        return mix((sums[end] - sums[start]) * self.undo[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def constants(seed: int, many: int) -> list[np.uint64]:
    """Odd random multipliers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [np.uint64(int(x) * 2 + 1) for x in rng.integers(1, 2**63, many, dtype=np.uint64)]


def words_at(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; `body` goes on for eight bytes after the last place."""
    eights = np.ndarray((len(body) - 7, 1), "V8", body, 0, (body.strides[0], 8)) if body.flags.c_contiguous else np.lib.stride_tricks.as_strided(body, (len(body) - 7, 8), (1, 1))
    return np.ascontiguousarray(eights[at]).view("<u8")[:, 0]


def hashed_words(body: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word of all rows, and the number of each row's first word (len + 1).

    They are taken from the word's bytes themselves up to SHORT_WORD bytes, and from its BLAKE2 digest beyond.
    """
    k = constants(seed, 6)
    starts, ends, at = words_of(body, offsets)
    one, two = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), STEP):
        s, e = starts[i : i + STEP], ends[i : i + STEP]
        if not len(s):
            break
        first = int(s[0])
        piece = np.concatenate([body[first : int(e[-1])], np.zeros(16, np.uint8)])
        size = e - s
        halves = []
        for shift in (0, 8):
            left = np.clip(size - shift, 0, 8)
            # places past a short word's end are masked away, so they only have to exist
            got = words_at(piece, np.minimum(s - first + shift, len(piece) - 8))
            halves.append(np.where(left > 0, got & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.maximum(left, 1)) * 8).astype(np.uint64)), np.uint64(0)))
        long = np.flatnonzero(size > SHORT_WORD)
        if len(long):
            raw = body.data if body.flags.c_contiguous else body.tobytes()
            digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True))
            pair = np.frombuffer(digests, "<u8").reshape(-1, 2)
            halves[0][long], halves[1][long] = pair[:, 0], pair[:, 1]
        n = size.astype(np.uint64)
        one[i : i + STEP] = mix(mix(halves[0] * k[0] + n) + halves[1] * k[1])
        two[i : i + STEP] = mix(mix(halves[1] * k[2] + n * k[3]) + halves[0] * k[4])
    return one, two, at


def spans(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit identifiers of the stretches [start, end) of symbols, equal for equal stretches wherever they stand.

    Identifiers of 1, 2, 4, ... symbols are made of two of the level before and mixed at each level; a stretch
    is named by the two of the largest level that cover it, and its length.
    """
    k = constants(seed, 64)
    size = np.asarray(end) - start
    out = np.zeros(len(size), np.uint64)
    if not len(size):
        return out
    level = np.frexp(size.astype(np.float64))[1] - 1
    current = symbols
    for turn in range(int(level.max()) + 1):
        if turn:
            half = 1 << (turn - 1)
            current = mix(current[:-half] * k[turn] + current[half:])
        at = np.flatnonzero(level == turn) if turn < level.max() or level.min() < turn else slice(None)
        a, b = start[at], end[at] - (1 << turn)
        out[at] = mix(mix(current[a] * k[60] + current[b]) + size[at].astype(np.uint64) * k[61])
    return out


def between(start: np.ndarray, end: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """The stretches of 0..n that none of the stretches [start, end) covers."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else np.zeros(0, np.int64)
    at = 0
    for x, y in zip(start[first].tolist(), end[np.r_[first[1:] - 1, len(end) - 1]].tolist() if len(first) else [], strict=True):
        if x > at:
            yield at, x
        at = y
    if at < n:
        yield at, n


def byte_grams(body: np.ndarray, seed: int) -> np.ndarray:
    """Identifiers of the 32 bytes from each place on: of eight bytes, then twice of the identifiers there and half as far on."""
    k = constants(seed, 4)
    n = len(body) - 7
    grams = mix(np.ascontiguousarray(np.lib.stride_tricks.as_strided(body, (n, 8), (1, 1))).view("<u8")[:, 0] * k[0] + k[1])
    for turn, half in enumerate((8, 16)):
        grams = mix(grams[:-half] * k[2 + turn] + grams[half:])
    return grams


def byte_spans(body: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two independent 64-bit identifiers of each stretch [start, end) of at least eight bytes, taken from its bytes."""
    k = constants(seed, 6)
    size = (end - start).astype(np.uint64)
    u, v = mix(size * k[0]), mix(size * k[1])
    high = np.uint64(32)
    least = int(size.min()) if len(size) else 0
    for step in range(0, int(size.max()) if len(size) else 0, 8):
        at = slice(None) if step < least else np.flatnonzero(step < size)
        got = words_at(body, np.minimum(start[at] + step, end[at] - 8))
        x = (u[at] ^ got) * k[2]
        u[at] = x ^ (x >> high)
        if both:
            x = (v[at] + got) * k[3]
            v[at] = x ^ (x >> high)
    return signed(mix(u)), signed(mix(v)) if both else None


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by running minima of blocks from both sides."""
    n = len(values)
    if width == 1 or n < width:
        return values[: max(0, n - width + 1)].copy()
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def families(grams: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts that share their least gram.

    grams[p] is the fingerprint of the gram at p; a window that starts at i holds the grams
    i..i + width - 1, and its anchor is the first least one: that depends on the window's content
    alone, so equal windows have equal anchors at equal places. Returns first start, last start and
    anchor of each run of valid starts with one anchor.
    """
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keyed, width) & low).astype(np.int64)
    starts = np.flatnonzero(valid[: len(anchor)])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    anchor = anchor[starts]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return starts[new], starts[last], anchor[new]


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+ of all rows, and each row's first word's number (len + 1)."""
    starts, ends = [], []
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(body))]
    for low in range(0, len(body), STEP):
        high = min(low + STEP, len(body))
        solid = ~IS_SPACE[body[max(low - 1, 0) : high + 1]]
        own = solid[1 if low else 0 :][: high - low]
        before, after = np.zeros(high - low, bool), np.zeros(high - low, bool)
        before[0 if low else 1 :] = solid[: high - low - (0 if low else 1)]
        rest = solid[2 if low else 1 :][: high - low]
        after[: len(rest)] = rest
        inside = cuts[(cuts >= low) & (cuts <= high)]
        before[inside[inside < high] - low] = False
        after[inside[inside > low] - 1 - low] = False
        starts.append(np.flatnonzero(own & ~before) + low)
        ends.append(np.flatnonzero(own & ~after) + 1 + low)
    starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    return starts, ends, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(df: DataFrame) -> list:
    meta = df.metadataColumn("_metadata")
    return [F.xxhash64(meta.getField("file_path")).alias("kf"), meta.getField("row_index").alias("kr")]


def filed(docs: DataFrame, name: str = "filed") -> DataFrame:
    """docs if its rows come from files in which they have a place, else docs stored."""
    try:
        docs.select(*_keys(docs)).schema  # noqa: B018  analysed here
        return docs
    except AnalysisException:
        return stored(docs, name)


def placed(docs: DataFrame, *columns, name: str = "placed") -> DataFrame:
    """The columns and a key of each row, (kf, kr): its file and its place there, which a second reading gives again.

    Rows that don't come from files are stored first.
    """
    try:
        out = docs.select(*columns, *_keys(docs))
        out.schema  # noqa: B018  analysed here
        return out
    except AnalysisException:
        kept = stored(docs.select(*columns), name)
        return kept.select("*", *_keys(kept))


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A key for each row, null or repeated ids included; stable only once the result has been stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def batches_of(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in stretches of rows of about `most` text bytes, each with its flat bytes and offsets."""
    body, offsets = flat(batch.column(text))
    for i, j in slices(offsets, most):
        yield batch.slice(i, j - i), body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def long_and_short(batch: pa.RecordBatch, most: int, overlap: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """As batches_of, but a text longer than `most` bytes comes in pieces that overlap: rows, place of the piece in its text, bytes, offsets."""
    for part, body, offsets in batches_of(batch, text, most):
        if part.num_rows == 1 and len(body) > most + overlap:
            for low in range(0, len(body) - overlap, most):
                piece = body[low : low + most + overlap]
                yield part, low, piece, np.array([0, len(piece)])
        else:
            yield part, 0, body, offsets


def listed(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Row numbers and fields (long) of a column of lists of structs, flattened; a null list counts as empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(np.asarray(values.field(f)).astype(np.int64) for f in fields)


def repeated(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The rows whose key stands in two rows at least. The keys are stored first, so that Spark can split a hot key's rows in the join."""
    keys = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), name)
    return rows.join(keys, key, "left_semi")


def staged_texts(docs: DataFrame, id_col: str, text_col: str, name: str, more: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The texts as a table bucketed by a row key `rid` (rid, doc_id, text, digest), and of each distinct text the first row.

    The second table has rid (of the row of the smallest doc_id, null ids last), how many rows there are, and the digest.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    rows = bucketed(with_row_key(rows, "rid").withColumn("digest", F.unhex(F.sha2("text", 256))), "rid", name)
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows, stored(first.select(F.col("first.rid").alias("rid"), "copies", "digest"), f"{name}-first")
