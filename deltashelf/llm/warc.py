"""WARC archives written index first, and read back by coalesced byte ranges.

Each task writes its records, each a gzip member of its own, to one archive in the shared folder, and
returns an index row per record: file, offset, length, URL, digest. Readers sort the index rows of the
records they want within a file, join neighbours into ranges, and read each range at once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Least payload bytes for which later copies become revisits.
LEAST_REVISIT = 100
#: Ranges are joined over gaps up to this, and up to this size.
MOST_GAP, MOST_RANGE = 64 << 10, 4 << 20
#: Bytes of compressed records that one reading task is given, about.
READ_SHARE = 32 << 20

INDEX = "page_id long, record_type string, refers_to long, file string, offset long, length long, url string, digest string"


def plan_records(pages: DataFrame) -> DataFrame:
    """The rows of pages (row_key, page_id, url, html) with digest, payload bytes, record_type and refers_to.

    Of equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id is the response
    (null ids last; of repeated ids one), the others revisit it.
    """
    hashed = pages.select("row_key", "page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    first = hashed.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    return stored(hashed.join(stored(first, "warc-first"), "digest", "left").select("row_key", "digest", "payload_bytes", F.when(F.col("first.row_key") != F.col("row_key"), F.col("first.page_id")).alias("refers_to"), F.when(F.col("first.row_key") != F.col("row_key"), "revisit").otherwise("response").alias("record_type"), F.when(F.coalesce(F.col("first.row_key") != F.col("row_key"), F.lit(True)), F.col("row_key")).alias("own_key")), "warc-plan")


def record_id(digest: str, row_key: int | None) -> str:
    """URN of a record: of the response of a digest that others revisit by the digest alone, of others by their row too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest if row_key is None else f'{digest}|{row_key}')}>"


def record(url: str, body: bytes, digest: str, kind: str, page_id: int | None, refers_to: int | None, row_key: int | None) -> bytes:
    """One gzip member that holds a WARC record; row_key is None for the response that others revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if kind == "revisit" else http + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(digest, row_key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(digest, None)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}", f"X-Payload-Length: {len(body)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = zlib.decompressobj(31).decompress(data)
    end = raw.index(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


def write(pages: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns the index. A task that is run again writes a file of a new name; only what the index names counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        at = 0
        for b in batches:
            if out is None:
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            rows = []
            for page_id, url, html, digest, kind, refers, key in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "record_type", "refers_to", "own_key")), strict=True):
                data = record(url or "", html, digest, kind, page_id, refers, key)
                out.write(data)
                rows.append((at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("record_type"), b.column("refers_to"), pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), b.column("url"), b.column("digest")], [x.split(" ")[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    joined = pages.join(records, "row_key").select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "record_type", "refers_to", "own_key")
    return joined.mapInArrow(run, INDEX)


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, numbers of the rows inside) of joined ranges; rows are (offset, length) by offset."""
    start = end = 0
    inside: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if inside and (offset - end > MOST_GAP or offset + length - start > MOST_RANGE):
            yield start, end - start, inside
            inside = []
        if not inside:
            start = end = offset
        end = max(end, offset + length)
        inside.append(i)
    if inside:
        yield start, end - start, inside


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest (of the payload that was read; a revisit's from its headers) of the selected index rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fs, base = pafs.FileSystem.from_uri(folder)
        group = group.sort_values("offset", kind="stable")
        out = []
        with fs.open_input_file(f"{base}/{group['file'].iloc[0]}") as f:
            spots = list(zip(group["offset"], group["length"], strict=True))
            for start, length, inside in ranges(spots):
                f.seek(start)
                data = f.read(length)
                for i in inside:
                    headers, payload = parse(data[spots[i][0] - start : spots[i][0] - start + spots[i][1]])
                    kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "revisit":
                        size, digest = int(headers["X-Payload-Length"]), stated
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"record at {spots[i][0]} of {group['file'].iloc[0]}: digest doesn't match")
                    number = headers["X-Page-Id"].strip()
                    refers = headers.get("X-Refers-To-Page-Id", "").strip()
                    out.append((int(number) if number else None, size, digest, kind, int(refers) if refers else None))
        frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    # as many tasks as there are bytes to read; the index rows alone would look like work for one
    total = index.agg(F.sum("length")).first()[0] or 0
    share = F.floor(F.col("offset") / READ_SHARE).alias("share")
    spread = index.select("file", share, "offset", "length").repartition(max(1, -(-total // READ_SHARE), index.sparkSession.sparkContext.defaultParallelism), "file", "share")
    return spread.groupBy("file", "share").applyInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and reads all back; one row per row of pages.

    A null html is an empty payload; payloads under LEAST_REVISIT bytes are all responses; very long ones
    are written and digested whole; an empty table gives no archive and an empty result; repeated rows
    each get a record; further columns play no part.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    folder = folder or scratch(spark, "warc")
    rows = stored(rows.withColumn("row_key", F.monotonically_increasing_id()), "warc-rows")
    index = stored(write(rows, plan_records(rows), folder), "warc-index")
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
