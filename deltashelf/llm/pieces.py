"""SentencePiece encoding by a table of distinct chunks, and decoding.

Where no piece holds a white-space marker behind another character, a normalised text falls into chunks (a run
of markers and what follows it) that are segmented apart from each other. So each distinct chunk is segmented
once, and its ids are joined back by position: texts are taken in blocks, a block keeps the numbers of its
chunks in order and sends each of its distinct chunks once to the bucket of the chunk's hash; the bucket
segments what it gets and answers each block with ids in the order of the block's numbers.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed

#: The white-space marker (fixed value).
MARK = "▁"
CHUNKS = re.compile(" +[^ ]*")
#: Text of a block, in characters; a longer text is a block of its own.
BLOCK = 24 << 20
#: What a row counts besides its text, so that empty ones fill blocks too.
PER_ROW = 16
#: Chunks whose ids are turned to text at once.
SLICE = 1 << 16
#: Buckets for each shuffle partition, and their bounds.
BUCKETS, FEWEST, MOST = 4, 64, 8192
#: Distinct chunks that a bucket remembers at once; beyond it forgets them all and may segment some again.
REMEMBERED = 1 << 20


class Pieces:
    """A SentencePiece model whose pieces don't cross white-space markers."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        n = spec.normalizer_spec
        if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are and put one marker before them can be split into chunks")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback can be split into chunks")
        if any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("pieces of the user's own are matched before chunks")
        if any(MARK in p.piece.lstrip(MARK) for p in spec.pieces):
            raise ValueError("pieces cross white-space markers")
        self.mark = self.model.piece_to_id(MARK)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; the library puts a marker before what it gets, so the chunk's first one is left to it."""
        got = self.model.encode([c[1:] for c in chunks], num_threads=1)
        return [x or [self.mark] for x in got]

    def texts(self, ids: list[list[int]]) -> list[str]:
        """The text of each chunk's ids within a text; the library takes one marker off the start of what it decodes."""
        return [" " + x for x in self.model.decode(ids, num_threads=1)]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, markers as spaces; none if it is empty."""
    return CHUNKS.findall(" " + text.replace(MARK, " ")) if text else []


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays end to end behind their sizes, compressed."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(raw), *map(len, raw)], "<u8").tobytes() + b"".join(raw))


def _unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u8", n, 8)).tolist()
    at = 8 * (n + 1)
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends)]


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers as planes of bytes, the low ones first, which compress better apart."""
    numbers = numbers.astype(np.uint64)
    many = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return [((numbers >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(many)]


def _numbers(planes: list[bytes]) -> np.ndarray:
    return sum((np.frombuffer(p, np.uint8).astype(np.int64) << 8 * i for i, p in enumerate(planes)), np.int64(0))


def _blocks(buckets: int, id_type: pa.DataType):
    """Rows of a block: bucket -1 with the ids of its rows and the numbers of their chunks, and its distinct chunks by bucket."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(id_type)), ("pack", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = itertools.count(TaskContext.get().partitionId() << 24)

        def ended(ids: list, sizes: list[int], parts: list[np.ndarray], known: dict[str, int]) -> pa.RecordBatch:
            block = next(blocks)
            raw = [c.encode("utf-8", "surrogatepass") for c in known]
            codes = np.concatenate([np.zeros(0, np.uint32), *parts])
            bucket = np.fromiter((zlib.crc32(c) % buckets for c in raw), np.int64, len(raw))
            # in a bucket the frequent first and rare ones by their letters: small numbers and like neighbours compress well
            letters = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
            order = letters[np.lexsort((-np.bincount(codes, minlength=len(raw))[letters], bucket[letters]))]
            names, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            number = np.empty(len(order), np.int64)
            number[order] = (np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))) * buckets + bucket[order]
            packs = [_packed(np.array(sizes, "<u8"), *_planes(number[codes]))]
            for a, b in zip(first.tolist(), ends):
                own = [raw[i] for i in order[a:b].tolist()]
                packs.append(_packed(np.fromiter(map(len, own), "<u4", len(own)), b"".join(own)))
            n = len(packs)
            lists = pa.array([ids, *[None] * (n - 1)], pa.list_(id_type))
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([-1, *names.tolist()], pa.int32()), lists, pa.array(packs, pa.binary())], schema=schema)

        ids, sizes, parts, known, size = [], [], [], defaultdict(itertools.count().__next__), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if size and size + len(text) > BLOCK:
                    yield ended(ids, sizes, parts, known)
                    ids, sizes, parts, known, size = [], [], [], defaultdict(itertools.count().__next__), 0
                found = chunks_of(text)
                ids.append(i)
                sizes.append(len(found))
                if found:
                    parts.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                size += len(text) + PER_ROW
        if ids:
            yield ended(ids, sizes, parts, known)

    return run


def _segmented(path: str):
    """Each distinct chunk of a bucket is segmented once; every block gets its ids in its own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, current = pieces(path), {}, None
        for batch in batches:
            packs = []
            for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack")):
                if bucket != current or len(known) > REMEMBERED:
                    known, current = {}, bucket
                sizes, raw = _unpacked(pack.as_py())
                ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
                chunks = [raw[a:b] for a, b in zip([0, *ends], ends)]
                new = [c for c in chunks if c not in known]
                for c, ids in zip(new, model.segment([c.decode("utf-8", "surrogatepass") for c in new])):
                    known[c] = np.array(ids, "<u4").tobytes()
                got = [known[c] for c in chunks]
                packs.append(_packed(np.fromiter(map(len, got), "<u4", len(got)) // 4, *_planes(np.frombuffer(b"".join(got), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(packs, pa.binary())], ["block", "bucket", "pack"])

    return run


def _joined(path: str, buckets: int, with_ids: bool):
    """Ids and decoded texts of a block's rows, from the numbers of their chunks and the answers of all its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, *planes = _unpacked(batch.column("pack")[k].as_py())
                sizes, codes = np.frombuffer(sizes, "<u8").astype(np.int64), _numbers(planes)
                many, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                starts, total = np.full(buckets, -1, np.int64), 0
                for answer in sorted(batch.column("answers")[k].as_py() or [], key=lambda x: x["bucket"]):
                    counts, *planes = _unpacked(answer["pack"])
                    many.append(np.frombuffer(counts, "<u4").astype(np.int64))
                    flat.append(_numbers(planes))
                    starts[answer["bucket"]] = total
                    total += len(many[-1])
                if len(codes) and int(starts[codes % buckets].min()) < 0:
                    raise ValueError("a block lacks answers")
                codes = starts[codes % buckets] + codes // buckets
                many, flat = np.concatenate(many), np.concatenate(flat)
                ends = np.cumsum(many)
                starts, said, text = ends - many, [], []
                for low in range(0, len(many), SLICE):
                    own = flat[starts[low] : ends[min(low + SLICE, len(many)) - 1]].tolist()
                    cuts = (ends[low : low + SLICE] - starts[low]).tolist()
                    chunks = [own[a:b] for a, b in zip([0, *cuts], cuts)]
                    said += [",".join(map(str, c)) for c in chunks]
                    text += model.texts(chunks)
                n, sha, sha2, all_ids, texts = [], [], [], [], []
                at = 0
                for size in sizes.tolist():
                    own = codes[at : at + size]
                    at += size
                    n.append(int(many[own].sum()))
                    own = own.tolist()
                    sha.append(hashlib.sha256(",".join([said[c] for c in own]).encode()).hexdigest())
                    # the marker before the text's own start is no part of it
                    decoded = "".join([text[c] for c in own])[1:]
                    sha2.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        all_ids.append([i for c in own for i in flat[starts[c] : ends[c]].tolist()])
                        texts.append(decoded)
                ids = batch.column("ids")[k].values
                columns, names = [ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(sha2, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (and ids, decoded) of each row's whole text.

    Ids are those of the sentencepiece library without begin and end ids. Null texts count as empty and have no
    tokens; null and repeated ids and repeated rows give a row each; an empty table gives an empty result; further
    columns, whatever their names, play no part. A text of any length is worked on whole, in a block of its own
    if it is longer than BLOCK characters. A chunk stands once in each block that has it, so no chunk, however
    frequent, makes more rows than there are blocks.
    """
    spark = docs.sparkSession
    pieces(path)  # a model that can't be split this way is refused here
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = min(MOST, max(FEWEST, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = _arrow_type(rows)
    # each task's blocks go to the files of their buckets as they are, so that answers come to them and they stay in place
    blocks = bucketed(rows.mapInArrow(_blocks(buckets, id_type), f"block long, bucket int, ids array<{kind}>, pack binary"), "block", "pieces", dealt=False)
    asked = blocks.filter("bucket >= 0").select("block", "bucket", "pack").repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(_segmented(path), "block long, bucket int, pack binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "pack")).alias("answers"))
    both = blocks.filter("bucket < 0").select("block", "ids", "pack").join(answers.hint("merge"), "block", "left")
    more = ", ids array<long>, decoded string" if with_ids else ""
    return both.mapInArrow(_joined(path, buckets, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc_id"].dataType)
