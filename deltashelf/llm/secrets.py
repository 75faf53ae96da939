"""Secret scan: fixed patterns, and strings that a public vocabulary spells badly.

Ordinary words need few tokens of a byte-pair vocabulary for their length, random strings many. A run of
token-like characters whose characters per token stay under a bound is reported, after digests of well
known lengths, UUIDs, numbers and readable identifiers are set aside; of other runs those stretches are
reported that lie under the bound by themselves.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which ties at one start are listed (fixed values).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: What lies between the marks of a run; a UUID is one piece.
PIECE = re.compile(rf"{UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: The shapes of words in identifiers; whether such a part is words is for its ratio to say.
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]{2,}){1,6}[0-9]{0,4}")
#: Characters per token under which a string counts as random, and the least length judged.
MOST_RATIO, LEAST_LENGTH = 1.9, 20


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(piece: str) -> bool:
    """Digests of well known lengths, UUIDs and numbers."""
    return bool(UUID.fullmatch(piece)) or bool(DIGEST.fullmatch(piece)) and (len(piece) in DIGEST_LENGTHS or piece.isdigit())


def readable(run: str, count: Callable[[str], int], most_ratio: float = MOST_RATIO) -> bool:
    """Plain strings, and identifiers: parts joined by marks, each a number, or word-like in shape and by its own ratio."""
    core = run.strip("=.-_/+")
    if plain(core):
        return True
    parts = [p for p in re.split(r"[+/_=.\-]+", core) if p]
    return all(re.fullmatch(r"[0-9]+", p) or WORDS.fullmatch(p) and len(p) / count(p) >= most_ratio for p in parts)


def stretches(run: str, count: Callable[[str], int], most_ratio: float = MOST_RATIO) -> list[tuple[int, int]]:
    """Start and end of each part of a run that is badly spelt by itself, whatever readable text it touches.

    Bad pieces between marks are judged together with what lies between them, up to the next word or plain string
    of four or more characters, so that a key holding marks is one stretch; where that is too well spelt, alone.
    """
    found, held = [], []

    def close() -> None:
        if held:
            s, e = held[0][0], held[-1][1]
            both = [(s, e)] if (e - s) / count(run[s:e]) < most_ratio else held
            found.extend((a, b) for a, b in both if b - a >= LEAST_LENGTH)
            held.clear()

    for m in PIECE.finditer(run):
        p = m[0]
        ratio = len(p) / count(p)
        if plain(p) or (WORDS.fullmatch(p) and ratio >= most_ratio):
            if len(p) > 3:
                close()
        elif ratio < most_ratio:
            held.append(m.span())
    close()
    return found


def spans(text: str, count: Callable[[str], int], most_ratio: float = MOST_RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) >= LEAST_LENGTH and not readable(run, count, most_ratio) and len(run) / count(run) < most_ratio:
            found.append(("random", m.start(), m.end()))
        elif len(run) > LEAST_LENGTH and not plain(run.strip("=.-_/+")):
            found += [("random", m.start() + s, m.start() + e) for s, e in stretches(run, count, most_ratio)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def counter(path: str) -> Callable[[str], int]:
    encode = encoder(path).encode_ordinary

    @functools.lru_cache(maxsize=1 << 14)
    def count(run: str) -> int:
        # a run of any length is judged in pieces, so that one long run stays cheap
        return sum(len(encode(run[i : i + 4096])) for i in range(0, len(run), 4096))

    return count


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of each row's whole text.

    A null or empty text has no spans; very long texts are scanned whole, offsets count from their start;
    repeated rows give repeated rows; an empty table an empty result; further columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(x, count)] if x else [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["doc_id", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with each secret in text_col replaced by [kind]; overlapping spans become one, under the first's kind.

    Nulls stay null and empty texts empty; very long texts are redacted whole; repeated rows stay repeated;
    an empty table gives an empty result; further columns, whatever their names, are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            for x in b.column(at).to_pylist():
                if x:
                    pieces, done = [], 0
                    for k, s, e in spans(x, count):
                        if s >= done:
                            pieces += [x[done:s], f"[{k}]"]
                        done = max(done, e)
                    x = "".join([*pieces, x[done:]]) if pieces else x
                out.append(x)
            columns = list(b.columns)
            columns[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
