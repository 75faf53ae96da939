"""BPE encoding by a streaming transducer of bounded lookahead, and incremental decoding.

The encoding of a stretch of symbols is the one chain of tokens in which each adjacent pair is stable:
encoded alone, the pair stays those two tokens. So the transducer keeps, for each of the last few
positions, the last token of the encoding up to there (the longest token ending there that forms a
stable pair with the last token before it). A later token reaches back over less than the longest
token's length, so once all positions within that lookahead lead back to one position, the tokens up to
it can't change and leave. Memory stays at the lookahead plus what is not yet settled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class After(dict):
    """Tokens that may follow a token, each with whether the pair is stable, as they are asked for."""

    __slots__ = ("merges", "token")

    def __init__(self, merges: Merges, token: int):
        self.merges, self.token = merges, token

    def __missing__(self, b: int) -> bool:
        m = self.merges
        if m.kept >= m.KEEP:
            for x in m.after.values():
                x.clear()
            m.kept = 0
        got = self[b] = m.stable(self.token, b)
        m.kept += 1
        return got


class Rows(dict):
    """After by token."""

    __slots__ = ("merges",)

    def __missing__(self, a: int) -> After:
        got = self[a] = After(self.merges, a)
        return got


class State(dict):
    """A state of the automaton, the longest end of the text that begins a token: next states by symbol, as they are asked for.

    ends: the tokens that end here, the longest first, with their length and what may follow them; closes: those that end a word.
    """

    __slots__ = ("merges", "text", "ends", "closes")

    def __init__(self, merges: Merges, text: str):
        self.merges, self.text = merges, text
        here = [text[i:] for i in range(len(text))]
        self.ends, self.closes = (tuple((known[t], len(t), merges.after[known[t]]) for t in here if t in known) for known in (merges.standing, merges.final))

    def __missing__(self, symbol: str) -> State:
        m, t = self.merges, self.text + symbol
        while t not in m.begun:
            t = t[1:]
        got = m.states.get(t)
        if got is None:
            got = m.states[t] = State(m, t)
        if m.steps < m.KEEP:
            m.steps += 1
            self[symbol] = got
        return got


class Merges:
    """A merge list by ids: what each token is made of, and which pairs of tokens are stable."""

    #: Pairs of tokens, and steps between states, remembered at most.
    KEEP = 1 << 19

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.suffix = suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        self.rank: dict[int, int] = {}  # left part << 32 | right part -> rank
        for i, (a, b) in enumerate(pairs):
            x, y = vocab[a], vocab[b]
            self.rank.setdefault(x << 32 | y, i)
            self.made.setdefault(vocab[a + b], (i, x, y))
        ends = {t: i for t, i in vocab.items() if suffix and t.endswith(suffix) and len(t) > len(suffix)}
        symbols = {t for t in vocab if len(t) == 1} | {t for t in ends if len(t) == 1 + len(suffix)}
        usable = {t: i for t, i in vocab.items() if i in self.made or t in symbols}
        #: Tokens by text: those that end a word (without the mark of it), and all others.
        self.final = {t[: -len(suffix)]: i for t, i in usable.items() if t in ends} if suffix else usable
        self.plain = {t: i for t, i in usable.items() if t not in ends}
        self.longest = max(map(len, (*self.final, *self.plain)), default=1)
        #: A token that ends later begins less than the longest token's length back.
        self.lookahead = self.longest - 1
        self.alone: dict[int, bool] = {}
        self.left, self.right = {}, {}
        self.final = {t: i for t, i in self.final.items() if self.stands(i)}
        self.standing = {t: i for t, i in self.plain.items() if self.stands(i)}
        self.after, self.kept = Rows(), 0
        self.after.merges = self
        #: What tokens begin with, and the states so far; the first is that of no symbols.
        self.begun = {t[:i] for known in (self.standing, self.final) for t in known for i in range(len(t) + 1)} | {""}
        self.states: dict[str, State] = {}
        self.steps = 0
        self.start = self.states[""] = State(self, "")

    def _edge(self, token: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """The parts of a token that touch its edge, least first, each with the rank of the merge that ends it."""
        got = kept.get(token)
        if got is None:
            got, rank = [], 1 << 60
            t = token
            while True:
                got.append((t, rank))
                if t not in self.made:
                    break
                rank = self.made[t][0]
                t = self.made[t][side]
            got = kept[token] = got[::-1]
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether the symbols of a and b, merged together, end as a and b: no merge across the border comes up in time."""
        xs, ys = self._edge(a, 2, self.right), self._edge(b, 1, self.left)
        i = j = 0
        rank = self.rank.get
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = rank(x << 32 | y)
            # of merges of one rank the leftmost goes first
            if r is not None and r < x_ends and r <= y_ends:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
            if i == len(xs) or j == len(ys):
                return True

    def stands(self, token: int) -> bool:
        """Whether the token's own symbols are merged into it: its parts stand, and theirs is the merge that comes last."""
        got = self.alone.get(token)
        if got is None:
            made = self.made.get(token)
            got = self.alone[token] = made is None or (self.stands(made[1]) and self.stands(made[2]) and self._joins(made[1], made[2]))
        return got

    def _joins(self, a: int, b: int) -> bool:
        xs, ys = self._edge(a, 2, self.right), self._edge(b, 1, self.left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = self.rank.get(x << 32 | y)
            if r is not None and r < x_ends and r <= y_ends:
                return i == len(xs) - 1 and j == len(ys) - 1
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
            if i == len(xs) or j == len(ys):
                return False


class Encoder:
    """The transducer: feed() takes text of the byte alphabet and returns the ids settled so far; last=True ends the word."""

    #: Unsettled symbols between two looks for a settled position.
    CHECK = 64

    def __init__(self, merges: Merges):
        self.m = merges
        self._reset()

    def _reset(self) -> None:
        # text after the last settled position; for each position in it the last token up to there, by what may follow it, and where that begins
        self.buffer, self.after, self.begin = "", [None], [-1]
        self.state = self.m.start

    def feed(self, text: str, last: bool = False) -> list[int]:
        out: list[int] = []
        step = self.CHECK + self.m.lookahead
        for at in range(0, len(text), step):
            self._take(text[at : at + step], last and at + step >= len(text))
            if len(self.buffer) > step:
                out += self._settled()
        if last:
            out += self._chain(len(self.buffer))
            self._reset()
        return out

    def _take(self, text: str, last: bool) -> None:
        m = self.m
        after, begin, state = self.after, self.begin, self.state
        end = len(self.buffer)
        self.buffer += text
        for symbol in text[:-1] if last else text:
            end += 1
            state = state[symbol]
            for t, size, following in state.ends:
                before = after[end - size]
                if before is None or before[t]:
                    after.append(following)
                    begin.append(end - size)
                    break
            else:
                raise ValueError(f"no token ends with {symbol!r}")
        self.state = state
        if last:
            end += 1
            for t, size, following in state[text[-1]].closes:
                before = after[end - size]
                if before is None or before[t]:
                    after.append(following)
                    begin.append(end - size)
                    return
            raise ValueError(f"no token ends a word with {text[-1]!r}")

    def _chain(self, end: int) -> list[int]:
        got = []
        while end > 0:
            got.append(self.after[end].token)
            end = self.begin[end]
        return got[::-1]

    def _settled(self) -> list[int]:
        """Ids up to the last position that all positions within the lookahead lead back to."""
        n = len(self.buffer)
        at = {*range(max(0, n - self.m.lookahead), n + 1)}
        while len(at) > 1:
            furthest = max(at)
            at.remove(furthest)
            at.add(self.begin[furthest])
        upto = at.pop()
        if upto <= 0:
            return []
        out = self._chain(upto)
        self.buffer, self.after = self.buffer[upto:], self.after[upto:]
        self.begin = [x - upto for x in self.begin[upto:]]
        return out


class TextMachine:
    """Bytes to text, as they come: incomplete sequences wait, impossible ones become U+FFFD."""

    def __init__(self):
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        out = []
        i, n = 0, len(data)
        while i < n:
            b = data[i]
            if not self.need:
                if b < 0x80:
                    j = i + 1
                    while j < n and data[j] < 0x80:
                        j += 1
                    out.append(data[i:j].decode("ascii"))
                    i = j
                    continue
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                self.need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
                if self.need:
                    self.held = bytes([b])
                else:
                    out.append("�")
                i += 1
            elif self.low <= b <= self.high:
                self.held += bytes([b])
                self.low, self.high, self.need = 0x80, 0xBF, self.need - 1
                if not self.need:
                    out.append(self.held.decode("utf-8"))
                i += 1
            else:
                out.append("�")
                self.need = 0
        return "".join(out)

    def end(self) -> str:
        rest, self.need = ("�" if self.need else ""), 0
        return rest


#: Printable bytes that byte-level vocabularies write as themselves (fixed values).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHAR = {b: chr(b) for b in PRINTABLE}
BYTE_CHAR |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}
BYTE_TEXT = [BYTE_CHAR[b] for b in range(256)]

#: Numbers that are no decimal digits; where none occurs, re's own classes equal \p{L} and \p{N}.
ODD = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No"))
ODD_NUMBER = re.compile("[" + "".join(re.escape(c) for c in sorted(ODD) if c < "\U00010000") + "]")
BEYOND = re.compile("[\U00010000-\U0010FFFF]")


def _class(test) -> re.Pattern:
    """A pattern of one of the code points that a test holds for."""
    parts, start = [], None
    for c in range(0x110001):
        hit = c < 0x110000 and test(chr(c))
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            parts.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(parts) + "]")


#: What this Python's Unicode tables don't know, and the library's newer ones may.
UNKNOWN = _class(lambda c: unicodedata.category(c) == "Cn")


def narrow(text: str) -> bool:
    """Whether a text holds none but the first 256 code points."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def unknown(text: str) -> bool:
    # the first 256 code points are all known, and most texts hold no others
    return not narrow(text) and UNKNOWN.search(text) is not None


def odd_number(text: str) -> bool:
    return not text.isascii() and (ODD_NUMBER.search(text) is not None or (BEYOND.search(text) is not None and not ODD.isdisjoint(text)))


#: White space as Unicode's property has it (fixed values); Python's own class adds four separators.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_RUN = re.compile(f"[{WHITE}]+")
#: The classes that end the splitter's pattern, and of the first 256 code points those in each (letters, numbers, all else but white space), spelt out.
CLASSES = (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")
NARROW = [
    "[" + "".join(re.escape(c) for c in map(chr, range(256)) if test(c)) + "]"
    for test in (lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c)[0] == "N", lambda c: unicodedata.category(c)[0] not in "LN" and not re.match(f"[{WHITE}]", c))
]


class Known(dict):
    """Bytes of the ids and of the decoded text by word. Of two generations the older goes when the younger is full; long words are not kept."""

    __slots__ = ("tokenizer", "keep", "older")

    def __init__(self, tokenizer: WordTokenizer, keep: int):
        self.tokenizer, self.keep, self.older = tokenizer, keep, {}

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        got = self.older.get(word)
        if got is None:
            got = self.tokenizer._ids(self.tokenizer.encode_word(word))
        if len(word) <= 64:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class WordTokenizer:
    """A tokenizers file of the word kind: normaliser, splitter, byte alphabet and merges with word ends.

    keep bounds the memory of words already encoded: of two generations the older goes when the younger is full.
    """

    def __init__(self, path: str, keep: int = 1 << 17):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], model["merges"], self.suffix)
        self.vocab = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.joined = " " if spec.get("decoder") is None else ""
        import regex

        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split_any = regex.compile(pattern.replace(r"\s", WHITE))
        head, tail = pattern.removesuffix("|".join(CLASSES)), (r"[^\W\d_]+", r"\d", rf"(?:[^{WHITE}\w]|_)+")
        if not re.fullmatch(r"('[a-z]+\|)*", head) or head == pattern:
            raise ValueError(f"a splitter of another kind: {pattern}")
        # what begins with an apostrophe begins no letters and no number, so these can be tried first, as most words are letters
        self.split_plain, self.split_narrow = (re.compile(f"{letters}|{number}|{head}{other}") for letters, number, other in (tail, (NARROW[0] + "+", NARROW[1], NARROW[2] + "+")))
        self.encoder = Encoder(self.merges)
        self.path, self.library = path, None
        #: Bytes of each id, and of its token's text.
        self.number = {i: i.to_bytes(4, "little") for i in self.token}
        self.written = {i: t.encode() for i, t in self.token.items()}
        self.between = self.joined.encode()
        self.known = Known(self, keep)

    def normal(self, text: str) -> str:
        return self.lower(SPACE_RUN.sub(" ", text))

    def lower(self, text: str) -> str:
        """The normal form but for runs of white space, which only part words."""
        text = unicodedata.normalize("NFC", text)
        # lower-casing goes character by character, so the final sigma has no form of its own
        return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        if narrow(text):
            return self.split_narrow.findall(text)
        split = self.split_any if odd_number(text) else self.split_plain
        return split.findall(text)

    def newer(self, part: str) -> list[str]:
        """Words, in the byte alphabet, of a text with code points newer than this Python's tables: the library's normaliser and splitter know them."""
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(self.path)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def encode_word(self, word: str) -> list[int]:
        # printable ASCII stands for itself, and words hold no space
        if not (word.isascii() and word.isprintable()):
            word = "".join([BYTE_TEXT[b] for b in word.encode("utf-8", "surrogatepass")])
        return self.encoder.feed(word, last=True)

    def _ids(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.number[i] for i in ids]), self.between.join([self.written[i] for i in ids])

    def digests(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, their bytes and the decoded text's bytes."""
        entries: list[tuple[bytes, bytes]] = []
        for kind, part in self.segments(text):
            if kind:
                entries.append(self._ids([self.special[part]]))
            elif unknown(part):
                entries += [self._ids(self.encoder.feed(w, last=True)) for w in self.newer(part)]
            else:
                entries += map(self.known.__getitem__, self.words(self.lower(part)))
        if not entries:
            return 0, b"", b""
        numbers, written = zip(*entries, strict=True)
        data = b"".join(numbers)
        return len(data) // 4, data, self.between.join(written)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        if self.special_at is None or "<|" not in text:
            yield False, text
            return
        at = 0
        for m in self.special_at.finditer(text):
            yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        yield False, text[at:]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.digests(text)[1], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file tokens are joined by spaces; else bytes run through the text machine."""
        if self.joined:
            return self.joined.join(self.token[i] for i in ids)
        machine = TextMachine()
        return "".join(machine.feed(bytes(CHAR_BYTE[c] for c in self.token[i])) for i in ids) + machine.end()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of each row's whole text.

    Null texts count as empty and have no tokens; very long texts are taken whole; repeated rows give repeated rows; an empty
    table an empty result; further columns play no part. Texts with code points newer than this Python's Unicode tables are normalised and split by the
    library, and encoded as all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            n, ids, sha, text, sha2 = [], [], [], [], []
            for x in b.column(1).to_pylist():
                many, data, decoded = tok.digests(x or "")
                n.append(many)
                sha.append(hashlib.sha256(data).hexdigest())
                sha2.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(data, "<u4").astype(np.int64))
                    text.append(decoded.decode())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(sha2, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<long>, decoded string" if with_ids else ""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
