"""Spelling variants: pairs of words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and the acceptor again.

The composition is walked for each arc of the initial state apart, so it is dealt out by those arcs. An arc
stands for what both words of a pair are known to share: the first place at which they differ lies in a range [lo, hi)
of the shorter word, so they share the lo symbols before it and all but hi symbols of the shorter word at the end. At first
there are two ranges, the halves; an arc under which too much text lies is split into the halves of its range, until
a range is one place, under which there are no more words than the alphabet has pairs of letters.
Under one arc all words are of two lengths, the shorter one's and one more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Runs of letters once A-Z are lower-cased, and what lies between them.
RUN = re.compile("[a-zÀ-ÿ]+")
OTHER = re.compile("[^a-zÀ-ÿ]")
#: Characters of a text that are worked on at once, and words that a task counts before it hands them on.
STRETCH, COUNTED = 1 << 20, 200_000
#: Characters that words may hold under one arc before its range is split, and under the arcs that share an acceptor.
HEAVY, BUNDLE = 1 << 19, 1 << 17
#: Lengths up to which common endings are remembered.
SHORT = 48
KEYS = ["c", "lo", "hi", "head", "tail"]


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text with A-Z lower-cased, in stretches that end between runs."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        cut = OTHER.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        yield RUN.findall(text, at, end)
        at = end


def misspelt(word: str, start: int, every: int) -> str:
    """The run as it is counted: of those whose checksum `every` divides, without the symbol at the checksum's place."""
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    h %= len(word)
    return word[:h] + word[h + 1 :]


def _counts(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for stretch in runs(text.as_py() or ""):
                    for word, n in Counter(stretch).items():
                        # a run loses one symbol at most
                        if len(word) >= least:
                            word = misspelt(word, start, every)
                            if len(word) >= least:
                                found[word] += n
                    if len(found) >= COUNTED:
                        yield handed()
        if found:
            yield handed()

    return run


def vocabulary(docs: DataFrame, least: int = 6, fewest: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of at least `least` code points that stand at least `fewest` times: word, n."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counts(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


class Acceptor:
    """A minimal acyclic automaton: words are added in order, states of equal right languages are one."""

    def __init__(self):
        self.arcs: list[dict] = []
        self.final: list[bool] = []
        #: Words below each state, two at most.
        self.below: list[int] = []
        self.states: dict[tuple, int] = {}

    def state(self, final: bool, arcs: dict) -> int:
        key = (final, *arcs.items())
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.below.append(min(2, final + sum(self.below[q] for q in arcs.values())))
        return got

    def add(self, words: Iterable[str]) -> int:
        """The state from which exactly these words, which come in order and once each, are accepted."""
        # of the word added last: for each place whether a word ends there and the arcs that are settled, and the open arc's letter
        path, last = [[False, {}]], ""
        for word in words:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            self._settle(path, last, same)
            path += [[False, {}] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._settle(path, last, 0)
        return self.state(*path[0])

    def _settle(self, path: list, word: str, upto: int) -> None:
        while len(path) > upto + 1:
            node = path.pop()
            path[-1][1][word[len(path) - 1]] = self.state(*node)


class Pairs:
    """Composition of an acceptor with the one-edit transducer and the acceptor, from states that both sides share."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.known: dict[tuple[int, int, int], list[str]] = {}
        self.edits: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def common(self, x: int, y: int, size: int) -> list[str]:
        """Texts of a length that both states accept."""
        if size > SHORT:
            return self._walked(x, y, size)
        if x > y:
            x, y = y, x
        got = self.known.get((x, y, size))
        if got is None:
            if size == 0:
                got = [""] if self.a.final[x] and self.a.final[y] else []
            else:
                one, two = self.a.arcs[x], self.a.arcs[y]
                got = [c + v for c, q in one.items() if (r := two.get(c)) is not None for v in self.common(q, r, size - 1)]
            self.known[x, y, size] = got
        return got

    def _walked(self, x: int, y: int, size: int) -> list[str]:
        out, todo = [], [(x, y, size, ())]
        while todo:
            x, y, size, way = todo.pop()
            # the way stays a chain of its letters, so long texts aren't copied at each step
            if size <= SHORT:
                ends = self.common(x, y, size)
                if ends:
                    letters = []
                    while way:
                        way, c = way
                        letters.append(c)
                    start = "".join(reversed(letters))
                    out += [start + v for v in ends]
                continue
            two = self.a.arcs[y]
            todo += [(q, r, size - 1, (way, c)) for c, q in self.a.arcs[x].items() if (r := two.get(c)) is not None]
        return out

    def edited(self, q: int, left: int) -> list[tuple[str, str]]:
        """Pairs of endings from a state whose first symbols differ: one replaced (both of length left), or the first one more."""
        got = self.edits.get((q, left))
        if got is None:
            got, arcs = [], list(self.a.arcs[q].items())
            for i, (c, x) in enumerate(arcs):
                if left:
                    for d, y in arcs[i + 1 :]:
                        got += [(c + v, d + v) for v in self.common(x, y, left - 1)]
                got += [(c + v, v) for v in self.common(x, q, left) if not v.startswith(c)]
            self.edits[q, left] = got
        return got

    def of(self, start: int, left: int, places: int) -> Iterator[tuple[str, str]]:
        """All pairs from a shared state that differ first at one of so many places; the shorter word of a pair has length left."""
        a, todo = self.a, [(start, 0, ())]
        while todo:
            q, at, way = todo.pop()
            if a.below[q] < 2:
                continue
            arcs = a.arcs[q]
            if len(arcs) > 1 or a.final[q]:
                ends = self.edited(q, left - at)
                if ends:
                    letters, w = [], way
                    while w:
                        w, c = w
                        letters.append(c)
                    before = "".join(reversed(letters))
                    for x, y in ends:
                        yield before + x, before + y
            if at + 1 < places:
                todo += [(r, at + 1, (way, c)) for c, r in arcs.items() if at < left]


def _near():
    """Per word of the arcs at hand: how many words are near, and the most frequent of them."""

    def ended(arcs: list[tuple[tuple, list[tuple[str, int]]]]) -> pa.RecordBatch | None:
        acceptor = Acceptor()
        starts = [acceptor.add(m for m, _ in words) for _, words in arcs]
        pairs, best = Pairs(acceptor), {}
        for ((c, lo, hi, head, tail), words), start in zip(arcs, starts):
            many = dict(words)
            for x, y in pairs.of(start, min(hi, c) - lo, hi - lo):
                for own, other in ((x, y), (y, x)):
                    word, told = head + own + tail, (-many[other], head + other + tail)
                    n, old = best.get(word, (0, told))
                    best[word] = (n + 1, min(old, told))
        if not best:
            return None
        return pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([n for n, _ in best.values()], pa.int64()), pa.array([t[0] for _, t in best.values()], pa.int64()), pa.array([t[1] for _, t in best.values()], pa.string())], ["word", "n_near", "minus", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, current, own, size = [], None, [], 0
        for batch in batches:
            for *key, middle, n in zip(*(batch.column(k).to_pylist() for k in (*KEYS, "middle", "n"))):
                key = tuple(key)
                if key != current:
                    if len(own) > 1:
                        arcs.append((current, own))
                        if size > BUNDLE:
                            if (got := ended(arcs)) is not None:
                                yield got
                            arcs, size = [], 0
                    current, own = key, []
                own.append((middle, n))
                size += len(middle)
        if len(own) > 1:
            arcs.append((current, own))
        if arcs and (got := ended(arcs)) is not None:
            yield got

    return run


def _under(rows: DataFrame, ranges) -> DataFrame:
    """The rows once for each range of places of the shorter word at which pairs may differ first, with what such words share."""
    each = rows.select("word", "n", F.explode(ranges).alias("r")).select("word", "n", "r.*").filter("lo < hi")
    return each.select("word", "n", "c", "lo", "hi", F.expr("left(word, lo)").alias("head"), F.expr("right(word, greatest(c - hi, 0))").alias("tail"))


def _range(c, lo, hi):
    return F.struct(c.cast("int").alias("c"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def near(words: DataFrame, least: int, heavy: int = HEAVY) -> DataFrame:
    """word, n_near, form (the near word of largest n, ties to the smallest) and form_n of the words (word, n) that have near ones."""
    size, half = F.length("word"), lambda c: F.floor(c / 2)
    lengths = F.filter(F.array(size, size - 1), lambda c: c >= least)
    rows = stored(_under(words, F.flatten(F.transform(lengths, lambda c: F.array(_range(c, F.lit(0), half(c)), _range(c, half(c), c + 1))))), "spelling-arcs")
    ready = []
    while True:
        # what a text under an arc weighs is its middle; a range of one place can't be split, nor need be
        weight = F.sum(F.length("word") - F.length("head") - F.length("tail"))
        hot = stored(rows.filter("hi - lo > 1").groupBy(*KEYS).agg(weight.alias("weight")).filter(F.col("weight") > heavy).select(*KEYS), "spelling-heavy")
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, KEYS, "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        rows = stored(_under(rows.join(hot, KEYS, "left_semi"), F.array(_range(F.col("c"), F.col("lo"), middle), _range(F.col("c"), middle, F.col("hi")))), "spelling-arcs")
    found = None
    for part in ready:
        middle = F.expr("substring(word, lo + 1, length(word) - length(head) - length(tail))").alias("middle")
        dealt = part.select(*KEYS, middle, "n").repartition(*KEYS).sortWithinPartitions(*KEYS, "middle")
        got = dealt.mapInArrow(_near(), "word string, n_near long, minus long, form string")
        found = got if found is None else found.unionByName(got)
    best = F.min(F.struct("minus", "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words (word, form) with a form: where the chain of forms ends, which it does, by doubling the steps taken."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        dropped(ways)
        if longer.filter("moved").isEmpty():
            return longer.select("word", "root")
        # a table of its own columns, so that the next round reads no more than it needs
        ways, kept = longer.select("word", "root"), longer.stored_at
        ways.stored_at = kept


def variants(docs: DataFrame, least: int = 6, fewest: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of all texts, A-Z lower-cased, as `misspelt` counts them, of at least `least` code
    points and `fewest` occurrences. Near words differ by one inserted, deleted or replaced code point; the form is the
    most frequent near one (ties: smallest by code points) if it has `ratio` times the word's occurrences; the root is
    where forms lead. Null and empty texts hold no words; a null id is written as nothing in the checksum; rows that
    repeat count each; an empty table gives an empty result; texts and words of any length are taken whole;
    further columns, whatever their names, play no part. Words with more near words than others make no larger
    groups: their pairs are counted where they are found.
    """
    words = stored(vocabulary(docs, least, fewest, every, id_col, text_col), "spelling-words")
    close = stored(near(words, least, heavy), "spelling-near")
    rows = words.join(close, "word", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
