"""Suffix and substring dedup and the similarity join against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from deltashelf.llm import jaccard_join, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, rid string, row_key string"


def thue_morse(letters: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(letters))


def corpus(seed: int) -> list[tuple]:
    """Texts with copies, near copies, shared passages, repeats inside, low entropy, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    vocabulary = [word() for _ in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(rng.randint(15, 90)) for _ in range(6)]
    texts: list[str | None] = [None, "", "   \t\n", "one two", "ONE  two", "a b c d e", "=" * 1500, "=" * 700 + "x" + "=" * 700, "a " * 300, "ab " * 250 + "c", None, ""]
    for _ in range(40):
        parts = say(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    base = say(150)
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [rng.choice(texts[12:]) for _ in range(8)]
    rows = [(i * 3, t, "x", None) for i, t in enumerate(texts)]
    rows += [rows[20], (None, texts[25], None, None), (rows[30][0], "another " * 30, None, None)]
    rng.shuffle(rows)
    return rows


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def brute_bytes(rows, length=400):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return by_id(out)


def brute_words(rows, length=20):
    texts = [(doc, (t or "").encode().split()) for doc, t, *_ in rows]
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    out = []
    for k in order:
        doc, words = texts[k]
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first.setdefault(tuple(words[i : i + length]), (k, i)) != (k, i):
                gone[i : i + length] = [True] * length
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return by_id(out)


def brute_join(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(bytes(jaccard_join.LOWER)).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        k = top(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return by_id([(r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(rows)])


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).drop("kept_bytes").collect()
    assert by_id(tuple(r) for r in got) == brute_bytes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = [r for r in corpus(seed)]
    # rows that repeat an id are in stored order, so only their sum is fixed: leave them out here
    rows = list({r[0]: r for r in rows}.values())
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).drop("kept_text").collect()
    assert by_id(tuple(r) for r in got) == brute_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    rows = corpus(seed)
    got = jaccard_join.join_similar(spark.createDataFrame(rows, SCHEMA).repartition(3)).drop("leads", "kf", "kr").collect()
    assert by_id(tuple(r) for r in got) == brute_join(rows)


def test_texts_that_cheat_polynomials(spark):
    """Words and texts whose polynomial fingerprints modulo a power of two are the same under any base."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    words = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{words} {one}"), (2, f"{words} {other}"), (3, f"a b c d {one}"), (4, f"a b c d {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()] == [0] * 4
    # the first two share 15 of 17 shingles, the others have one each
    assert [r.component_id for r in jaccard_join.join_similar(docs).orderBy("doc_id").collect()] == [1, 1, 3, 4]
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    rows = [(1, one), (2, other)]
    assert by_id(tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("kept_bytes").collect()) == brute_bytes(rows)


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats, jaccard_join.join_similar])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
