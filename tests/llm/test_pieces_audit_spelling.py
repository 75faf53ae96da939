"""Chunk table of SentencePiece ids, filter audit and spelling variants against the library and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from deltashelf.llm import audit, pieces, spelling

MODEL = P.path("piece_bpe_32k.model")
CLASHING = "doc_id long, text string, lang string, block long, bucket int, ids string, pack string, word string, n long, c int, head string, digest string, mask int, salt int"
ODD = [None, "", " ", "  ", "a ", " a", "a  b   c", "▁x ▁▁ y▁", "tab\tand\nline\r\n", "<s> </s> <unk> <0x0A>", "日本語 テスト", "🙂🙂 👨‍👩‍👧", "\x00 nul", "ÀÉÿ×÷ Straße", "x" * 3000, "word " * 3000, "a b" * 5, "a b" * 5, "é   　."]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "i", "p", "w", 3, 4, "h", "d", 5, 6) for i, t, lang in rows], CLASHING).repartition(3)


# ---- op11

def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 4000)
    sp = library()
    rows = [(i if i % 5 else None, t, "en") for i, t in enumerate(ODD)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in pieces.encode_decode(documents(spark, rows), MODEL, with_ids=True).collect())
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "")
        text = sp.decode(ids)
        want.append((i is not None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text))
    assert got == sorted(want)
    assert pieces.encode_decode(documents(spark, rows).limit(0), MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\n\t.é日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_are_segmented_apart(text):
    model, sp = pieces.pieces(MODEL), library()
    chunks = pieces.chunks_of(text)
    ids = model.segment(chunks)
    assert [i for c in ids for i in c] == sp.encode(text)
    assert "".join(model.texts(ids))[1:] == sp.decode(sp.encode(text))


def test_a_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefg é") for _ in range(rng.randint(1, 12))) for _ in range(3_500_000))
    assert len(text) > pieces.BLOCK
    r = pieces.encode_decode(documents(spark, [(1, "a b", "en"), (2, text, "en"), (3, "b a", "en")]), MODEL).filter("doc_id = 2").first()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- op12

def brute_audit(rows, labels):
    def fails(i, t):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        return (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), bool(same) and (i is None or min(same) < i))

    known = [(lang or "", fails(i, t), any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)) for i, t, lang in rows]
    out = []
    for part in {k[0] for k in known}:
        own = [k for k in known if k[0] == part]
        shapley = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                at = "ABCDE".index(letter)
                gone = [k for k in left if k[1][at]]
                left = [k for k in left if not k[1][at]]
                shapley[letter] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(k[1][at] for k in own) - len(gone), sum(k[1][at] and sum(k[1]) == 1 for k in own), sum(k[2] for k in gone), sum(k[3] for k in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(7)
    say = lambda n, m: " ".join(rng.choice(["ab", "Cd", "ef#", "gh", "ij\x0b", "É"]) + str(rng.randrange(m)) for _ in range(n))
    rows = [(i, say(rng.choice([0, 5, 99, 100, 101, 200]), rng.choice([3, 500, 5000])), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(i, rows[i % 7][1], "fr") for i in range(100, 130)] + [(1, rows[1][1], "en"), (1, rows[1][1], "xx"), (None, rows[1][1], "en"), (None, "only here", ""), (None, "only here", ""), (200, None, "en"), (201, "", None), (202, "W X " * 60_000, "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 130, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*x, "x", "y") for x in labels], "doc_id long, quality int, toxic int, text string, part string")
    got = sorted(tuple(r) for r in audit.audit(documents(spark, rows), table).collect())
    assert got == brute_audit(rows, labels)
    assert audit.audit(documents(spark, rows).limit(0), table).count() == 0
    assert {r[-1] for r in audit.audit(documents(spark, rows), table.limit(0)).select("good_lost").collect()} == {0}


# ---- op13

def apart(a, b):
    """Whether one edit leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least=6, fewest=5, ratio=5, every=199):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= fewest}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def variants(spark, rows, **more):
    return sorted((tuple(r) for r in spelling.variants(documents(spark, rows), **more).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def corpus(rng, alphabet, sizes, many, heads=("",)):
    words = [rng.choice(heads) + "".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(many)]
    # some words far more frequent than others, so that forms lead on over several steps
    return [(i if i % 9 else None, " ".join(rng.choice(words[: rng.choice([3, 30, many])]) + rng.choice(["", ".", "1", " É×÷"]) for _ in range(400)), "en") for i in range(40)]


@pytest.mark.parametrize("seed, alphabet, sizes, heads", [(1, "ab", (5, 6, 7), ("",)), (2, "aÀ", (6, 7, 8), ("", "common")), (3, "aB", (3, 4, 5), ("theverysamestart", "theverysamestar"))])
def test_variants(spark, seed, alphabet, sizes, heads):
    rows = corpus(random.Random(seed), alphabet, sizes, 150, heads) + [(77, None, "en"), (78, "", "en"), (79, "Straße " * 6, "en")]
    want = brute_variants(rows)
    assert any(w[3] for w in want) and max(w[2] for w in want) > 3
    assert variants(spark, rows) == want
    # arcs so light that each range is split down to one place
    assert variants(spark, rows, heavy=1) == want


def test_variants_of_long_words_and_chains(spark):
    long = "ab" * 400
    chain = ["abcdef", "abcdeg", "abcdgg", "abcggg", "abgggg", "aggggg", "gggggg"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1) if k < 5 else 5**6)) + f" {long} {long}a {long[:-1]} {long[1:]} {long[:300]}x{long[301:]} " * 5
    rows = [(None, text, "en")]
    want = brute_variants(rows, every=10**9)
    assert variants(spark, rows, every=10**9) == want == variants(spark, rows, every=10**9, heavy=10)
    roots = {w[0]: w[5] for w in want}
    assert roots["abcdef"] not in ("abcdef", "abcdeg")
    assert variants(spark, []) == [] and variants(spark, [(1, "abcdef", "en")]) == []


def test_runs_are_cut_between_words(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("ab É1 C") for _ in range(5000)) + "z" * 500
    whole = [w for s in spelling.runs(text) for w in s]
    monkeypatch.setattr(spelling, "STRETCH", 7)
    assert [w for s in spelling.runs(text) for w in s] == whole
