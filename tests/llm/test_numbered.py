"""The other numbered operators against brute force, round trips and held-out accuracy."""

import codecs
import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltashelf.llm import ann, bpe, exact_dedup, packing, quality, queries, secrets, warc

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, rid string, row_key string, digest string, n long, h long, batch int, body string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3, "b") for r in rows], CLASHING).repartition(3)


ROWS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "A b"), (6, "a\tb"), (2, "a b"), (None, "a b"), (7, " "), (8, "c\x0bd e"), (9, "c d e"), (10, "long " * 30000)]


# ---- exact dedup

def test_exact(spark):
    got = exact_dedup.exact_dedup(documents(spark, ROWS)).collect()
    flat = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    for r in got:
        group = [i for i, t in enumerate(flat) if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(ROWS[i][0] for i in group if ROWS[i][0] is not None), len(group))
    assert sum(r.kept for r in got) == len(set(flat)) and len(got) == len(ROWS)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(documents(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 1000, 50_000])
def test_fuse(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    made = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_has(keys, *made).all()
    other = np.random.default_rng(n + 1).integers(2**63, 2**64, 100_000, dtype=np.uint64)
    assert exact_dedup.fuse_has(other, *made).mean() < 0.01
    assert len(made[3]) < 1.4 * n + 64


# ---- secrets

def test_secrets(spark):
    samples = ["password = 'abcdefghijkl'", "API_KEY:abcdefghijkl and Token=short", "secret: token: longvaluehere1", "x AKIAABCDEFGHIJKLMN y AKIA", "00112233445566778899aabbccddeeff", "deadbeefdeadbee", "token=ſecretvalue12", "K7xQ9vB2mZ4wT8rL6pN3 hello", "123e4567-e89b-12d3-a456-426614174000", "some_snake_case_identifier_name", "", None, "é" * 50 + " secret=" + "a" * 20]
    got = secrets.scan(documents(spark, list(enumerate(samples))), P.path("byte_bpe_50k.tiktoken")).collect()
    for r in got:
        text = samples[r.doc_id] or ""
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert sorted(want) == sorted((s.kind, s.start, s.end) for s in r.spans if s.kind != "random"), text
    random_found = {r.doc_id for r in got if any(s.kind == "random" for s in r.spans)}
    assert 7 in random_found and not random_found & {4, 5, 8, 9, 10, 11}


def test_secrets_of_one_case():
    count, r = secrets.counter(P.path("byte_bpe_50k.tiktoken")), random.Random(7)
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        keys = ["".join(r.choice(letters) for _ in range(32)) for _ in range(200)]
        for made in (keys, ["-".join(k[i : i + 8] for i in range(0, 32, 8)) for k in keys]):
            assert sum(("random", 0, len(k)) in secrets.spans(k, count) for k in made) >= 190
    words = ["some_snake_case_identifier_name", "/home/user/projects/settings/archive", "MAXIMUM_NUMBER_OF_CONNECTIONS", "internationalization", "2024-01-15-10-20-30-40-50"]
    assert not any(secrets.spans(w, count) for w in words)


def test_secrets_in_readable_runs():
    count, r = secrets.counter(P.path("byte_bpe_50k.tiktoken")), random.Random(7)
    for letters in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"):
        for before, after in (("//example.com/download/archive/", ""), ("config.production.service.key=", ""), ("/home/user/projects/settings/", "/archive/latest/download")):
            keys = ["".join(r.choice(letters) for _ in range(40)) for _ in range(200)]
            text = [f"x {before}{k}{after} y" for k in keys]
            assert sum(any(s == "random" and a <= len(before) + 4 and b >= len(before) + 40 for s, a, b in secrets.spans(t, count)) for t in text) >= 190
    fine = ["/users/123e4567-e89b-12d3-a456-426614174000/profile/settings", "/2024/01/15/archive/production/download", "https://example.com/documents/release-notes/version-2/index.html"]
    assert not any(s == "random" for w in fine for s, _, _ in secrets.spans(w, count))


def test_redact(spark):
    docs = documents(spark, [(1, "k password=abcdefghijkl1 z"), (2, None), (3, "plain")])
    got = {r.doc_id: r.text for r in secrets.redact(docs, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {1: "k [assign] z", 2: None, 3: "plain"}


# ---- packing

def naive_bfd(lengths, size):
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(left) if c >= x]
        if fits:
            i = min(fits, key=lambda i: left[i])
            left[i] -= x
        else:
            left.append(size - x)
    return sorted(left)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    steps, windows = packing.plan(dict(counts), 64)
    left, seen = [64] * windows, defaultdict(int)
    order = np.array(steps, np.int64).reshape(-1, 5)
    for x in lengths:
        t = order[order[:, 0] == x]
        rank = seen[x]
        seen[x] += 1
        k = np.searchsorted(t[:, 1], rank, side="right") - 1
        left[t[k, 3] + (rank - t[k, 1]) // t[k, 2]] -= x
    assert sorted(left) == naive_bfd(lengths, 64)


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(["", None, "a", "hello world " * 700, "x y z " * 100, "<|endoftext|> is special", "\n\n é", "hello world " * 700])] + [(2, "a")]
    got = packing.pack(documents(spark, rows), P.path("byte_bpe_50k.json"), 256, 0).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 256):
            part = np.array(ids[s : s + 256], "<u4")
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    have = defaultdict(int)
    for r in got:
        have[tuple(r)[:5]] += 1
    assert have == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by) == list(range(len(by)))
    assert packing.pack(documents(spark, rows).limit(0), P.path("byte_bpe_50k.json")).count() == 0


# ---- BPE

def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [None, "", " ", "²½ Ⅷ x²y", "ΑΣ ΣΑΣ", "it's we'LL", "foo_bar __ ١٢", "<|endoftext|> hi", "İ ŞİŞLİ é café 😀👩‍👩‍👧", "a" * 9000, "ab" * 4000, "!" * 3000, "\xa0x y​z\x1c\x85", "नमस्ते 你好世界", "thethe" * 500]
    texts += ["".join(rng.choice("abcdeinthr'sS !_-é中0½") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts))
    for r in bpe.encode_decode(documents(spark, rows), path, with_ids=True).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, lib.decode(ids, skip_special_tokens=False)), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)


def test_packing_of_long_white_space():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for text in (" " * 1_500_000, "a" + "\n" * 300_000 + " b", "x" * 100_000 + "\t " * 5000):
        assert packing.ids_of(text, path) == tok.encode(text, add_special_tokens=False).ids


def test_bpe_streams_alike():
    tok = bpe.tokenizer(P.path("word_bpe_49k.json"))
    word = "thequickbrownfoxjumps" * 400
    whole = tok.encode_word(word)
    e, got, held = bpe.Encoder(tok.merges), [], 0
    for i in range(0, len(word), 7):
        got += e.feed(word[i : i + 7], last=i + 7 >= len(word))
        held = max(held, len(e.buffer))
    assert got == whole and held < 4 * (e.CHECK + tok.merges.lookahead)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_text_machine(data, step):
    m = bpe.TextMachine()
    assert "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.end() == codecs.decode(data, "utf-8", "replace")


# ---- nearest neighbours

def exact_nearest(vectors, query, k):
    x = np.array(vectors[query], np.float64)
    got = []
    for i, v in vectors.items():
        if i != query:
            v = np.array(v, np.float64)
            got.append((-float(v @ x / np.sqrt((v * v).sum()) / np.sqrt((x * x).sum())), i))
    return [i for _, i in sorted(got)[:k]]


def test_recall(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in rows}
    got = defaultdict(list)
    for r in queries.op8_nearest(spark, SMALL).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = [len(set(got[q]) & set(exact_nearest(vectors, q, 5))) / 5 for q in vectors if q % 50 == 0]
    assert len(hits) == len(got) and np.mean(hits) >= 0.9


def test_recall_beyond_what_is_scored(spark):
    """Tables of several blocks, with a dense cluster: recall of what a query returns, not of a model of it."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 32))
    x[:1500] = x[0] + 0.05 * rng.normal(size=(1500, 32))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(t, F.col("vec_id") % 50 == 0, 5).collect():
        got[r.query_id].add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = []
    for q in range(0, 9000, 50):
        s = u @ u[q]
        s[q] = -9
        hits.append(len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert len(got) == 180 and np.mean(hits) >= 0.9


def test_postings_grow_with_the_table(spark):
    """A vector goes to as many files at every size, a query to as many; each part of a file is met by each lot of its queries once."""
    from pyspark.sql import functions as F

    pivots = 40
    for n in (1000, 5000):
        rows = spark.range(n).select(F.col("id").alias("key"), F.array(*((F.col("id") * 7 + i).cast("int") % pivots for i in range(ann.POSTED))).alias("pivots"))
        asked = spark.range(n // 50).select(F.col("id").alias("query_id"), F.sequence(F.lit(0), F.lit(7)).alias("pivots"))
        one = spark.range(pivots).select(F.col("id").cast("int").alias("pivot"), F.lit(1).alias("split"), F.lit(1).alias("lot"))
        assert ann.posted(rows, one, "key", "split", "lot").count() == ann.POSTED * n
        assert ann.posted(asked, one, "query_id", "lot", "split").count() == 8 * (n // 50)
        cut = one.withColumn("split", F.lit(3)).withColumn("lot", F.lit(2))
        meets = ann.posted(rows, cut, "key", "split", "lot").join(ann.posted(asked, cut, "query_id", "lot", "split"), ["pivot", "split", "lot"]).groupBy("query_id", "key", "pivot").count()
        plain = rows.select("key", F.explode("pivots").alias("pivot")).join(asked.select("query_id", F.explode("pivots").alias("pivot")), "pivot")
        assert meets.count() == plain.count() and meets.filter("count <> 1").count() == 0


def test_split_files_find_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 8))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    find = lambda: [tuple(r) for r in ann.nearest(t, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    whole = find()
    monkeypatch.setattr(ann, "POSTINGS", 3)
    monkeypatch.setattr(ann, "QUERIES", 2)
    cut = find()
    # smaller parts give at least as much: each hands on its k nearest
    assert len(whole) == len(cut) == 70
    assert all(b[3] >= a[3] - 1e-12 for a, b in zip(whole, cut, strict=True))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, [2.0, 0.0])]
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, `key` string, `order` int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(t, F.col("vec_id") % 50 == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 1.0), (0, 4, 7, 0.0)]
    assert ann.nearest(t.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


# ---- WARC

def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(1, "u", body), (2, None, body), (3, "u\nv", "short"), (4, "u", "short"), (5, "u", None), (6, "é", "é" * 60), (2, "u", body), (None, "u", body), (0, "u", "é" * 60)]
    t = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, digest string, offset int").repartition(2)
    got = warc.archive(t).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r.page_id]
        assert r.payload_digest in {hashlib.sha256((x[2] or "").encode()).hexdigest() for x in own}
        assert r.payload_bytes in {len((x[2] or "").encode()) for x in own}
    kinds = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or -1) for r in got)
    assert kinds == sorted([(False, 0, "response", -1), (False, 1, "response", -1), (False, 2, "revisit", 1), (False, 2, "revisit", 1), (False, 3, "response", -1), (False, 4, "response", -1), (False, 5, "response", -1), (False, 6, "revisit", -1), (True, 0, "revisit", 1)])
    assert warc.archive(t.limit(0)).count() == 0


def test_ranges():
    spots = [(0, 10), (10, 5), (100_000, 10), (100_020, 10), (5_000_000, 10)]
    assert list(warc.ranges(spots)) == [(0, 15, [0, 1]), (100_000, 30, [2, 3]), (5_000_000, 10, [4])]


# ---- quality

def test_quality_holds_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, labels.filter("doc_id % 4 <> 0"))
    got = quality.score(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert np.mean([r.keep for r in good]) > 0.97 and np.mean([r.keep for r in bad]) < 0.1


def test_quality_edges(spark):
    docs = documents(spark, ROWS)
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None
    got = quality.score(docs, None, carry=["rid"]).collect()
    assert len(got) == len(ROWS) and all(r.keep and r.score is None and r._rid == "x" for r in got)
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    many = documents(spark, [(i, "good words here " * 9 if i % 2 else "BAD!! " * 20) for i in range(1, 200)] + ROWS)
    got = quality.score(many, quality.train(many, both)).collect()
    assert len(got) == 199 + len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(many.limit(0), quality.train(many, both)).count() == 0
