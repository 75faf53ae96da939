"""Very long texts among short ones, and columns whose names the operators use themselves."""

import hashlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers as P

from deltashelf.llm import bpe, common, jaccard_join, quality, secrets, substring_dedup, suffix_dedup, warc

#: Words of the long text, of eight letters or fewer and a space each.
LONG = 600_000


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghiklmnoprstu"))[rng.integers(0, 19, (n, 8))]
    return ["".join(x[:k]) for x, k in zip(letters.tolist(), rng.integers(3, 9, n).tolist(), strict=True)]


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_long_repeats(spark, tmp_path):
    long, other = words(1, LONG), words(2, 400)
    passage = long[LONG // 2 : LONG // 2 + 150]
    changed = [*long[: LONG // 3], "changed", *long[LONG // 3 + 1 :]]
    rows = [(1, " ".join(long)), (2, " ".join([*other[:200], *passage, *other[200:]])), (3, "short one"), (4, None)]
    docs = table(spark, tmp_path, rows)

    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    common_bytes = (" " + " ".join(passage) + " ").encode()
    one, two = (t.encode() for _, t in rows[:2])
    at, end = one.index(common_bytes), one.index(common_bytes) + len(common_bytes)
    # the two texts may agree by chance in the letters beside the passage
    while one[at - 1] == two[two.index(common_bytes) - (one.index(common_bytes) - at) - 1]:
        at -= 1
    while one[end] == two[two.index(common_bytes) + end - one.index(common_bytes)]:
        end += 1
    assert len(common_bytes) > 400
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (len(one), end - at, 1, sha(one[:at] + one[end:]))
    assert got[2].n_removed == end - at and got[3].n_removed == got[4].n_bytes == 0

    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert (got[1].n_words, got[1].n_removed, got[1].kept_sha256) == (LONG, 0, sha(one))
    assert (got[2].n_words, got[2].n_removed, got[2].kept_sha256) == (550, 150, sha(" ".join(other).encode()))

    near = docs.union(spark.createDataFrame([(5, " ".join(changed))], docs.schema))
    near.write.parquet(f"{tmp_path}/near")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_similar(spark.read.parquet(f"{tmp_path}/near")).collect()}
    assert got == {1: (LONG - 4, 1), 2: (546, 2), 3: (1, 3), 4: (0, 4), 5: (LONG - 4, 1)}


def test_long_scans(spark, tmp_path):
    long = " ".join(words(3, LONG))
    secret = " password=abcdef123456xyz"
    docs = table(spark, tmp_path, [(1, long + secret), (2, "plain"), (3, None)])
    vocabulary = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs, vocabulary).collect()}
    assert got == {1: [("assign", len(long) + 1, len(long) + len(secret))], 2: [], 3: []}
    clean = {r.doc_id: r.text for r in secrets.redact(docs, vocabulary).collect()}
    assert clean == {1: long + " [assign]", 2: "plain", 3: None}

    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    known = spark.createDataFrame([(i, " ".join(words(10 + i, 30)) if i % 2 else "#### $$$$ " * 9) for i in range(300)], "doc_id long, text string")
    model = quality.train(known, labels)
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(scored) == 3 and scored[1].keep

    pages = docs.selectExpr("doc_id as page_id", "'http://a.example/' as url", "text as html").unionAll(docs.selectExpr("doc_id + 10", "'http://b.example/'", "text"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    whole = (long + secret).encode()
    assert got[1] == (len(whole), sha(whole), "response", None) and got[11] == (len(whole), sha(whole), "revisit", 1)


def test_long_encoding(spark, tmp_path):
    from tokenizers import Tokenizer

    long = " ".join(words(4, LONG // 8))
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    # the library's own pass over the whole text
    ids = lib.encode(long, add_special_tokens=False).ids
    (got,) = bpe.encode_decode(table(spark, tmp_path, [(1, long)]), P.path("word_bpe_49k.json")).collect()
    assert (got.n_tokens, got.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
    assert got.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False).encode())


CLASH = ("kf", "kr", "row", "row_key", "h", "n", "leads", "kept", "keep", "score", "features")


def test_stages_keep_clashing_columns(spark, tmp_path):
    say = [" ".join(words(100 + i, 60)) for i in range(60)]
    texts = [*say, say[0], say[1] + " more", None, "", "password=abcdef123456xyz"]
    rows = [(i, t, "en", "s", None if t is None else len(t), *(f"{c}{i}" for c in CLASH)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]
    left = {r.doc_id: r for r in docs.collect()}
    # the exact copy and the near copy go, and of the null and the empty text the second
    assert set(left) == {*range(60), 62, 64}
    assert all(r[c] == f"{c}{i}" for i, r in left.items() for c in CLASH) and left[64].text == "[assign]"
    assert {p.doc_id for p in pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == set(left)
