"""The pipeline's stages, each on what the one before kept."""

import random
import zlib

import corpus_pipeline as pipeline
import public_tokenizers as P

from deltashelf.llm import common


def folder(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeiourst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = [say(rng.randint(30, 150)) for _ in range(60)]
    base = say(100).split()
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (10, 50, 90)]
    texts = good + ["  ".join(good[0].split(" ")), good[1]] + near + [say(40).upper().replace(" ", "!! ") for _ in range(40)] + [None, ""] + [say(20) + " password=abcdef123456xyz " + say(20)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if t and t.isupper() else 1, 0) for i, t in enumerate(texts) if t and len(t) > 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts


def test_stages(spark, tmp_path):
    sf, texts = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf), "test")
        assert out.columns == docs.columns and out.schema == docs.schema or [f.name for f in out.schema] == [f.name for f in docs.schema]
        docs = out
        kept[name] = {r.doc_id: r for r in docs.collect()}
    upper = {i for i, t in enumerate(texts) if t and t.isupper()}
    assert not upper & set(kept["quality classifier"]) and set(range(60)) <= set(kept["quality classifier"])
    assert {60, 61}.isdisjoint(kept["exact dedup"]) and set(range(60)) <= set(kept["exact dedup"])
    near = kept["n-gram Jaccard join"]
    assert 62 in near and {63, 64}.isdisjoint(near) and set(range(60)) <= set(near)
    last = kept["secret scan"]
    assert set(last) == set(near)
    hidden = [r for r in last.values() if r.text and "[assign]" in r.text]
    assert len(hidden) == 1 and hidden[0].n_chars == len(hidden[0].text) and "password" not in hidden[0].text
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == set(last)


def test_run_equals_stages(spark, tmp_path):
    sf, _ = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf), "test")
    want = sorted((r.doc_id, r.text or "") for r in docs.collect())
    from deltashelf.llm import packing

    enc = packing.encoder(P.path("byte_bpe_50k.json"))
    import numpy as np

    pieces = sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in want for ids in [[*enc.encode_ordinary(t), 0]])
    assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in pipeline.run(spark, sf).collect()) == pieces


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
