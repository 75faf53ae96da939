"""Code points that this Python's Unicode tables lack, and what co-training hands over where metadata tells something."""

import random
import unicodedata

import numpy as np
import public_tokenizers as P
import tokenizers

from deltashelf.llm import bpe, quality


def test_every_code_point_is_split_as_the_library_does():
    path = P.path("word_bpe_49k.json")
    own, library = bpe.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    unassigned = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    known = [chr(c) for c in range(0, 0x110000, 37) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    lines = [f"ab{c}cd {c}{c}1" for c in unassigned[::11] + [x for x in unassigned if ord(x) < 0x20000] + known]
    want = library.encode_batch(lines, add_special_tokens=False)
    bad = [lines[i] for i, w in enumerate(want) if own.encode(lines[i]) != w.ids]
    assert not bad, (len(bad), bad[:3])


def test_both_views_hand_over_where_both_know(spark, monkeypatch):
    """Sources that tell good from bad: each view's fit grows by what the other is sure of, and the result is right."""
    rng = random.Random(6)
    good, bad = [f"word{i}" for i in range(200)], [f"junk{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(2400):
        y = rng.random() < 0.6
        words = [rng.choice(good if rng.random() < (0.85 if y else 0.15) else bad) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words), "en", f"s{rng.randrange(5) + (0 if y else 5)}", 100))
        if i % 3 == 0:
            labels.append((i, int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    sizes = {}
    fit = quality.Linear.fit

    def watched(self, x, y, weight=None):
        if x.shape[1] > 10:
            sizes.setdefault(x.shape[1], []).append(len(y))
        return fit(self, x, y, weight)

    monkeypatch.setattr(quality.Linear, "fit", watched)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(sizes) == 2
    for grown in sizes.values():
        assert grown == sorted(grown) and grown[-1] > grown[0] + 100
    truth = {r[0]: r[3] < "s5" for r in rows}
    kept = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert np.mean([kept[i] == truth[i] for i in truth]) > 0.99
