"""Quality classifier by co-training of a text view and a metadata view.

Two linear classifiers, one of the whole text's content and one of the page's metadata, are fitted on a
bounded sample of labelled rows. In each round both score every unlabelled document; of those of which one
is confident, a bounded number, spread over the whole table by hash, is handed to the other as labelled.
How confident is told on labelled rows held out for that. Both views are then calibrated on other held-out
rows, and a last linear model of the two calibrated logits scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, batches_of, mix, words_of

#: Bound of the labelled sample, taken in hash order of the id.
LABELLED = 5000
#: Shares of the labelled sample held out for confidence and for the last calibration; rounds; rows handed over per round, view and class, at most; least confidence.
HELD_OUT, ROUNDS, HANDED, CONFIDENT = (0.15, 0.15), 3, 150, 0.95
#: Pieces in which confident rows are first ranked.
PIECES = 32
#: Buckets of hashed words and of hashed metadata.
WORDS, META = 1024, 128
#: Documents whose score is under this are rejected.
LEAST_SCORE = 0.5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_features(body: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Roots of the relative frequencies of bytes and of hashed lower-case words, and a few shares."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)[:, None]
    letters = np.bincount(doc * 256 + body, minlength=n * 256).reshape(n, 256) / size
    low = LOWER[body]
    starts, ends, at = words_of(low, offsets)
    word = rolling.of(rolling.sums(low), starts, ends)
    own = np.repeat(np.arange(n), np.diff(at))
    total = np.maximum(np.diff(at), 1)[:, None]
    hashed = np.bincount(own * WORDS + (word % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS) / total
    upper, marks, digits = letters[:, 65:91].sum(1), letters[:, 33:48].sum(1) + letters[:, 58:65].sum(1) + letters[:, 123:127].sum(1), letters[:, 48:58].sum(1)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    again = np.bincount(own, weights=same, minlength=n) / total[:, 0]
    shape = np.stack([upper, marks, digits, again, letters[:, 10] * 10, np.minimum(2, size[:, 0] / total[:, 0] / 10), np.minimum(2, np.log1p(total[:, 0]) / 5)], axis=1)
    return np.concatenate([np.sqrt(letters), np.sqrt(hashed), shape], axis=1).astype(np.float32)


def meta_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed language, source and their pair, and the decade of the length; nulls are values of their own."""
    rows = len(lang)
    out = np.zeros((rows, META + 17), np.float32)
    for i, (a, b, c) in enumerate(zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), strict=True)):
        for j, x in enumerate((f"l:{a}", f"s:{b}", f"p:{a}:{b}")):
            h = 0
            for ch in x.encode():
                h = (h * 1000003 ^ ch) & 0xFFFFFFFF
            out[i, (h ^ h >> 15) % META] += 1
        out[i, META + (16 if c is None else min(15, int(max(c, 0)).bit_length() // 2))] = 1
    return out


@dataclass
class Linear:
    """Logistic regression with an L2 penalty, by accelerated gradient steps on scaled features."""

    penalty: float = 1e-3
    steps: int = 150

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Linear:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = ((x - self.mean) / self.scale).astype(np.float32)
        y = y.astype(np.float32)
        weight = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
        weight = weight / weight.sum()
        w, b = np.zeros(z.shape[1], np.float32), np.float32(0)
        v, c, t = w, b, 1.0
        rate = np.float32(1.0 / (0.25 * self._top(z, weight) + 0.25 + self.penalty))
        penalty = np.float32(self.penalty)
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
            g = weight * (p - y)
            w2, b2 = v - rate * (z.T @ g + penalty * v), c - rate * g.sum()
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, c = w2 + np.float32((t - 1) / t2) * (w2 - w), b2 + np.float32((t - 1) / t2) * (b2 - b)
            w, b, t = w2, b2, t2
        self.w = w.astype(np.float64) / self.scale
        self.b = b - float(self.mean @ self.w)
        return self

    @staticmethod
    def _top(z: np.ndarray, weight: np.ndarray) -> float:
        """Largest eigenvalue of the weighted second moments, by power steps."""
        v = np.full(z.shape[1], z.shape[1] ** -0.5, np.float32)
        top = 1.0
        for _ in range(12):
            u = z.T @ (weight * (z @ v))
            top = float(np.linalg.norm(u)) or 1.0
            v = u / np.float32(top)
        return 1.2 * top

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    both: tuple[float, float, float]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of the two views, and combined."""
        a = self.text_scale[0] * self.text.logit(text) + self.text_scale[1]
        b = self.meta_scale[0] * self.meta.logit(meta) + self.meta_scale[1]
        return chance(a), chance(b), chance(self.both[0] * a + self.both[1] * b + self.both[2])


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    m = Linear(1e-3, 300).fit(logit[:, None], y)
    return max(0.0, float(m.w[0])), float(m.b)


def calibrated(text: Linear, meta: Linear, text_held: np.ndarray, meta_held: np.ndarray, y: np.ndarray) -> CoTrained:
    """The two views with scales and their combination, taken on held-out rows."""
    a, b = text.logit(text_held), meta.logit(meta_held)
    sa, sb = platt(a, y), platt(b, y)
    both = Linear(1e-3, 300).fit(np.stack([sa[0] * a + sa[1], sb[0] * b + sb[1]], axis=1), y)
    return CoTrained(text, meta, sa, sb, (float(both.w[0]), float(both.w[1]), float(both.b)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(41)
    for batch in batches:
        for part, body, offsets in batches_of(batch):
            t = text_features(body, offsets, rolling).astype(np.float16)
            m = meta_features(part.column("lang"), part.column("source"), part.column("n_chars")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["doc_id", "t", "m"])


HANDOVER = "turn int, view string, label int, h long, doc_id {kind}, features binary"


def _confident(shared, turn: int):
    """Of all rows those of which a view is confident, for the other view: of each class the least by hash that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, model = Rolling(41), shared.value
        held: dict[tuple[str, int], list] = {("text", 0): [], ("text", 1): [], ("meta", 0): [], ("meta", 1): []}
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part, body, offsets in batches_of(batch):
                t = text_features(body, offsets, rolling).astype(np.float16)
                m = meta_features(part.column("lang"), part.column("source"), part.column("n_chars")).astype(np.float16)
                a, b, _ = model.scores(t.astype(np.float32), m.astype(np.float32))
                h = mix(np.asarray(part.column("h")).view(np.uint64) + np.uint64(turn)) >> np.uint64(1)
                known = np.asarray(part.column("doc_id").is_valid())
                for view, p, features in (("text", b, t), ("meta", a, m)):
                    for label, sure in ((1, p), (0, 1 - p)):
                        rows = np.flatnonzero((sure >= CONFIDENT) & known)
                        # twice as many as are handed over, as labelled ones still leave
                        rows = rows[np.argsort(h[rows], kind="stable")[: 2 * HANDED]]
                        mine = held[view, label]
                        mine += [(int(h[i]), part.column("doc_id")[i].as_py(), features[i].tobytes()) for i in rows]
                        mine.sort(key=lambda x: x[0])
                        del mine[2 * HANDED :]
        for (view, label), mine in held.items():
            if mine:
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array([turn] * n, pa.int32()), pa.array([view] * n), pa.array([label] * n, pa.int32()), pa.array([x[0] for x in mine], pa.int64()), pa.array([x[1] for x in mine], kind), pa.array([x[2] for x in mine], pa.binary())], ["turn", "view", "label", "h", "doc_id", "features"])

    return run


def columns(docs: DataFrame, more: list = ()) -> DataFrame:
    """doc_id, text and the metadata columns; metadata that docs lacks counts as null."""
    have = {c.lower() for c in docs.columns}
    meta = [F.col(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *meta, *more)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> CoTrained | None:
    """The fitted model, or None where the labelled sample doesn't hold both classes in each of its parts.

    At most LABELLED labelled documents are taken, in hash order of doc_id, so the sample is the same
    wherever the rows lie; of a doc_id that repeats, the row of the least features. All rows without a label are scored in each
    round. Rows without id or label, and ids labelled twice unlike, teach nothing.
    """
    h = F.xxhash64("doc_id").alias("h")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("double").alias("target"), F.max(label_col).alias("most")).filter("target = most").select("doc_id", "target", h)
    rows = columns(docs)
    sample = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("h", "doc_id").limit(LABELLED)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.join(F.broadcast(sample.select("doc_id")), "doc_id").select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(_features, f"doc_id {kind}, t binary, m binary")  # at most LABELLED ids
    # of a repeated id the least row, so that it is the same one each time
    one = got.groupBy("doc_id").agg(F.min(F.struct("t", "m")).alias("row"))
    table = sample.join(one, "doc_id").orderBy("h", "doc_id").select("target", "h", "row.t", "row.m").toArrow()
    if not table.num_rows:
        return None
    t = np.stack([np.frombuffer(x.as_buffer(), np.float16) for x in table.column("t")]).astype(np.float32)
    m = np.stack([np.frombuffer(x.as_buffer(), np.float16) for x in table.column("m")]).astype(np.float32)
    y = (table.column("target").to_numpy() > 0).astype(np.float64)
    place = (mix(table.column("h").to_numpy().view(np.uint64)) % np.uint64(1000)).astype(float) / 1000
    sure, last = place < HELD_OUT[0], (place >= HELD_OUT[0]) & (place < sum(HELD_OUT))
    fit = ~(sure | last)
    if any(len(set(y[part])) < 2 for part in (sure, last, fit)):
        return None

    given = {"text": [(t[fit], y[fit])], "meta": [(m[fit], y[fit])]}
    taken: set = set()
    every = columns(docs, [h])
    for turn in range(ROUNDS + 1):
        models = {view: Linear().fit(*(np.concatenate(x) for x in zip(*parts, strict=True))) for view, parts in given.items()}
        if turn == ROUNDS:
            break
        shared = docs.sparkSession.sparkContext.broadcast(calibrated(models["text"], models["meta"], t[sure], m[sure], y[sure]))  # a few thousand weights
        found = every.mapInArrow(_confident(shared, turn), HANDOVER.format(kind=kind)).join(known.select("doc_id"), "doc_id", "left_anti")
        # of a repeated id the least features, so that they are the same ones each time
        found = found.groupBy("view", "label", "h", "doc_id").agg(F.min("features").alias("features"))
        # first within pieces, so that what reaches the four last groups is bounded whatever the number of tasks
        piece = F.row_number().over(Window.partitionBy("view", "label", "piece").orderBy("h", "doc_id"))
        found = found.withColumn("piece", F.pmod("h", F.lit(PIECES))).withColumn("nth", piece).filter(F.col("nth") <= HANDED)
        first = F.row_number().over(Window.partitionBy("view", "label").orderBy("h", "doc_id"))
        chosen = found.withColumn("nth", first).filter(F.col("nth") <= HANDED).select("view", "label", "doc_id", "features").orderBy("view", "label", "nth").collect()  # at most 4 * HANDED rows
        for view in given:
            mine = [r for r in chosen if r.view == view and (view, r.doc_id) not in taken]
            taken |= {(view, r.doc_id) for r in mine}
            if mine:
                given[view].append((np.stack([np.frombuffer(r.features, np.float16) for r in mine]).astype(np.float32), np.array([r.label for r in mine], np.float64)))
    return calibrated(models["text"], models["meta"], t[last], m[last], y[last])


def score(docs: DataFrame, model: CoTrained | None, carry: list[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, p_text, p_meta, score, keep, and each column named in carry as `_<name>`.

    Without a model the scores are null and every row is kept. Null and empty texts are scored by their
    metadata and the features of an empty text; very long texts are scored whole; repeated rows are scored
    each; an empty table gives an empty result; further columns, whatever their names, play no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "p_text", "p_meta", "score", "keep", *(f"_{c}" for c in carry)]
    rows = columns(docs, [F.col(c).alias(f"_{c}") for c in carry])
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("keep"), *names[5:])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, fitted = Rolling(41), shared.value
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                t = text_features(body, offsets, rolling).astype(np.float16).astype(np.float32)
                m = meta_features(part.column("lang"), part.column("source"), part.column("n_chars"))
                a, b, c = fitted.scores(t, m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= LEAST_SCORE), *(part.column(x) for x in names[5:])], names)

    more = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double, keep boolean{more}")
