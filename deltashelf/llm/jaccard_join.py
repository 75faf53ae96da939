"""Similarity join on sets of word shingles with adaptive prefixes of several matches.

Each set's shingles are put in one order for all sets, frequent ones last. Of two sets x and y that are
similar enough, the first |x| - t + l shingles of x and |y| - t + l of y, t the least overlap, have at least
l in common. A document is posted with a prefix whose l grows with what its candidates are estimated to
cost: with the counts of the frequent shingles in its plain prefix. The longer a prefix, the more shared
ones are asked for:

* a document leaves if fewer than l of its posted shingles are posted by anyone else;
* a similar pair shares at least s = o(x, y) - max(|x| - p(x), |y| - p(y)) posted shingles, o the overlap
  that sets of these sizes need and p the lengths of the prefixes; this is l or more.

Now the posted shingles' exact counts are known, and the same is done once more: of a document's a(x) posted
shingles that others share, rarest first, the first a(x) - s + k of both sides have k in common, and pairs
that share k of them are verified; k is larger where the estimated candidates are many.

The result is connected components, so pairs that are already connected need no look. In a first round each
document is paired with one leader of each posted shingle only, and verified against the one it shares
most with, s at least. Then all pairs across components are counted, of growing blocks of the documents
with each other and with what is not yet looked at, and connected before the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, dropped, flat, hashed_words, mix, placed, signed, spans, stored
from .substring_dedup import _record

#: Frequent shingles that are told apart when shingles are ordered, at most (they are broadcast).
FREQUENT = 50_000
#: Shingles of which one stretch of texts is counted at once, and the least count there that is passed on.
STRETCH, LEAST_SEEN = 2_000_000, 3
#: l as a share of the set's size, by the estimated candidates from which it is taken.
LENGTHS = ((0, 0.05), (1_000, 0.125), (20_000, 0.25))
#: k by the estimated candidates from which it is taken.
MATCHES = ((0, 1), (256, 2))
#: Parts in 128 of the documents in each block but the last; pieces that a frequent shingle is dealt to.
BLOCKS, SALTS = (1, 8, 32), 64
#: Sets already posted that a task remembers, so that copies are posted once by it.
REMEMBERED = 200_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Shingles:
    """Distinct shingle hashes of a batch of texts, sorted within each text."""

    def __init__(self, words: int):
        self.words = words

    def of(self, body: np.ndarray, offsets: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Hashes, the number of each one's text, and, if asked for, independent second hashes."""
        one, two, at = hashed_words(LOWER[body], offsets, 31)
        sizes = np.diff(at)
        many = np.where(sizes >= self.words, sizes - self.words + 1, (sizes > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(sizes)), many)
        i = np.repeat(at[:-1], many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        end = np.minimum(i + self.words, at[doc + 1])
        got = spans(one, i, end, 32)
        order = np.lexsort((got, doc))
        got, doc = got[order], doc[order]
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
        return got[new], doc[new], spans(two, i, end, 33)[order][new] if both else None


def least(n, share: int):
    """ceil(share * n / 100)."""
    return (share * n + 99) // 100


def digests(got: np.ndarray, n: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's set: sums of two independent hashes of its shingles."""
    sums = []
    for values in (got, more):
        total = np.zeros(len(got) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(0x51ED270B)), out=total[1:])
        ends = np.cumsum(n)
        sums.append(signed(total[ends] - total[ends - n]))
    return sums[0], sums[1]


def _facts(words: int):
    """Of each row the size and the digest of its set; of shingles seen more often in a stretch of texts how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, count = Shingles(words), [], 0

        def counted(kind: pa.DataType) -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= LEAST_SEEN
            none = int(often.sum())
            empty = [pa.nulls(none, t) for t in (kind, *[pa.int64()] * 5)]
            return _record("doc_id kf kr n u v token seen", *empty, signed(token[often]), seen[often].astype(np.int64))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part, body, offsets in batches_of(batch):
                got, doc, more = sets.of(body, offsets, both=True)
                n = np.bincount(doc, minlength=part.num_rows)
                u, v = digests(got, n, more)
                none = pa.nulls(part.num_rows, pa.int64())
                yield _record("doc_id kf kr n u v token seen", part.column("doc_id"), part.column("kf"), part.column("kr"), n.astype(np.int64), u, v, none, none)
                held.append(got)
                count += len(got)
                if count >= STRETCH:
                    yield counted(kind)
                    held, count = [], 0
        if held:
            yield counted(kind)

    return run


def _posted(words: int, share: int, shared):
    """(token, salt, u, p): the posted prefix of each text's set, p its length; frequent tokens have a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, done = Shingles(words), set()
        known, count = shared.value
        place = np.argsort(np.argsort(count, kind="stable"), kind="stable") + 1
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                got, doc, more = sets.of(body, offsets, both=True)
                n = np.bincount(doc, minlength=part.num_rows)
                u, v = digests(got, n, more)
                weight, cost = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64)
                if len(known) and len(got):
                    k = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    hit = known[k] == got
                    weight[hit], cost[hit] = place[k[hit]], count[k[hit]]
                order = np.lexsort((got, weight, doc))
                got, weight, cost = got[order], weight[order], cost[order]
                at = np.arange(len(got)) - (np.cumsum(n) - n)[doc]
                spare = n - least(n, share)
                total = np.bincount(doc, weights=np.where(at <= spare[doc], cost, 0), minlength=part.num_rows)
                part_of = np.zeros(part.num_rows)
                for least_cost, length in LENGTHS:
                    part_of[total >= least_cost] = length
                p = np.minimum(spare + np.maximum(1, (part_of * n).astype(np.int64)), n)
                fresh = np.zeros(part.num_rows, bool)
                for i, key in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
                    fresh[i] = key not in done
                    done.add(key)
                if len(done) > REMEMBERED:
                    done.clear()
                keep = (at < p[doc]) & fresh[doc]
                own = doc[keep]
                salt = np.where(weight[keep] > 0, (u[own] & (SALTS - 1)) + 1, 0).astype(np.int32)
                yield _record("token salt u p", signed(got[keep]), salt, u[own], p[own].astype(np.int32))

    return run


def _sets(words: int):
    """The sorted shingles of each wanted text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(words)
        for batch in batches:
            for part, body, offsets in batches_of(batch):
                got, doc, _ = sets.of(body, offsets)
                raw, ends = got.tobytes(), 8 * np.cumsum(np.bincount(doc, minlength=part.num_rows))
                yield _record("cid shingles", part.column("cid"), pa.array([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary()))

    return run


def _overlap(share: int):
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                ok.append(100 * common >= share * (len(x) + len(y) - common))
            yield _record("a b", batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_())))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that are links. Both sides of each join are stored tables, so Spark can split a document of many pairs."""
    pairs = stored(pairs.select("a", "b"), "join-pairs")
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    links = stored(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_overlap(share), "a long, b long"), "join-links")
    dropped(pairs)
    return links


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(cid, comp): the least cid reachable by links (a, b), for each cid that has one, by alternating large and small stars.

    Raises an error where the rounds don't suffice.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "join-edges")
    for _ in range(rounds):
        # done when each document points at one root, and no root points on
        points = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = edges.select(F.col("v").alias("u")).distinct()
        if points.join(roots, "u", "left_semi").union(points.filter("n > 1")).isEmpty():
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct())
        both = edges.union(edges.select("v", "u"))
        # the least neighbours are stored first, so that Spark can split a hub's rows in the join
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "join-low")
        large = stored(both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "join-large")
        least_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least_of, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least_of.select("u", F.col("m").alias("v"))).distinct(), "join-edges")
        dropped(edges, low, large)
        edges = after
    raise RuntimeError(f"components not found within {rounds} rounds")


def needed(share: int, a: str, b: str) -> Column:
    """The least overlap of similar sets of these sizes."""
    return F.expr(f"({share} * ({a} + {b}) + {99 + share}) div {100 + share}")


def fitting(share: int, x: str, y: str) -> Column:
    """Whether the sizes allow a link, and whether enough of both sets' shingles may be shared."""
    n, m = (f"{x}.n", f"{y}.n"), (f"{x}.m", f"{y}.m")
    return (100 * F.least(*n) >= share * F.greatest(*n)) & (needed(share, *n) <= F.least(*m))


def asked(share: int, x: str, y: str) -> Column:
    """How many posted shingles a similar pair shares at least."""
    rest = F.greatest(*(F.col(f"{t}.n") - F.col(f"{t}.p") for t in (x, y)))
    return needed(share, f"{x}.n", f"{y}.n") - rest


def ordered(own: DataFrame, share: int) -> DataFrame:
    """The postings (token, doc) of shingles that more than one component has posted, rarest first within a document.

    doc: cid, n, p, m, a (how many there are), pos (the place among them), k, block.
    """
    across = stored(own.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("f")).filter("low < high").select("token", "f"), "join-across")
    mine = Window.partitionBy("cid")
    left = own.join(across, "token").select("token", "f", "doc.*")
    left = left.withColumn("a", F.count(F.lit(1)).over(mine).cast("int")).withColumn("m", F.expr("n - p + a")).filter(100 * F.col("m") >= share * F.col("n"))
    left = left.withColumn("pos", F.row_number().over(mine.orderBy("f", "token")))
    early = F.col("pos") <= F.col("a") - (F.expr(f"({share} * n + 99) div 100") - F.col("n") + F.col("p")) + 1
    cost = F.sum(F.when(early, F.col("f") - 1)).over(mine)
    k = F.lit(MATCHES[0][1])
    for least_cost, matches in MATCHES[1:]:
        k = F.when(cost >= least_cost, F.lit(matches)).otherwise(k)
    part = F.pmod(F.xxhash64("cid"), F.lit(128))
    block = F.lit(len(BLOCKS))
    for i in reversed(range(len(BLOCKS))):
        block = F.when(part < sum(BLOCKS[: i + 1]), F.lit(i)).otherwise(block)
    out = stored(left.select("token", F.struct("cid", "n", "p", "m", "a", "pos", k.alias("k"), block.alias("block")).alias("doc")), "join-ordered")
    dropped(across)
    return out


def met(postings: DataFrame, block: int, share: int) -> DataFrame:
    """Pairs (a, b) across components of a block with itself and later blocks that share k early posted shingles."""
    x = postings.filter(F.col("doc.block") >= block).select("token", F.col("doc").alias("x"), F.col("comp").alias("of_x"))
    y = postings.filter(F.col("doc.block") == block).select("token", F.col("doc").alias("y"), F.col("comp").alias("of_y"))
    k = F.least("x.k", "y.k")
    early = [F.col(f"{t}.pos") <= F.col(f"{t}.a") - asked(share, "x", "y") + k for t in "xy"]
    once = (F.col("x.block") > block) | (F.col("x.cid") < F.col("y.cid"))
    rows = x.join(y, "token").filter((F.col("of_x") != F.col("of_y")) & once & fitting(share, "x", "y") & early[0] & early[1])
    shared = rows.groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), k.alias("k")).agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter("shared >= k").select("a", "b")


def postings(texts: DataFrame, classes: DataFrame, words: int, share: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token and doc (cid, n, p, m, central) of the documents that may have partners. m: how many of its shingles others may have."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT shingles
    posts = texts.select("text").mapInArrow(_posted(words, share, shared), "token long, salt int, u long, p int")
    # a frequent shingle is known to be shared and dealt to SALTS groups; of others a group is one shingle
    group = Window.partitionBy("token", "salt")
    alive = posts.withColumn("low", F.min("u").over(group)).withColumn("high", F.max("u").over(group)).filter("salt > 0 or low <> high")
    alive = stored(alive.select("token", "u", "p").distinct(), "join-alive")
    own = Window.partitionBy("u", "v")
    sized = alive.join(classes.select("u", "v", "n", "cid"), "u").withColumn("m", F.expr("n - p") + F.count(F.lit(1)).over(own))
    sized = stored(sized.filter(100 * F.col("m") >= share * F.col("n")).select("token", "cid", F.col("n").cast("int").alias("n"), "p", F.col("m").cast("int").alias("m")), "join-sized")
    dropped(alive)
    many = stored(sized.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "join-many")
    # again, among those that are left; and how shared a document's shingles are, as what near copies were made of is most so
    own = Window.partitionBy("cid")
    again = sized.join(many, "token").withColumn("m", (F.expr("n - p") + F.count(F.lit(1)).over(own)).cast("int")).withColumn("central", -F.avg("f").over(own))
    out = stored(again.filter(100 * F.col("m") >= share * F.col("n")).select("token", F.struct("cid", "n", "p", "m", "central").alias("doc")), "join-postings")
    dropped(sized, many)
    return out


def join_similar(docs: DataFrame, words: int = 5, share: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, leads, and the row's key kf, kr (see common.placed).

    A row's set: distinct shingles of `words` words after lower-casing A-Z, or its whole word sequence if
    that is shorter; two rows link when 100 * intersection >= share * union. component_id is the smallest
    doc_id reachable by links (null ids last), leads whether the row is the first of its component. Rows
    without words, null or empty texts, link with nothing, have their own id and lead. Rows that repeat
    an id or a text count each, and just one of them leads; very long texts are worked on in pieces; an
    empty table gives an empty result; further columns, whatever their names, play no part.
    """
    texts = placed(docs, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), name="join-rows")
    id_type = docs.schema[id_col].dataType.simpleString()
    facts = stored(texts.mapInArrow(_facts(words), f"doc_id {id_type}, kf long, kr long, n long, u long, v long, token long, seen long"), "join-facts")
    frequent = facts.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).toPandas()  # at most FREQUENT rows
    frequent = frequent.assign(token=frequent["token"].to_numpy(np.int64).view(np.uint64)).sort_values("token")

    # equal sets are one class; its first row stands for it
    rows = facts.filter("kr is not null").drop("token", "seen")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kf", "kr")).alias("first")
    classes = stored(rows.groupBy("u", "v", "n").agg(first).withColumn("cid", F.monotonically_increasing_id()), "join-classes")
    tokens = postings(texts, classes.filter("n > 0"), words, share, (frequent["token"].to_numpy(np.uint64), frequent["seen"].to_numpy(np.int64)))

    wanted = stored(tokens.select("doc.cid").distinct().join(classes, "cid").select("cid", "first.kf", "first.kr"), "join-wanted")
    sets = stored(texts.join(wanted.hint("merge"), ["kf", "kr"]).select("cid", "text").mapInArrow(_sets(words), "cid long, shingles binary"), "join-sets")

    # a leader of each shingle: the document whose shingles most others share
    lead = stored(tokens.groupBy("token").agg(F.min(F.struct("doc.central", "doc")).alias("lead")).select("token", F.col("lead.doc").alias("lead")), "join-lead")
    votes = tokens.join(lead, "token").filter((F.col("doc.cid") != F.col("lead.cid")) & fitting(share, "doc", "lead"))
    votes = votes.groupBy(F.col("doc.cid").alias("a"), F.col("lead.cid").alias("b"), asked(share, "doc", "lead").alias("asked")).agg(F.count(F.lit(1)).alias("shared")).filter("shared >= asked")
    links = _verified(votes.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b"), sets, share)
    comp = stored(components(links), "join-comp")

    def labelled(of: DataFrame) -> DataFrame:
        return of.join(comp, F.col("doc.cid") == F.col("cid"), "left").select("token", "doc", F.coalesce("comp", "doc.cid").alias("comp"))

    left = ordered(stored(labelled(tokens), "join-own"), share)
    dropped(tokens, lead)
    for block in range(len(BLOCKS) + 1):
        links = links.union(_verified(met(stored(labelled(left), "join-labelled"), block, share), sets, share))
        comp = stored(components(links), "join-comp")
    dropped(left, sets)

    known = stored(classes.join(comp, "cid", "left").select("u", "v", "n", "first", F.coalesce("comp", "cid").alias("comp")), "join-known")
    heads = known.groupBy("comp").agg(F.min("first").alias("head"))
    known = stored(known.join(heads, "comp").select("u", "v", "n", "head"), "join-heads")
    mine = F.struct("kf", "kr") == F.struct("head.kf", "head.kr")
    return rows.join(known.hint("merge"), ["u", "v", "n"]).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | mine).alias("leads"),
        "kf",
        "kr",
    )
