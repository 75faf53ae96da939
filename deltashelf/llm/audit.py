"""Audit of how filters interact: what each removes, loses and repeats in every order, and its Shapley value.

A row fails a set of filters; rows are counted by part and set, so that everything else works on at most 32 counts
a part. The value of a coalition is how many rows it removes. The Hart-Mas-Colell potential of a coalition is
its value plus the potentials of the coalitions that lack one of its members, over its size; what a filter adds
to the grand potential is its Shapley value. Kept and removed rows of each step of an order are differences of
coalitions.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
ORDERS = math.factorial(len(FILTERS))
#: Parts over which rows without an id are dealt in the join with labels; they match none.
SALTS = 256
#: Thresholds: fewest words, percent of distinct words, percent of capitals.
WORDS, DISTINCT, CAPITALS = 100, 80, 10


def failing(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with mask: the bits of the filters A to D that the text fails; E needs the table."""
    text = F.col(text_col)
    # one kind of white space, so that words are split at a plain character
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    rows = rows.withColumn("_words", words).withColumn("_many", F.size("_words"))
    fails = (F.col("_many") < WORDS, 100 * F.size(F.array_distinct("_words")) < DISTINCT * F.col("_many"), 100 * capitals > CAPITALS * F.length(text), text.rlike("[#$%&*|]"))
    return rows.withColumn("mask", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")).drop("_words", "_many")


def counted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows, rows of quality 1 and toxic rows of each part and set of failed filters: part, mask, n, good, toxic."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = failing(rows, "text").withColumn("digest", F.unhex(F.sha2("text", 256))).drop("text")
    # rows without an id match no label, and are dealt out
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    kinds = ["digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    # copies fall together before they meet by digest: by id first, for of equal texts all rows of the smallest id stay
    of_id = rows.groupBy(*kinds, "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    of_kind = of_id.groupBy("digest", "part", "mask", "good", "toxic").agg(first, F.sum("n").alias("n"))
    of_text = Window.partitionBy("digest")
    leads = F.col("first.id").eqNullSafe(F.min(F.struct("first.none", "first.id")).over(of_text)["id"])
    of_kind = of_kind.withColumn("leading", F.when(leads, F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("leading").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("leading")).alias("n")))).alias("x")
    return of_kind.select("part", "good", "toxic", both).groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def potentials(value: Column) -> Column:
    """Potentials of all coalitions, times the number of orders, from the array of their values: exact in whole numbers."""

    def of(found: Column, s: Column) -> Column:
        less = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(found, s - (1 << i))).otherwise(0) for i in range(len(FILTERS))), F.lit(0))
        return F.concat(found, F.array(F.call_function("div", F.get(value, s) * ORDERS + less, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(COALITIONS - 1)), F.array(F.lit(0).cast("long")), of)


def coalitions(counts: DataFrame) -> DataFrame:
    """A row per part: total, and arrays over all coalitions of removed rows, and of good and toxic ones among them, and potentials."""
    each = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(COALITIONS - 1))).alias("s"))
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    value = each.groupBy("part", "s").agg(F.sum("n").alias("total"), *(F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")))
    packed = value.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("v"))
    out = packed.select("part", "total", F.transform("v", lambda x: x["n"]).alias("removed"), F.transform("v", lambda x: x["good"]).alias("good"), F.transform("v", lambda x: x["toxic"]).alias("toxic"))
    return out.withColumn("potential", potentials(F.col("removed")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row fails A with under 100 words, B with under 80 % distinct words, C with over 10 % capitals, D with one of
    #$%&*|, E if a smaller id of the table has the same text. shapley is what the step's filter removes, summed
    over all orders. Null texts count as empty, which fail A; a null part is the empty one; null ids are larger than
    all others and equal to each other, so of rows that repeat the smallest id of a text none fails E. Of labels
    that repeat an id any that says 1 counts; null labels say nothing. Texts of any length are judged whole. Without rows
    there are no parts, and the result is empty. Further columns, whatever their names, play no part.
    """
    c = coalitions(counted(docs, labels, id_col, text_col, part_col))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))).alias("filter_order")
    steps = c.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    letters = F.transform(F.sequence(F.lit(1), F.col("step")), lambda i: bit(F.substr("filter_order", i, F.lit(1))))
    steps = steps.withColumn("own", bit(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("upto", F.aggregate(letters, F.lit(0), lambda a, x: a + x)).withColumn("before", F.col("upto") - F.col("own"))
    at = lambda array, s: F.get(array, s).cast("long")
    step = lambda array: at(array, F.col("upto")) - at(array, F.col("before"))
    every = F.lit(COALITIONS - 1)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - at("removed", F.col("upto"))).alias("kept"), step("removed").alias("removed"), (at("removed", F.col("own")) - step("removed")).alias("redundant"),
        (at("removed", every) - at("removed", every - F.col("own"))).alias("unique_fails"), step("good").alias("good_lost"), step("toxic").alias("toxic_lost"), (at("potential", every) - at("potential", every - F.col("own"))).alias("shapley"),
    )
