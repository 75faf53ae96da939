"""State tables: append with dedup, upserts, flags. Each operator maps the table and what came in to the new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRANSITIONS


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by a total order."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rn", at).filter("_rn = 1").drop("_rn")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep-first dedup by a total order."""
    return latest(rows, key, [F.col(c).asc() for c in order])


def new_rows(incoming: DataFrame, table: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: of the incoming rows the first of each key that the table lacks."""
    return keep_first(incoming, key, order).join(table.select(*key), list(key), "left_anti")


def touched(observations: DataFrame, key: str, at: str) -> DataFrame:
    """First and last time each key was seen."""
    return observations.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_seen"))


def upsert(table: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last writer wins: incoming rows over the table's of the same key."""
    both = table.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.col("_new").desc(), *(F.col(c).desc() for c in order)]).drop("_new")


def change_kind(incoming: DataFrame, table: DataFrame, key: Sequence[str], hash_col: str) -> DataFrame:
    """new, updated or unchanged, by whether the key is known and its content hash equal."""
    known = table.select(*key, F.col(hash_col).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col(hash_col), "unchanged").otherwise("updated")
    return incoming.join(known, list(key), "left").withColumn("change_kind", kind).drop("_known")


def fresh_snapshots(observations: DataFrame, listing: str, hash_col: str, order: Sequence[str]) -> DataFrame:
    """Observations whose content differs from the listing's previous one: what is appended; the rest only touch."""
    before = F.lag(hash_col).over(Window.partitionBy(listing).orderBy(*order))
    return observations.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(hash_col))).drop("_before")


def demoted(notifications: DataFrame, in_story: DataFrame, key: str = "product_key") -> DataFrame:
    """Pending notifications of products that a story tells become demoted."""
    flags = in_story.select(key).distinct().withColumn("_story", F.lit(True))
    status = F.when(F.col("_story") & (F.col("status") == "pending"), "demoted").otherwise(F.col("status"))
    return notifications.join(flags, key, "left").withColumn("status", status).drop("_story")


def marked(outbox: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Delivery results (id, result, at): attempts plus one, sent_at only when sent."""
    both = outbox.join(results.select(key, F.col("result").alias("_result"), F.col("at").alias("_at")), key, "left")
    hit = F.col("_result").isNotNull()
    return both.withColumn("attempts", F.col("attempts") + hit.cast("int")).withColumn("sent_at", F.when(F.col("_result") == "sent", F.col("_at")).otherwise(F.col("sent_at"))).withColumn("status", F.coalesce("_result", "status")).drop("_result", "_at")


def enqueued(events: DataFrame, outbox: DataFrame, min_severity: int, quiet_baseline: bool = True) -> DataFrame:
    """New outbox rows, each dedup key once for ever: below the severity gate, or of a baseline, they are suppressed, but kept."""
    quiet = (F.lit(quiet_baseline) & F.coalesce("baseline", F.lit(False))) | ~F.coalesce(F.col("severity") >= min_severity, F.lit(False))
    rows = events.withColumn("status", F.when(quiet, "suppressed").otherwise("pending")).withColumn("attempts", F.lit(0))
    return new_rows(rows, outbox, ["dedup_key"], ["detected_at", "id"])


def review_state(history: DataFrame) -> DataFrame:
    """The current review of each alert: the last of its history by (changed_at, id)."""
    return latest(history, ["alert_id"], [F.col("changed_at").desc(), F.col("id").desc()])


def legal(current: Column, new: Column, steps: Mapping[str, Sequence[str]] = TRANSITIONS) -> Column:
    """Whether a status may become another; a missing one may not."""
    ok = F.lit(False)
    for a, targets in steps.items():
        ok = ok | ((current == a) & new.isin(*targets)) if targets else ok
    return F.coalesce(ok, F.lit(False))


def checked_transition(current: Column, new: Column, steps: Mapping[str, Sequence[str]] = TRANSITIONS) -> Column:
    """The new status, or an error where the step is not allowed."""
    return F.when(legal(current, new, steps), new).otherwise(F.raise_error(F.concat(F.lit("illegal status change "), F.coalesce(current, F.lit("null")), F.lit(" to "), F.coalesce(new, F.lit("null")))).cast("string"))


def merged_suggestions(table: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates by fingerprint over stored suggestions: refreshed while PROPOSED, left alone otherwise, new ones PROPOSED."""
    a, b = table.alias("t"), candidates.alias("c")
    both = a.join(b, F.col("t.fingerprint") == F.col("c.fingerprint"), "full_outer")
    refresh = F.col("t.fingerprint").isNull() | ((F.col("t.status") == "PROPOSED") & F.col("c.fingerprint").isNotNull())
    pick = lambda n: F.when(refresh, F.col(f"c.{n}")).otherwise(F.col(f"t.{n}")).alias(n)
    names = [n for n in candidates.columns if n != "fingerprint"]
    action = F.when(F.col("t.fingerprint").isNull(), "inserted").when(F.col("c.fingerprint").isNull(), "kept").when(F.col("t.status") == "PROPOSED", "updated").otherwise("left")
    return both.select(F.coalesce("t.fingerprint", "c.fingerprint").alias("fingerprint"), *map(pick, names), F.coalesce("t.status", F.lit("PROPOSED")).alias("status"), action.alias("action"))


def seen_components(components: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Discovered components become seen: those named, or all."""
    hit = F.col("source") == "discovered"
    if names is not None:
        hit = hit & F.col("canonical_name").isin(list(names))
    return components.withColumn("changed", hit).withColumn("source", F.when(hit, "seen").otherwise(F.col("source")))


def delta_state(table: DataFrame, incoming: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Items ever seen with first and last time, after a run that succeeded."""
    rows = table.select(*key, "first_seen", "last_seen").unionByName(incoming.select(*key, F.col(at).alias("first_seen"), F.col(at).alias("last_seen")))
    return rows.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def audit(tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Row counts per table, and rows whose reference (table, column, table, column) leads nowhere: (check, n)."""
    out = None
    for name, t in tables.items():
        row = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"rows:{name}").alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    for child, column, parent, target in references:
        lost = tables[child].filter(F.col(column).isNotNull()).join(tables[parent].select(F.col(target).alias(column)), column, "left_anti")
        out = out.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"orphans:{child}.{column}").alias("check"), "n"))
    return out


def compared(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts against a manifest: equal, changed, missing, added."""
    both = now.withColumnRenamed("n", "now").join(manifest.withColumnRenamed("n", "then"), "check", "full_outer")
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("then"), "equal").otherwise("changed")
    return both.withColumn("state", state)


def digests(files: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of files read as binaryFile, each of which must fit a row (2 GB)."""
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def empty_tables(counts: DataFrame) -> DataFrame:
    """The tables that an audit found without rows: table."""
    return counts.filter(F.col("check").startswith("rows:") & (F.col("n") == 0)).select(F.substring_index("check", ":", -1).alias("table"))


def _linked(spans: DataFrame, shift: int) -> DataFrame:
    """lo, hi of disjoint spans with the end of the one before and the start of the one after."""
    whole = shift >= 64
    group = F.lit(0) if whole else F.shiftright("lo", shift)
    w = Window.partitionBy("group").orderBy("lo", "hi")
    rows = spans.withColumn("group", group).withColumn("prev", F.lag("hi").over(w)).withColumn("next", F.lead("lo").over(w))
    if whole:
        return rows.drop("group")
    above = _linked(spans.groupBy(group.alias("group")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), shift + 16)
    above = above.select(F.shiftright("lo", shift).alias("group"), F.col("prev").alias("before"), F.col("next").alias("after"))
    return rows.join(above, "group", "left").select("lo", "hi", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def neighbours(rows: DataFrame, key: str) -> DataFrame:
    """Each key (a whole number, never null) with the previous and next one of the whole table: key, prev_id, next_id.

    Windows hold at most 2^16 numbers each; their first and last keys are linked in turn, so no task takes the table.
    """
    ids = rows.select(F.col(key).cast("long").alias("lo"))
    return _linked(ids.withColumn("hi", F.col("lo")), 16).select(F.col("lo").alias(key), F.col("prev").alias("prev_id"), F.col("next").alias("next_id"))


def content_digest(rows: DataFrame, name: str) -> DataFrame:
    """One row: table, n, digest and schema of a table's content, whatever the order of its rows and columns or the files they lie in.

    Each row is hashed by SHA-256 as JSON with its columns by name; the digest is the number of rows and the sums of the hashes'
    quarters. Equal rows count as often as they stand. Maps, whose entries have no order, are refused.
    """
    columns = sorted(rows.columns)
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}), 256)
    quarter = lambda i: F.sum(F.conv(F.substring("_row", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"q{i}")
    sums = rows.select(row.alias("_row")).agg(F.count(F.lit(1)).alias("n"), *(quarter(i) for i in range(4)))
    if any("map<" in f.dataType.simpleString() for f in rows.schema):
        raise ValueError(f"{name} has a map, which has no order")
    schema = ",".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    parts = [F.coalesce(F.col(f"q{i}"), F.lit(0)).cast("string") for i in range(4)]
    return sums.select(F.lit(name).alias("table"), "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *parts), 256).alias("digest"), F.lit(schema).alias("schema"))


def manifest_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What an archive of these tables claims: table, n, digest, schema."""
    out = None
    for name, rows in tables.items():
        one = content_digest(rows, name)
        out = one if out is None else out.unionByName(one)
    return out


def archive_problems(tables: Mapping[str, DataFrame], manifest: DataFrame, references: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """What of an archive differs from its manifest: table, problem (missing, added, schema, rows, content or orphans). No row: it is what it claims to be."""
    now = manifest_of(tables).select("table", F.struct("n", "digest", "schema").alias("now"))
    both = now.join(manifest.select("table", F.struct("n", "digest", "schema").alias("then")), "table", "full_outer")
    differs = lambda f: F.col(f"now.{f}") != F.col(f"then.{f}")
    found = F.when(F.col("now").isNull(), F.array(F.lit("missing"))).when(F.col("then").isNull(), F.array(F.lit("added"))).otherwise(F.array_compact(F.array(F.when(differs("schema"), "schema"), F.when(differs("n"), "rows"), F.when(~differs("n") & differs("digest"), "content"))))
    out = both.select("table", F.explode(found).alias("problem"))
    for child, column, parent, target in references:
        orphans = tables[child].filter(F.col(column).isNotNull()).join(tables[parent].select(F.col(target).alias(column)), column, "left_anti").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(orphans.filter("n > 0").select(F.lit(child).alias("table"), F.lit("orphans").alias("problem")))
    return out


def dealt_budget(items: DataFrame, budget: int, source: str = "source", key: str = "key", order: Sequence[str] = ("pos",), priority: str = "priority", limit: str | None = None) -> DataFrame:
    """The items that a run's budget reaches: dealt in rounds, one item a source and round, sources by priority (larger first) and name.

    Of items that repeat a source's key the first by order counts; items without a key are passed over; limit names a column with the
    source's own most (null: none). Adds round and turn (1, 2, ...). The ranks before the exchange keep no more than the budget's items of a source
    in a task, and the last choice is the top of the parts' tops, so no task takes a source or the table.
    """
    rows = keep_first(items.filter(F.col(key).isNotNull()), [source, key], list(order))
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order, key))
    most = F.lit(budget) if limit is None else F.least(F.lit(budget), F.coalesce(F.col(limit).cast("int"), F.lit(budget)))
    rows = rows.withColumn("round", nth).filter(F.col("round") <= budget).filter(F.col("round") <= most)
    top = rows.orderBy("round", F.desc_nulls_last(priority), F.asc_nulls_last(source)).limit(budget)
    turn = F.row_number().over(Window.orderBy("round", F.desc_nulls_last(priority), F.asc_nulls_last(source)))
    return top.withColumn("turn", turn)
