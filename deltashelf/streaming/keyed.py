"""Streams with keyed state: each listing's last observation, and the evidence of stories as it comes and goes."""

from __future__ import annotations

import contextlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.identity import content_hash
from ..operators import diff, rules, state
from ..operators import stories as told
from ..schema import OBSERVATION_FIELDS, SEVERITY_RULES, Rule, StoryRule

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """While it lasts, streams that start keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ---- listings


class Previous(StatefulProcessor):
    """Gives each observation of a key with the one before it, of which the last is all that is kept.

    Observations that are not after the last are repeats if equal to it, and late ones else. A key's observations of one
    micro-batch are ordered in memory; how much that is, the source's limits for a batch say.
    """

    def __init__(self, key: str, order: Sequence[str], kept: str):
        self.key, self.order, self.kept = key, tuple(order), kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        at = lambda r: tuple(r[c] for c in self.order)
        last = None
        if self.last.exists():
            *when, record = self.last.get()
            last = (tuple(when), record)
        first = last
        for row in sorted(rows, key=at):
            here = (at(row), row["record"])
            late = last is not None and here[0] <= last[0]
            if late and here[0] == last[0]:
                continue
            yield Row(**{self.key: key[0]}, **{c: row[c] for c in self.order}, old=None if late or last is None else last[1], record=row["record"], late=late)
            if not late:
                last = here
        if last is not first:
            self.last.update((*last[0], last[1]))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: N802
        self.last.update((*(initialState[c] for c in self.order), initialState["record"]))

    def close(self) -> None:
        pass


ZERO = "timestamp_ntz'1970-01-01'"


def _number(c: str, kind: T.DataType) -> F.Column:
    """Times and days as numbers, which state keeps and compares whatever the zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(ZERO), F.col(c))
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.unix_date(c) if isinstance(kind, T.DateType) else F.col(c)


def _moment(c: str, kind: T.DataType) -> F.Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", F.col(c), F.expr(ZERO))
    return F.timestamp_micros(c) if isinstance(kind, T.TimestampType) else F.date_from_unix_date(c) if isinstance(kind, T.DateType) else F.col(c)


def with_previous(stream: DataFrame, listing: str = "product_key", order: Sequence[str] = ("captured_at", "seq"), record: str = "record", known: DataFrame | None = None) -> DataFrame:
    """A stream of observations with the one before each, as JSON: listing, order, old, record, late.

    known holds observations from before the stream began, of which each listing's last counts; it is read when a
    checkpoint is new.
    """
    kinds = {c: stream.schema[c].dataType for c in order}
    packed = lambda rows: rows.select(listing, *(_number(c, kinds[c]).alias(c) for c in order), F.to_json(record).alias("record"))
    rows = packed(stream)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = ", ".join(f"{c} {fields[c]}" for c in (*order, "record"))
    schema = f"{listing} {fields[listing]}, {', '.join(f'{c} {fields[c]}' for c in order)}, old string, record string, late boolean"
    first = None if known is None else packed(state.latest(known, [listing], [F.desc(c) for c in order])).groupBy(listing)
    out = rows.groupBy(listing).transformWithState(Previous(listing, order, kept), schema, "Update", "None", initialState=first)
    return out.select(listing, *(_moment(c, kinds[c]).alias(c) for c in order), "old", "record", "late")


def changes(pairs: DataFrame, record: T.StructType, listing: str = "product_key", order: Sequence[str] = ("captured_at", "seq"), severities: Sequence[Rule] = SEVERITY_RULES) -> tuple[DataFrame, DataFrame]:
    """Of observations with those before them: the snapshots whose content is new, and the events."""
    both = pairs.filter("not late").select(listing, *order, F.from_json("old", record).alias("old"), F.from_json("record", record).alias("record"))
    fields = sorted(f.name for f in record if f.name not in OBSERVATION_FIELDS)
    digest = lambda r: content_hash(F.struct(*(F.col(f"{r}.{n}").alias(n) for n in fields)))
    both = both.withColumn("content_hash", digest("record"))
    fresh = both.filter(F.col("old").isNull() | (digest("old") != F.col("content_hash"))).drop("old")
    events = both.select(listing, *order, F.explode(diff.events(F.col("old"), F.col("record"))).alias("e")).select(listing, *order, "e.*")
    names = ("change_type", "field", "unseen_component", "direction", "magnitude_pct")
    return fresh, events.withColumn("severity", rules.severity({n: F.col(n) for n in names}, severities))


def catch_up(spark: SparkSession, source: str, schema: T.StructType, tables, checkpoint: str, listing: str = "product_key", order: Sequence[str] = ("captured_at", "seq"), known: DataFrame | None = None, most_files: int = 1000) -> None:
    """Applies all files that no run has read yet: appends snapshots, events and late observations per batch, and ends.

    A batch that runs again replaces its own parts, so nothing is told twice. most_files bounds a batch.
    """

    def apply(pairs: DataFrame, batch: int) -> None:
        pairs.persist()
        try:
            fresh, events = changes(pairs, schema["record"].dataType, listing, order)
            for name, rows in (("snapshots", fresh), ("events", events), ("late", pairs.filter("late"))):
                tables.put(name, rows, batch)
        finally:
            pairs.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    with keyed_state(spark):
        with_previous(stream, listing, order, known=known).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---- stories

#: Microseconds.
MILLI, DAY = 1_000, 86_400_000_000


class Evidence(StatefulProcessor):
    """Per rule and key: each manufacturer's events inside the window, by day, and the first of them.

    Now is the latest time that any event has had, which the watermark tells. A timer stands at the time
    at which the earliest first event leaves the window; then the manufacturer's next event is looked for, day by day.
    """

    def __init__(self, windows: dict[str, int], delay_days: int):
        self.windows, self.delay = windows, delay_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "manufacturer string, day int", "at array<long>")
        self.firsts = handle.getMapState("firsts", "manufacturer string", "first long, latest long")
        self.said = handle.getValueState("said", "step long, n long, last_timer long")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() * MILLI + self.delay * DAY

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        since = self._now(timerValues) - self.windows[key[0]] * DAY
        found: dict[tuple[str, int], list] = {}
        for r in rows:
            if r.at >= since:
                found.setdefault((r.manufacturer, r.at // DAY), []).append(r.at)
        for place, new in found.items():
            old = self.days.getValue(place)[0] if self.days.containsKey(place) else []
            # of events at one time one suffices
            self.days.updateValue(place, (sorted({*old, *new}),))
            name = (place[0],)
            first, latest = self.firsts.getValue(name) if self.firsts.containsKey(name) else (new[0], new[0])
            self.firsts.updateValue(name, (min(first, *new), max(latest, *new)))
        yield from self._told(key, since)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield from self._told(key, self._now(timerValues) - self.windows[key[0]] * DAY)

    def _told(self, key: tuple, since: int) -> Iterator[Row]:
        firsts = {}
        for name, (first, latest) in list(self.firsts.iterator()):
            if first < since:
                first = self._next(name[0], first, latest, since)
                if first is None:
                    self.firsts.removeKey(name)
                    continue
                self.firsts.updateValue(name, (first, latest))
            firsts[name[0]] = first
        step, n, timer = self.said.get() if self.said.exists() else (0, 0, -1)
        if timer >= 0:
            self.handle.deleteTimer(timer)
            timer = -1
        if firsts:
            gone = min(firsts.values()) + (self.windows[key[0]] - self.delay) * DAY
            timer = max(0, gone // MILLI)
            self.handle.registerTimer(timer)
        if firsts or n:
            yield Row(rule_id=key[0], key=key[1], step=step + 1, n_manufacturers=len(firsts), manufacturers=",".join(sorted(firsts)), first_at=min(firsts.values(), default=None), last_at=max(firsts.values(), default=None))
            self.said.update((step + 1, len(firsts), timer))
        elif self.said.exists():
            self.said.update((step, 0, timer))

    def _next(self, name: str, first: int, latest: int, since: int) -> int | None:
        """The manufacturer's first event inside the window; days before it are forgotten."""
        for day in range(first // DAY, latest // DAY + 1):
            place = (name, day)
            if not self.days.containsKey(place):
                continue
            at = list(self.days.getValue(place)[0])
            left = at[bisect_left(at, since) :]
            if left:
                if len(left) < len(at):
                    self.days.updateValue(place, (left,))
                return left[0]
            self.days.removeKey(place)
        return None

    def close(self) -> None:
        pass


def evidence_stream(events: DataFrame, story_rules: Sequence[StoryRule]) -> DataFrame:
    """A stream of events as that of what each rule and key now shows; of the rows of one, the largest step counts."""
    enabled = [r for r in story_rules if r.enabled]
    delay = max(r.window_days for r in enabled)
    rows = told.matching(events.withColumn("detected_at", F.col("detected_at").cast("timestamp")).withWatermark("detected_at", f"{delay} days"), enabled, timed=True)
    rows = rows.select("rule_id", "key", "manufacturer", "detected_at", F.unix_micros("detected_at").alias("at"))
    schema = "rule_id string, key string, step long, n_manufacturers long, manufacturers string, first_at long, last_at long"
    out = rows.groupBy("rule_id", "key").transformWithState(Evidence({r.id: r.window_days for r in enabled}, delay), schema, "Update", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_at", "last_at")})


def follow_stories(spark: SparkSession, source: str, schema: T.StructType, story_rules: Sequence[StoryRule], tables, checkpoint: str, most_files: int = 1000, prepare=lambda rows: rows) -> None:
    """Reads all files of events that no run has read yet and appends what stories become, per batch.

    Late events count as long as they lie inside the window.
    """
    stream = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source))
    with keyed_state(spark):
        evidence_stream(stream, story_rules).writeStream.foreachBatch(lambda rows, batch: tables.put("stories", rows, batch)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_stories(tables, story_rules: Sequence[StoryRule]) -> DataFrame:
    """The stories that are told now, as stories.detect gives them."""
    last = state.latest(tables.read("stories"), ["rule_id", "key"], [F.desc("step")]).drop("step", "batch")
    return told.scored(last, story_rules)
