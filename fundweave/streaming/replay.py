"""Ordered replay of broker partitions: contiguous offsets, idempotent retries, poison barrier."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fundweave.shared import staged
from fundweave.streaming.envelopes import CONFLICT, INVALID_SCHEMA, LATE, NON_CONTIGUOUS, QUARANTINE
from fundweave.streaming.pages import Pages

ACCEPTED, NOOP, SKIPPED = "ACCEPTED", "NOOP", "SKIPPED"


#: What a call needs to know of earlier ones; clock is the latest event time taken.
OFFSETS = "topic string, partition int, next_offset long, clock timestamp"
EVENTS = "event_id string, topic string, partition int, offset long, payload_hash string, event_time timestamp"
_KEYS = ["topic", "partition"]
#: Offsets of a block within which the clock is a running maximum; one row a block carries it on.
_BLOCK = 1 << 16


def _with_clock(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _clock: the latest event time of the partition's rows before, the initial clock included."""
    block = F.floor(F.col("offset") / _BLOCK)
    before = lambda *keys: Window.partitionBy(*keys)
    rows = rows.withColumn("_block", block)
    blocks = rows.groupBy(*_KEYS, "_block").agg(F.max("event_time").alias("_latest"))
    upto = before(*_KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*_KEYS, "_block", F.max("_latest").over(upto).alias("_before"))
    inside = before(*_KEYS, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = rows.withColumn("_inside", F.max("event_time").over(inside)).join(blocks, [*_KEYS, "_block"])
    return j.withColumn("_clock", F.greatest("_inside", "_before", "clock")).drop("_inside", "_before", "_block")


def replay_batch(parsed: DataFrame, initial: DataFrame | None = None, events: DataFrame | None = None, lateness: str | None = None) -> DataFrame:
    """parsed records (see parse_envelope) with status, for records in order of offset and time.

    A record that cannot be taken is quarantined and halts its partition: what follows is
    SKIPPED. Order of checks: the payload; with lateness (an interval) an event older than
    the partition's clock less that is LATE_EVENT, which is quarantined without a halt and
    uses up its offset; a known event id is NOOP at the same coordinates with the same
    canonical hash, else CONFLICT; another offset than the next is NON_CONTIGUOUS_OFFSET.

    initial (OFFSETS; clock may be absent) is where each partition starts, 0 where it is
    absent; events (EVENTS) are those that earlier calls have taken. Both come from
    replay_state(). Event ids known from there hold for all partitions.

    No partition is folded in one task: a record fails by itself, by its predecessor (the
    offset before it is absent: a join), or by the record that had its event id before (a
    window an event id); the least failing place of a partition then decides for all.
    """
    place = ["offset", "timestamp", "raw_hash", "_copy"]
    copies = Window.partitionBy(*_KEYS, "offset", "timestamp", "raw_hash").orderBy(F.lit(0))
    p = parsed.withColumn("_copy", F.row_number().over(copies))
    start = initial if initial is not None else parsed.select(*_KEYS).distinct().withColumn("next_offset", F.lit(0).cast("long"))
    if "clock" not in start.columns:
        start = start.withColumn("clock", F.lit(None).cast("timestamp"))
    p = p.join(start.select(*_KEYS, "next_offset", "clock"), _KEYS, "left").fillna(0, ["next_offset"])
    if lateness:
        p = _with_clock(p, place).withColumn("_horizon", F.col("_clock") - F.expr(f"interval {lateness}"))
    else:
        p = p.withColumn("_horizon", F.lit(None).cast("timestamp"))
    late = F.col("valid") & F.coalesce(F.col("event_time") < F.col("_horizon"), F.lit(False))
    p = p.withColumn("_late", late)
    here = F.struct("offset", "payload_hash")
    # The record that had the id before: among valid ones in time, the one before in this call, or one of an earlier call.
    named = F.when(F.col("valid") & ~F.col("_late"), F.col("event_id"))
    same_id = Window.partitionBy(*_KEYS, named).orderBy(*place)
    known = F.when(named.isNotNull(), F.lag(F.struct(here.alias("h"), F.col("event_time").alias("t"))).over(same_id))
    p = p.withColumn("_known", known).withColumn("_known", F.when(F.coalesce(F.col("_known.t") < F.col("_horizon"), F.lit(False)), F.lit(None)).otherwise(F.col("_known")))
    if events is not None:
        # A row an id and a row a place, so that an id which several partitions have taken does not repeat the record.
        kept = F.coalesce(F.col("event_time"), F.lit("9999-12-31").cast("timestamp"))
        there = [*_KEYS, "offset", "payload_hash"]
        events = staged(events.select("event_id", *there, "event_time"), "known-events")
        anywhere = events.groupBy("event_id").agg(F.max(kept).alias("_old_time"))
        at_place = events.groupBy("event_id", *there).agg(F.max(kept).alias("_same_time"))
        p = p.join(anywhere, "event_id", "left").join(at_place, ["event_id", *there], "left")
    else:
        p = p.withColumns({c: F.lit(None).cast("timestamp") for c in ("_old_time", "_same_time")})
    stands = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.col(c) < F.col("_horizon"), F.lit(False))
    has_id = F.col("_known").isNotNull() | stands("_old_time")
    retry = F.when(F.col("_known").isNotNull(), F.col("_known.h") == here).otherwise(stands("_same_time"))
    new = F.col("valid") & ~has_id
    p = p.withColumn("_new", new).withColumn("_retry", retry)
    taken = p.where(F.col("_new") & (F.col("offset") >= F.col("next_offset")))
    before = taken.select(*_KEYS, (F.col("offset") + 1).alias("offset"), F.lit(True).alias("_has")).distinct()
    p = p.join(before, [*_KEYS, "offset"], "left")
    first = F.row_number().over(Window.partitionBy(*_KEYS, "offset", "_new").orderBy(*place)) == 1
    p = p.withColumn("_first", first)
    follows = (F.col("offset") == F.col("next_offset")) | ((F.col("offset") > F.col("next_offset")) & F.col("_has").isNotNull())
    beyond = (F.col("offset") > F.col("next_offset")) & F.col("_has").isNull()
    status = (
        F.when(~F.col("valid"), INVALID_SCHEMA).when(F.col("_late"), F.when(beyond, NON_CONTIGUOUS).otherwise(LATE))
        .when(has_id, F.when(F.col("_retry"), NOOP).otherwise(CONFLICT)).when(follows & F.col("_first"), ACCEPTED).otherwise(NON_CONTIGUOUS)
    )
    p = p.withColumn("_status", status).withColumn("_at", F.struct(*place))
    fail = p.where(F.col("_status").isin(INVALID_SCHEMA, CONFLICT, NON_CONTIGUOUS)).groupBy(*_KEYS).agg(F.min("_at").alias("_fail"))
    out = p.join(fail, _KEYS, "left")
    return out.select(*parsed.columns, F.when(F.col("_at") > F.col("_fail"), SKIPPED).otherwise(F.col("_status")).alias("status"))


def committable_offsets(replayed: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """topic, partition, next_offset, partitions of the initial state included."""
    taken = F.when(F.col("status").isin(ACCEPTED, LATE), F.col("offset") + 1)
    n = replayed.groupBy("topic", "partition").agg(F.coalesce(F.max(taken), F.lit(0)).alias("next_offset"))
    if initial is not None:
        n = n.unionByName(initial.select("topic", "partition", "next_offset"))
    return n.groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))


def replay_state(
    replayed: DataFrame, initial: DataFrame | None = None, events: DataFrame | None = None, lateness: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(OFFSETS, EVENTS) after a call, for the next one; with lateness, without events that would be late."""
    clock = replayed.where(F.col("status").isin(ACCEPTED, NOOP, LATE)).groupBy(*_KEYS).agg(F.max("event_time").alias("clock"))
    if initial is not None and "clock" in initial.columns:
        clock = clock.unionByName(initial.select(*_KEYS, "clock")).groupBy(*_KEYS).agg(F.max("clock").alias("clock"))
    offsets = committable_offsets(replayed, initial).join(clock, _KEYS, "left")
    known = replayed.where(F.col("status") == ACCEPTED).select("event_id", *_KEYS, "offset", "payload_hash", "event_time")
    known = known if events is None else events.select(*known.columns).unionByName(known)
    if lateness:
        young = F.coalesce(F.col("event_time") >= F.col("clock") - F.expr(f"interval {lateness}"), F.lit(True))
        known = known.join(clock, _KEYS, "left").where(young).drop("clock")
        # An id that comes again after it was forgotten is the later event's.
        known = known.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in known.columns if c != "event_id"]), "offset").alias("e")).select("event_id", "e.*")
    return offsets, known


def quarantined(replayed: DataFrame) -> DataFrame:
    """Coordinates, reason and hash of the bytes of what was not taken."""
    q = replayed.where(F.col("status").isin(*QUARANTINE))
    return q.select("topic", "partition", "offset", F.col("status").alias("reason"), F.col("raw_hash").alias("payload_hash"))


def event_id_conflicts(parsed: DataFrame) -> DataFrame:
    """event_id, coordinates and first_* of records whose event id an earlier record has elsewhere.

    Earlier is by timestamp, topic, partition, offset.
    """
    at = F.struct("timestamp", "topic", "partition", "offset", "payload_hash")
    # Written whole before any filter, which would parse the payloads again for each use.
    parsed = staged(parsed.select("valid", "event_id", "timestamp", "topic", "partition", "offset", "payload_hash"), "parsed")
    first = parsed.where("valid").groupBy("event_id").agg(F.min(at).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    j = parsed.where("valid").join(first, "event_id")
    other = (F.col("topic") != F.col("f.topic")) | (F.col("partition") != F.col("f.partition")) | (F.col("offset") != F.col("f.offset")) | (F.col("payload_hash") != F.col("f.payload_hash"))
    return j.where(other).select("event_id", "topic", "partition", "offset", F.col("f.topic").alias("first_topic"), F.col("f.partition").alias("first_partition"), F.col("f.offset").alias("first_offset"))


REPLAYED = "topic string, partition int, offset long, event_id string, source_id string, target_id string, amount double, event_time timestamp, payload_hash string, raw_hash string, status string"


def _ms(times: pd.Series) -> pd.Series:
    """Milliseconds since the epoch, 0 of null."""
    return times.astype("datetime64[ms]").astype("int64").where(times.notna(), 0)


class Replay(StatefulProcessor):
    """One partition's cursor, clock, halt and known events, kept in the state store.

    With lateness (milliseconds) events older than the clock less that are late; what the
    clock has left behind is forgotten, so that the state holds the events of one such span.
    """

    def __init__(self, lateness: int | None = None) -> None:
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "next_offset long, halted boolean, clock long")
        self.seen = Pages(handle, "seen")  # offset, payload_hash, at

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A row a known event, or one with a null event id."""
        offset, clock = initialState["next_offset"].iloc[0], _ms(initialState["clock"]).iloc[0]
        self.cursor.update((int(offset), False, int(clock)))
        known = initialState[initialState["event_id"].notna()]
        self.seen.begin()
        for e, o, h, at in zip(known["event_id"], known["offset"], known["payload_hash"], _ms(known["event_time"]), strict=True):
            self.seen.put(e, {"offset": int(o), "payload_hash": h, "at": int(at)})
        self.seen.end()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following, halted, clock = self.cursor.get() if self.cursor.exists() else (0, False, 0)
        # A trigger's records of a partition; the source bounds them by its rows or files a trigger.
        batch = pd.concat(list(rows)).sort_values(["offset", "timestamp", "raw_hash"], kind="stable")
        status, began = [], clock
        self.seen.begin()
        for r, at in zip(batch.itertuples(index=False), _ms(batch["event_time"]).tolist(), strict=True):
            horizon = clock - self.lateness if self.lateness is not None and clock else None
            clock = max(clock, at) if not halted and r.valid else clock
            if halted:
                status.append(SKIPPED)
                continue
            if not r.valid:
                halted = True
                status.append(INVALID_SCHEMA)
                continue
            if horizon is not None and at < horizon:
                halted = r.offset > following
                following += r.offset == following
                status.append(NON_CONTIGUOUS if halted else LATE)
                continue
            known = self.seen.get(r.event_id)
            if known is not None and not (horizon is not None and known["at"] < horizon):
                same = known["offset"] == r.offset and known["payload_hash"] == r.payload_hash
                halted = not same
                status.append(NOOP if same else CONFLICT)
            elif r.offset != following:
                halted = True
                status.append(NON_CONTIGUOUS)
            else:
                self.seen.put(r.event_id, {"offset": int(r.offset), "payload_hash": r.payload_hash, "at": at})
                following += 1
                status.append(ACCEPTED)
        self.cursor.update((int(following), bool(halted), int(clock)))
        if self.lateness is not None and clock > began:
            for e in [k for k, v in self.seen.items() if v["at"] < clock - self.lateness]:
                self.seen.remove(e)
        self.seen.end()
        names = [c.split()[0] for c in REPLAYED.split(", ")][:-1]
        out = batch[names].reset_index(drop=True)
        out["status"] = status
        yield out

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, interval: str | None) -> int | None:
    if interval is None:
        return None
    return int(spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}"))).first()[0])


def replay_stream(parsed: DataFrame, initial: DataFrame | None = None, events: DataFrame | None = None, lateness: str | None = None) -> DataFrame:
    """replay_batch() on a stream. A halt stays, over batches, until the state is reset.

    initial and events are what a new query begins with; events of other partitions are not
    compared (conflict_stream() does that).
    """
    begin = None
    if initial is not None or events is not None:
        state = initial if initial is not None else events.select(*_KEYS).distinct().withColumn("next_offset", F.lit(0).cast("long"))
        if "clock" not in state.columns:
            state = state.withColumn("clock", F.lit(None).cast("timestamp"))
        if events is None:
            events = parsed.sparkSession.createDataFrame([], EVENTS)
        begin = staged(state.join(events.select("event_id", *_KEYS, "offset", "payload_hash", "event_time"), _KEYS, "left"), "replay-state").groupBy(*_KEYS)
    return parsed.groupBy(*_KEYS).transformWithStateInPandas(
        statefulProcessor=Replay(_milliseconds(parsed.sparkSession, lateness)), outputStructType=REPLAYED, outputMode="Append", timeMode="None", initialState=begin
    )


_SEEN = "map<string, struct<offset: bigint, payload_hash: string, at: bigint>>"


def stored_state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(OFFSETS, EVENTS) that a stopped replay_stream() query has left in its checkpoint."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    at = lambda c: F.when(F.col(c) > 0, F.timestamp_millis(c))
    offsets = read("cursor").select("key.topic", "key.partition", "value.next_offset", "value.clock")
    events = read("seen").select("key.topic", "key.partition", F.explode(F.from_json("user_map_value.ids", _SEEN)).alias("event_id", "e"))
    events = events.select("event_id", "topic", "partition", "e.offset", "e.payload_hash", "e.at")
    return offsets.withColumn("clock", at("clock")), events.withColumn("event_time", at("at")).drop("at")


CONFLICTS = "event_id string, topic string, partition int, offset long, first_topic string, first_partition int, first_offset long, reason string"


_CONFLICT_NAMES = [c.split()[0] for c in CONFLICTS.split(", ")]
_IN_TIME = ["timestamp", "topic", "partition", "offset"]


class FirstSeen(StatefulProcessor):
    """Where each event id of a bucket was seen first, for ever; other coordinates are conflicts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = Pages(handle, "first")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(_IN_TIME, kind="stable")  # a trigger's records of a bucket
        self.first.begin()
        out = []
        for r in batch.itertuples(index=False):
            at = [r.topic, int(r.partition), int(r.offset), r.payload_hash]
            first = self.first.get(r.event_id)
            if first is None:
                self.first.put(r.event_id, at)
            elif first != at:
                out.append((r.event_id, *at[:3], *first[:3], CONFLICT))
        self.first.end()
        yield pd.DataFrame(out, columns=_CONFLICT_NAMES)

    def close(self) -> None:
        pass


class FirstSeenInTime(StatefulProcessor):
    """Where an event id was seen first, until the watermark has passed its event; records below it are late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "topic string, partition int, offset long, payload_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        batch = pd.concat(list(rows)).sort_values(_IN_TIME, kind="stable")  # of one event id
        first = tuple(self.first.get()) if self.first.exists() else None
        out = []
        for r, ms in zip(batch.itertuples(index=False), _ms(batch["event_time"]).tolist(), strict=True):
            at = (r.topic, int(r.partition), int(r.offset), r.payload_hash)
            if ms < watermark:
                out.append((key[0], *at[:3], *(first or (None, -1, -1))[:3], LATE))
            elif first is None:
                first = at
                self.first.update(at)
                self.handle.registerTimer(ms + 1)
            elif first != at:
                out.append((key[0], *at[:3], *first[:3], CONFLICT))
        yield pd.DataFrame(out, columns=_CONFLICT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield pd.DataFrame([], columns=_CONFLICT_NAMES)

    def close(self) -> None:
        pass


def conflict_stream(parsed: DataFrame, lateness: str | None = None, buckets: int = 256) -> DataFrame:
    """event_id_conflicts() on a stream, with reason CONFLICT.

    With lateness (an interval) the stream has an event-time watermark: records below it are
    LATE_EVENT, and the state holds only ids whose events are not, each under its own key.
    Without it the ids are kept in buckets.
    """
    valid, processor, key = parsed.where("valid"), FirstSeen(), "_bucket"
    if lateness:
        processor, key = FirstSeenInTime(), "event_id"
        # The copy of the time carries no watermark, so that late rows are not dropped before they are seen.
        valid = valid.withWatermark("event_time", lateness)
        valid = valid.withColumn("_time", F.col("event_time") + F.expr("interval 0 seconds")).drop("event_time").withColumnRenamed("_time", "event_time")
    else:
        valid = valid.withColumn("_bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)))
    return valid.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=CONFLICTS, outputMode="Append", timeMode="EventTime" if lateness else "None"
    )


def use_rocksdb(spark) -> None:
    """The state store that processors with their own state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
