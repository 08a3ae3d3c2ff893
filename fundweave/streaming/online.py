"""Running account features, feedback, pins and counters of streams."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from fundweave.operators.evidence import PIN_SCHEMA, apply_pins, commands_of, ids_of
from fundweave.operators.features import account_features
from fundweave.shared import staged
from fundweave.streaming.envelopes import LATE, QUARANTINE
from fundweave.streaming.pages import Pages

HOUR_MS = 3_600_000


def online_account_features(edges: DataFrame) -> DataFrame:
    """account_features() of a stream of edges, in update or complete mode.

    The sums are Spark's own streaming aggregation on decimals, so they equal those of a
    batch over the same edges.
    """
    return account_features(edges)


class Sightings(StatefulProcessor):
    """What has been seen of the edge ids of a bucket: event time and batch of each sighting.

    With bounded state, edges below the watermark are late, and an id is forgotten once the
    watermark has passed the hour of its last sighting: a bucket's timer stands at the end of
    the earliest such hour.
    """

    def __init__(self, columns: list[str], bounded: bool) -> None:
        self.columns, self.bounded = columns, bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = Pages(handle, "seen")  # times, batches
        self.alarm = handle.getValueState("alarm", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() if self.bounded else None
        hours = set()
        self.seen.begin()
        for batch in rows:
            batch = batch.sort_values(["edge_id", "sighted_ms"], kind="stable")  # repeats within a batch come together
            late, earlier, now = [], [], int(batch["sighted_in"].iloc[0])
            for edge, ms in zip(batch["edge_id"].tolist(), batch["sighted_ms"].tolist(), strict=True):
                late.append(watermark is not None and ms < watermark)
                ident = "" if edge is None else f"={edge}"
                times, batches = self.seen.get(ident) or ((), ())
                earlier.append([{"ms": t, "batch": b} for t, b in zip(times, batches, strict=True)])
                if not late[-1]:
                    self.seen.put(ident, ([*times, ms], [*batches, now]))
                    hours.add(ms // HOUR_MS)
            yield batch[self.columns].assign(_late=late, _batch=now, _earlier=earlier).reset_index(drop=True)
        self.seen.end()
        if self.bounded and hours:
            self._wake((min(hours) + 1) * HOUR_MS)

    def _wake(self, at: int) -> None:
        """A timer at that time, unless an earlier one will come."""
        if not self.alarm.exists() or self.alarm.get()[0] > at:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.alarm.exists() and self.alarm.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.alarm.clear()
            watermark = timerValues.getCurrentWatermarkInMs()
            self.seen.begin()
            last = {e: (max(times) // HOUR_MS + 1) * HOUR_MS for e, (times, _) in self.seen.items()}
            for e in [e for e, ms in last.items() if ms <= watermark]:
                self.seen.remove(e)
                del last[e]
            self.seen.end()
            if last:
                self._wake(min(last.values()))
        yield pd.DataFrame([], columns=[*self.columns, "_late", "_batch", "_earlier"])

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, lateness: str | None = None, buckets: int = 256) -> DataFrame:
    """stream of edges with _late, _batch (its time) and _earlier (ms, batch) of the same id's sightings before."""
    columns, ms = stream.columns, F.unix_millis("event_time").alias("sighted_ms")
    if lateness:
        # The copy of the time carries no watermark, so that late rows are not dropped before they are seen.
        stream = stream.withWatermark("event_time", lateness)
        own = (F.col("event_time") + F.expr("interval 0 seconds")).alias("event_time")
        stream = stream.select(*[own if c == "event_time" else F.col(c) for c in columns])
    now = F.unix_millis(F.current_timestamp()).alias("sighted_in")  # a micro-batch has one time, also when it is run again
    rows = stream.select("*", ms, now, F.pmod(F.xxhash64("edge_id"), F.lit(buckets)).alias("_bucket"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=Sightings(columns, lateness is not None), outputMode="Append", timeMode="EventTime" if lateness else "None",
        outputStructType=f"{fields}, _late boolean, _batch long, _earlier array<struct<ms: bigint, batch: bigint>>",
    )


_MARK = "batch_time long, before_ms long, before_id string, after_ms long, after_id string"


def checked_edges(stream: DataFrame, path: str, checkpoint: str, lateness: str | None = None, buckets: int = 256):
    """Starts a durable append of edges that may enter running features; others go to rejected rows.

    path/accepted has the edges, path/rejected those with a reason: LATE_EVENT (with lateness,
    an interval: below the watermark), DUPLICATE_EDGE (the id was accepted before, or stands
    twice in the batch; the first by time stays) or NON_MONOTONIC_ORDER (at or below the
    greatest (event_time, edge_id) of the batches before). A batch writes to folders of its
    own id, so a repeated batch replaces what it wrote.

    Ids are looked up in keyed state and the greatest edge is one row a batch in path/marks,
    so a batch costs what it holds, whatever came before. Without lateness ids are kept for
    ever, with it as long as the watermark lets their events in.
    """
    spark, columns = stream.sparkSession, stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/marks/batch="
        before = spark.read.schema(_MARK).parquet(f"{at}{batch_id - 1}").first() if batch_id else None
        mark = (before.after_ms, before.after_id) if before else (None, None)
        batch = staged(batch, "checked-edges")
        now = batch.agg(F.max("_batch")).first()[0]
        here = F.struct(F.unix_millis("event_time").alias("ms"), F.col("edge_id").alias("id"))
        above = lambda edge, ms, name: ms.isNull() | (edge > F.struct(ms.alias("ms"), name.alias("id")))
        old_ms, old_id = F.lit(mark[0]).cast("long"), F.lit(mark[1]).cast("string")
        # An earlier sighting was let in, or one before it was, if it stood above the mark of its own batch.
        seen = batch.where(F.size("_earlier") > 0).select("edge_id", F.explode("_earlier").alias("e")).select("edge_id", "e.*").distinct()
        inside = seen.where(F.col("batch") == now).withColumn("before_ms", old_ms).withColumn("before_id", old_id)
        past = seen.where(F.col("batch") < now)
        if not past.isEmpty():
            marks = spark.read.schema(_MARK).parquet(f"{path}/marks").select(F.col("batch_time").alias("batch"), "before_ms", "before_id")
            inside = inside.unionByName(past.join(marks, "batch"))
        let_in = inside.where(above(F.struct("ms", F.col("edge_id").alias("id")), F.col("before_ms"), F.col("before_id")))
        let_in = let_in.select("edge_id", "ms", "batch").withColumn("s", F.struct("batch", "ms")).groupBy("edge_id").agg(F.array_sort(F.collect_set("s")).alias("_in"))
        # Rows see only sightings before their own, so a row's own batch counts where its list has it.
        b = batch.join(let_in, "edge_id", "left")
        known = F.exists("_earlier", lambda e: F.array_contains(F.coalesce("_in", F.array().cast("array<struct<batch:bigint,ms:bigint>>")), F.struct(e["batch"].alias("batch"), e["ms"].alias("ms"))))
        reason = F.when(F.col("_late"), LATE).when(known, "DUPLICATE_EDGE").when(~above(here, old_ms, old_id), "NON_MONOTONIC_ORDER")
        b = staged(b.withColumn("reason", reason).withColumn("_here", here), "checked-edges")
        b.where("reason is null").select(*columns).write.mode("overwrite").parquet(f"{path}/accepted/batch={batch_id}")
        b.where("reason is not null").select(*columns, "reason").write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        top = b.where("reason is null").agg(F.max("_here")).first()[0]
        after = max([m for m in (mark, top and tuple(top)) if m and m[0] is not None], default=(None, None))
        spark.createDataFrame([(now, *mark, *after)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{at}{batch_id}")

    found = sightings(stream, lateness, buckets)
    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parity(online: DataFrame, offline: DataFrame) -> DataFrame:
    """Accounts on which two feature tables differ in any column."""
    columns = [c for c in offline.columns if c != "account_id"]
    j = online.alias("a").join(offline.alias("b"), "account_id", "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return j.where(~same).select("account_id")


class Feedback(StatefulProcessor):
    """The hash that each event id of a bucket was accepted with."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", "event_id string", "payload_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).drop_duplicates(["event_id", "payload_hash"])  # a trigger's rows of a bucket
        clash = batch["event_id"].duplicated(keep=False)
        status = []
        for r, two in zip(batch.itertuples(index=False), clash.tolist(), strict=True):
            known = self.taken.getValue((r.event_id,))[0] if self.taken.containsKey((r.event_id,)) else None
            status.append("CONFLICT" if two or known not in (None, r.payload_hash) else "NOOP" if known else "INSERT")
            if status[-1] == "INSERT" and r.known_case:
                self.taken.updateValue((r.event_id,), (r.payload_hash,))
        yield batch.assign(status=status).reset_index(drop=True)

    def close(self) -> None:
        pass


def feedback_sink(stream: DataFrame, cases: DataFrame, path: str, checkpoint: str, buckets: int = 32):
    """Appends feedback (event_id, case_id, disposition, snapshot_hash, payload_hash) once each.

    Repeats are no-ops; other bytes under an id, or an unknown case, go to rejected=true.
    Each row tells whether its hash is that of the case. The ids are keyed state: a batch
    reads nothing of what was written before.
    """
    known = cases.select("case_id", F.col("snapshot_hash").alias("_now"))
    s = stream.join(known, "case_id", "left").withColumn("snapshot_matches", F.col("snapshot_hash").eqNullSafe(F.col("_now")))
    s = s.withColumn("known_case", F.col("_now").isNotNull()).drop("_now")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields)
    s = s.withColumn("_bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets))).groupBy("_bucket")
    s = s.transformWithStateInPandas(statefulProcessor=Feedback(), outputStructType=f"{fields}, status string", outputMode="Append", timeMode="None")
    s = s.withColumn("rejected", (F.col("status") == "CONFLICT") | ~F.col("known_case")).drop("known_case")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("rejected or status = 'INSERT'").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Pins(StatefulProcessor):
    """A case's first fields, and what pins have made of them: values read once and written at most once a trigger; a case bounds them.

    Of the evidence that pins add, the state has only the edges and the numbers of the
    commands that its ids are hashes of.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.case = handle.getValueState("case", "fields string")
        self.pins = handle.getValueState("pins", "pins string")  # snapshot hash, states of edges, effective commands

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0].to_dict()
        self.case.update((self._text({k: (sorted(v) if k.endswith("_ids") else v) for k, v in row.items()}),))

    @staticmethod
    def _text(value) -> str:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        commands = commands_of(pd.concat(list(rows)))  # of one case
        case, pins, done = (json.loads(self.case.get()[0]) if self.case.exists() else None), {}, []
        if case is not None and self.pins.exists():
            case["snapshot_hash"], states, done = json.loads(self.pins.get()[0])
            seen_of, action_of = ids_of(case["case_id"])
            pins = {edge: (*state, seen_of(edge)) for edge, *state in states}  # the first effective command on an edge pins it
            case["evidence_ids"] = sorted({*case["evidence_ids"], *(p[2] for p in pins.values()), *map(action_of, done)})
        out = apply_pins(case, pins, commands)
        if new := [r[1] for r in out if r[5] == "APPLIED"]:
            self.pins.update((self._text([case["snapshot_hash"], [[edge, *p[:2]] for edge, p in pins.items()], done + new]),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIN_SCHEMA.split(",")])

    def close(self) -> None:
        pass


def pin_stream(commands: DataFrame, cases: DataFrame) -> DataFrame:
    """evidence.pin_log() on a stream of commands; cases of evidence.pin_cases() are the state that a new query begins with."""
    return commands.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=Pins(), outputStructType=PIN_SCHEMA, outputMode="Append", timeMode="None", initialState=cases.groupBy("case_id")
    )


class Histogram:
    """Counts of values in log-scaled buckets: bounded, mergeable, quantiles within a bucket of the exact ones."""

    def __init__(self, per_octave: int = 4) -> None:
        self.per_octave = per_octave
        self.counts: dict[int, int] = {}

    def bucket(self, value: float) -> int:
        return max(0, math.ceil(math.log2(value) * self.per_octave)) if value > 1 else 0

    def add(self, value: float, n: int = 1) -> None:
        at = self.bucket(value)
        self.counts[at] = self.counts.get(at, 0) + n

    def merge(self, other: Histogram) -> None:
        if other.per_octave != self.per_octave:
            raise ValueError("histograms of other buckets")
        for at, n in other.counts.items():
            self.counts[at] = self.counts.get(at, 0) + n

    def quantile(self, share: float) -> float | None:
        """Upper bound of the bucket that holds the nearest rank."""
        rank = max(1, math.ceil(share * sum(self.counts.values())))
        for at in sorted(self.counts):
            rank -= self.counts[at]
            if rank <= 0:
                return 2 ** (at / self.per_octave)
        return None


def latency_histogram(values: DataFrame, column: str, per_octave: int = 4) -> DataFrame:
    """bucket, upper, n: the same buckets over a table of values; histograms merge by adding n."""
    v = F.col(column)
    # The engine's logarithm of 2^29 is a little more than 29: a bucket too high by that is one whose lower bound is not below the value.
    raw = F.ceil(F.log2(v) * per_octave)
    near = F.when(F.pow(F.lit(2.0), (raw - 1) / per_octave) >= v, raw - 1).when(F.pow(F.lit(2.0), raw / per_octave) < v, raw + 1).otherwise(raw)
    bucket = F.when(v > 1, F.greatest(near, F.lit(0))).otherwise(F.lit(0)).cast("int")
    return values.where(v.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("upper", F.pow(F.lit(2.0), F.col("bucket") / per_octave))


class Counters(StreamingQueryListener):
    """Rows processed and batch latency of the queries of a session, by query name."""

    def __init__(self) -> None:
        self.processed: dict[str, int] = {}
        self.latency_ms: dict[str, Histogram] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.processed[name] = self.processed.get(name, 0) + event.progress.numInputRows
        self.latency_ms.setdefault(name, Histogram()).add(event.progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(replayed: DataFrame, name: str | Observation = "replay") -> DataFrame:
    """Counts accepted and quarantined events as they pass."""
    bad = F.col("status").isin(*QUARANTINE)
    return replayed.observe(name, F.count_if(F.col("status") == "ACCEPTED").alias("accepted"), F.count_if(bad).alias("quarantined"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, to a table, and returns the table.

    In complete mode the last state replaces the table.
    """
    spark: SparkSession = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = (
            stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
