"""Transaction envelopes in broker records: strict parsing, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundweave.functions.hashing import canonical_object
from fundweave.functions.scalars import is_blank

RECORD = "topic string, partition int, offset long, value binary, timestamp timestamp"
#: Reasons of quarantine.
INVALID_SCHEMA, NON_CONTIGUOUS, CONFLICT = "INVALID_SCHEMA", "NON_CONTIGUOUS_OFFSET", "CONFLICT"
#: Our own reason: an event older than the stream's clock allows.
LATE = "LATE_EVENT"
QUARANTINE = (INVALID_SCHEMA, NON_CONTIGUOUS, CONFLICT, LATE)
_FIELDS = "schema_version string, event_id string, source_partition long, source_offset long, source_id string, target_id string, amount double, event_time string"
#: The exact keys and JSON types of an envelope.
_SHAPE = (
    r"^OBJECT<amount: (DOUBLE|BIGINT|DECIMAL\(\d+,\s?\d+\)), event_id: STRING, event_time: STRING, schema_version: STRING, "
    r"source_id: STRING, source_offset: BIGINT, source_partition: BIGINT, target_id: STRING>$"
)


def event_hash(fields: dict[str, Column]) -> Column:
    """Hash of an event's canonical JSON, which no blanks, key order or way to write a number changes."""
    kinds = {"amount": T.DoubleType(), "event_time": T.TimestampType(), "source_offset": T.LongType(), "source_partition": T.LongType()}
    return F.sha2(canonical_object({n: (c, kinds.get(n, T.StringType())) for n, c in fields.items()}), 256)


def parse_envelope(records: DataFrame) -> DataFrame:
    """records with raw_hash, payload_hash, valid and the envelope's fields (null unless valid).

    payload_hash is that of the canonical event where the record is valid, so that a retry
    may be written in another way; otherwise, and for quarantine, the hash of the bytes.

    Valid: one JSON object of exactly the known keys and types (a number in quotes is no
    number), version 1, well-formed id, non-blank ends, a positive amount, a UTC time of
    whole seconds, and the coordinates of the record itself.
    """
    text = F.try_validate_utf8(F.col("value").cast("string"))
    p = records.withColumn("raw_hash", F.sha2("value", 256)).withColumn("_e", F.from_json(text, _FIELDS))
    shape = F.schema_of_variant(F.try_parse_json(text)).rlike(_SHAPE)
    e = lambda name: F.col(f"_e.{name}")
    rules: Column = (
        shape & (e("schema_version") == "1") & e("event_id").rlike(r"^[a-zA-Z0-9_\-:]+$") & ~is_blank(e("source_id")) & ~is_blank(e("target_id"))
        & (e("amount") > 0) & (e("amount") < float("inf")) & e("event_time").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.0{1,6})?(Z|\+00:00)$")
        & e("event_time").try_cast("timestamp").isNotNull() & (e("source_partition") == F.col("partition")) & (e("source_offset") == F.col("offset"))
    )
    p = p.withColumn("valid", F.coalesce(rules, F.lit(False)))
    p = p.withColumn("_time", e("event_time").try_cast("timestamp"))
    fields = {n: F.when(F.col("valid"), e(n)).alias(n) for n in ("event_id", "source_id", "target_id", "amount")}
    time = F.when(F.col("valid"), F.col("_time")).alias("event_time")
    names = ("amount", "event_id", "schema_version", "source_id", "source_offset", "source_partition", "target_id")
    canonical = event_hash({n: e(n) for n in names} | {"event_time": F.col("_time")})
    digest = F.when(F.col("valid"), canonical).otherwise(F.col("raw_hash")).alias("payload_hash")
    return p.select(*records.columns, "raw_hash", digest, "valid", *fields.values(), time)


def envelope_json(event_id: Column, partition: Column, offset: Column, source: Column, target: Column, amount: Column, time: Column) -> Column:
    """The payload of an envelope."""
    at = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(
        amount.alias("amount"), event_id.alias("event_id"), at.alias("event_time"), F.lit("1").alias("schema_version"), source.alias("source_id"),
        offset.alias("source_offset"), partition.alias("source_partition"), target.alias("target_id"),
    )
    return F.to_json(body).cast("binary")


def broker_stream(spark: SparkSession, *, servers: str | None = None, topic: str | None = None, path: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Ordered records of a Kafka topic, or of files with the same columns."""
    if servers:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return reader.load().select("topic", "partition", "offset", "value", "timestamp")
    reader = spark.readStream.schema(RECORD)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def quarantine_sink(replayed: DataFrame, path: str, checkpoint: str):
    """Starts a durable append of quarantined records, laid out by topic and partition.

    A batch writes to a folder of its own id, so a batch that is repeated after a failure
    replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        q = batch.where(F.col("status").isin(*QUARANTINE))
        q = q.select("topic", "partition", "offset", F.col("status").alias("reason"), F.col("raw_hash").alias("payload_hash"), F.current_timestamp().alias("quarantined_at"))
        q.write.mode("overwrite").partitionBy("topic", "partition").json(f"{path}/batch={batch_id}")

    return replayed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_quarantine(spark: SparkSession, path: str, topic: str | None = None, partition: int | None = None) -> DataFrame:
    q = spark.read.json(path)
    if topic is not None:
        q = q.where(F.col("topic") == topic)
    return q if partition is None else q.where(F.col("partition") == partition)
