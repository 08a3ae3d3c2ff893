"""Queries over replay and running features, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from fundweave.functions.scalars import nearest_millis
from fundweave.operators import evidence, features
from fundweave.plans import cases
from fundweave.plans import tables as t
from fundweave.plans.tables import EDGES
from fundweave.shared import shared_dir, staged
from fundweave.streaming import envelopes, online, replay


def _records(spark, d):
    """Events as broker records: a partition for eight users; broken payloads, a gap, retries and a conflict."""
    e = t.edges(spark, d).withColumn("partition", F.expr("cast(cast(substring(source_id, 2) as int) div 8 as int)"))
    e = e.withColumn("offset", (F.row_number().over(Window.partitionBy("partition").orderBy("event_id")) - 1).cast("long"))
    k = F.col("event_id")
    event_id = F.when(k % 1511 == 700, F.concat(F.lit("e"), (k - 64).cast("string"))).otherwise(F.col("edge_id"))
    good = envelopes.envelope_json(event_id, F.col("partition"), F.col("offset"), F.col("source_id"), F.col("target_id"), F.col("amount"), F.col("event_time"))
    broken = F.get(F.array(F.lit("{"), F.lit("[]"), F.regexp_replace(good.cast("string"), '"source_offset":(\\d+)', '"source_offset":"$1"'),
                           F.regexp_replace(good.cast("string"), r"^\{", '{"extra":1,'), F.regexp_replace(good.cast("string"), "Z\"", "+07:00\"")), (k % 5).cast("int"))
    value = F.when(k % 997 == 500, broken.cast("binary")).otherwise(good)
    r = e.where(k % 1999 != 1200).select(F.lit("transfers").alias("topic"), "partition", "offset", value.alias("value"), F.date_trunc("second", "event_time").alias("timestamp"), "event_id")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(k % 101 == 3, 2).otherwise(1)))).drop("event_id", "copy")


def _parsed(spark, d):
    return envelopes.parse_envelope(_records(spark, d))


def _valid(spark, d):
    p = _parsed(spark, d)
    return p.select("topic", "partition", "offset", "valid", "event_id", "source_id", "target_id", "amount", "event_time")


def _replayed(spark, d):
    return replay.replay_batch(staged(_parsed(spark, d), "records"))


def _replay_batch(spark, d):
    return _replayed(spark, d).select("partition", "offset", "status")


def _offsets(spark, d):
    return replay.committable_offsets(_replayed(spark, d))


def _quarantine(spark, d):
    return replay.quarantined(_replayed(spark, d)).select("topic", "partition", "offset", "reason")


def _conflicts(spark, d):
    return replay.event_id_conflicts(_parsed(spark, d))


def _halves(spark, d):
    """The records of each partition's first half; those of the second, with retries of the first written in another way."""
    r = staged(_records(spark, d), "records")
    r = r.withColumn("cut", F.expr("(max(offset) over (partition by partition) + 1) div 2"))
    k = F.regexp_extract(F.col("value").cast("string"), '"event_id":"e(\\d+)"', 1).try_cast("long")
    first, names = r.where("offset < cut"), ["topic", "partition", "offset", "value", "timestamp"]
    # Another order of the keys and blanks between them: the same event in other bytes.
    other = F.regexp_replace(F.col("value").cast("string"), r'^\{("amount":[^,]*),(.*)\}$', "{ $2, $1 }").cast("binary")
    again = first.where((k % 7 == 1) & F.col("value").cast("string").rlike('^\\{"amount".*00Z"|^\\{"amount".*Z"')).withColumn("value", other).dropDuplicates(["partition", "offset"])
    return first.select(*names), r.where("offset >= cut").unionByName(again).select(*names)


def _resumed(spark, d):
    """Two calls, the second with the state that the first has left."""
    first, second = (staged(envelopes.parse_envelope(x), "records") for x in _halves(spark, d))
    one = staged(replay.replay_batch(first), "replayed")
    offsets, events = (staged(x, "replay-state") for x in replay.replay_state(one))
    two = replay.replay_batch(second, offsets, events)
    call = lambda df, n: df.select(F.lit(n).alias("call"), "partition", "offset", "status")
    return call(one, 1).unionByName(call(two, 2))


def _resumed_stream(spark, d):
    """The same two calls as streams: the second begins with what is read out of the first one's state store."""
    replay.use_rocksdb(spark)
    out, begin = [], (None, None)
    for n, half in enumerate(_halves(spark, d), 1):
        path, check = shared_dir(spark, "broker"), shared_dir(spark, "checkpoint")
        half.repartition(4, "partition").write.parquet(path)
        parsed = envelopes.parse_envelope(envelopes.broker_stream(spark, path=path, per_trigger=100))
        done = online.run_once(replay.replay_stream(parsed, *begin), shared_dir(spark, "replayed"), check)
        out.append(done.select(F.lit(n).alias("call"), "partition", "offset", "status"))
        begin = replay.stored_state(spark, check)
    return out[0].unionByName(out[1])


def _stream_source(spark, d):
    path = shared_dir(spark, "broker")
    _records(spark, d).repartition(4, "partition").write.parquet(path)
    return envelopes.parse_envelope(envelopes.broker_stream(spark, path=path, per_trigger=100))


def _replay_stream(spark, d):
    replay.use_rocksdb(spark)
    out = online.run_once(replay.replay_stream(_stream_source(spark, d)), shared_dir(spark, "replayed"), shared_dir(spark, "checkpoint"))
    return out.select("partition", "offset", "status")


def _conflict_stream(spark, d):
    replay.use_rocksdb(spark)
    return online.run_once(replay.conflict_stream(_stream_source(spark, d)), shared_dir(spark, "conflicts"), shared_dir(spark, "checkpoint"))


def _edge_stream(spark, d):
    path = shared_dir(spark, "edges")
    e = t.edges(spark, d).drop("event_id")
    e.repartition(6, "edge_id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _online(spark, d):
    f = online.online_account_features(_edge_stream(spark, d))
    return online.run_once(f, shared_dir(spark, "online"), shared_dir(spark, "checkpoint"), "complete")


def _parity(spark, d):
    off = features.account_features(t.edges(spark, d))
    bad = online.parity(_online(spark, d), off)
    return off.agg(F.count(F.lit(1)).alias("accounts")).crossJoin(bad.agg(F.count(F.lit(1)).alias("differing")))


def _pin_stream(spark, d):
    replay.use_rocksdb(spark)
    path, known = shared_dir(spark, "commands"), staged(cases._pin_cases(spark, d), "pin-cases")
    cases._pin_commands(spark, d, known).repartition("case_id").write.parquet(path)
    c = spark.read.parquet(path)
    stream = spark.readStream.schema(c.schema).parquet(path)
    got = online.run_once(evidence.digested(online.pin_stream(stream, known)), shared_dir(spark, "pins"), shared_dir(spark, "checkpoint"))
    return evidence.pin_parity(c, known, got)


def _quarantine_stream(spark, d):
    """The quarantined records, through the durable sink."""
    path, sink = shared_dir(spark, "replayed"), shared_dir(spark, "quarantine")
    _replayed(spark, d).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    envelopes.quarantine_sink(stream, sink, shared_dir(spark, "checkpoint")).awaitTermination()
    return envelopes.read_quarantine(spark, sink).select("topic", "partition", "offset", "reason")


def _counters(spark, d):
    """accepted, quarantined: what is observed as replayed records pass."""
    seen = Observation("replay")
    df = online.observed(_replayed(spark, d), seen)
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["accepted"], seen.get["quarantined"])], "accepted long, quarantined long")


def _edge_batches(spark, d, lateness=None):
    """Edges in four batches by time, through the check; some come again two batches later, some come a batch late."""
    replay.use_rocksdb(spark)
    path, out, check = (shared_dir(spark, n) for n in ("edges", "checked", "checkpoint"))
    k, e = F.col("event_id"), staged(t.edges(spark, d), "edges")
    size = e.agg(F.max("event_id")).first()[0] // 4 + 1
    part = F.floor(k / size)
    late = F.when(k % 29 == 3, part + 1).otherwise(part)
    again = e.where(k % 31 == 5).withColumn("batch", part + 2)
    every = staged(e.withColumn("batch", late).unionByName(again), "edge-batches")
    for i in range(6):
        every.where(F.col("batch") == i).drop("batch", "event_id").write.mode("append").parquet(path)
        stream = spark.readStream.schema(e.drop("event_id").schema).parquet(path)
        online.checked_edges(stream, out, check, lateness).awaitTermination()
    accepted = spark.read.parquet(f"{out}/accepted").select("edge_id", F.lit("ACCEPTED").alias("status"))
    return accepted.unionByName(spark.read.parquet(f"{out}/rejected").select("edge_id", F.col("reason").alias("status")))


def _checked(spark, d):
    return _edge_batches(spark, d)


def _late(spark, d):
    """With a watermark of three days, so that the state holds three days of edges."""
    return _edge_batches(spark, d, "3 days")


def _feedback(spark, d):
    """Labels of documents as feedback on evidence cases, in two batches; some again, some with other bytes, some on no case."""
    replay.use_rocksdb(spark)
    path, out, check = (shared_dir(spark, n) for n in ("feedback", "appended", "checkpoint"))
    k = F.col("doc_id")
    ev = t.evidence(spark, d).withColumn("doc_id", F.substring("evidence_id", 3, 20).cast("long"))
    cases_of = staged(ev.where(k % (7 * t.CASE_DOCUMENTS) >= t.CASE_DOCUMENTS).select("case_id").distinct().withColumn("snapshot_hash", F.sha2("case_id", 256)), "feedback-cases")
    snapshot = F.when(k % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("case_id", 256))
    rows = ev.select(F.concat(F.lit("fb"), k.cast("string")).alias("event_id"), "case_id", F.when(k % 2 == 0, "CONFIRMED").otherwise("DISMISSED").alias("disposition"),
                     snapshot.alias("snapshot_hash"), "payload_hash", k)
    again = rows.where(k % 3 == 0).withColumn("payload_hash", F.when(k % 9 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("payload_hash")))
    for part in (rows.where(k % 4 < 2).unionByName(rows.where(k % 4 == 1)), rows.where(k % 4 >= 2).unionByName(again.where(k % 4 < 2))):
        part = part.drop("doc_id")
        part.write.mode("append").parquet(path)
        online.feedback_sink(spark.readStream.schema(part.schema).parquet(path), cases_of, out, check).awaitTermination()
    return spark.read.parquet(out).select("event_id", "payload_hash", "rejected", "snapshot_matches")


def _latencies(spark, d):
    """Log-scaled buckets of the milliseconds between an account's transfers, each time rounded to its nearest one as in the SQL."""
    w = Window.partitionBy("source_id").orderBy("event_time", "edge_id")
    e = t.edges(spark, d).withColumn("ms", nearest_millis(F.col("event_time")))
    gaps = e.select((F.col("ms") - F.lag("ms").over(w)).alias("ms"))
    return online.latency_histogram(gaps, "ms", per_octave=1).select("bucket", "n")


QUERIES = {
    "parse_envelope": _valid,
    "replay_batch": _replay_batch,
    "replay_offsets": _offsets,
    "replay_quarantine": _quarantine,
    "event_id_conflicts": _conflicts,
    "replay_stream": _replay_stream,
    "online_features": _online,
    "online_features_parity": _parity,
    "pin_stream_parity": _pin_stream,
    "quarantine_stream": _quarantine_stream,
    "replay_counters": _counters,
    "checked_edges": _checked,
    "late_edges": _late,
    "replay_resumed": _resumed,
    "replay_resumed_stream": _resumed_stream,
    "conflict_stream": _conflict_stream,
    "feedback_stream": _feedback,
    "latency_histogram": _latencies,
}

_RECORDS = f"""{EDGES},
p AS (SELECT *, substr(source_id, 2)::INTEGER // 8 AS part FROM edges),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS off FROM p),
r1 AS (SELECT part, off, event_id AS k, CASE WHEN event_id % 1511 = 700 THEN 'e' || (event_id - 64) ELSE edge_id END AS eid, source_id, target_id, amount,
       date_trunc('second', event_time) AS ts, event_id % 997 <> 500 AS valid FROM o WHERE event_id % 1999 <> 1200),
st AS (SELECT *, CASE WHEN NOT valid THEN 'INVALID_SCHEMA'
            WHEN valid AND off > min(CASE WHEN valid THEN off END) OVER (PARTITION BY part, CASE WHEN valid THEN eid ELSE 'x' || k END) THEN 'CONFLICT'
            WHEN off > 0 AND lag(off) OVER (PARTITION BY part ORDER BY off) IS DISTINCT FROM off - 1 THEN 'NON_CONTIGUOUS_OFFSET' END AS reason FROM r1),
fl AS (SELECT part, min(off) AS f FROM st WHERE reason IS NOT NULL GROUP BY part),
one AS (SELECT st.*, CASE WHEN f IS NULL OR off < f THEN 'ACCEPTED' WHEN off = f THEN reason ELSE 'SKIPPED' END AS status FROM st LEFT JOIN fl USING (part)),
rp AS (SELECT part, off, k, status FROM one UNION ALL SELECT part, off, k, CASE WHEN status = 'ACCEPTED' THEN 'NOOP' ELSE 'SKIPPED' END FROM one WHERE k % 101 = 3)"""
_FEATURES = f"""WITH {EDGES},
ends AS (SELECT source_id AS account_id, 0 AS i, 1 AS o, 0::DECIMAL(18,2) AS ai, amount::DECIMAL(18,2) AS ao FROM edges
         UNION ALL SELECT target_id, 1, 0, amount::DECIMAL(18,2), 0 FROM edges),
f AS (SELECT account_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(ai)::DOUBLE AS amount_in, sum(ao)::DOUBLE AS amount_out
      FROM ends GROUP BY account_id)"""

def _resumed_sql(by_partition: bool) -> str:
    """The second call knows the events that the first has taken, of all partitions or of the record's own; its records may follow the first one's cursor."""
    kp, same = ("part AS kp,", "kp = in2.part") if by_partition else ("", "TRUE")
    return f"""{_RECORDS},
ct AS (SELECT part, (max(off) + 1) // 2 AS cut FROM r1 GROUP BY part),
f1 AS (SELECT part, min(off) AS f FROM st JOIN ct USING (part) WHERE reason IS NOT NULL AND off < cut GROUP BY part),
c1 AS (SELECT st.*, CASE WHEN f IS NULL OR off < f THEN 'ACCEPTED' WHEN off = f THEN reason ELSE 'SKIPPED' END AS status
       FROM st JOIN ct USING (part) LEFT JOIN f1 USING (part) WHERE off < cut),
call1 AS (SELECT part, off, status FROM c1 UNION ALL SELECT part, off, CASE WHEN status = 'ACCEPTED' THEN 'NOOP' ELSE 'SKIPPED' END FROM c1 WHERE k % 101 = 3),
nx AS (SELECT part, cut, coalesce(max(off + 1) FILTER (status = 'ACCEPTED'), 0) AS nxt FROM ct LEFT JOIN c1 USING (part) GROUP BY part, cut),
in2 AS (SELECT part, off, k, eid, valid, 1 AS copy FROM r1 JOIN ct USING (part) WHERE off >= cut
        UNION ALL SELECT part, off, k, eid, valid, 2 FROM r1 JOIN ct USING (part) WHERE off >= cut AND k % 101 = 3
        UNION ALL SELECT part, off, k, eid, valid, 1 FROM r1 JOIN ct USING (part) WHERE off < cut AND substr(eid, 2)::BIGINT % 7 = 1 AND (valid OR k % 5 = 2)),
kn AS (SELECT eid, {kp} list(part * 10000000000 + off) AS places FROM c1 WHERE status = 'ACCEPTED' GROUP BY ALL),
k2 AS (SELECT in2.*, nxt, kn.places,
              CASE WHEN valid THEN lag(in2.off) OVER (PARTITION BY in2.part, CASE WHEN in2.valid THEN in2.eid ELSE 'x' || in2.k END ORDER BY in2.off, copy) END AS before
       FROM in2 JOIN nx USING (part) LEFT JOIN kn ON in2.valid AND kn.eid = in2.eid AND ({same})),
u2 AS (SELECT DISTINCT part, off + 1 AS off FROM k2 WHERE valid AND places IS NULL AND before IS NULL AND off >= nxt),
s2 AS (SELECT k2.*, CASE WHEN NOT valid THEN 'INVALID_SCHEMA'
              WHEN before IS NOT NULL THEN CASE WHEN before = k2.off THEN 'NOOP' ELSE 'CONFLICT' END
              WHEN places IS NOT NULL THEN CASE WHEN list_contains(places, k2.part * 10000000000 + k2.off) THEN 'NOOP' ELSE 'CONFLICT' END
              WHEN k2.off = nxt OR (k2.off > nxt AND u2.off IS NOT NULL) THEN 'ACCEPTED' ELSE 'NON_CONTIGUOUS_OFFSET' END AS reason
       FROM k2 LEFT JOIN u2 ON u2.part = k2.part AND u2.off = k2.off),
f2 AS (SELECT part, min(off * 2 + copy) AS f FROM s2 WHERE reason NOT IN ('ACCEPTED', 'NOOP') GROUP BY part),
call2 AS (SELECT part, off, CASE WHEN off * 2 + copy > f THEN 'SKIPPED' ELSE reason END AS status FROM s2 LEFT JOIN f2 USING (part))
SELECT 1 AS call, part AS partition, off AS offset, status FROM call1 UNION ALL SELECT 2, part, off, status FROM call2"""


#: Six batches of edges: which edge comes in which, in all.
_BATCHES = f"""{EDGES},
z AS (SELECT max(event_id) // 4 + 1 AS size FROM edges),
bt AS (SELECT edge_id, event_id AS k, event_time, event_id // size + (event_id % 29 = 3)::INTEGER AS batch, 0 AS again FROM edges, z
       UNION ALL SELECT edge_id, event_id, event_time, event_id // size + 2, 1 FROM edges, z WHERE event_id % 31 = 5)"""

ORACLE_SQL = {
    "replay_resumed": f"WITH {_resumed_sql(False)}",
    "replay_resumed_stream": f"WITH {_resumed_sql(True)}",
    "conflict_stream": f"""WITH {_RECORDS},
        v AS (SELECT * FROM r1 WHERE valid UNION ALL SELECT * FROM r1 WHERE valid AND k % 101 = 3),
        w AS (SELECT *, first_value(part) OVER x AS fp, first_value(off) OVER x AS fo FROM v WINDOW x AS (PARTITION BY eid ORDER BY ts, part, off))
        SELECT eid AS event_id, 'transfers' AS topic, part AS partition, off AS offset, 'transfers' AS first_topic, fp AS first_partition, fo AS first_offset,
               'CONFLICT' AS reason
        FROM w WHERE part <> fp OR off <> fo""",
    "late_edges": f"""WITH {_BATCHES},
        wm AS (SELECT i AS batch, (SELECT max(epoch_ms(event_time)) - 3 * 86400000 FROM bt WHERE bt.batch < i) AS low FROM range(6) AS t(i)),
        j AS (SELECT bt.*, coalesce(epoch_ms(event_time) < low, FALSE) AS late FROM bt JOIN wm USING (batch)),
        top AS (SELECT i AS batch, (SELECT max(row(epoch_ms(event_time), edge_id)) FROM j WHERE j.batch < i AND again = 0 AND NOT late) AS mark FROM range(6) AS t(i)),
        o AS (SELECT j.*, row(epoch_ms(event_time), edge_id) <= mark AS low FROM j JOIN top USING (batch)),
        a AS (SELECT edge_id, batch FROM o WHERE again = 0 AND NOT late AND (low IS NULL OR NOT low))
        SELECT o.edge_id, CASE WHEN late THEN 'LATE_EVENT' WHEN again = 1 AND a.edge_id IS NOT NULL THEN 'DUPLICATE_EDGE'
               WHEN low THEN 'NON_MONOTONIC_ORDER' ELSE 'ACCEPTED' END AS status
        FROM o LEFT JOIN a ON a.edge_id = o.edge_id AND a.batch < o.batch""",
    "feedback_stream": f"""WITH {t.EVIDENCE},
        r AS (SELECT 'fb' || doc_id AS event_id, doc_id AS k, 'c' || (doc_id // {t.CASE_DOCUMENTS}) AS case_id, sha256(coalesce(text, '')) AS h FROM documents),
        b AS (SELECT *, CASE WHEN k % 4 < 2 THEN 1 ELSE 2 END AS batch FROM r
              UNION ALL SELECT event_id, k, case_id, CASE WHEN k % 9 = 0 THEN sha256('other') ELSE h END, 2 FROM r WHERE k % 3 = 0 AND k % 4 < 2),
        j AS (SELECT b.*, (k // {t.CASE_DOCUMENTS}) % 7 <> 0 AS known, first_value(h) OVER (PARTITION BY event_id ORDER BY batch) AS first_h,
                     row_number() OVER (PARTITION BY event_id ORDER BY batch) AS nth FROM b)
        SELECT event_id, h AS payload_hash, NOT known OR h <> first_h AS rejected, known AND k % 5 <> 0 AS snapshot_matches FROM j
        WHERE NOT known OR nth = 1 OR h <> first_h""",
    "latency_histogram": f"""WITH {EDGES},
        g AS (SELECT epoch_ms(event_time) - lag(epoch_ms(event_time)) OVER (PARTITION BY source_id ORDER BY event_time, edge_id) AS ms FROM edges)
        SELECT CASE WHEN ms > 1 THEN ceil(log2(ms))::INTEGER ELSE 0 END AS bucket, count(*) AS n FROM g WHERE ms IS NOT NULL GROUP BY ALL""",
    "parse_envelope": f"""WITH {_RECORDS},
        v AS (SELECT 'transfers' AS topic, part AS partition, off AS offset, valid, CASE WHEN valid THEN eid END AS event_id, CASE WHEN valid THEN source_id END AS source_id,
                     CASE WHEN valid THEN target_id END AS target_id, CASE WHEN valid THEN amount END AS amount, CASE WHEN valid THEN ts END AS event_time, k FROM r1)
        SELECT * EXCLUDE (k) FROM v UNION ALL SELECT * EXCLUDE (k) FROM v WHERE k % 101 = 3""",
    "replay_batch": f"WITH {_RECORDS} SELECT part AS partition, off AS offset, status FROM rp",
    "replay_offsets": f"""WITH {_RECORDS}
        SELECT 'transfers' AS topic, part AS partition, coalesce(max(off + 1) FILTER (status = 'ACCEPTED'), 0) AS next_offset FROM rp GROUP BY part""",
    "replay_quarantine": f"""WITH {_RECORDS}
        SELECT 'transfers' AS topic, part AS partition, off AS offset, status AS reason FROM rp WHERE status IN ('INVALID_SCHEMA', 'NON_CONTIGUOUS_OFFSET', 'CONFLICT')""",
    "quarantine_stream": f"""WITH {_RECORDS}
        SELECT 'transfers' AS topic, part AS partition, off AS offset, status AS reason FROM rp WHERE status IN ('INVALID_SCHEMA', 'NON_CONTIGUOUS_OFFSET', 'CONFLICT')""",
    "replay_counters": f"""WITH {_RECORDS}
        SELECT count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status IN ('INVALID_SCHEMA', 'NON_CONTIGUOUS_OFFSET', 'CONFLICT')) AS quarantined FROM rp""",
    "checked_edges": f"""WITH {_BATCHES},
        top AS (SELECT i AS batch, (SELECT max(row(epoch_ms(event_time), edge_id)) FROM bt WHERE bt.batch < i AND again = 0) AS mark FROM range(6) AS t(i)),
        o AS (SELECT bt.*, row(epoch_ms(event_time), edge_id) <= mark AS low FROM bt JOIN top USING (batch)),
        a AS (SELECT edge_id, batch FROM o WHERE again = 0 AND (low IS NULL OR NOT low))
        SELECT o.edge_id, CASE WHEN again = 1 AND a.edge_id IS NOT NULL THEN 'DUPLICATE_EDGE' WHEN low THEN 'NON_MONOTONIC_ORDER' ELSE 'ACCEPTED' END AS status
        FROM o LEFT JOIN a ON a.edge_id = o.edge_id AND a.batch < o.batch""",
    "event_id_conflicts": f"""WITH {_RECORDS},
        v AS (SELECT * FROM r1 WHERE valid UNION ALL SELECT * FROM r1 WHERE valid AND k % 101 = 3),
        w AS (SELECT *, first_value(part) OVER x AS fp, first_value(off) OVER x AS fo FROM v WINDOW x AS (PARTITION BY eid ORDER BY ts, part, off))
        SELECT eid AS event_id, 'transfers' AS topic, part AS partition, off AS offset, 'transfers' AS first_topic, fp AS first_partition, fo AS first_offset
        FROM w WHERE part <> fp OR off <> fo""",
    "replay_stream": f"WITH {_RECORDS} SELECT part AS partition, off AS offset, status FROM rp",
    "online_features": f"{_FEATURES} SELECT *, CASE WHEN amount_in = 0 THEN 0.0::DOUBLE ELSE least(amount_out / amount_in, 1.0) END AS pass_through_ratio FROM f",
    "online_features_parity": f"{_FEATURES} SELECT count(*) AS accounts, 0::BIGINT AS differing FROM f",
}
