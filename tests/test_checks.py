"""Audits, evaluation, drift, claims, evidence and replay on small examples."""

import hashlib
import json
import math
import random
import struct
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fundweave.functions import hashing
from fundweave.operators import audits, claims, drift, evaluation, evidence, models, release
from fundweave.shared import shared_dir
from fundweave.streaming import envelopes, online, replay


def _scores(spark, y, s):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, s, strict=True))], "row_id int, y int, score double")


def test_detection_metrics(spark):
    m = evaluation.detection_metrics(_scores(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), 2).first()
    assert m.precision_at_k == 0.5 and m.average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert m.brier == pytest.approx((0.01 + 0.64 + 0.09 + 0.01) / 4)
    tie = evaluation.top_alerts(_scores(spark, [0, 1, 1], [0.5, 0.5, 0.5]), 1).first()
    assert tie.row_id == 0
    assert evaluation.average_precision(_scores(spark, [1, 0, 1, 0], [0.5] * 4)).first()[0] == 0.5
    assert evaluation.average_precision(_scores(spark, [0], [0.5])).first()[0] == 0.0


def test_trace_metrics(spark):
    lab = spark.createDataFrame([("c", "e1", "RELEVANT"), ("c", "e2", "CONFIRMED_BENIGN"), ("c", "e3", "UNKNOWN")], "case_id string, edge_id string, label string")
    m = evaluation.trace_metrics(lab.select("case_id", "edge_id"), lab).first()
    assert (m.recall, m.benign_share, m.unknown_share) == (1.0, pytest.approx(1 / 3), pytest.approx(1 / 3))
    none = evaluation.trace_metrics(lab.limit(0), lab).first()
    assert (none.recall, none.benign_share, none.unknown_share) == (0.0, 0.0, 0.0)
    assert evaluation.training_mask(lab).count() == 2


def test_returned_edges_without_a_label(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "case_id string, edge_id string")
    found = evaluation.unlabelled_returns(pairs(("c", "e1"), ("c", "e2"), ("d", "e1")), pairs(("c", "e1")).withColumn("label", F.lit("UNKNOWN")))
    assert sorted((r.case_id, r.edge_id) for r in found.collect()) == [("c", "e2"), ("d", "e1")]


def test_stored_hashes_are_verified(spark):
    df = spark.createDataFrame([("a", 1, ["x", "é"]), (None, None, None)], "k string, n int, l array<string>")
    body = [{"k": "a", "l": ["x", "é"], "n": 1}, {"k": None, "l": None, "n": None}]
    hashes = [hashlib.sha256(json.dumps(b, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for b in body]
    df = df.withColumn("h", F.when(F.col("k") == "a", hashes[0]).otherwise(hashes[1]))
    assert [r.hash_ok for r in hashing.verify_hash(df, ["k", "n", "l"], "h").collect()] == [True, True]
    assert [r.hash_ok for r in hashing.verify_hash(df.withColumn("n", F.lit(7)), ["k", "n", "l"], "h").collect()] == [False, False]


def test_gate(spark):
    base = [0.70, 0.71, 0.69, 0.70, 0.72]
    assert models.promotion(spark, base, [0.78, 0.79, 0.77, 0.80, 0.79]).first().selected
    r = models.promotion(spark, base, [0.78, 0.79, 0.77, 0.60, 0.60]).first()
    assert r.n_gains == 3 and not r.selected


@pytest.mark.parametrize(("base", "cur", "n", "drifted"), [(range(1, 9), range(1, 9), 4, False), (range(1, 6), range(10, 60, 10), 2, True), ([5] * 9, [5] * 3, 4, False), ([1e308, -1e308, 0], [1e308], 3, True)])
def test_drift(spark, base, cur, n, drifted):
    b, c = (spark.createDataFrame([(float(x),) for x in v], "value double") for v in (base, cur))
    edges, bins = drift.psi_bins(b, "value", n)
    assert edges == sorted(set(edges)) and len(edges) == n + 1
    assert drift.psi(edges, bins, c, "value").first().drifted == drifted


def test_split_audits(spark):
    rec = [("a", 1, ["x", "y"], ["e1"]), ("b", 2, ["y", "z"], ["e2"]), ("c", 1, ["q"], ["e3"])]
    records = spark.createDataFrame([(i, "t", s, n, e) for i, s, n, e in rec], "case_id string, typology string, generator_seed long, entity_ids array<string>, edge_ids array<string>")
    man = spark.createDataFrame([("train", "a"), ("validation", "b"), ("test", "c")], "track string, case_id string")
    m = audits.split_members(records, man)
    assert sorted(map(tuple, audits.split_overlap(m).collect())) == [("entity", "y"), ("seed", "1")]
    with pytest.raises(ValueError, match="entity"):
        audits.assert_split_safe(m)
    with pytest.raises(ValueError):
        audits.split_members(records.where("case_id <> 'a'"), man)
    ids = spark.createDataFrame([("train", "entity", "a"), ("test", "entity", "b"), ("train", "edge", "e"), ("test", "edge", "f")], "side string, kind string, id string")
    ticks = lambda *t: spark.createDataFrame([(x,) for x in t], "tick long")
    status = lambda t, i: audits.temporal_split_audit(t, i, 10, 5).first().status
    assert status(ticks(10, 16), ids) == "SAFE"
    assert status(ticks(10, 11), ids) == status(ticks(10, 15, 20), ids) == "BLOCKED_DATA"
    assert status(ticks(11, 12), ids) == status(ticks(10, 11), ids.where("side = 'train'")) == "NOT_EVALUABLE"


def test_stages(spark):
    rows = [("a", i, s) for i, s in enumerate(audits.STAGES)] + [("b", 0, "PREREGISTERED"), ("b", 1, "FITTED"), ("c", 0, "OTHER"), ("d", 0, "FITTED")]
    bad = audits.stage_violations(spark.createDataFrame(rows, "run_id string, seq int, stage string"))
    assert {(r.run_id, r.stage) for r in bad.collect()} == {("b", "FITTED"), ("c", "OTHER"), ("d", "FITTED")}
    assert audits.STAGES[:2] == ("PREREGISTERED", "DATA_VERIFIED") and audits.STAGES[-1] == "DECIDED" and len(audits.STAGES) == 9


def test_claims(spark):
    good = {"summary": "s", "claims": [{"text": "t", "cited_evidence_ids": ["e1"]}]}
    bad = lambda ids: {"summary": "s", "claims": [good["claims"][0], {"text": "u", "cited_evidence_ids": ids}]}
    rows = [
        ("ok", True, "OK", json.dumps(good), ["e1"]), ("none", True, "OK", json.dumps(good), []), ("off", False, "OK", json.dumps(good), ["e1"]),
        ("budget", True, "BUDGET", json.dumps(good), ["e1"]), ("broken", True, "OK", "{", ["e1"]), ("extra", True, "OK", json.dumps(good | {"x": 1}), ["e1"]),
        ("foreign", True, "OK", json.dumps(bad(["e9"])), ["e1"]), ("uncited", True, "OK", json.dumps(bad([])), ["e1"]),
        ("empty", True, "OK", '{"summary":"s","claims":[]}', ["e1"]), ("long", True, "OK", json.dumps(good | {"summary": "s" * 2001}), ["e1"]),
    ]
    runs = spark.createDataFrame([(a, "c", *r) for a, *r in rows], "run_id string, case_id string, provider_on boolean, transport string, answer string, evidence_ids array<string>")
    got = {r.run_id: (r.status, r.n_claims) for r in claims.claim_status(runs).collect()}
    assert got == {
        "ok": ("HYPOTHESIS_GENERATED", 1), "none": ("INSUFFICIENT_EVIDENCE", 0), "off": ("AI_UNAVAILABLE", 0), "budget": ("AI_UNAVAILABLE", 0),
        "broken": ("AI_INVALID_OUTPUT", 0), "extra": ("AI_INVALID_OUTPUT", 0), "foreign": ("AI_INVALID_OUTPUT", 0), "uncited": ("AI_INVALID_OUTPUT", 0),
        "empty": ("HYPOTHESIS_GENERATED", 0), "long": ("AI_INVALID_OUTPUT", 0),
    }
    m = claims.claim_metrics(claims.claim_status(runs.limit(0))).first()
    assert (m.citation_precision, m.claim_coverage, m.unsupported_claims, m.abstention_rate) == (1.0, 1.0, 0, 0.0)


def test_puts_and_pins(spark):
    t = lambda *r: spark.createDataFrame(list(r), "id string, h string")
    got = evidence.put_status(t(("a", "1"), ("b", "2"), ("c", "1"), ("c", "2"), ("d", "1")), t(("a", "1"), ("b", "1")), "id", "h")
    assert {(r.id, r.status) for r in got.collect()} == {("a", "NOOP"), ("b", "CONFLICT"), ("c", "CONFLICT"), ("d", "INSERT")}


CASE_ROWS = [("c1", "s", "2024-01-01 00:00:00", ["f", "e"], ["ev9"]), ("c2", "s", None, [], [])]
CASE = "case_id string, seed_entity string, created_at string, trace_edge_ids array<string>, evidence_ids array<string>"
COMMANDS = "case_id string, seq long, edge_id string, is_pinned boolean, tag string, expected_hash string"


def _pin_cases(spark):
    return evidence.pin_cases(spark.createDataFrame(CASE_ROWS, CASE).withColumn("created_at", F.col("created_at").cast("timestamp")))


def _snapshot(case_id, created_at, ids, edges):
    body = {"case_id": case_id, "created_at": created_at, "evidence_ids": sorted(ids), "seed_entity": "s", "trace_edge_ids": sorted(edges)}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_pins_make_evidence_and_snapshots(spark):
    digest = lambda **kw: hashlib.sha256(json.dumps(kw, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    action = lambda seq: "ev:pin:" + digest(case_id="c1", seq=seq)[:32]
    seen = "ev:txn:" + digest(case_id="c1", edge_id="e")
    first = {r.case_id: r.snapshot_hash for r in _pin_cases(spark).collect()}
    assert first == {"c1": _snapshot("c1", "2024-01-01T00:00:00Z", ["ev9"], ["e", "f"]), "c2": _snapshot("c2", None, [], [])}
    rows = [
        ("c1", 1, "f", False, None, None),  # nothing to unpin
        ("c1", 2, "e", True, "X", first["c1"]), ("c1", 3, "e", True, "X", None), ("c1", 4, "e", True, "Y", first["c1"]), ("c1", 5, "g", True, "X", None),
        ("c1", 6, "e", False, "X", None), ("c1", 7, "e", False, "X", None), ("c1", 8, "e", False, "Y", None), ("c9", 1, "e", True, "X", None), ("c2", 1, "e", True, "X", None),
    ]
    log = evidence.pin_log(spark.createDataFrame(rows, COMMANDS).repartition(4), _pin_cases(spark))
    got = {(r.case_id, r.seq): r for r in log.collect()}
    assert [got["c1", i].status for i in range(1, 9)] == ["NOOP", "APPLIED", "NOOP", "SNAPSHOT_CONFLICT", "INVALID_EDGE", "APPLIED", "NOOP", "APPLIED"]
    assert got["c9", 1].status == "CASE_NOT_FOUND" and got["c2", 1].status == "INVALID_EDGE"
    ids = ["ev9"]
    for seq, new in ((2, [action(2), seen]), (6, [action(6)]), (8, [action(8)])):  # unpinning keeps the evidence
        ids += new
        assert got["c1", seq].snapshot_hash == _snapshot("c1", "2024-01-01T00:00:00Z", ids, ["e", "f"])
        assert (got["c1", seq].evidence_id, got["c1", seq].action_id) == (seen, action(seq))
    assert got["c1", 6].previous_hash == got["c1", 2].snapshot_hash == got["c1", 5].snapshot_hash
    found = {r.evidence_id: r for r in evidence.pin_evidence(log).collect()}
    assert set(found) == set(ids) - {"ev9"}
    assert json.loads(found[action(2)].payload_summary) == {"edge_id": "e", "is_pinned": True, "previous_snapshot_hash": first["c1"], "typology_tag": "X"}
    assert found[seen].category == "OBSERVED" and found[action(6)].category == "ANALYST"


def test_streamed_pins_go_on_from_the_state(spark):
    replay.use_rocksdb(spark)
    source, out, check = (shared_dir(spark, n) for n in ("src", "out", "chk"))
    cases = _pin_cases(spark)
    rows = [("c1", i, "ef"[i % 2], i % 3 != 0, "XY"[i % 2], None) for i in range(1, 13)] + [("c9", 1, "e", True, "X", None)]
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, COMMANDS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(COMMANDS).parquet(source)
        got = online.run_once(online.pin_stream(stream, cases), out, check)
    want = evidence.pin_log(spark.createDataFrame(rows, COMMANDS), cases)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_release(spark):
    names = [(r, f"f{i}", "h") for r in ("ok", "bad", "few") for i in range(5 if r != "few" else 4)]
    exp = spark.createDataFrame(names, "release_id string, name string, sha256 string")
    act = exp.withColumn("sha256", F.when((F.col("release_id") == "bad") & (F.col("name") == "f1"), "x").otherwise(F.col("sha256")))
    rel = spark.createDataFrame([(r, False, True, "a", "a") for r in ("ok", "bad", "few")], "release_id string, drifted boolean, tests_passed boolean, git_sha string, built_sha string")
    assert {r.release_id: r.ready for r in release.release_status(rel, exp, act).collect()} == {"ok": True, "bad": False, "few": False}


def _payload(event="ev", part=0, offset=0, **change):
    body = {"schema_version": "1", "event_id": event, "source_partition": part, "source_offset": offset, "source_id": "a", "target_id": "b", "amount": 5.5, "event_time": "2024-01-01T00:00:00Z"}
    return json.dumps({k: v for k, v in (body | change).items() if v is not ...}).encode()


def _log(spark, rows):
    df = spark.createDataFrame([("t", p, o, v, i) for i, (p, o, v) in enumerate(rows)], "topic string, partition int, offset long, value binary, i long")
    return df.select("topic", "partition", "offset", "value", F.timestamp_seconds("i").alias("timestamp"))


@pytest.mark.parametrize(
    "change",
    [{"extra": 1}, {"amount": ...}, {"amount": "5"}, {"event_id": 1}, {"source_offset": 1.5}, {"source_offset": "0"}, {"amount": True}, {"amount": -1}, {"event_time": "2024-01-01T00:00:00"},
     {"event_time": "2024-01-01T00:00:00+07:00"}, {"event_time": "2024-01-01T00:00:00.5Z"}, {"event_time": "2024-13-01T00:00:00Z"}, {"source_id": " "}, {"event_id": "a b"}, {"schema_version": "2"}, {"source_partition": 3}],
)
def test_envelopes_are_strict(spark, change):
    r = envelopes.parse_envelope(_log(spark, [(0, 0, _payload(**change)), (0, 1, _payload(offset=1)), (0, 2, b"\xff{"), (0, 3, b"[]")])).orderBy("offset").collect()
    assert [x.valid for x in r] == [False, True, False, False]


OK = lambda i, p=0: (p, i, _payload(f"ev{p}-{i}", p, i))
CASES = [
    ([OK(0), OK(0)], ["ACCEPTED", "NOOP"]),
    ([OK(0), (0, 1, _payload("ev0-0", 0, 1))], ["ACCEPTED", "CONFLICT"]),
    ([OK(5)], ["NON_CONTIGUOUS_OFFSET"]),
    ([OK(0), (0, 1, b"x"), OK(2)], ["ACCEPTED", "INVALID_SCHEMA", "SKIPPED"]),
    ([OK(0), (0, 1, b"x"), OK(2), OK(0, 1), OK(1, 1)], ["ACCEPTED", "INVALID_SCHEMA", "SKIPPED", "ACCEPTED", "ACCEPTED"]),
    ([OK(0), OK(2), OK(3)], ["ACCEPTED", "NON_CONTIGUOUS_OFFSET", "SKIPPED"]),
]


@pytest.mark.parametrize(("rows", "want"), CASES)
def test_replay(spark, rows, want):
    p = envelopes.parse_envelope(_log(spark, rows))
    got = [r.status for r in replay.replay_batch(p).orderBy("partition", "offset", "timestamp").collect()]
    assert got == want


def _state(spark, *events):
    return spark.createDataFrame([("t", 0, 2), ("t", 9, 4)], "topic string, partition int, next_offset long"), replay.replay_state(
        replay.replay_batch(envelopes.parse_envelope(_log(spark, list(events))))
    )[1]


def test_replay_goes_on_from_an_initial_state(spark):
    start, known = _state(spark, OK(0), OK(1))
    r = replay.replay_batch(envelopes.parse_envelope(_log(spark, [OK(1), OK(2), OK(4)])), start, known)
    assert [x.status for x in r.orderBy("offset").collect()] == ["NOOP", "ACCEPTED", "NON_CONTIGUOUS_OFFSET"]
    assert {(x.partition, x.next_offset) for x in replay.committable_offsets(r, start).collect()} == {(0, 3), (9, 4)}


@pytest.mark.parametrize(("rows", "want"), [
    ([(0, 0, _payload("ev0-0", 0, 0, amount=6.5)), OK(2)], ["CONFLICT", "SKIPPED"]),  # other bytes at a known offset
    ([(0, 2, _payload("ev0-1", 0, 2))], ["CONFLICT"]),  # a known id at a new offset
    ([(3, 0, _payload("ev0-1", 3, 0))], ["CONFLICT"]),  # and in another partition
    ([(0, 1, json.dumps(json.loads(_payload("ev0-1", 0, 1)), indent=1, sort_keys=True).encode()), OK(2)], ["NOOP", "ACCEPTED"]),
    ([(0, 1, _payload("new", 0, 1))], ["NON_CONTIGUOUS_OFFSET"]),
])
def test_replay_compares_with_earlier_calls(spark, rows, want):
    start, known = _state(spark, OK(0), OK(1))
    r = replay.replay_batch(envelopes.parse_envelope(_log(spark, rows)), start, known)
    assert [x.status for x in r.orderBy("offset", "timestamp").collect()] == want


TIMED = lambda i, h, p=0: (p, i, _payload(f"ev{p}-{i}", p, i, event_time=f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00Z"))


def test_late_events_are_alike_in_batch_and_stream_and_the_state_stays_level(spark):
    replay.use_rocksdb(spark)
    source, out, check = (shared_dir(spark, n) for n in ("src", "out", "chk"))
    rows = [TIMED(i, i if i % 7 else max(0, i - 5)) for i in range(60)] + [TIMED(3, 3), TIMED(58, 58)]
    want = replay.replay_batch(envelopes.parse_envelope(_log(spark, rows)), lateness="3 hours")
    want = sorted((r.offset, r.status) for r in want.collect())
    assert {s for _, s in want} == {"ACCEPTED", "LATE_EVENT", "NOOP"} and (3, "NOOP") in want and (58, "NOOP") in want
    held = []
    for part in (rows[:20], rows[20:40], rows[40:60], rows[60:]):
        _log(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = replay.replay_stream(envelopes.parse_envelope(envelopes.broker_stream(spark, path=source)), lateness="3 hours")
        got = online.run_once(stream, out, check)
        held.append(replay.stored_state(spark, check)[1].count())
    # A call sorts its records, so that the retry follows its event at once; in a later call it is late.
    got = sorted((r.offset, r.status) for r in got.collect())
    assert got == sorted((3, "LATE_EVENT") if w == (3, "NOOP") else w for w in want)
    assert max(held) <= 4  # events of three hours


def test_conflicts_over_partitions_in_a_stream(spark):
    replay.use_rocksdb(spark)
    source, (out, check), (out2, check2) = shared_dir(spark, "src"), *[(shared_dir(spark, "out"), shared_dir(spark, "chk")) for _ in "ab"]
    parts = [[TIMED(0, 1), TIMED(1, 30, 1)], [(2, 0, _payload("ev0-0", 2, 0)), TIMED(1, 30, 1), (2, 1, _payload("ev1-1", 2, 1, event_time="2024-01-02T08:00:00Z"))]]
    for part in parts:
        _log(spark, part).coalesce(1).write.mode("append").parquet(source)
        parsed = envelopes.parse_envelope(envelopes.broker_stream(spark, path=source))
        got = online.run_once(replay.conflict_stream(parsed), out, check)
        bounded = online.run_once(replay.conflict_stream(parsed, "2 hours"), out2, check2)
    key = lambda df: sorted((r.event_id, r.partition, r.offset, r.first_partition, r.reason) for r in df.collect())
    assert key(got) == [("ev0-0", 2, 0, 0, "CONFLICT"), ("ev1-1", 2, 1, 1, "CONFLICT")]
    assert key(bounded) == [("ev0-0", 2, 0, -1, "LATE_EVENT"), ("ev1-1", 2, 1, 1, "CONFLICT")]  # the first is forgotten
    left = spark.read.format("statestore").option("path", check2).option("stateVarName", "first").load()
    assert left.select("key.event_id").distinct().count() <= 1


def test_streamed_replay_survives_a_restart_and_quarantines(spark):
    replay.use_rocksdb(spark)
    source, out, check, bad = (shared_dir(spark, n) for n in ("src", "out", "chk", "bad"))
    stream = lambda: replay.replay_stream(envelopes.parse_envelope(envelopes.broker_stream(spark, path=source)))
    _log(spark, [OK(0), OK(1), OK(0, 1)]).coalesce(1).write.parquet(source)
    assert online.run_once(stream(), out, check).where("status = 'ACCEPTED'").count() == 3
    _log(spark, [OK(1), (0, 2, _payload("ev0-0", 0, 2)), OK(3), OK(2, 1)]).coalesce(1).write.mode("append").parquet(source)
    got = {(r.partition, r.offset, r.status) for r in online.run_once(stream(), out, check).collect()}
    assert {(0, 1, "NOOP"), (0, 2, "CONFLICT"), (0, 3, "SKIPPED"), (1, 2, "NON_CONTIGUOUS_OFFSET")} <= got
    envelopes.quarantine_sink(spark.readStream.schema(spark.read.parquet(out).schema).parquet(out), bad, shared_dir(spark, "chk")).awaitTermination()
    q = envelopes.read_quarantine(spark, bad, "t", 0).collect()
    assert [(r.offset, r.reason) for r in q] == [(2, "CONFLICT")]


def test_feedback_is_appended_once(spark):
    replay.use_rocksdb(spark)
    source, out, check = (shared_dir(spark, n) for n in ("src", "out", "chk"))
    cases = spark.createDataFrame([("c1", "h1")], "case_id string, snapshot_hash string")
    rows = lambda *r: spark.createDataFrame(list(r), "event_id string, case_id string, disposition string, snapshot_hash string, payload_hash string")
    first, other, lost = ("f1", "c1", "CONFIRMED", "h1", "p1"), ("f1", "c1", "DISMISSED", "h1", "p2"), ("f2", "c9", "CONFIRMED", "h0", "p3")
    for batch in ([first, first], [first, other, lost]):
        rows(*batch).write.mode("append").parquet(source)
        online.feedback_sink(spark.readStream.schema(rows(first).schema).parquet(source), cases, out, check).awaitTermination()
    got = {(r.event_id, r.payload_hash, r.rejected, r.snapshot_matches) for r in spark.read.parquet(out).collect()}
    assert got == {("f1", "p1", False, True), ("f1", "p2", True, True), ("f1", "p1", True, True), ("f2", "p3", True, False)}


EDGE = "edge_id string, source_id string, target_id string, amount double, event_time timestamp"


def test_running_features_reject_repeats_and_late_edges(spark):
    replay.use_rocksdb(spark)
    source, out, check = (shared_dir(spark, n) for n in ("src", "out", "chk"))
    at = lambda m: datetime(2024, 1, 1, 10, m)
    batches = [
        [("e2", "a", "b", 1.0, at(2)), ("e1", "a", "b", 2.0, at(1)), ("e1", "a", "b", 2.0, at(1)), ("e3", "a", "b", 5.0, at(2))],
        [("e4", "b", "a", 1.0, at(2)), ("e2", "a", "b", 1.0, at(9)), ("e3", "a", "b", 5.0, at(0)), ("e5", "a", "b", 1.0, at(1)), ("e6", "b", "c", 7.0, at(3))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, EDGE).coalesce(1).write.mode("append").parquet(source)
        online.checked_edges(spark.readStream.schema(EDGE).parquet(source), out, check).awaitTermination()
    assert {r.edge_id for r in spark.read.parquet(f"{out}/accepted").collect()} == {"e1", "e2", "e3", "e4", "e6"}
    got = sorted((r.batch, r.edge_id, r.reason) for r in spark.read.parquet(f"{out}/rejected").collect())
    assert got == [(0, "e1", "DUPLICATE_EDGE"), (1, "e2", "DUPLICATE_EDGE"), (1, "e3", "DUPLICATE_EDGE"), (1, "e5", "NON_MONOTONIC_ORDER")]


def test_counters_of_a_stream(spark):
    counters = online.Counters()
    spark.streams.addListener(counters)
    try:
        source = shared_dir(spark, "src")
        spark.range(7).write.parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", shared_dir(spark, "chk")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if counters.processed.get("counted"):
                break
            time.sleep(0.1)
        assert counters.processed["counted"] == 7 and counters.latency_ms["counted"].quantile(0.5) > 0
    finally:
        spark.streams.removeListener(counters)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_nearest_ranks_are_those_of_sorted_values(spark, n):
    values = [("g", float(i * 37 % 101)) for i in range(n)] + [("empty", None), (None, 3.0), (None, 1.0)]
    df = spark.createDataFrame(values, "g string, x double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: tuple(r)[1:] for r in claims.nearest_rank(df, "x", *shares, by=("g",)).collect()}
    ordered = sorted(x for g, x in values if g == "g")
    assert got["g"] == tuple(ordered[max(0, math.ceil(p * n) - 1)] for p in shares)
    assert got["empty"] == (0.0,) * 5 and got[None] == (1.0, 1.0, 1.0, 3.0, 3.0)
    assert tuple(claims.nearest_rank(df.limit(0), "x", 0.5).collect()) in ((), ((0.0,),))


def test_text_of_doubles_is_that_of_scripting_languages(spark):
    rng = random.Random(4)
    values = [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(20_000)]
    values += [round(rng.uniform(0, 1e6), 2) for _ in range(5000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 18) for _ in range(5000)]
    values += [0.0, -0.0, 5e-324, 1e23, 2e23, 1e16, 1e15, 9999999999999998.0, 1e-4, 1e-5, 1e22, 2.0**62, 2.0**63, 1.7976931348623157e308, float("inf"), float("-inf"), 100.0]
    df = spark.createDataFrame([(v,) for v in values if not math.isnan(v)], "x double").repartition(4)
    bad = [r for r in df.select("x", hashing.float_text(F.col("x")).alias("t")).collect() if r.t != repr(r.x)]
    # Digits are the engine's own: above 2^63 the last of 17 may be the second nearest.
    assert all(float(r.t) == r.x and len(r.t) <= len(repr(r.x)) + 1 and abs(r.x) > 2**63 for r in bad) and len(bad) <= 5
    assert spark.createDataFrame([(float("nan"),), (None,)], "x double").select(hashing.float_text(F.col("x")).alias("t")).where("t is not null").count() == 0


def test_latencies_in_buckets():
    h, other = online.Histogram(4), online.Histogram(4)
    values = [0, 1, 3, 7, 20, 55, 148, 403, 1096, 2980]
    for v in values:
        (h if v % 2 else other).add(v)
    h.merge(other)
    for share in (0.1, 0.5, 0.9, 1.0):
        exact = values[math.ceil(share * len(values)) - 1]
        assert max(exact, 1) <= h.quantile(share) * 1.0001 <= max(exact, 1) * 2**0.25 * 1.001
    assert online.Histogram().quantile(0.5) is None


def test_a_local_session_without_a_shared_folder_gets_one_of_its_own():
    from types import SimpleNamespace

    from fundweave import shared

    conf = SimpleNamespace(get=lambda key, default: default)  # the setting cannot be changed in a running session
    session = lambda app, master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))
    a, b, c = (shared.shared_dir(session(app, "local[2]"), "x") for app in ("one", "one", "two"))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] != c.rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("one", "spark://host:7077"), "x")
