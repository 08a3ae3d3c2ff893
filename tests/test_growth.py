"""What showed on larger tables only, on small examples."""

import hashlib
import itertools
import json
import math
import pathlib
import random
import time

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fundweave.operators import evaluation, evidence, models, quality, traversal
from fundweave.plans import graph, intake, streams, tables
from fundweave.shared import shared_dir, staged
from fundweave.streaming import envelopes, online, pages, replay
from tests import oracle


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Events twice, with the same times under other keys, as larger tables have them; the first copy is shortened."""
    folder = tmp_path_factory.mktemp("copies")
    with duckdb.connect() as con:
        con.sql(f"""COPY (SELECT event_id + 1000 * i AS event_id, ts, user_id + 100 * i AS user_id, event_type, value, props
                          FROM '{oracle.DATA}/events.parquet', range(2) AS t(i)) TO '{folder}/events.parquet'""")
    return str(folder)


def test_buckets_of_powers_of_two(spark):
    values = [2**i + j for i in range(1, 45) for j in (-1, 0, 1)]
    df = spark.createDataFrame([(v,) for v in values], "ms long")
    for per_octave in (1, 4):
        h = online.Histogram(per_octave)
        for v in values:
            h.add(v)
        assert {r.bucket: r.n for r in online.latency_histogram(df, "ms", per_octave).collect()} == h.counts


def test_gaps_of_times_that_part_milliseconds(spark, tmp_path):
    # Three accounts, on both sides of the epoch; gaps of few milliseconds stand at the bounds of buckets.
    with duckdb.connect() as con:
        con.sql(f"""COPY (SELECT i AS event_id, epoch_ms(0) + to_microseconds(CASE WHEN i % 97 > 0 THEN i * 1499 + i * i % 977 - 500000 END) AS ts, i % 3 AS user_id,
                          'view' AS event_type, 1.0::DOUBLE AS value, '{{"k": 1}}' AS props
                          FROM range(1000) AS t(i)) TO '{tmp_path}/events.parquet'""")
    oracle.compare(spark, oracle.connection(str(tmp_path)), streams.QUERIES["latency_histogram"], streams.ORACLE_SQL["latency_histogram"], str(tmp_path))


def test_checked_edges_whose_times_do_not_follow_their_ids(spark, copies):
    oracle.compare(spark, oracle.connection(copies), streams.QUERIES["checked_edges"], streams.ORACLE_SQL["checked_edges"], copies)


def test_a_snapshot_costs_what_changes(spark):
    rng = random.Random(3)
    case = {"case_id": "c é", "created_at": None, "evidence_ids": ["ev:a"], "seed_entity": "s", "trace_edge_ids": [f"e{i}" for i in range(500)]}
    body, ids = evidence.Snapshot(case), ["ev:a"]
    for i in range(2000):
        ids.append(f"ev:{rng.choice(['pin', 'txn'])}:{rng.getrandbits(64):x}é")
        body.add(ids[-1])
        body.add(rng.choice(ids))  # known
        if i % 50 == 0:
            text = json.dumps({**case, "evidence_ids": sorted(ids)}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            assert body.digest() == hashlib.sha256(text.encode()).hexdigest()
    assert body.ids() == sorted(ids)
    commands = [("c", i, f"e{i % 500}", True, str(i), None) for i in range(8000)]
    began = time.process_time()
    case = {"case_id": "c", "created_at": None, "evidence_ids": [], "seed_entity": "s", "trace_edge_ids": [f"e{i}" for i in range(500)], "snapshot_hash": "x"}
    assert {r[5] for r in evidence.apply_pins(case, {}, commands)} == {"APPLIED"} and len(case["evidence_ids"]) == 8500
    assert time.process_time() - began < 5  # 17 s when each snapshot was encoded as a whole


def test_a_stream_of_pins_writes_little_a_command(spark, copies, monkeypatch):
    paths = {}
    monkeypatch.setattr(streams, "shared_dir", lambda spark, name: paths.setdefault(name, shared_dir(spark, name)))
    got = streams.QUERIES["pin_stream_parity"](spark, copies).first()
    assert (got.commands, got.differing) == (4 * tables.edges(spark, copies).count(), 0)
    size = lambda name, files: sum(f.stat().st_size for f in pathlib.Path(paths[name].removeprefix("file://")).rglob(files))
    assert size("pins", "*.parquet") < 40 * got.commands  # 129 with ids and hashes as text
    assert size("checkpoint", "*.sst") < 20 * got.commands  # 53 with the evidence that pins add


def test_logs_of_pins_are_compared_by_case_then_by_command(spark):
    edges = [f"e{i}" for i in range(20)]
    cases = spark.createDataFrame([(c, "s", None, edges, []) for c in "abcd"], "case_id string, seed_entity string, created_at timestamp, trace_edge_ids array<string>, evidence_ids array<string>")
    rows = [(c, i, edges[i % 20], i % 3 > 0, "t", None) for c in "abcd" for i in range(30)] + [("x", 1, "e1", True, "t", None)]
    commands = spark.createDataFrame(rows, "case_id string, seq long, edge_id string, is_pinned boolean, tag string, expected_hash string")
    cases = staged(evidence.pin_cases(cases), "cases")
    log = lambda c: staged(evidence.digested(evidence.pin_log(c, cases)), "log")
    compare = lambda c, got: tuple(evidence.pin_parity(c, cases, got).first())
    said = log(commands)
    assert compare(commands, said) == (121, 0)
    # One command that is told otherwise, two that are missing, one too many and a case that only the stream has.
    other = said.withColumn("said", F.when(F.expr("case_id = 'a' and seq = 7"), F.lit(b"?")).otherwise(F.col("said"))).where("not (case_id = 'b' and seq in (3, 4))")
    more = said.where("case_id = 'c' and seq = 1").withColumn("seq", F.lit(99).cast("long")).unionByName(said.where("case_id = 'x'").withColumn("case_id", F.lit("y")))
    assert compare(commands, other.unionByName(more)) == (123, 5)
    assert compare(commands, said.limit(0)) == (121, 121)
    # Commands that come twice count twice and are alike.
    twice = commands.unionByName(commands)
    assert compare(twice, log(twice)) == (242, 0)


class _Store:
    """The calls that pages make of a state store, counted."""

    def __init__(self):
        self.values, self.calls, self.maps = {}, 0, {}

    def getValueState(self, name, schema):
        return _Value(self, self.values, name)

    def getMapState(self, name, key, schema):
        return _Map(self, self.maps.setdefault(name, {}))


class _Value:
    def __init__(self, store, values, name):
        self.store, self.values, self.name = store, values, name

    def exists(self):
        self.store.calls += 1
        return self.name in self.values

    def get(self):
        self.store.calls += 1
        return self.values[self.name]

    def update(self, value):
        self.store.calls += 1
        self.values[self.name] = value


class _Map:
    def __init__(self, store, values):
        self.store, self.values = store, values

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.values

    def getValue(self, key):
        self.store.calls += 1
        return self.values[key]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.values[key]


def test_pages_hold_what_a_map_holds_in_few_calls():
    store, want, rng = _Store(), {}, random.Random(5)
    seen = pages.Pages(store, "seen")
    for trigger in range(30):
        before, n = store.calls, rng.choice([1, 20, 3000])
        seen.begin()
        for _ in range(n):
            ident = f"é{rng.randrange(20_000)}"
            assert seen.get(ident) == want.get(ident)
            seen.put(ident, [trigger])
            want[ident] = [trigger]
        for ident in rng.sample(sorted(want), min(len(want), n // 3)):
            seen.remove(ident)
            del want[ident]
        seen.end()
        assert n < 3000 or store.calls - before < 3000  # two calls an id and more before
    seen.begin()
    assert dict(seen.items()) == want and seen.n == len(want)
    for ident in sorted(want):
        seen.remove(ident)
    seen.end()
    assert not store.maps["seen"] and store.values["seen_size"][0] == 0


def test_an_id_that_two_partitions_have_taken_gives_one_row_a_record(spark):
    payload = lambda event, part, at: json.dumps({"amount": 5.5, "event_id": event, "event_time": "2024-01-01T00:00:00Z", "schema_version": "1",
                                                  "source_id": "a", "source_offset": at, "source_partition": part, "target_id": "b"}).encode()
    log = lambda *rows: envelopes.parse_envelope(spark.createDataFrame([("t", p, o, payload(e, p, o), None) for p, o, e in rows], envelopes.RECORD))
    one = replay.replay_batch(log((0, 0, "x"), (1, 0, "x"), (1, 1, "y")))
    assert {r.status for r in one.collect()} == {"ACCEPTED"}
    two = replay.replay_batch(log((0, 0, "x"), (1, 0, "x"), (2, 0, "x"), (0, 1, "z")), *replay.replay_state(one))
    assert sorted((r.partition, r.offset, r.status) for r in two.collect()) == [(0, 0, "NOOP"), (0, 1, "ACCEPTED"), (1, 0, "NOOP"), (2, 0, "CONFLICT")]


@pytest.mark.parametrize("name", ["replay_resumed", "replay_resumed_stream"])
def test_calls_that_go_on_equal_their_sql(spark, name, tmp_path):
    # Of 30,000 events, whose halves part a repeated id and hold a broken record of the kind that is sent again.
    with duckdb.connect() as con:
        con.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE event_id < 30000) TO '{tmp_path}/events.parquet'")
    oracle.compare(spark, oracle.connection(str(tmp_path)), streams.QUERIES[name], streams.ORACLE_SQL[name], str(tmp_path))


def test_the_gate_needs_a_row_a_multiset_of_picks(spark):
    rng = random.Random(7)
    rows = [(i, [rng.randrange(60, 70) * 1.0 for _ in range(5)], [rng.randrange(60, 72) * 1.0 for _ in range(5)]) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, baseline array<double>, candidate array<double>")
    out = evaluation.bootstrap_gate(df)
    for r in out.collect():
        d = [c - b for b, c in zip(r.baseline, r.candidate, strict=True)]
        means = sorted(sum(p) / 5 for p in itertools.product(d, repeat=5))
        assert r.lower_bound == pytest.approx(means[78] + 0.1 * (means[79] - means[78]))


def test_trace_floors_from_few_edges_hold_and_spare_the_rest(spark):
    rng = random.Random(5)
    rows = [(f"e{a:02d}-{i:02d}", f"n{a}", f"n{rng.randrange(40)}", float(rng.randrange(1, 400))) for a in range(40) for i in range(60)]
    edges = spark.createDataFrame(rows, "edge_id string, source_id string, target_id string, amount double")
    best = Window.partitionBy("source_id").orderBy(F.desc("amount"), "edge_id")
    few = edges.withColumn("_r", F.row_number().over(best)).where("_r <= 10").drop("_r")
    nodes = spark.createDataFrame([(f"n{a}", None) for a in range(40)], "seed string, floor double")
    exact = {r.seed: r.floor for r in traversal._two_hop_floors(nodes, edges, 51).collect()}
    coarse = traversal._raised(nodes, traversal._two_hop_floors(nodes, few, 51))
    near = {r.seed: r.floor for r in coarse.collect()}
    assert len(exact) == 40 and all(near[s] is not None and near[s] <= exact[s] for s in exact)
    assert {r.seed: r.floor for r in traversal._two_hop_floors(coarse, edges, 51).collect()} == exact
    # Edges within two hops that are not below the first floors: few beside the 60 x 60 there are.
    of = {}
    for e in rows:
        of.setdefault(e[1], []).append(e)
    for s in exact:
        ahead = [e for e in of[s] if e[3] >= near[s]]
        assert sum(e[3] >= near[s] for t in {x[2] for x in ahead} for e in of[t]) < 300


def test_traces_are_folded_without_a_group_a_seed(spark):
    plan = graph.QUERIES["trace_candidates_one_hop"](spark, oracle.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_order_lines_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_LINES", 1000)
    lines = tables.lines(spark, oracle.DATA)
    parts = spark.read.parquet(f"{oracle.DATA}/lineitem.parquet").count() // 1000 + 1
    assert lines.rdd.getNumPartitions() == parts > 4
    con = oracle.connection()
    oracle.compare(spark, con, intake.QUERIES["canonical_edges"], intake.ORACLE_SQL["canonical_edges"])
    oracle.compare(spark, con, intake.QUERIES["read_transfers"], intake.ORACLE_SQL["read_transfers"])


def test_numbers_are_judged_without_reading_them_as_text(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 5e-324, -1.0, 1.5, 1e300, 9007199254740993.0]
    rows = [(f"a{i}", f"b{j}", v, t) for i, v in enumerate(values) for j, t in enumerate(values)]
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, "sourceNodeId string, targetNodeId string, value double, time double")
        df = df.withColumn("value", F.col("value").cast(kind)).withColumn("time", F.col("time").cast(kind))
        known = quality.reason_code(kinds=df.schema)
        assert df.where(~known.eqNullSafe(quality.reason_code())).count() == 0
        plan = df.select(known)._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan.upper()


def test_a_swap_weighs_what_the_case_loses(spark):
    rng = random.Random(7)
    edges = [(f"c{c}", f"e{c}-{i}", rng.choice(["RELEVANT", "CONFIRMED_BENIGN"]), rng.random()) for c in range(6) for i in range(rng.choice([2, 9, 40]))]
    edges += [("only", f"o{i}", "RELEVANT", 0.5) for i in range(3)]
    sample = models.ranking_sample(spark.createDataFrame(edges, "case_id string, edge_id string, label string, x double"), ["x"], per_class=15)
    weighted = models._gain_of_swap(models.ranking_pairs(sample, 4), sample, models.Logistic(0.0, (2.0,)))
    assert "aggregate" not in weighted.select("weight")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # not once a pair
    by_case = {}
    for r in sample.collect():
        by_case.setdefault(r.case_id, []).append(r)
    discount = lambda rank: 1 / math.log2(rank + 1)
    got = weighted.collect()
    assert len(got) > 50
    for r in got:
        order = sorted(by_case[r.case_id], key=lambda s: (-2.0 * s.x[0], s.edge_id, s.i))
        rank = {(s.relevant, s.i): k for k, s in enumerate(order, 1)}
        ideal = sum(discount(k) for k in range(1, r.n_relevant + 1))
        assert r.weight == pytest.approx(abs(discount(rank[1, r.p]) - discount(rank[0, r.n])) / ideal)
