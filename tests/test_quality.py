"""Intake: reason codes, reports, adapters, artifacts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fundweave.operators import quality
from fundweave.shared import shared_dir, with_ordinal
from fundweave.sources import transfers

RAW = "sourceNodeId string, targetNodeId string, value double, time double, n int"


def _report(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW)
    r = quality.quality_report(df.drop("n")).first()
    return r.input_rows, r.accepted_rows, r.rejected_rows, r.duplicate_rows


def _plain_reason(source, target, value, tick):
    if any(x is None or not x.strip() for x in (source, target)):
        return quality.BAD_ID
    if value is None or not math.isfinite(value) or value <= 0:
        return quality.BAD_AMOUNT
    if tick is None or not math.isfinite(tick) or tick < 0 or tick != int(tick):
        return quality.BAD_TICK
    return None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reports_and_quarantine_equal_a_plain_pass(spark, seed):
    r = random.Random(seed)
    ids, values = ["k1", "k2", "k3", None, "", " \t ", "\u2003"], [0.01, 7.25, 7.25, 8e11, 0.0, -3.5, None, float("nan"), float("inf"), float("-inf")]
    rows = [(r.choice(ids), r.choice(ids[:5]), r.choice(values), r.choice([0.0, 3.0, 3.0, 12.0, -2.0, 2.25, None])) for _ in range(150)]
    rows += [("k1", "k2", 7.25, 3.0)] * 4
    reasons = [_plain_reason(*x) for x in rows]
    distinct = len({tuple("nan" if v != v else v for v in x) for x in rows})
    assert _report(spark, rows) == (len(rows), reasons.count(None), len(rows) - reasons.count(None), len(rows) - distinct)
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], RAW).repartition(3)
    good, bad = quality.clean_transfers(df, "n")
    assert {x.row_ordinal: x.reason_code for x in bad.collect()} == {i: k for i, k in enumerate(reasons) if k}
    assert sorted(x.n for x in good.collect()) == [i for i, k in enumerate(reasons) if k is None]


def test_reason_precedence_and_text_casts(spark):
    rows = [("", "b", "-1", "x", 0), ("a", "b", "-1", "x", 1), ("a", "b", "5", "x", 2), ("a", "b", " 5 ", "1", 3), ("a", "b", "1e2", "3", 4)]
    df = spark.createDataFrame(rows, "sourceNodeId string, targetNodeId string, value string, time string, n int")
    got = {r.n: r.r for r in df.select("n", quality.reason_code().alias("r")).collect()}
    assert got == {0: quality.BAD_ID, 1: quality.BAD_AMOUNT, 2: quality.BAD_TICK, 3: quality.BAD_AMOUNT, 4: None}


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    for n in (1, 7):
        got = with_ordinal(df.repartition(n), "k").select("k", "row_ordinal").collect()
        assert sorted((r.row_ordinal, r.k) for r in got) == [(i, i) for i in range(1000)]


def test_adapters(spark):
    df = spark.createDataFrame([("t1", "a", "b", 5.0)], "transaction_id string, orig_id string, dest_id string, amount double").withColumn("timestamp", F.current_timestamp())
    assert transfers.adapt(df, "transactions").columns == list(quality.EDGE)
    quality.assert_canonical(transfers.adapt(df, "transactions"))
    with pytest.raises(ValueError, match="dest_id"):
        transfers.adapt(df.drop("dest_id"), "transactions")
    raw = spark.createDataFrame([("a", "b", 5.0, 4)], "sourceNodeId string, targetNodeId string, value double, time long")
    e = transfers.adapt_ticks(raw, "time", start="2024-01-01T00:00:00Z", tick_seconds=90, prefix="x:").first()
    assert (e.edge_id, e.event_time.isoformat()) == ("x:0", "2024-01-01T00:06:00")


@pytest.mark.parametrize("bad", [{"sourceNodeId": " \t"}, {"targetNodeId": None}, {"value": 0.0}, {"value": float("inf")}, {"value": None}, {"time": -1}, {"time": None}])
def test_tick_rules(spark, bad):
    row = {"sourceNodeId": "secret-a", "targetNodeId": "b", "value": 5.0, "time": 4} | bad
    df = spark.createDataFrame([tuple(row.values()), ("a", "b", 1.0, 0)], "sourceNodeId string, targetNodeId string, value double, time long")
    with pytest.raises(ValueError) as e:
        transfers.adapt_ticks(df, "time", start="2024-01-01T00:00:00Z", tick_seconds=1, prefix="x")
    assert f"bad_{next(iter(bad))}" in str(e.value) and "secret-a" not in str(e.value)


def test_tick_parameters(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 0)], "sourceNodeId string, targetNodeId string, value double, time long")
    good = {"start": "2024-01-01T07:00:00+07:00", "tick_seconds": 1, "prefix": "x"}
    assert transfers.adapt_ticks(df, "time", **good).first().event_time.isoformat() == "2024-01-01T00:00:00"
    for change in ({"start": "2024-01-01 00:00:00"}, {"tick_seconds": 0}, {"prefix": " "}):
        with pytest.raises(ValueError):
            transfers.adapt_ticks(df, "time", **(good | change))
    for column, kind in (("time", "double"), ("value", "string")):
        with pytest.raises(ValueError, match=column if column == "value" else "integer"):
            transfers.adapt_ticks(df.withColumn(column, F.col(column).cast(kind)), "time", **good)


def test_clean_artifacts_need_their_own_report(spark):
    raw = spark.createDataFrame([("a", "b", 1.0, 0), ("a", None, 1.0, 0)], "sourceNodeId string, targetNodeId string, value double, time long")
    edges = transfers.adapt_ticks(quality.clean_transfers(raw)[0], "time", start="2024-01-01T00:00:00Z", tick_seconds=1, prefix="x")
    report = quality.quality_report(raw, source_id="src", raw_sha256="0" * 64)
    good = {"source": "src", "parent_hash": "0" * 64, "adapter": "ticks"}
    m = transfers.write_clean_artifact(edges, shared_dir(spark, "a"), report, **good, params=("k:v",)).first()
    assert (m.row_count, m.params) == (1, ["k:v", f"quality_report_sha256:{report.first().report_hash}"])
    assert transfers.write_clean_artifact(edges, shared_dir(spark, "a"), "a" * 64, **good).first().params == ["quality_report_sha256:" + "a" * 64]
    for edges_, report_, change in ((edges, report, {"source": "other"}), (edges, report, {"parent_hash": "1" * 64}), (edges.limit(0), report, {}), (edges, "A" * 64, {}), (edges, "a", {})):
        with pytest.raises(ValueError):
            transfers.write_clean_artifact(edges_, shared_dir(spark, "a"), report_, **(good | change))


def test_run_ledger(spark):
    row = ("r1", "a" * 40, "b" * 64, "c" * 64, "ap", 0.5)
    runs = lambda *rows: spark.createDataFrame(list(rows), "run_id string, git_sha string, dataset_hash string, split_hash string, metric string, value double")
    path = shared_dir(spark, "ledger")
    assert [tuple(r) for r in transfers.run_ledger(runs(row), path).collect()] == [row]
    assert transfers.run_ledger(runs(("r1", *row[1:5], 0.25)), path).first().value == 0.25  # each call reads back its own rows
    for bad in (("r1", "A" * 40, *row[2:]), (*row[:2], "b", *row[3:]), (*row[:3], None, *row[4:]), (*row[:5], float("nan")), (*row[:5], None)):
        with pytest.raises(ValueError, match="bad_"):
            transfers.run_ledger(runs(row, ("r2", *bad[1:])), path)
    with pytest.raises(ValueError, match="repeated_metric"):
        transfers.run_ledger(runs(row, row), path)
    assert spark.read.parquet(path).count() == 2


def test_run_artifacts_are_written_once(spark):
    path = shared_dir(spark, "run")
    transfers.append_run_artifact(spark, {"b": 1, "a": "é"}, path)
    assert spark.read.text(path).first().value == '{"a": "é", "b": 1}'
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        transfers.append_run_artifact(spark, {}, path)


def test_raw_csv_is_read_leniently(spark):
    path = shared_dir(spark, "csv")
    rows = [("t1", "a", "b", "5.5", "2024-01-01 10:00:00"), ("t2", "a", "b", "many", "never")]
    spark.createDataFrame(rows, "transaction_id string, orig_id string, dest_id string, amount string, timestamp string").write.option("header", True).csv(path)
    got = {r.edge_id: r for r in transfers.read_transfers(spark, path, "transactions", "csv").collect()}
    assert got["t1"].amount == 5.5 and got["t1"].event_time.hour == 10 and (got["t2"].amount, got["t2"].event_time) == (None, None)
    with pytest.raises(ValueError, match="missing source columns"):
        transfers.read_transfers(spark, path, "accounts", "csv")


@pytest.mark.parametrize("bad", [{"edge_id": " "}, {"source_id": None}, {"amount": float("nan")}, {"amount": None}, {"event_time": None}])
def test_canonical_rules_name_columns_not_values(spark, bad):
    row = {"edge_id": "e", "source_id": "secret-a", "target_id": "b", "amount": 1.0, "event_time": "2024-01-01"} | bad
    df = spark.createDataFrame([tuple(row.values())], "edge_id string, source_id string, target_id string, amount double, event_time string")
    with pytest.raises(ValueError) as e:
        quality.assert_canonical(df.withColumn("event_time", F.col("event_time").cast("timestamp")))
    assert f"bad_{next(iter(bad))}" in str(e.value) and "secret-a" not in str(e.value)


def test_labels(spark):
    df = spark.createDataFrame([("1", 0.0, "2"), ("2", 1.0, "3"), ("3", 0.5, "3"), ("4", None, None)], "nodeid string, isFraud double, fraudStep string")
    lab = quality.account_labels(df)
    assert [r.is_fraud for r in lab.orderBy("account_id").collect()] == [0, 1, None, None]
    with pytest.raises(ValueError):
        quality.assert_labels(lab)


def test_artifacts_refuse_to_overwrite_and_count_rows(spark):
    df = spark.createDataFrame([("e1", "a", "b", 5.0, "x")], "edge_id string, source_id string, target_id string, amount double, label string").withColumn("event_time", F.current_timestamp())
    path = shared_dir(spark, "artifact")
    m = transfers.write_public_artifact(df, path, source="s", parent_hash="0" * 64, adapter="transactions").first()
    assert m.row_count == 1 and "label" not in m.columns and len(m.output_hash) == 64
    assert "label" not in spark.read.parquet(path).columns
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        transfers.write_public_artifact(df, path, source="s", parent_hash="0" * 64, adapter="transactions")
    assert transfers.artifact_inventory(spark, path).where("length(sha256) = 64").count() >= 1


def test_case_documents_and_corpus(spark, tmp_path):
    import json

    doc = {"caseId": "c1", "seedEntity": "a", "createdAt": "2024-01-01T00:00:00Z", "nodes": [{"nodeId": "a", "riskScore": 0.5}],
           "edges": [{"edgeId": "e2", "source": "a", "target": "b", "flowAmount": 5.0}, {"edgeId": "e1", "source": "b", "target": "a", "flowAmount": 6.0}], "evidence": []}
    (tmp_path / "case.json").write_text(json.dumps(doc, indent=1))
    got = transfers.read_case_documents(spark, str(tmp_path / "case.json"))
    assert got["cases"].first().trace_edge_ids == ["e1", "e2"]
    assert got["edges"].columns[:4] == ["case_id", "position", "edge_id", "source"]
    corpus = {"cases": [{"caseId": "c1", "graphEdges": [{"edgeId": "e", "source": "a", "target": "b"}], "evidence": [{"evidenceId": "v"}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(corpus, indent=1))
    gold = transfers.read_gold_corpus(spark, str(tmp_path / "gold.json"))
    e, v = gold["edges"].first(), gold["evidence"].first()
    assert (e.flow_amount, e.relationship_type, e.identity_confidence) == (1000.0, "FUNDS_TRANSFER", 0.95)
    assert (v.category, v.polarity, v.confidence) == ("OBSERVED", "SUPPORTING", 0.9)
