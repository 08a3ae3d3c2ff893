"""Evidence and case tables: idempotent puts, referential checks, selections, pins."""

from __future__ import annotations

import bisect
import hashlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundweave.functions.hashing import integrity_hash
from fundweave.functions.scalars import utc_seconds
from fundweave.shared import staged


def put_status(batch: DataFrame, current: DataFrame, key: str, hash_col: str) -> DataFrame:
    """batch with status INSERT, NOOP or CONFLICT against the current table.

    The same key with the same hash is NOOP, with another one CONFLICT. Inside the batch a
    key with two hashes is a CONFLICT in all its rows.
    """
    inside = batch.groupBy(key).agg((F.min(hash_col) != F.max(hash_col)).alias("_clash"))
    have = current.select(key, F.col(hash_col).alias("_have"))
    j = batch.join(inside, key).join(have, key, "left")
    status = (
        F.when(F.col("_clash"), "CONFLICT").when(F.col("_have").isNull(), "INSERT")
        .when(F.col("_have").eqNullSafe(F.col(hash_col)), "NOOP").otherwise("CONFLICT")
    )
    return j.withColumn("status", status).drop("_clash", "_have")


def get_many(requests: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """request_id, position and the item of every requested id, in request order.

    requests (request_id, ids array). A missing item is a row with found = false.
    """
    asked = requests.select("request_id", F.posexplode("ids").alias("position", key))
    return asked.join(items.withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def resolve_cases(cases: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case edges whose ends are known, gaps): cases (case_id, trace_edge_ids).

    gaps: case_id, kind (edge, node), id that no table has; a case with any is an error.
    """
    ids = cases.select("case_id", F.explode("trace_edge_ids").alias("edge_id"))
    found = ids.join(edges, "edge_id")
    no_edge = ids.join(edges, "edge_id", "left_anti").select("case_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"))
    ends = found.select("case_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    no_node = ends.join(nodes, "node_id", "left_anti").select("case_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    return found, no_edge.unionByName(no_node)


def referential_gaps(**pairs: tuple[DataFrame, str, DataFrame, str]) -> DataFrame:
    """rule, id of rows of a table whose reference another lacks.

    Each rule is (table, column, referenced table, its column).
    """
    out = None
    for rule, (table, column, other, key) in pairs.items():
        ref = other.select(F.col(key).alias("_k")).distinct()
        gap = table.join(ref, table[column] == ref["_k"], "left_anti").select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("id")).distinct()
        out = gap if out is None else out.unionByName(gap)
    return out


def evidence_by_polarity(evidence: DataFrame, polarity: str, limit: int = 50) -> DataFrame:
    """case_id, evidence_id, rank: the first evidence of one polarity of each case, by id."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is 1..50")
    w = Window.partitionBy("case_id").orderBy("evidence_id")
    e = evidence.where(F.col("polarity") == polarity).withColumn("rank", F.row_number().over(w))
    return e.where(F.col("rank") <= limit).select("case_id", "evidence_id", "rank")


def prompt_evidence(evidence: DataFrame, pinned: DataFrame, limit: int = 50) -> DataFrame:
    """case_id, evidence_id, position: pinned first, then mitigating, then supporting; each once."""
    w = Window.partitionBy("case_id").orderBy("evidence_id")
    pins = evidence.join(pinned, ["case_id", "evidence_id"], "left_semi").withColumn("rank", F.row_number().over(w))
    pins = pins.where(F.col("rank") <= limit).select("case_id", "evidence_id", "rank")
    groups = [pins, evidence_by_polarity(evidence, "MITIGATING", limit), evidence_by_polarity(evidence, "SUPPORTING", limit)]
    every = None
    for i, g in enumerate(groups):
        part = g.withColumn("grp", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("case_id", "evidence_id").agg(F.min(F.struct("grp", "rank")).alias("at"))
    return first.select("case_id", "evidence_id", F.row_number().over(Window.partitionBy("case_id").orderBy("at", "evidence_id")).alias("position"))


def case_summary(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.size("evidence_ids").alias("n_evidence"), F.size("trace_edge_ids").alias("n_trace_edges"))


def latest_pins(commands: DataFrame) -> DataFrame:
    """case_id, edge_id and the state of the last command (case_id, edge_id, seq, is_pinned, tag)."""
    last = commands.groupBy("case_id", "edge_id").agg(F.max_by(F.struct("is_pinned", "tag", "seq"), "seq").alias("x"))
    return last.select("case_id", "edge_id", "x.*")


#: How the evidence that pins leave names its method.
ACTION_METHOD, OBSERVED_METHOD = "forensic-canvas-pin-v1", "forensic-canvas-transaction-v1"
CASE_FIELDS = ("case_id", "created_at", "evidence_ids", "seed_entity", "trace_edge_ids")
PIN_SCHEMA = (
    "case_id string, seq long, edge_id string, is_pinned boolean, tag string, status string,"
    "previous_hash string, snapshot_hash string, evidence_id string, action_id string"
)


_JSON = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))
#: Evidence ids of a block of a snapshot's text.
_BLOCK = 64


def ids_of(case_id: str) -> tuple[Callable[[str], str], Callable[[int], str]]:
    """(of an edge, of a command's seq): the evidence ids that pins of a case leave."""
    head = hashlib.sha256(f'{{"case_id":{_JSON.encode(case_id)},'.encode())

    def digest(name: str, value) -> str:
        state = head.copy()
        state.update(f'"{name}":{_JSON.encode(value)}}}'.encode())
        return state.hexdigest()

    return lambda edge: "ev:txn:" + digest("edge_id", edge), lambda seq: "ev:pin:" + digest("seq", seq)[:32]


class Snapshot:
    """The hash of a case's CASE_FIELDS while evidence ids are added.

    The ids are kept in order as blocks of canonical JSON, with the state of the hash before
    each block: a new id is hashed from its block on, and nothing else is encoded again.
    """

    def __init__(self, case: dict) -> None:
        ids = case["evidence_ids"]
        rest = [{k: case[k] for k in CASE_FIELDS if before(k)} for before in (lambda k: k < "evidence_ids", lambda k: k > "evidence_ids")]
        head, tail = (_JSON.encode(part) for part in rest)
        self.tail = f"],{tail[1:]}".encode()
        self.blocks = [ids[i : i + _BLOCK] for i in range(0, len(ids), _BLOCK)]
        self.texts = [[_JSON.encode(i).encode() for i in b] for b in self.blocks]
        self.joined: list = [None] * len(self.blocks)  # a block's text, if it is known
        self.states = [hashlib.sha256(f'{head[:-1]},"evidence_ids":['.encode())]  # before the first blocks, as far as they are known

    def add(self, new: str) -> None:
        if not self.blocks:
            self.blocks, self.texts, self.joined = [[]], [[]], [None]
        n = max(0, bisect.bisect_right(self.blocks, new, key=lambda b: b[0] if b else "") - 1)
        block, text = self.blocks[n], self.texts[n]
        at = bisect.bisect_left(block, new)
        if block[at : at + 1] == [new]:
            return
        block.insert(at, new)
        text.insert(at, _JSON.encode(new).encode())
        self.joined[n] = None
        if len(block) == 2 * _BLOCK:
            self.blocks[n : n + 1], self.texts[n : n + 1] = [block[:_BLOCK], block[_BLOCK:]], [text[:_BLOCK], text[_BLOCK:]]
            self.joined.insert(n, None)
        del self.states[n + 1 :]

    def digest(self) -> str:
        for n in range(len(self.states) - 1, len(self.texts)):
            state = self.states[n].copy()
            if self.joined[n] is None:
                self.joined[n] = b",".join(self.texts[n])
            if n:
                state.update(b",")
            state.update(self.joined[n])
            self.states.append(state)
        state = self.states[-1].copy()
        state.update(self.tail)
        return state.hexdigest()

    def ids(self) -> list[str]:
        return [i for b in self.blocks for i in b]


def apply_pins(case: dict | None, pins: dict[str, tuple], commands: list[tuple]) -> list[tuple]:
    """Folds commands (case_id, seq, edge_id, is_pinned, tag, expected_hash) of one case in order; changes case and pins.

    case: its CASE_FIELDS (created_at as text, ids sorted) and snapshot_hash. A stale
    expected hash is SNAPSHOT_CONFLICT, an edge of another case INVALID_EDGE, an unchanged
    state NOOP; an effective command adds an action, and if it pins the observed edge, to
    the case's evidence and makes a new snapshot. Without an expected hash a command is
    meant for the snapshot that it meets.
    """
    out = []
    edges = frozenset(case["trace_edge_ids"]) if case else frozenset()
    snapshot = Snapshot(case) if case else None
    seen_of, action_of = ids_of(case["case_id"]) if case else (None, None)
    for case_id, seq, edge, pinned, tag, expected in commands:
        before = case["snapshot_hash"] if case else None
        row = (case_id, seq, edge, pinned, tag)
        had = pins.get(edge)
        if case is None:
            out.append((*row, "CASE_NOT_FOUND", None, None, None, None))
        elif expected is not None and expected != before:
            out.append((*row, "SNAPSHOT_CONFLICT", before, before, None, None))
        elif edge not in edges:
            out.append((*row, "INVALID_EDGE", before, before, None, None))
        elif (had is None and not pinned) or (had is not None and had[:2] == (pinned, tag)):
            out.append((*row, "NOOP", before, before, had[2] if had else None, None))
        else:
            seen, action = had[2] if had else seen_of(edge), action_of(seq)
            for new in {action, seen} if pinned else {action}:
                snapshot.add(new)
            case["snapshot_hash"] = snapshot.digest()
            pins[edge] = (pinned, tag, seen)
            out.append((*row, "APPLIED", before, case["snapshot_hash"], seen, action))
    if snapshot:
        case["evidence_ids"] = snapshot.ids()
    return out


def pin_cases(cases: DataFrame) -> DataFrame:
    """CASE_FIELDS and snapshot_hash of cases (case_id, seed_entity, created_at, trace_edge_ids, evidence_ids), as pin_log() takes them."""
    ids = {c: F.array_sort(F.array_distinct(c)) for c in ("trace_edge_ids", "evidence_ids")}
    c = cases.withColumns({**ids, "created_at": utc_seconds(F.col("created_at"))}).select(*CASE_FIELDS)
    return c.withColumn("snapshot_hash", integrity_hash(c, list(CASE_FIELDS)))


def commands_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("seq", kind="stable")
    columns: Sequence = [pdf[c].tolist() for c in ("case_id", "seq", "edge_id", "is_pinned", "tag", "expected_hash")]
    return [tuple(None if x is None or x != x else x for x in row) for row in zip(*columns, strict=True)]


def pin_log(commands: DataFrame, cases: DataFrame) -> DataFrame:
    """PIN_SCHEMA of every command: a fold over each case's own commands, which also bounds it.

    commands (case_id, seq, edge_id, is_pinned, tag, expected_hash); cases of pin_cases().
    """

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        case = None
        if len(right):
            case = {k: (sorted(v) if k.endswith("_ids") else v) for k, v in right.iloc[0].to_dict().items()}
        rows = apply_pins(case, {}, commands_of(left))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIN_SCHEMA.split(",")])

    c = commands.select("case_id", "seq", "edge_id", "is_pinned", "tag", "expected_hash")
    return c.groupBy("case_id").cogroup(cases.groupBy("case_id")).applyInPandas(fold, PIN_SCHEMA)


def digested(log: DataFrame) -> DataFrame:
    """case_id, seq, said: 128 bits for all that a pin log says of a command, which its ids and hashes take 300 bytes for."""
    said = F.to_json(F.struct("edge_id", "is_pinned", "tag", "status", "previous_hash", "snapshot_hash", "evidence_id", "action_id"), {"ignoreNullFields": "false"})
    return log.select("case_id", "seq", F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("said"))


def pin_parity(commands: DataFrame, cases: DataFrame, got: DataFrame) -> DataFrame:
    """One row (commands, differing): how many commands a digested() log has otherwise than pin_log(), or not at all.

    Cases are compared first, by the number and a sum of their digests, which takes a row a
    case. Only in cases that differ are the commands compared one by one.
    """

    def totals(log: DataFrame) -> DataFrame:
        # Both logs come with the commands of a case together, so that a task sends few rows.
        return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("seq", "said").cast("decimal(20,0)")).alias("total"))

    both = totals(digested(pin_log(commands, cases))).unionByName(totals(got))
    same = (F.count(F.lit(1)) == 2) & (F.min("n") == F.max("n")) & (F.min("total") == F.max("total"))
    by_case = staged(both.groupBy("case_id").agg(F.max("n").alias("commands"), same.alias("same")), "pin-parity")
    agreed = by_case.where("same").select("commands", F.lit(0).cast("long").alias("differing"))
    other = by_case.where("not same").select(F.col("case_id").alias("_case"))
    if not other.isEmpty():
        within = lambda df: df.join(other, df["case_id"].eqNullSafe(other["_case"]), "left_semi")
        sides = [(digested(pin_log(within(commands), within(cases))), 1, 0), (within(got), 0, 1)]
        rows = [log.select("*", F.lit(b).alias("b"), F.lit(s).alias("s")) for log, b, s in sides]
        each = rows[0].unionByName(rows[1]).groupBy("case_id", "seq", "said").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
        each = each.groupBy("case_id", "seq").agg(F.greatest(F.sum("b"), F.sum("s")).alias("commands"), F.sum(F.least("b", "s")).alias("alike"))
        agreed = agreed.unionByName(each.select("commands", (F.col("commands") - F.col("alike")).alias("differing")))
    return agreed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("commands", "differing")])


def pin_evidence(log: DataFrame) -> DataFrame:
    """evidence_id, case_id, category, source_reference, polarity, generation_method_version, payload_summary.

    A row for the action of each effective command, and one for each edge that was pinned.
    """
    done = log.where("status = 'APPLIED'")
    summary = F.to_json(
        F.struct("edge_id", "is_pinned", F.col("previous_hash").alias("previous_snapshot_hash"), F.col("tag").alias("typology_tag")), {"ignoreNullFields": "false"}
    )
    edge = F.concat(F.lit("edge:"), "edge_id")
    row = lambda ident, category, method, text: F.struct(
        ident.alias("evidence_id"), F.lit(category).alias("category"), edge.alias("source_reference"), F.lit("UNKNOWN").alias("polarity"),
        F.lit(method).alias("generation_method_version"), text.alias("payload_summary"),
    )
    action = row(F.col("action_id"), "ANALYST", ACTION_METHOD, summary)
    seen = row(F.col("evidence_id"), "OBSERVED", OBSERVED_METHOD, F.to_json(F.struct("edge_id")))
    both = done.select("case_id", F.explode(F.when(F.col("is_pinned"), F.array(action, seen)).otherwise(F.array(action))).alias("x"))
    return both.select("case_id", "x.*").distinct()
