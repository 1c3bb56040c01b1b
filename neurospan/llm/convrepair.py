"""Repair of conversations' structure at least cost.

The rows of a conversation, in order, are edited (kept, given another role, deleted, or preceded by an
inserted empty turn) until their roles read (s?(ua)+)?. That is a shortest path in a lattice of (turn
index, grammar state), found by Dijkstra with the key (cost, audit): audit is the string of edits'
initials, so ties go to the least one in ASCII.

Conversations have no bound: all rows are sorted by ranges, and each task walks through its own in
order. A conversation that lies in one task and isn't long is searched at once, up to the first end
that the grammar accepts. Of others each stretch gives a table of the best way between any two states;
such tables are joined in pairs. Tables add costs and concatenate audits, which keeps the order of
ties: two ways of equal cost between the same states are never one the other's beginning, since
what the longer one had more would be insertions, which cost something.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, tune

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
STRETCH = 512  # turns that are searched together

# States: nothing yet, after system, after user, after assistant. The role that goes on from each, and where to.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {"u": "user", "a": "assistant"}
ACCEPTED = (START, ASSISTANT)

Way = tuple[int, str]  # cost, audit
Table = dict[tuple[int, int], Way]

_SPACE = r"[\x20\x09-\x0D]"
_LEGAL = frozenset(("su", "ua", "au"))
FAULTS = ("blank", "duplicate", "truncated")


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations damaged by a hash of their ids and turns: some rows go, lose their text or its ends, stand twice, or become the user's.

    Null roles and texts become one blank, as do null ids and turns in what is hashed.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def _edges(code: tuple[str, int] | None, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows passed, next state) of the edits in a state before a row; None: after the last."""
    want = _NEXT[q]
    yield INSERT, "I", 0, _AFTER[want]
    if code is None:
        return
    yield DELETE, "D", 1, q
    role, fault = code
    if fault in (0, 3):
        cost = TRUNCATED if fault else 0
        if role == want or (role == "s" and q == START):
            yield cost, "K", 1, _AFTER[role]
        if role != want:
            yield cost + REROLE, "R", 1, _AFTER[want]


def search(codes: list[tuple[str, int]], start: int, whole: bool) -> dict[int, Way]:
    """Best ways over rows (role initial, fault) from a state: to the first accepting end if whole, else to every state."""
    n, done, ends = len(codes), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            if whole and q in ACCEPTED:
                return {q: (cost, audit)}
            ends[q] = (cost, audit)
        for more, initial, step, then in _edges(codes[i] if i < n else None, q):
            if (i + step, then) not in done:
                heapq.heappush(heap, (cost + more, audit + initial, i + step, then))
    return ends


def table_of(codes: list[tuple[str, int]]) -> Table:
    return {(p, q): way for p in range(4) for q, way in search(codes, p, False).items()}


def joined(a: Table, b: Table) -> Table:
    out: Table = {}
    for (p, m), (c1, s1) in a.items():
        for (m2, q), (c2, s2) in b.items():
            if m == m2:
                way = (c1 + c2, s1 + s2)
                if (p, q) not in out or way < out[p, q]:
                    out[p, q] = way
    return out


class Tables:
    """Joins tables in order, those of like length first, so that a long conversation's audits aren't copied for each stretch."""

    def __init__(self):
        self.held: list[tuple[int, Table]] = []

    def add(self, t: Table) -> None:
        n = 1
        while self.held and self.held[-1][0] == n:
            t, n = joined(self.held.pop()[1], t), 2 * n
        self.held.append((n, t))

    def best(self) -> Way:
        """The whole conversation's way."""
        total = self.held[-1][1]
        for _, t in reversed(self.held[:-1]):
            total = joined(t, total)
        return min(total[START, q] for q in ACCEPTED if (START, q) in total)


_STRETCH = "conv_id long, part long, n long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, whole boolean, ways array<struct<p:int,q:int,cost:long,audit:string>>"
_WAYS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


class _Stretch:
    """Rows of a conversation that follow each other."""

    def __init__(self, conv):
        self.conv, self.codes, self.counts, self.illegal = conv, [], [0, 0, 0, 0], 0

    def add(self, role: str, fault: int) -> None:
        self.illegal += bool(self.codes) and self.codes[-1][0] + role not in _LEGAL
        self.codes.append((role, fault))
        self.counts[fault] += 1

    def row(self, part: int, whole: bool) -> tuple:
        ways = {(START, q): w for q, w in search(self.codes, START, True).items()} if whole else table_of(self.codes)
        held = [{"p": p, "q": q, "cost": c, "audit": s} for (p, q), (c, s) in ways.items()]
        return (self.conv, part, len(self.codes), self.codes[0][0], self.codes[-1][0], *self.counts[1:], self.illegal, whole, held)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, initial, fault, copies), sorted, to stretches; the first and last conversation of a task may go on elsewhere."""
    from pyspark import TaskContext

    base, part, out = TaskContext.get().partitionId() << 40, 0, []
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), *((c, pa.int64()) for c in (*FAULTS, "illegal")), ("whole", pa.bool_()), ("ways", _WAYS)])
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    held, cut = None, True  # cut: what is held may be only a part of its conversation
    for b in batches:
        for conv, role, fault, copies in zip(*(b.column(k).to_pylist() for k in range(4))):
            for k in range(copies):
                if held is None or held.conv != conv or len(held.codes) >= STRETCH:
                    if held is not None:
                        same = held.conv == conv
                        out.append(held.row(base + part, not (cut or same)))
                        part, cut = part + 1, same
                    held = _Stretch(conv)
                held.add(role, fault if not k or fault == 1 else 2)
                if len(out) >= 256:
                    yield batch()
                    out.clear()
    if held is not None:
        out.append(held.row(base + part, False))
    if out:
        yield batch()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of conversations, sorted by part, to one row a conversation."""
    names = ["conv_id", "n", *FAULTS, "illegal", "cost", "audit"]
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in names])
    conv, counts, last, tables, way = None, None, "", None, None

    def row() -> pa.RecordBatch:
        cost, audit = way or tables.best()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, *counts, cost, audit), schema)], schema=schema)

    for b in batches:
        for s in b.to_pylist():
            if counts is None or s["conv_id"] != conv:
                if counts is not None:
                    yield row()
                conv, counts, last, tables, way = s["conv_id"], [0] * 5, None, Tables(), None
            if last is not None:
                counts[4] += last + s["first_role"] not in _LEGAL
            counts = [a + s[c] for a, c in zip(counts, ("n", *FAULTS, "illegal"))]
            last = s["last_role"]
            if s["whole"]:
                way = (s["ways"][0]["cost"], s["ways"][0]["audit"])
            else:
                tables.add({(w["p"], w["q"]): (w["cost"], w["audit"]) for w in s["ways"]})
    if counts is not None:
        yield row()


ORDER = ["conv_id", "turn", "role", "text"]  # nulls first, strings by their bytes


def classes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): distinct rows with their number and their first one's fault.

    fault is 1 for a blank text, 2 for a role and text that an earlier turn has, 3 for an end without [.!?],
    else 0. Further copies follow their first one, so they repeat it.
    """
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    distinct = rows.groupBy(*ORDER).agg(F.count("*").alias("copies")).withColumn("same", same)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = distinct.groupBy("conv_id", "same").agg(F.min(when).alias("least"))
    at = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = distinct.alias("a").join(first.hint("merge").alias("b"), at("conv_id") & (F.col("a.same") == F.col("b.same")))
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", 1).when(when > F.col("least"), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return met.select("a.conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def plans(found: DataFrame) -> DataFrame:
    """(conv_id, n, blank, duplicate, truncated, illegal, cost, audit) of every conversation of classes()."""
    tune(found.sparkSession)
    slim = found.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    dealt = slim.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions(*ORDER)
    stretches = dealt.select("conv_id", "initial", "fault", "copies").mapInArrow(_stretches, _STRETCH)
    return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_folded, "conv_id long, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text, edit) of repaired turns, from rows (conv_id, audit, role, text, copies), each conversation's audit first; None for a conversation's start."""
    audit, at, q, conv = "", 0, START, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            at += 1
            want = _NEXT[q]
            q = _AFTER[want]
            yield conv, _NAMES[want], "", "I"

    begun = False
    for b in bounded(batches, 3):
        for c, plan, role, text, copies in zip(*(b.column(k).to_pylist() for k in range(5))):
            if plan is not None:
                if begun:
                    yield from inserted()
                audit, at, q, conv, begun = plan, 0, START, c, True
                yield conv, None, None, None
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                want = role[:1] if edit == "K" else _NEXT[q]
                q = _AFTER[want]
                yield conv, role if edit == "K" else _NAMES[want], text, edit
    if begun:
        yield from inserted()


BYTES = 1 << 22  # of texts in a batch that is written


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out, size, place = [], 0, 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    for conv, role, text, edit in _steps(batches):
        if role is None:
            place = 0
            continue
        out.append((conv, place, role, text, edit))
        place, size = place + 1, size + len(text) + 50
        if size > BYTES:
            yield make()
            out, size = [], 0
    if out:
        yield make()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, found, held, first = [], [], None, True
    make = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
    for conv, role, text, _ in _steps(batches):
        if role is None:
            if held is not None:
                found.append(held.hexdigest())
            if len(found) >= 512:
                yield make()
                ids, found = [], []
            held, first = hashlib.sha256(), True
            ids.append(conv)
            continue
        held.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    if held is not None:
        found.append(held.hexdigest())
    if ids:
        yield make()


def apply_plans(found: DataFrame, planned: DataFrame, digest: bool = False) -> DataFrame:
    """(conv_id, place, role, text, edit) of repaired turns; with digest (conv_id, repaired_sha256) of role:text, joined by line feeds.

    A conversation's turns pass one task in order, but none is held beyond its own row.
    """
    none = F.lit(None).cast("string")
    rows = found.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", none.alias("audit"))
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), F.lit(1).cast("long").alias("copies"), "audit")
    dealt = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    slim = dealt.select("conv_id", "audit", "role", "text", "copies")
    return slim.mapInArrow(_digests, "conv_id long, repaired_sha256 string") if digest else slim.mapInArrow(_repaired, "conv_id long, place long, role string, text string, edit string")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns lacking between a conversation's least and greatest; 0 where all are null."""
    turns = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("_n"))
    lacking = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(lacking, F.lit(0)).alias("gaps"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, plans) of rows (conv_id, turn, role, text), both written; apply_plans() makes the turns of them.

    Rows are taken by turn (nulls first), then role and text; a null role or text counts as one blank. A null
    conv_id is a conversation too. Repeated rows are duplicates. Roles count by their first character; one of
    other roles, or without any, has to be given another or deleted. Conversations without rows don't appear.
    Other columns are left out. An empty table gives empty results.
    """
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    own = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), blank("role"), blank("text"))
    found = materialize(classes(own))
    return found, materialize(plans(found))
