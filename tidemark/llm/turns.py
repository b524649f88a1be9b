"""Operator 12: repair of the turn structure of conversations.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  Its rows are walked in
order through the four states of that grammar (nothing yet, after system, after user, after assistant);
each step keeps or reroles or deletes a row, after inserting up to two turns.  The walks of many
conversations go together: rows are dealt by a hash of the conversation, a task collects whole
conversations into batches, and in each batch one DuckDB recursion advances all of them by one turn and
keeps the least (cost, audit) of each state.

A conversation is cut into segments of bounded length.  A segment is walked from each state it may begin
in, so segments are independent, and a long conversation costs one combination of states a segment.  At
equal cost no audit can be the beginning of another (inserts would cost more), so the ASCII-least audit of
a prefix stays the least whatever follows, and segments may be joined from the left.

Walks see neither roles nor texts, only an initial and a fault; texts are read again when the audit is
applied, in order and one row at a time, so a conversation of any length needs no more memory than its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS_CHARS, Tables

#: Rows of a segment, and of a batch.
SEGMENT, BATCH = 256, 8192
RANK = {"s": 1, "u": 2, "a": 3}
#: Cost of a kept or reroled truncated row, of rerole, delete and insert.
OPEN_END, REROLE, DELETE, INSERT = 3, 3, 4, 3
#: Faults of a row as the walk sees them.
SOUND, MUST_GO, TRUNCATED = 0, 1, 2
ROLE = {2: "user", 3: "assistant"}


def following(state: int) -> int:
    """The state after an inserted or reroled turn: a user's turn, or the assistant's after it."""
    return 3 if state == 2 else 2


def moves() -> list[tuple[int, str, str, int, int, str]]:
    """(state, edit, initial that it needs, next state, cost, letters) of one row with the inserts before it."""
    found = []
    for state in range(4):
        at = state
        for inserts in range(3):
            found.append((state, "D", "", at, inserts * INSERT + DELETE, "I" * inserts + "D"))
            found.append((state, "R", "", following(at), inserts * INSERT + REROLE, "I" * inserts + "R"))
            for initial, to in RANK.items():
                if to == following(at) or (initial == "s" and at == 0):
                    found.append((state, "K", initial, to, inserts * INSERT, "I" * inserts + "K"))
            at = following(at)
    return found


#: Inserts that end a conversation in each state.
ENDING = {0: "", 1: "II", 2: "I", 3: ""}

WALK = f"""WITH RECURSIVE walk AS (
  SELECT seg, 0 AS pos, s AS start, s AS state, 0 AS cost, '' AS audit FROM starts
  UNION ALL
  SELECT seg, pos, start, state, best.c, best.a FROM (
    SELECT w.seg, w.pos + 1 AS pos, w.start, m.t AS state,
      min(struct_pack(c := w.cost + m.cost + CASE WHEN t.fault = {TRUNCATED} AND m.edit <> 'D' THEN {OPEN_END} ELSE 0 END, a := w.audit || m.letters)) AS best
    FROM walk w JOIN turns t ON t.seg = w.seg AND t.pos = w.pos JOIN moves m ON m.s = w.state
    WHERE (m.needs = '' OR m.needs = t.initial) AND (t.fault <> {MUST_GO} OR m.edit = 'D') GROUP BY w.seg, w.pos, w.start, m.t))
SELECT seg, start, state, cost, audit FROM walk JOIN lengths USING (seg) WHERE pos = n"""


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): every row with its damage and how often it now stands there (0: dropped).

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 sets its role to user.  Nulls count as one space, in the roles and texts too.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")), F.lit(20))
    slim = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind"))
    new = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return slim.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), new.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def collapsed(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one row with ``n`` summed, plus ``print`` (MD5 of the text); dropped rows keep only their conversation."""
    gone = F.col("n") == 0
    bare = rows.select("conv_id", *(F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")), F.col("n").cast("long").alias("n"))
    return bare.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("print", F.md5(F.col("text").cast("binary")))


def judged(rows: DataFrame) -> DataFrame:
    """``collapsed`` rows without text: conv_id, turn, role, print, n, initial, ``fault`` of the first copy; further copies are duplicates.

    The first fault of a row counts: blank (no character but white space), duplicate (role and text seen
    earlier), truncated (the last such character is none of ``.!?``).
    """
    key = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("print")).cast("binary"))
    spread = F.concat(F.lit("-"), F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).cast("binary")))  # of dropped rows; they meet nothing
    bare = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    slim = rows.select("conv_id", "turn", "role", "print", "n", F.when(F.col("n") > 0, key).otherwise(spread).alias("seen"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    first = slim.where("n > 0").groupBy("seen").agg(F.min(F.struct("turn")).alias("first"))  # a null turn is the first
    later = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("blank"), F.lit("blank")).when(later, F.lit("duplicate")).when(F.col("truncated"), F.lit("truncated"))
    return slim.join(first, "seen", "left").select("conv_id", "turn", "role", "print", "n", "initial", fault.alias("fault"))


def _in_order(rows: DataFrame, *lead: str) -> DataFrame:
    """Whole conversations in one partition, rows in order: turn (nulls first), then role and the MD5 of the text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *lead, F.col("turn").asc_nulls_first(), "role", "print")


class _Walker:
    """DuckDB in a task: the least (cost, audit) from state to state over segments of (initial, fault) rows."""

    def __init__(self) -> None:
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.con.execute("CREATE TABLE moves (s INT, edit VARCHAR, needs VARCHAR, t INT, cost INT, letters VARCHAR)")
        self.con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())

    def walk(self, segments: list[tuple[bool, list[tuple[str, int]]]]) -> list[dict[tuple[int, int], tuple[int, str]]]:
        flat = [(k, p, initial, fault) for k, (_, rows) in enumerate(segments) for p, (initial, fault) in enumerate(rows)]
        columns = list(zip(*flat, strict=True))
        self.con.register("turns", pa.table({"seg": pa.array(columns[0], pa.int32()), "pos": pa.array(columns[1], pa.int32()), "initial": pa.array(columns[2], pa.string()), "fault": pa.array(columns[3], pa.int8())}))
        self.con.register("lengths", pa.table({"seg": pa.array(range(len(segments)), pa.int32()), "n": pa.array([len(rows) for _, rows in segments], pa.int32())}))
        begin = [(k, s) for k, (first, _) in enumerate(segments) for s in ((0,) if first else range(4))]
        self.con.register("starts", pa.table({"seg": pa.array([b[0] for b in begin], pa.int32()), "s": pa.array([b[1] for b in begin], pa.int32())}))
        found: list[dict] = [{} for _ in segments]
        for seg, start, state, cost, audit in self.con.execute(WALK).fetchall():
            found[seg][start, state] = cost, audit
        return found


class _Conversation:
    """Counts and open walks of one conversation, as its rows come in."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.counts = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last = None
        self.turns = 0
        self.best: dict[int, tuple[int, str]] = {0: (0, "")}

    def see(self, turn, initial: str, fault: str | None) -> tuple[str, int]:
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        return (initial if initial in RANK else "-", MUST_GO if fault in ("blank", "duplicate") else TRUNCATED if fault else SOUND)

    def join(self, segment: dict[tuple[int, int], tuple[int, str]]) -> None:
        new: dict[int, tuple[int, str]] = {}
        for (start, state), (cost, audit) in segment.items():
            if start in self.best:
                had = self.best[start]
                now = had[0] + cost, had[1] + audit
                if state not in new or now < new[state]:
                    new[state] = now
        self.best = new

    def row(self) -> tuple:
        cost, audit = min((c + INSERT * len(ENDING[s]), a + ENDING[s]) for s, (c, a) in self.best.items())
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), cost, audit)


AUDITED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walker = _Walker()
    open_: _Conversation | None = None
    segments: list[tuple[bool, list]] = []
    owners: list[_Conversation] = []
    done: list[_Conversation] = []
    schema, size = None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal segments, owners, done, size
        if segments:
            for owner, found in zip(owners, walker.walk(segments), strict=True):
                owner.join(found)
        if done:
            columns = list(zip(*(c.row() for c in done), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        segments, owners, done, size = [], [], [], 0

    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
        for conv_id, turn, n, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_ is None or conv_id != open_.conv_id:
                if open_ is not None:
                    done.append(open_)
                if size >= BATCH:
                    yield from flush()
                open_, length, first = _Conversation(conv_id), SEGMENT, True
            for copy in range(n):
                if length == SEGMENT:
                    if size >= BATCH:
                        yield from flush()
                    segments.append((first, []))
                    owners.append(open_)
                    length, first = 0, False
                segments[-1][1].append(open_.see(turn, initial, fault if not copy else "blank" if fault == "blank" else "duplicate"))
                length, size = length + 1, size + 1
    if open_ is not None:
        done.append(open_)
        yield from flush()


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``judged`` rows."""
    ordered = _in_order(rows).select("conv_id", "turn", "n", "initial", "fault")
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(AUDITED)])
    return ordered.mapInArrow(_audits, schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from rows in order, each conversation's audit first."""
    schema, conv, letters, at, body, state, place = None, None, "", 0, 0, 0, 0
    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", batch.schema.field(1).type)])
        out: list[tuple] = []

        def write(edit: str, role: str, text: str, turn) -> None:
            nonlocal place
            out.append((conv, place, edit, role, text, turn))  # noqa: B023
            place += 1

        for conv_id, turn, role, text, n, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                conv, letters, at, body, state, place = conv_id, audit, 0, len(audit.rstrip("I")), 0, 0
            for _ in range(n):
                while letters[at] == "I":
                    state, at = following(state), at + 1
                    write("I", ROLE[state], "", None)
                if letters[at] == "K":
                    state = RANK[role[0]]
                    write("K", role, text, turn)
                elif letters[at] == "R":
                    state = following(state)
                    write("R", ROLE[state], text, turn)
                at += 1
            while body <= at < len(letters):  # inserts after the last row
                state, at = following(state), at + 1
                write("I", ROLE[state], "", None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text, turn): the turns after repair, in order within a partition; inserted ones have no turn."""
    head = audited.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit("").alias("print"), "audit", F.lit(0).alias("lead"))
    body = rows.where("n > 0").select("conv_id", "turn", "role", "text", "n", "print", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("lead"))
    ordered = _in_order(body.unionByName(head), "lead").select("conv_id", "turn", "role", "text", "n", "audit")
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string("place long, edit string, role string, text string"), rows.schema["turn"]])
    return ordered.mapInArrow(_apply, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha, begun, schema = None, None, False, None
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field(0).type), ("repaired_sha256", pa.string())])
        out = []
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv_id == conv:
                sha.update(b"\n")
            else:
                if begun:
                    out.append((conv, sha.hexdigest()))
                conv, sha, begun = conv_id, hashlib.sha256(), True
            sha.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], type=schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` turns: SHA-256 of their ``role:text`` lines; takes them in the order they have there."""
    return turns.select("conv_id", "role", "text").mapInArrow(_digest, T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of conversations that have been damaged by ``damaged``.

    Every conversation id has a row of audits, also one without rows after damage (zeros, an empty audit).
    A null id is a conversation of its own.  Rows go by turn, nulls first, then by role and the MD5 of the
    text; equal rows of a turn are duplicates of the first.  Null roles and texts are one space, and so
    illegal and blank.  Edits: K keeps a row (its role's initial must fit), R makes it the turn that fits,
    D deletes it, I inserts an empty turn before it.  Empty tables give no rows; other columns are not read.
    The rows of one conversation pass through one task in order, as its digest needs, one batch at a time.
    """
    tables = Tables(conversations.sparkSession)
    rows = tables.write("rows", collapsed(damaged(conversations, conv_id, turn, role, text)))
    audited = tables.write("audits", audits(judged(rows)))
    return audited, repaired(rows, audited)
