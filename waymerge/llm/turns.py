"""Conversation structure repair: cheapest edits by dynamic programming over sorted streams of turns.

Rows go to tasks by conversation and are sorted by turn. A task reads them from the last to the first and carries four costs
across Arrow batches: the cheapest way to end well from each state (nothing yet; after system, user, assistant). Each row adds
one byte, the best edit for each state. At the conversation's first row these bytes, read from the front, give the edits, the
ASCII-least ones among the cheapest. Bytes and texts of one conversation wait in memory up to MEMORY and beyond that in
an unnamed file of the task, so memory does not grow with a conversation.

One conversation is one stream: its edits and the digest of its text depend on all of it in order, so a giant one takes its
task as long as reading it takes.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import slices

MEMORY = 8 << 20  # bytes of one conversation kept in memory, roughly
OUT = 4 << 20  # bytes of rows that leave in one batch, roughly
SPACE = " \t\n\x0b\x0c\r"
EDITS = "DIKR"  # in ASCII order
START, SYSTEM, USER, ASSISTANT = range(4)  # states, by the last role
ENDS = (START, ASSISTANT)  # roles are nothing, or system at most once, then user and assistant in turns
NEXT = (USER, USER, ASSISTANT, USER)  # the user or assistant turn that may follow each state
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})  # by initial s, u, a, other: state after
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
NAMES = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for a truncated turn that stays

    def __post_init__(self) -> None:
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert < 1:
            raise ValueError("costs must not be negative, and an insert must cost something")


class Steps:
    """One row's step of the recurrence, from the costs after it to those before it; equal steps are computed once."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.known = costs, {}
        best = [(0, None) if q in ENDS else (float("inf"), None) for q in range(4)]
        self.end = tuple(cost for cost, _ in self.inserted(best))

    def inserted(self, best: list[tuple]) -> list[tuple]:
        for _ in range(3):  # no cheapest way inserts more than three turns in a row
            for q in range(4):
                cost = self.costs.insert + best[NEXT[q]][0]
                if cost < best[q][0] or cost == best[q][0] and best[q][1] is not None and best[q][1] > 1:
                    best[q] = (cost, 1)
        return best

    def __call__(self, kind: int, after: tuple) -> tuple[int, tuple, int]:
        """(an edit of two bits for each state, the costs before the row less their least, that least)."""
        found = self.known.get((kind, after))
        if found is None:
            initial, fault = divmod(kind, 4)
            stays = self.costs.truncated if fault == TRUNCATED else 0
            best = []
            for q in range(4):
                ways = [(self.costs.delete + after[q], 0)]
                if fault not in (BLANK, DUPLICATE):
                    if q in KEPT[initial]:
                        ways.append((stays + after[KEPT[initial][q]], 2))
                    ways.append((self.costs.rerole + stays + after[NEXT[q]], 3))
                best.append(min(ways))
            best = self.inserted(best)
            least = min(cost for cost, _ in best)
            edits = sum(edit << 2 * q for q, (_, edit) in enumerate(best))
            found = self.known[kind, after] = edits, tuple(cost - least for cost, _ in best), least
        return found


class Backlog:
    """Edit bytes, kinds, roles and texts of a conversation, added from the last row to the first and read the other way."""

    def __init__(self) -> None:
        self.edits, self.rows, self.bytes, self.file, self.parts = bytearray(), [], 0, None, []

    def add(self, edits: int, initial: int, role: str, text: str) -> None:
        self.edits.append(edits)
        self.rows.append((initial, role, text))
        self.bytes += len(role) + len(text) + 64
        if self.bytes > MEMORY:
            self.file = self.file or tempfile.TemporaryFile()
            part = marshal.dumps((bytes(self.edits), self.rows))
            self.parts.append((self.file.seek(0, 2), self.file.write(part)))
            self.edits, self.rows, self.bytes = bytearray(), [], 0

    def forward(self) -> Iterator[tuple]:
        for edits, row in zip(reversed(self.edits), reversed(self.rows)):
            yield edits, *row
        for at, length in reversed(self.parts):
            self.file.seek(at)
            edits, rows = marshal.loads(self.file.read(length))
            for e, row in zip(reversed(edits), reversed(rows)):
                yield e, *row
        if self.file:
            self.file.close()


def edited(backlog: Backlog) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) from the first row to the last; role and text are null where the row goes."""
    state = START

    def insert() -> tuple[str, str, str]:
        nonlocal state
        state = NEXT[state]
        return "I", NAMES[state], ""

    for edits, initial, role, text in backlog.forward():
        while (edit := edits >> 2 * state & 3) == 1:
            yield insert()
        if edit == 0:
            yield "D", None, None
        elif edit == 2:
            state = KEPT[initial][state]
            yield "K", role, text
        else:
            state = NEXT[state]
            yield "R", NAMES[state], text
    while state not in ENDS:
        yield insert()


class Conversation:
    """What is known of a conversation while its rows pass from the last to the first."""

    def __init__(self, conv_id, steps: Steps) -> None:
        self.conv_id, self.steps, self.after, self.cost, self.backlog = conv_id, steps, steps.end, 0, Backlog()
        self.faults, self.illegal, self.turns, self.first, self.last, self.following = [0] * 4, 0, 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, kind: int) -> None:
        initial, fault = divmod(kind, 4)
        edits, self.after, least = self.steps(kind, self.after)
        self.cost += least
        self.backlog.add(edits, initial, role, text)
        self.faults[fault] += 1
        if self.following is not None and (initial, self.following) not in LEGAL:
            self.illegal += 1
        self.following = initial
        if turn is not None and turn != self.first:
            self.turns += 1
            self.first = turn
            self.last = turn if self.last is None else self.last

    def gaps(self) -> int:
        return 0 if self.last is None else self.last - self.first + 1 - self.turns


def conversations(batches: Iterator[pa.RecordBatch], steps: Steps) -> Iterator[Conversation]:
    open_ = None
    for batch in slices(batches, "text"):
        for conv_id, turn, role, text, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind"))):
            if open_ is None or conv_id != open_.conv_id:
                if open_ is not None:
                    yield open_
                open_ = Conversation(conv_id, steps)
            open_.add(turn, role, text, kind)
    if open_ is not None:
        yield open_


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 64
        if size > OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def sorted_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and kind (initial and fault), by conversation in one task each, from the last turn to the first.

    One exchange: the window that finds repeated turns and the sort after it both keep the partitioning by conversation.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.repartition("conv_id").withColumn("seen", seen)
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    falling: list[Column] = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("seen").desc()]
    return rows.sortWithinPartitions(*falling).select("conv_id", "turn", "role", "text", (initial * 4 + fault).cast("int").alias("kind"))


def _streamed(turns: DataFrame, fields: str, result, costs: Costs) -> DataFrame:
    """One output row for each tuple that ``result`` gives of a conversation, after its conv_id."""
    rows = sorted_turns(turns)
    out = StructType([StructField("conv_id", turns.schema["conv_id"].dataType), *StructType.fromDDL(fields).fields])
    kinds = {StringType(): pa.string(), LongType(): pa.int64(), IntegerType(): pa.int32()}
    plain = [pa.field(f.name, kinds[f.dataType]) for f in out.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([pa.field("conv_id", first.schema.field("conv_id").type), *plain])

        def every():
            yield first
            yield from batches

        yield from in_batches(((c.conv_id, *row) for c in conversations(every(), Steps(costs)) for row in result(c)), schema)

    return rows.mapInArrow(run, out)


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K kept, R role changed, I inserted), role, text.

    Turns are taken by number, nulls first; those of one number by role, then text, so copies stand together. Each turn's first
    fault counts: blank (white space only), duplicate (role and text seen earlier in the conversation), truncated (the last
    character that is not white space is none of ``.!?``). Blank and duplicate turns go. The other edits are the cheapest after which role
    initials read s at most once, then u and a in turns, at least one such pair, or nothing; among equally cheap ones those whose initials
    (D, I, K, R) are ASCII-least. A role that is empty or starts with another letter cannot be kept. A null role or text counts
    as one space; null conv_ids are one conversation; other columns are not read. A conversation whose turns all go, and an empty table, give no rows.
    """
    def rows(c: Conversation) -> Iterator[tuple]:
        position = 0
        for edit, role, text in edited(c.backlog):
            if role is not None:
                yield position, edit, role, text
                position += 1

    return _streamed(turns, "position bigint, edit string, role string, text string", rows, costs)


def audit(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps``: turn numbers missing between the least and the greatest (null numbers do not count; only nulls: 0). ``illegal``: adjacent turns whose initials are not su,
    ua or au. ``audit``: the edits' initials in order, D for a turn that goes. ``repaired_sha256``: of the
    repaired turns as ``role:text``, joined by newlines. Rules and odd cases as in ``repair``; a conversation without rows is not in the result.
    """
    def row(c: Conversation) -> Iterator[tuple]:
        digest, letters, between = hashlib.sha256(), [], ""
        for edit, role, text in edited(c.backlog):
            letters.append(edit)
            if role is not None:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
        faults = c.faults
        yield c.gaps(), faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], c.illegal, c.cost + c.after[START], "".join(letters), digest.hexdigest()

    numbers = ", ".join(f"{x} bigint" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _streamed(turns, f"{numbers}, audit string, repaired_sha256 string", row, costs)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?``,
    3 repeats it, 4 makes it the user's. A null in any column is read as one space there (conv_id and turn themselves stay null)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), h.alias("h")).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def audit_damaged(turns: DataFrame) -> DataFrame:
    """``audit`` of the damaged rows for every conversation of ``turns``; one of which no row is left has zeros, an empty audit and the hash of an empty string."""
    found = audit(damage(turns)).withColumnRenamed("conv_id", "id")
    joined = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    empty = {c: 0 for c, kind in found.dtypes if kind == "bigint" and c != "id"}
    return joined.fillna({**empty, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
