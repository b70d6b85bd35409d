"""Conversation structure repair: the cheapest edits that make the roles a legal sequence.

Legal are the initials (s?(ua)+)?: perhaps a system turn, then pairs of user and
assistant. Rows are dealt out by conversation, sorted, and walked in slices by a
recursive query of DuckDB: each recursion advances one turn for all conversations
of the slice and keeps, for each state of the grammar, the least cost and the
audit (the edits' initials) that reaches it. Of two audits of equal cost the one
that is first in ASCII stays; neither can be the beginning of the other, since
both hold one letter a turn and insertions cost, so what follows cannot reverse it.

A conversation that goes on beyond a slice hands its states over to the next: cost,
audit and a running hash each, so that a conversation of any length is streamed
through its task (the hash of its whole text is one stream in any case) and only a
slice of it is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tune_arrow

#: Rows that are walked at once.
SLICE = 4096
#: What white space is here, for trimming.
SPACE = "\t\n\x0b\x0c\r "
#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
#: (state, insertions, state after them), insertions of user and assistant turns by turns.
INSERTIONS = [(0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)]
#: What comes next in each state, and the state after it.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Insertions that end a conversation in each state.
ENDING = {0: 0, 1: 2, 2: 1, 3: 0}
INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5

_EDITS = [(q, "K", role[0], r, 0) for q, (role, r) in NEXT.items()] + [(0, "K", "s", 1, 0)] + [(q, "R", None, r, REROLE) for q, (_, r) in NEXT.items()] + [(q, "D", None, q, DELETE) for q in NEXT]
#: (state, letters, initial that a kept row needs, state after, cost), with insertions before the row.
MOVES = [(q, "I" * n + kind, initial, after, INSERT * n + cost) for q, n, r in INSERTIONS for s, kind, initial, after, cost in _EDITS if s == r]

_WALK = """
    WITH RECURSIVE walk(c, k, q, cost, place, audit, origin) AS (
        SELECT c, 0::BIGINT, q, cost, place, '', q FROM start
        UNION ALL
        SELECT c, k, q, s.cost, s.place, s.audit, s.origin FROM (
            SELECT w.c, w.k + 1 AS k, m.after AS q,
                min({'cost': w.cost + m.cost + CASE WHEN r.truncated AND m.kind <> 'D' THEN $fine ELSE 0 END, 'place': w.place, 'audit': w.audit || m.letters, 'origin': w.origin}) AS s
            FROM walk w JOIN turns r ON r.c = w.c AND r.k = w.k JOIN moves m ON m.q = w.q
            WHERE (m.initial IS NULL OR m.initial = r.initial) AND (m.kind = 'D' OR NOT r.must_go)
            GROUP BY w.c, w.k, m.after))
    SELECT w.c, w.q, w.cost, w.audit, w.origin FROM walk w JOIN sizes n ON n.c = w.c AND n.k = w.k
"""


@dataclass
class Reached:
    """The best way into one state so far, and the hash of what it keeps."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    lines: int = 0

    def onward(self, state: int, letters: str, turns: list[tuple[str, str]]) -> Reached:
        """This way with more edits, which use up the turns (role, text) given."""
        out = Reached(self.cost, self.audit + letters, self.digest.copy(), self.lines)
        rows = iter(turns)
        for edit in letters:
            role, after = NEXT[state]
            text = ""
            if edit != "I":
                own, text = next(rows)
                if edit == "D":
                    continue
                if edit == "K":
                    role, after = own, 1 if own[:1] == "s" else after
            out.digest.update((b"\n" if out.lines else b"") + f"{role}:{text}".encode())
            out.lines += 1
            state = after
        return out


@dataclass
class Conversation:
    """What has been seen of one conversation."""

    conv_id: object
    states: dict[int, Reached] = field(default_factory=lambda: {0: Reached()})
    least: int | None = None
    most: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    last: str | None = None

    def count(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None:
            self.distinct += turn != self.most  # turns come in order
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]

    def result(self) -> tuple:
        ends = [(s.cost + INSERT * ENDING[q], s.audit + "I" * ENDING[q], q) for q, s in self.states.items()]
        cost, audit, q = min(ends)
        best = self.states[q].onward(q, "I" * ENDING[q], [])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, best.digest.hexdigest()


def _walked(con, turns: pa.Table, start: pa.Table, sizes: pa.Table) -> list[tuple]:  # noqa: ANN001
    moves = pa.table({k: [m[i] for m in MOVES] for i, k in enumerate(("q", "letters", "initial", "after", "cost"))})
    moves = moves.append_column("kind", pa.array([m[1][-1] for m in MOVES]))
    for name, t in (("turns", turns), ("start", start), ("sizes", sizes), ("moves", moves)):
        con.register(name, t)
    return con.execute(_WALK.replace("$fine", str(TRUNCATED))).fetchall()


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, gone, fault), sorted by conversation and turn: one row a conversation."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    open_: Conversation | None = None

    def made(done: list[Conversation]) -> pa.RecordBatch:
        rows = list(zip(*(c.result() for c in done), strict=True))
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    for whole in batches:
        kind = whole.schema.field(0).type
        for at in range(0, whole.num_rows, SLICE):
            rows = list(zip(*(c.to_pylist() for c in whole.slice(at, SLICE).columns), strict=True))
            here: list[tuple[Conversation, list]] = []
            before = open_
            for conv_id, turn, role, text, gone, fault in rows:
                if open_ is None or open_.conv_id != conv_id:
                    open_ = Conversation(conv_id)
                if not here or here[-1][0] is not open_:
                    here.append((open_, []))
                if not gone:
                    open_.count(turn, role, fault)
                    here[-1][1].append((role, text, fault))
            flat = [(c, k, *row) for c, (_, own) in enumerate(here) for k, row in enumerate(own)]
            turns = pa.table({"c": pa.array([r[0] for r in flat], pa.int64()), "k": pa.array([r[1] for r in flat], pa.int64()), "initial": pa.array([r[2][:1] for r in flat], pa.string()), "must_go": pa.array([r[4] in ("blank", "duplicate") for r in flat], pa.bool_()), "truncated": pa.array([r[4] == "truncated" for r in flat], pa.bool_())})
            first = [(c, q, s.cost, place) for c, (conv, _) in enumerate(here) for place, (q, s) in enumerate(sorted(conv.states.items(), key=lambda x: x[1].audit))]
            start = pa.table({k: pa.array([f[i] for f in first], pa.int64()) for i, k in enumerate(("c", "q", "cost", "place"))})
            sizes = pa.table({"c": pa.array(range(len(here)), pa.int64()), "k": pa.array([len(own) for _, own in here], pa.int64())})
            ways: dict[int, list[tuple]] = {}
            for c, *way in _walked(con, turns, start, sizes):
                ways.setdefault(c, []).append(way)
            for c, (conv, own) in enumerate(here):
                if c < len(here) - 1:  # it ends here: only the way that wins is written out
                    cost = lambda w: (w[1] + INSERT * ENDING[w[0]], conv.states[w[3]].audit + w[2] + "I" * ENDING[w[0]])  # noqa: B023, E731
                    ways[c] = [min(ways[c], key=cost)]
                said = [(role, text) for role, text, _ in own]
                states = {}
                for q, total, audit, origin in ways[c]:
                    states[q] = conv.states[origin].onward(origin, audit, said)
                    states[q].cost = total
                conv.states = states
            ended = [before] if before is not None and here[0][0] is not before else []
            if done := ended + [conv for conv, _ in here[:-1]]:
                yield made(done)
    if open_ is not None:
        yield made([open_])


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: the rows of a table of conversations with planted faults.

    Null roles and texts, and null ids in the hashed key, read as one space. A row that
    is dropped stays with gone = true, without role and text, so that its conversation
    is known. Faults by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text,
    2 removes its `.!?`, 3 repeats it, 4 makes it the user's."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    out = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
    k = F.col("_kind")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).when(k != 0, F.col("text"))
    out = out.select("conv_id", "turn", F.when(k == 4, "user").when(k != 0, F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("gone"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")


def first_fault(text: Column, repeated: Column) -> Column:
    """blank, duplicate, truncated or null."""
    end = F.rtrim(text, F.lit(SPACE))
    return F.when(end == "", "blank").when(repeated, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")


def repaired(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text, gone): its faults and its cheapest repair.

    Rows go by turn, nulls first, then by role and text, so the result does not hang on
    their order; repeated rows are duplicates. Null conv_ids are one conversation. Rows
    with gone = true only name their conversation; one without other rows has zeros, an
    empty audit and the hash of nothing. Roles and texts must not be null; a role whose
    initial is none of s, u, a can only be changed or deleted. Other columns are not
    read; an empty table gives no rows.

    One shuffle, by conversation; duplicates are found in it too (the rows of one role
    and text in a conversation are dealt with it). Sorts spill, and the walk streams."""
    tune_arrow(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    dealt = dealt.withColumn("again", again)  # of equal rows at one turn, the first is no duplicate
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text", "again")
    fault = F.when(~F.col("gone"), first_fault(F.col("text"), F.col("again")))
    return dealt.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault")).mapInArrow(walk, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
