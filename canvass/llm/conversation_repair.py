"""Repair of conversation structure by a Viterbi search whose paths leave as soon as they coalesce.

A conversation is right if its role initials spell ``(s?(ua)+)?``: nothing, or
an optional system turn and whole pairs of user and assistant. Four states
tell how far such a spelling has come. Every row is kept, given another role
or deleted, and empty turns may be inserted; the search holds the cheapest path
into each state. The paths form a tree of back pointers that counts the
references to every node. A path without references is freed, and once the root
has a single reference left, all survivors share the edits below it: these
edits are final, are given out and forgotten.

Among equally cheap paths the least sequence of edit initials wins. Two tied
paths are compared on all that is not final yet, row by row back to their
common ancestor. Inserts stand before the row that follows them, so that paths
over the same rows never begin one another, and the lesser one stays the lesser
whatever comes. A state that can follow no course which another state does not
follow more cheaply is given up, by the bounds of ``SLACK``.

Rows arrive sorted, one conversation after the other, and no conversation is
gathered: a task holds the open end of one path tree, and a run of rows that
must go counts as one number. The open end is a few rows long unless ties last;
where they last to the end (say, all rows of one role and each cut off), its
rows are held to the end, and ``longest_open`` reports their number.

Rows with any null, empty or very long cell take part: a null conversation is
one conversation, null turns come first, and null role and text count as one
space. Rows of the same turn are ordered by role and text. Repeated rows are
duplicates. A table without rows has no conversations. Columns beyond the four
named ones pass unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a row of some initial is kept.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a user or assistant turn, whichever may follow.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: SLACK[x][y]: from y on, edits cost at most so much more than from x on. From an assistant turn, whatever follows a
#: system turn may follow too, and a start needs at most one system turn deleted; an open pair takes one insert.
SLACK = {
    START: {SYSTEM: 4, USER: 5, ASSISTANT: 3},
    SYSTEM: {START: 0, USER: 2, ASSISTANT: 0},
    USER: {START: 2, SYSTEM: 2, ASSISTANT: 2},
    ASSISTANT: {START: 0, SYSTEM: 4, USER: 2},
}
#: What ends a conversation in each state.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
PAIRS = {"su", "ua", "au"}

Line = tuple[str, str, str]


class _Node:
    """Edits on the way to one row: a run of forced deletions, inserts, and what becomes of the row."""

    __slots__ = ("parent", "run", "letters", "lines", "kids", "held")

    def __init__(self, parent: _Node | None, run: int, letters: str, lines: list[Line]):
        self.parent, self.run, self.letters, self.lines = parent, run, letters, lines
        self.kids: set[_Node] = set()
        self.held = False
        if parent is not None:
            parent.kids.add(self)


class PathTree:
    """The cheapest path into each state; ``final`` gathers the edits that all of them share."""

    def __init__(self):
        self.root = _Node(None, 0, "", [])
        self.root.held = True
        self.ends: dict[int, tuple[int, _Node]] = {START: (0, self.root)}
        self.run = 0  # forced deletions since the last choice
        self.open = self.longest_open = 0

    def forced(self) -> None:
        """A row that has to go, on every path."""
        self.run += 1

    def row(self, role: str, text: str, cut_off: bool) -> Iterator[tuple[str, list[Line]]]:
        """A row with a choice; yields what has become final."""
        best: dict[int, tuple[int, _Node, str, list[int], str]] = {}
        for state, (cost, node) in self.ends.items():
            options = [(DELETE, "D", [], state)]
            inserts, at = [], state
            for _ in range(3):
                paid = INSERT * len(inserts) + CUT_OFF * cut_off
                letters = "I" * len(inserts)
                if (to := KEPT.get((at, role[:1]))) is not None:
                    options.append((paid, letters + "K", [*inserts, None], to))
                options.append((paid + REROLE, letters + "R", [*inserts, NEXT[at]], NEXT[at]))
                at = NEXT[at]
                inserts.append(at)
            for price, letters, roles, to in options:
                if to not in best or self._before(cost + price, node, letters, *best[to][:3]):
                    best[to] = cost + price, node, letters, roles
        low = {s: x[0] for s, x in best.items()}
        best = {s: x for s, x in best.items() if not any(low[y] + more < x[0] for y, more in SLACK[s].items() if y in low)}
        before = [node for _, node in self.ends.values()]
        ends = {}
        for state, (cost, node, letters, roles) in best.items():
            lines = [("I", NAMES[r], "") for r in roles[:-1]]
            if roles:
                lines.append((letters[-1], role if roles[-1] is None else NAMES[roles[-1]], text))
            child = _Node(node, self.run, letters, lines)
            child.held = True
            ends[state] = cost, child
        self.ends, self.run = ends, 0
        self.open += 1
        for node in before:
            node.held = False
            self._free(node)
        yield from self._final()
        self.longest_open = max(self.longest_open, self.open)

    def _before(self, cost: int, node: _Node, letters: str, cost2: int, node2: _Node, letters2: str) -> bool:
        if cost != cost2:
            return cost < cost2
        if node is node2:
            return letters < letters2
        # the rows are the same, so the difference nearest to the root decides; forced runs are common to both
        less = letters < letters2
        while node is not node2:
            if node.letters != node2.letters:
                less = node.letters < node2.letters
            node, node2 = node.parent, node2.parent
        return less

    def _free(self, node: _Node) -> None:
        while not node.held and not node.kids and node.parent is not None:
            node.parent.kids.discard(node)
            node = node.parent

    def _final(self) -> Iterator[tuple[str, list[Line]]]:
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids.pop()
            self.root.parent = None
            self.open -= 1
            yield "D" * self.root.run + self.root.letters, self.root.lines
            self.root.lines = []

    def close(self) -> tuple[int, Iterator[tuple[str, list[Line]]]]:
        """Cost of the whole conversation, and the edits that were still open."""
        found = []
        for state, (cost, node) in self.ends.items():
            path = []
            while node is not self.root:
                path.append(node)
                node = node.parent
            path.reverse()
            rest = [NEXT[state], ASSISTANT][: CLOSING[state]]
            letters = "".join("D" * x.run + x.letters for x in path) + "D" * self.run + "I" * len(rest)
            found.append((cost + INSERT * len(rest), letters, [line for x in path for line in x.lines] + [("I", NAMES[r], "") for r in rest]))
        cost, letters, lines = min(found)
        return cost, iter([(letters, lines)])


def damage_of(conv: str, turn: str) -> Column:
    """What happens to a row: 0 drops it, 1 empties it, 2 removes its final marks, 3 repeats it, 4 makes it the user's."""
    spelt = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    return F.crc32(F.concat_ws(":", *spelt)) % 20


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped) after the damage; a dropped row leaves its conversation's name only."""
    k = damage_of(conv, turn)
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text, role))
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(k == 0, None).when(k == 4, F.lit("user")).otherwise(by).alias("role"),
        F.when(k == 0, None).when(k == 1, F.lit("")).when(k == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        (k == 0).alias("dropped"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns for rows to be repaired as they are."""
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text, role))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), by.alias("role"), said.alias("text"), F.lit(False).alias("dropped"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with their faults, conversations together and in order within each task.

    One shuffle by conversation serves the search for earlier equal rows, whose
    windows are finer, and the final order.
    """
    first = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    return (
        rows.repartition("conv")
        .withColumn("again", F.row_number().over(first) > 1)
        .select(
            "conv", "turn", "role", "text",
            F.when(F.col("dropped"), "gone").when(end == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
        )
        .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    )


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Conversations one after the other, each an iterator over its rows that has to be used up."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
    held = next(rows, None)

    def same(conv: object) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[0] == conv:
            yield held
            held = next(rows, None)

    while held is not None:
        conv = held[0]
        yield conv, same(conv)


class _Report:
    """Running figures of one conversation."""

    def __init__(self):
        self.tree = PathTree()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.last = None
        self.turns = self.illegal = self.cost = 0

    def edits(self, rows: Iterator[tuple]) -> Iterator[tuple[str, list[Line]]]:
        """All edits in order."""
        for _, turn, role, text, fault in rows:
            if fault == "gone":
                continue
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
            if self.last is not None:
                self.illegal += self.last + role[:1] not in PAIRS
            self.last = role[:1]
            if fault:
                self.counts[fault] += 1
            if fault in ("blank", "duplicate"):
                self.tree.forced()
                self.cost += DELETE
            else:
                yield from self.tree.row(role, text, fault == "truncated")
        cost, rest = self.tree.close()
        self.cost += cost
        yield from rest

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv, place (from 0), edit (K, R or I), role and text, for rows of ``damaged`` or ``undamaged``."""
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T.StructType.fromDDL("place long, edit string, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, out = _typed(batches)
        names = ["conv", "place", "edit", "role", "text"]
        types = [out, pa.int64(), pa.string(), pa.string(), pa.string()]
        lines, size = [], 0
        for conv, turns in _conversations(batches):
            place = 0
            for _, found in _Report().edits(turns):
                for edit, role, text in found:
                    lines.append((conv, place, edit, role, text))
                    place += 1
                    size += 50 + len(text)
                if size > 4_000_000:
                    yield _batch(lines, names, types)
                    lines, size = [], 0
        if lines:
            yield _batch(lines, names, types)

    return _in_order(rows).mapInArrow(run, schema)


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], pa.DataType]:
    first = next(batches, None)
    if first is None:
        return iter(()), pa.null()
    return (b for part in ([first], batches) for b in part), first.schema.field(0).type


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, longest_open long"


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the hash of the repaired turns."""
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T.StructType.fromDDL(FIGURES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, out = _typed(batches)
        types = [out, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()]
        done, size = [], 0
        for conv, turns in _conversations(batches):
            figures, sha, audit, any_line = _Report(), hashlib.sha256(), [], False
            for letters, lines in figures.edits(turns):
                audit.append(letters)
                for _, role, text in lines:
                    sha.update(f"{'\n' if any_line else ''}{role}:{text}".encode())
                    any_line = True
            audit = "".join(audit)
            done.append((conv, figures.gaps(), *figures.counts.values(), figures.illegal, figures.cost, audit, sha.hexdigest(), figures.tree.longest_open))
            size += 200 + len(audit)
            if size > 4_000_000:
                yield _batch(done, schema.names, types)
                done, size = [], 0
        if done:
            yield _batch(done, schema.names, types)

    return _in_order(rows).mapInArrow(run, schema)


def conversation_repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage, faults, cheapest repair and its hash, for every conversation."""
    return report(damaged(rows, conv, turn, role, text)).withColumnRenamed("conv", conv)


ORACLE = r"""
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: ascii(x)) as codes
  from conversations
), hit as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_concat([cast(4294967295 as bigint)], codes), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 as k
  from keyed, crc
), damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(case when k = 3 then [1, 2] else [1] end) as copy from hit where k <> 0)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from damaged
), judged as (
  select *, left(role, 1) as r, lag(left(role, 1)) over (partition by conv_id order by i) as r0,
         case when body = '' then 'blank'
              when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
              when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed
), figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (r0 is not null and r0 || r not in ('su', 'ua', 'au')) as illegal,
         count(*) as n
  from judged group by conv_id
), walk as (
  select conv_id, cast(0 as bigint) as i, {'c': 0, 'a': '', 't': ''} as s0, cast(null as struct(c integer, a varchar, t varchar)) as s1,
         cast(null as struct(c integer, a varchar, t varchar)) as s2, cast(null as struct(c integer, a varchar, t varchar)) as s3
  from figures
  union all
  select conv_id, i,
         {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t},
         list_min(list_filter([{'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t},
                               {'c': case when stays and r = 's' then s0.c + cut end, 'a': s0.a || 'K', 't': s0.t || line}], lambda x: x.c is not null)),
         list_min(list_filter(list_concat([{'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t}],
                              list_transform([s0, s1, b3], lambda x: {'c': case when stays and r = 'u' then x.c + cut end, 'a': x.a || 'K', 't': x.t || line}),
                              list_transform([s0, s1, b3], lambda x: {'c': case when stays then x.c + cut + 2 end, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || text})), lambda x: x.c is not null)),
         list_min(list_filter([{'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t},
                               {'c': case when stays and r = 'a' then b2.c + cut end, 'a': b2.a || 'K', 't': b2.t || line},
                               {'c': case when stays then b2.c + cut + 2 end, 'a': b2.a || 'R', 't': b2.t || chr(10) || 'assistant:' || text}], lambda x: x.c is not null))
  from (
    select *, list_min(list_filter([s3, {'c': b2.c + 2, 'a': b2.a || 'I', 't': b2.t || chr(10) || 'assistant:'}], lambda x: x.c is not null)) as b3
    from (
      select w.*, j.* exclude (conv_id, i), j.i as i,
             j.fault not in ('blank', 'duplicate') as stays, cast(j.fault = 'truncated' as integer) as cut, chr(10) || j.role || ':' || j.text as line,
             list_min(list_filter(list_concat([s2], list_transform([s0, s1, s3], lambda x: {'c': x.c + 2, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'})), lambda x: x.c is not null)) as b2
      from (select conv_id, i as at, s0, s1, s2, s3 from walk) w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.at + 1
    )
  )
), ended as (
  select conv_id, list_min(list_filter([s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
           {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}], lambda x: x.c is not null)) as best
  from walk join figures using (conv_id) where i = n
)
select c.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate,
       coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost,
       coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join figures f on f.conv_id is not distinct from c.conv_id
left join ended e on e.conv_id is not distinct from c.conv_id
"""
