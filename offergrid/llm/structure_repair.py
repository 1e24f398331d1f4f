"""Repair of conversation structure: the cheapest edits that leave an optional system turn and then user-assistant pairs.

A Viterbi search runs over the rows of a conversation in order. Its survivors (the best edits that reach each state of
the turn grammar) share a tree of back pointers with reference counts; as soon as all survivors descend from one edit,
everything up to it is final and leaves memory. So a conversation of any length is streamed, and only the part that is
still undecided is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
UNDELETED_TRUNCATED = 5
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: The grammar ``(s?(ua)+)?`` of role initials: nothing yet, after s, after u, after a; the first and last may end.
START, LED, ASKED, ANSWERED = range(4)
MOVES = {(START, "s"): LED, (START, "u"): ASKED, (LED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
FINAL = (START, ANSWERED)
#: A state whose cost is beyond another's by more than this can be imitated by that one for less, however the rows go on:
#: (state, other): an Insert where the other lacks a turn, a Delete where it can't take the system row.
LEAD = {(START, ANSWERED): 2, (START, ASKED): 7, (LED, ANSWERED): 0, (LED, ASKED): 5, (ASKED, ANSWERED): 5, (ANSWERED, ASKED): 5}

ROW = "conv long, turn long, role string, text string, fault int"
OUT = "conv long, seq long, edit string, role string, text string, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class Node:
    """An edit in the tree of back pointers: ``refs`` counts its children and the survivors that end in it."""

    __slots__ = ("edit", "kids", "parent", "refs", "role", "text")

    def __init__(self, parent: Node | None, edit: str, role: str | None = None, text: str | None = None):
        self.parent, self.edit, self.role, self.text, self.refs, self.kids = parent, edit, role, text, 0, set()
        if parent is not None:
            parent.refs += 1
            parent.kids.add(self)


class Repairer:
    """One conversation: ``row`` takes its next row, ``end`` its end; both return the edits that have become final."""

    def __init__(self):
        self.root = Node(None, "")
        self.best = {START: (0, self.root)}
        self.root.refs = 1
        self._insert(self.best)
        self._hold(self.best, {})
        self.pending = 0

    @staticmethod
    def _less(a: Node, b: Node) -> bool:
        """Whether the edits that lead to ``a`` are less, as ASCII text, than those to ``b``: from where they part."""
        left, right, seen = [], [], {}
        node, i = a, 0
        while node is not None:
            seen[node] = i
            left.append(node.edit)
            node, i = node.parent, i + 1
        node = b
        while node not in seen:
            right.append(node.edit)
            node = node.parent
        return left[: seen[node]][::-1] < right[::-1]

    def _offer(self, into: dict, state: int, cost: int, parent: Node, edit: str, role=None, text=None) -> bool:
        """A way to a state: taken if it is cheaper than the one there, or as cheap and its edits are less."""
        old = into.get(state)
        if old is not None and old[0] < cost:
            return False
        node = Node(parent, edit, role, text)
        if old is not None and old[0] == cost and not self._less(node, old[1]):
            self._free(node)
            return False
        node.refs += 1
        into[state] = cost, node
        if old is not None:
            self._drop(old[1])
        return True

    def _insert(self, into: dict) -> None:
        """All ways on by inserted turns, until none is better."""
        todo = sorted(into, key=lambda s: into[s][0])
        while todo:
            state = todo.pop(0)
            cost, node = into[state]
            for initial in "ua":
                to = MOVES.get((state, initial))
                if to is not None and self._offer(into, to, cost + COSTS[INSERT], node, INSERT, ROLES[initial], ""):
                    todo.append(to)

    def _drop(self, node: Node) -> None:
        node.refs -= 1
        self._free(node)

    def _free(self, node: Node) -> None:
        while node.refs == 0 and node.parent is not None:
            parent, node.parent = node.parent, None
            parent.kids.discard(node)
            parent.refs -= 1
            node = parent

    def _hold(self, new: dict, old: dict) -> None:
        for cost, node in old.values():
            self._drop(node)
        for state, (cost, _) in list(new.items()):
            if any(other in new and cost > new[other][0] + lead for (s, other), lead in LEAD.items() if s == state):
                self._drop(new.pop(state)[1])
        self.best = new

    def _settled(self) -> Iterator[Node]:
        """Edits that all survivors share: from the root, as long as one child holds everything."""
        while self.root.refs == 1 and self.root.kids:
            (kid,) = self.root.kids
            kid.parent, self.root = None, kid
            yield kid

    def row(self, role: str, text: str, fault: int) -> list[Node]:
        new: dict = {}
        late = UNDELETED_TRUNCATED if fault == TRUNCATED else 0
        for state, (cost, node) in self.best.items():
            self._offer(new, state, cost + COSTS[DELETE], node, DELETE, role)
            if fault in (BLANK, DUPLICATE):
                continue
            for initial in "sua":
                to = MOVES.get((state, initial))
                if to is None:
                    continue
                if role[:1] == initial:
                    self._offer(new, to, cost + late + COSTS[KEEP], node, KEEP, role, text)
                elif initial != "s":
                    self._offer(new, to, cost + late + COSTS[REROLE], node, REROLE, ROLES[initial], text)
        self._insert(new)
        self._hold(new, self.best)
        return list(self._settled())

    def end(self) -> tuple[list[Node], int]:
        """The last edits and the cost of all."""
        ends = [self.best[s] for s in FINAL if s in self.best]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or c == cost and self._less(n, node):
                cost, node = c, n
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1], cost


class _Conversation:
    """The rows of one conversation as they come: counts, and final edits with their numbers."""

    def __init__(self, conv):
        self.conv, self.repair, self.seq, self.rows, self.faults = conv, Repairer(), 0, 0, [0] * 4
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.before: str | None = None

    def _edits(self, nodes: list[Node]) -> Iterator[tuple]:
        for n in nodes:
            yield (self.conv, self.seq, n.edit, n.role, n.text if n.edit != DELETE else None, *[None] * 7)
            self.seq += 1

    def row(self, turn, role: str, text: str, fault: int) -> Iterator[tuple]:
        self.rows += 1
        self.faults[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        return self._edits(self.repair.row(role, text, fault))

    def end(self) -> Iterator[tuple]:
        nodes, cost = self.repair.end()
        yield from self._edits(nodes)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        yield (self.conv, None, None, None, None, self.rows, gaps, *self.faults[1:], self.illegal, cost)


def with_faults(rows: DataFrame) -> DataFrame:
    """ROW columns, each conversation's rows together and in order, each with its first fault.

    blank: nothing but ASCII separators; duplicate: role and text stood earlier in the conversation; truncated: the last
    other character ends no sentence. Order: turn (nulls first), then role and text, so equal rows stand together. Rows
    marked ``gone`` stay as rows without a turn, role and text: they only name their conversation.

    One shuffle, by conversation; duplicates are found by sorting within it, not by a set of all texts so far. A window
    counts by the text's digest. A conversation's rows meet in one task, since its digest is of its whole text in order.
    """
    blank = ~F.col("text").rlike(r"[^ \t-\r]")
    whole = ~F.col("text").rlike(r"[.!?][ \t-\r]*\z")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = rows.select("conv", "turn", "role", "text", F.coalesce("gone", F.lit(False)).alias("gone")).repartition("conv")
    first = Window.partitionBy("conv", "gone", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy(*order)
    seen = dealt.withColumn("_n", F.row_number().over(first))
    fault = F.when(F.col("gone"), None).when(blank, BLANK).when(F.col("_n") > 1, DUPLICATE).when(whole, TRUNCATED).otherwise(NONE)
    return seen.sortWithinPartitions(F.asc_nulls_first("conv"), *order).select("conv", "turn", "role", "text", fault.cast("int").alias("fault"))


def repair(rows: DataFrame, most_rows: int = 4096, most_chars: int = 8_000_000) -> DataFrame:
    """Edits and a report of each conversation of ``rows`` (conv, turn, role, text; ``gone`` marks rows to leave out).

    Result: OUT columns, in runs of one conversation: its edits in order (seq, edit, the role and text that stay; an
    inserted turn has an empty text, a deleted row none), then a row without seq that holds its counts and cost. Role and
    text are not null; a role is known by its first character, an empty or other one can only change or go. A conversation
    without rows, or with rows ``gone`` alone, has a report of zeros; an empty table gives no rows. Cheapest edits; of
    several as cheap the least as ASCII text. Output leaves in batches, so a long conversation needs no memory for itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, chars = None, [], 0
        for batch in batches:
            for conv, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out += now.end()
                    now = _Conversation(conv)
                if fault is not None:
                    out += now.row(turn, role, text, fault)
                    chars += len(text)
                if len(out) >= most_rows or chars >= most_chars:
                    yield _batch(out)
                    out, chars = [], 0
        if now is not None:
            out += now.end()
        if out:
            yield _batch(out)

    return with_faults(rows).mapInArrow(work, OUT)


_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], kind: str = OUT) -> pa.RecordBatch:
    fields = [f.split() for f in kind.split(", ")]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(repaired: DataFrame) -> DataFrame:
    """One row a conversation from the runs of ``repair``: counts, edits as letters, the digest of ``role:text`` lines.

    Reads the runs where they are: no shuffle; a digest takes in one turn after the other.
    """
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, any_turn = hashlib.sha256(), [], False
        for batch in batches:
            done = []
            for conv, seq, edit, role, text, _, *counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if seq is None:
                    done.append((conv, *counts, "".join(audit), digest.hexdigest()))
                    digest, audit, any_turn = hashlib.sha256(), [], False
                    continue
                audit.append(edit)
                if edit != DELETE:
                    digest.update(f"{'\n' if any_turn else ''}{role}:{text}".encode())
                    any_turn = True
            if done:
                yield _batch(done, REPORT)

    return repaired.mapInArrow(work, REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows for ``repair`` from conversations, damaged by crc32(``conv_id:turn``) modulo 20; nulls are one space.

    0 marks a row gone, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    given = rows.select(F.col("conv_id").alias("conv"), "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return given.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("_copy"))
