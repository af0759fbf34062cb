"""Conversation structure repair (operator 12): A* on the edit lattice.

A conversation's rows are read in order, each with its first fault. A node of the lattice is the number of rows read and
what the repaired roles end with; edits lead from node to node. The search is keyed (cost plus heuristic, audit): the
heuristic is the suffix sum of what the rows ahead cost at least, a deletion for each that must go and the cheaper of
deletion and charge for each truncated one, so the first path that ends has the least cost and, of equals, the least
audit. Rows come sorted and go through in blocks: after a block only the best path to each of four ends is left, and what
these share is final, so texts are let go as they come and no conversation is held whole.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.textcore import quoted, small_batches
from quillstack.session import table

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that are searched at once.
BLOCK = 256
_WHITE = r"\x20\x09-\x0D"
#: Ends of the repaired roles: nothing yet, s, u, a. What each initial leads to; a conversation may end with nothing or a.
_START, _S, _U, _A = range(4)
_NEXT = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_WANTS = {_START: "u", _S: "u", _U: "a", _A: "u"}
_ROLE = {"u": "user", "a": "assistant"}
_ENDS = (_START, _A)
#: Any end takes the place of any other for two insertions and a deletion at most; a path that costs more than the best by
#: more than that can't be part of a cheapest one.
CATCH_UP = 2 * INSERT + DELETE
_FAULTS = ("blank", "duplicate", "truncated")
_TURN = "edit string, turn long, role string, text string, fault string"
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def search(rows: list[tuple[str, int]], seeds: list[tuple[int, str, int]], last: bool) -> list[tuple[int, str, int]]:
    """The best (cost, audit, end) at each end after `rows` (initial, fault as a place in _FAULTS from 1, or 0).

    `seeds` are the best before them. After the last row only the best of those ends that a conversation may have."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if rows[k][1] in (1, 2) else min(DELETE, TRUNCATED) if rows[k][1] == 3 else 0)
    queue = [(cost + ahead[0], audit, 0, end) for cost, audit, end in seeds]
    heapq.heapify(queue)
    done: set[tuple[int, int]] = set()
    out: list[tuple[int, str, int]] = []
    while queue:
        f, audit, k, end = heapq.heappop(queue)
        if (k, end) in done:
            continue
        done.add((k, end))
        cost = f - ahead[k]
        if k == n and (not last or end in _ENDS):
            out.append((cost, audit, end))
            if last or len(out) == 4:
                return out

        def go(edit: str, price: int, row: int, to: int, cost=cost, audit=audit):
            if (row, to) not in done:
                heapq.heappush(queue, (cost + price + ahead[row], audit + edit, row, to))

        go("I", INSERT, k, _NEXT[end, _WANTS[end]])
        if k == n:
            continue
        initial, fault = rows[k]
        go("D", DELETE, k + 1, end)
        if fault in (1, 2):
            continue
        charge = TRUNCATED if fault == 3 else 0
        if (end, initial) in _NEXT:
            go("K", charge, k + 1, _NEXT[end, initial])
        go("R", REROLE + charge, k + 1, _NEXT[end, _WANTS[end]])
    return out


class _Repair:
    """One conversation as its rows come: counts, and edits as soon as they are final."""

    def __init__(self, sink):
        self.sink = sink  # called with (edit, turn, role, text, fault) of each edit
        self.block: list[tuple[str, int]] = []
        self.held: list[tuple] = []  # rows whose edit is open
        self.seeds, self.end, self.cost = [(0, "", _START)], _START, 0
        self.turns, self.least, self.most, self.before = 0, None, None, None
        self.initial: str | None = None
        self.counts = dict.fromkeys((*_FAULTS, "illegal"), 0)
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.before:  # sorted by turn
            self.turns, self.before, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        if fault:
            self.counts[_FAULTS[fault - 1]] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        self.block.append((initial, fault))
        self.held.append((turn, role, text, fault))
        if len(self.block) == BLOCK:
            self._advance(False)

    def _advance(self, last: bool) -> None:
        self.seeds = search(self.block, self.seeds, last)
        least = min(cost for cost, _, _ in self.seeds)
        self.seeds = [x for x in self.seeds if x[0] <= least + CATCH_UP]
        self.block = []
        common = os.path.commonprefix([audit for _, audit, _ in self.seeds])
        self.seeds = [(cost, audit[len(common) :], end) for cost, audit, end in self.seeds]
        at = 0
        for edit in common:
            turn, role, text, fault = self.held[at] if edit != "I" else (None, None, "", 0)
            at += edit != "I"
            if edit in "RI":
                role = _ROLE[_WANTS[self.end]]
            if edit != "D":
                self.end = _NEXT[self.end, role[:1]]
            self.sink(edit, turn, role, text, _FAULTS[fault - 1] if fault else None)
        self.held = self.held[at:]
        self.audit.append(common)

    def finish(self) -> list:
        self._advance(True)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return [gaps, *self.counts.values(), self.seeds[0][0], "".join(self.audit)]


def initial_faults(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, gone, fault) with the rows of a conversation together and in order: by turn, nulls first,
    then by role and text. Null roles and texts are one space. `gone` (where the input has it) marks rows that only stand
    for their conversation."""
    spaced = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    rows = df.select(quoted(conv).alias("conv"), quoted(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), gone.alias("gone")).repartition("conv")
    same = Window.partitionBy("conv", "gone", "role", F.xxhash64("text"), F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z")
    fault = F.when(blank, 1).when(F.row_number().over(same) > 1, 2).when(cut, 3).otherwise(0)
    return rows.withColumn("fault", fault).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", F.col("fault") == 2)  # of equal rows the first is no duplicate


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, tuple | None]]:
    """(conversation, is it new, row or None) of sorted batches."""
    before, first = None, True
    for batch in batches:
        for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = first or conv != before
            before, first = conv, False
            yield conv, new, None if gone else (turn, role, text, fault)


def _summaries(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv", *(x.split()[0] for x in _SUMMARY.split(", "))]
    out: list[list] = []
    conv, work, digest = None, None, None

    def done() -> None:
        values = work.finish()
        out.append([conv, *values, digest.hexdigest()])

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for at, new, row in _conversations(batches):
        if new:
            if work:
                done()
            if len(out) >= 1000:
                yield flush()
            conv, digest, begun = at, hashlib.sha256(), []

            def hashed(edit, turn, role, text, fault, digest=digest, begun=begun):
                if edit != "D":
                    digest.update(("\n" * len(begun) + f"{role}:{text}").encode())
                    begun[:] = [1]

            work = _Repair(hashed)
        if row:
            work.add(*row)
    if work:
        done()
        yield flush()


def _turns(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv", "step", *(x.split()[0] for x in _TURN.split(", "))]
    out: list[list] = []
    work = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for at, new, row in _conversations(batches):
        if new:
            if work:
                work.finish()
            step = [0]

            def kept(*edit, at=at, step=step):
                out.append([at, step[0], *edit])
                step[0] += 1

            work = _Repair(kept)
        if row:
            work.add(*row)
        if len(out) >= 1000:
            yield flush()
    if work:
        work.finish()
    if out:
        yield flush()


def _each(rows: DataFrame, work, schema: str, conv: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(rows.sparkSession)
    kind = rows.schema["conv"].dataType
    arrow = to_arrow_type(kind)
    return rows.mapInArrow(lambda batches: work(batches, arrow), f"conv {kind.simpleString()}, {schema}").withColumnRenamed("conv", conv)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, step, edit, turn, role, text, fault): a row an edit in order, as it leaves the row; edits are K, R, D and I.

    Deleted rows (D) are there with the text that goes. A row's first fault of blank, duplicate and truncated counts. Rows
    without a conversation are one; a null role or text is one space, so its text is blank. Rows that share a turn are in
    the order of role and text. Only the four columns are read, other columns don't come along; an empty table stays empty.
    """
    return _each(initial_faults(df, conv, turn, role, text), _turns, f"step long, {_TURN}", conv)


def summaries(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, of the rows that
    `repaired` takes and as it repairs them. A boolean column `gone` marks rows that only keep their conversation in
    the result. One task reads a conversation in order, as its digest asks for, and holds the rows of open edits alone.
    """
    return _each(initial_faults(df, conv, turn, role, text), _summaries, _SUMMARY, conv)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows damaged by the CRC-32 of `conv:turn` modulo 20: 0 drops one (`gone`), 1 empties it, 2 takes its [.!?] away,
    3 repeats it, 4 makes it the user's. Nulls are one space."""
    spaced = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", spaced(conv), spaced(turn)).cast("binary")) % 20
    said = F.when(k == 1, "").when(k == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    rows = df.select(quoted(conv).alias(conv), quoted(turn).alias(turn), F.when(k == 4, "user").otherwise(spaced(role)).alias(role), said.alias(text), (k == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))))
    return rows.drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(damaged(table(spark, sf_dir, "conversations")))
