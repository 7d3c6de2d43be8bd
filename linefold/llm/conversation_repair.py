"""Cheapest repair of conversations whose roles must alternate, by alignment with every feasible target.

The turns of a conversation must end up with role initials `(s?(ua)+)?`. Edits and costs: Keep 0, Rerole to user or
assistant 3, Delete 4, Insert an empty turn 3; a truncated turn that stays adds 3. Blank and repeated turns must be
deleted. For each length there is one target string, so the turns are aligned with each feasible length by
Wagner-Fischer: a cell (turn, rest) holds the least cost of aligning the turns from there with the last `rest` signs.
Targets share their tails, so one table serves all lengths; an odd target, which starts with a kept system turn,
enters it behind that turn. Ukkonen's band keeps the cells that the cost of a plain walk, the incumbent, allows: no
cheaper alignment deletes more than a quarter or inserts more than a third of it. Alignments of all lengths that cost
the least are traced back, at each step by the edit whose initial is least, and the ASCII-least audit is taken.

The table grows with the square of a conversation. From `LONG` turns on, cells whose rests agree in parity are folded
into one, which gives the same cost and audit in time and memory in proportion to the turns.

Conversations are dealt by id and sorted by Spark, and stream through tasks twice: turns without texts for the audit,
then audits and turns for the repaired text. A hash of the whole repaired conversation has to see its turns one after
the other, so a conversation is one task's work; the task holds about 100 bytes for each of its turns, never its texts.

Turns come by number, nulls first; turns of one number by role, then text, a repeat next to its turn. A null role or
text is one space, and a null id is an id. A role that starts with none of u, a, s, or is empty, can't be kept.
Repeated rows are repeated turns, so the later ones are duplicates. Ids without a turn have counts of zero, an empty
audit and the hash of the empty string; an empty table gives no rows. Only the four columns named are read.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LONG = 1_024
NEVER = 1 << 60
#: Codes of role initials; 0 is any other.
CODES = {"u": 1, "a": 2, "s": 3}
LEGAL = {(3, 1), (1, 2), (2, 1)}
SPACES = "\\x20\\x09-\\x0D"


def sign(rest: int) -> int:
    """The role initial of a target where `rest` signs are left, itself included."""
    return 1 if rest % 2 == 0 else 2


class Turns:
    """What the alignment needs of the turns of one conversation: initials, and the costs of staying."""

    def __init__(self):
        self.initials, self.forced, self.extra = bytearray(), bytearray(), bytearray()

    def __len__(self) -> int:
        return len(self.initials)

    def add(self, initial: int, forced: bool, truncated: bool) -> None:
        self.initials.append(initial)
        self.forced.append(forced)
        self.extra.append(TRUNCATED if truncated and not forced else 0)

    def stay(self, i: int, wanted: int) -> int:
        """The cost of turn i in a place that wants a user or an assistant; too much where it must go."""
        if self.forced[i]:
            return NEVER
        return self.extra[i] + (KEEP if self.initials[i] == wanted else REROLE)

    def openings(self) -> Iterator[tuple[int, int]]:
        """(turn, cost) of every system turn that can open an odd target, all before it deleted."""
        for i, initial in enumerate(self.initials):
            if initial == CODES["s"] and not self.forced[i]:
                yield i, DELETE * i + KEEP + self.extra[i]


def incumbent(turns: Turns) -> int:
    """The cost of a plain walk: what can stay stays in turn, and a last answer is added where it lacks."""
    cost = placed = 0
    for i in range(len(turns)):
        if turns.forced[i]:
            cost += DELETE
        else:
            cost += turns.stay(i, 1 + placed % 2)
            placed += 1
    return cost + INSERT * (placed % 2)


class Table:
    """Costs of aligning the turns from i on with the last `rest` signs, inside the band."""

    def __init__(self, turns: Turns, limit: int):
        self.turns, n = turns, len(turns)
        fewer, more = limit // DELETE, limit // INSERT
        self.low = [max(0, n - i - fewer) for i in range(n + 1)]
        self.costs: list[list[int]] = [[]] * n + [[INSERT * rest for rest in range(more + 1)]]
        for i in range(n - 1, -1, -1):
            after, low, shift = self.costs[i + 1], self.low[i], self.low[i] - self.low[i + 1]
            stays = (turns.stay(i, sign(0)), turns.stay(i, sign(1)))
            row, left = [], NEVER
            for rest in range(low, n - i + more + 1):
                at = rest - low + shift
                cost = left + INSERT
                if at < len(after) and after[at] + DELETE < cost:
                    cost = after[at] + DELETE
                if rest and at and after[at - 1] + stays[rest % 2] < cost:
                    cost = after[at - 1] + stays[rest % 2]
                row.append(cost)
                left = cost
            self.costs[i] = row

    def cost(self, i: int, rest: int) -> int:
        at = rest - self.low[i]
        return self.costs[i][at] if 0 <= at < len(self.costs[i]) else NEVER

    def rests(self, i: int) -> range:
        return range(self.low[i], self.low[i] + len(self.costs[i]))

    def trace(self, i: int, rest: int) -> str:
        """The ASCII-least audit among the cheapest from a cell on."""
        out, n = [], len(self.turns)
        while i < n or rest:
            cost = self.cost(i, rest)
            if i < n and self.cost(i + 1, rest) + DELETE == cost:
                out.append("D")
                i += 1
            elif rest and self.cost(i, rest - 1) + INSERT == cost:
                out.append("I")
                rest -= 1
            else:
                out.append("K" if self.turns.initials[i] == sign(rest) else "R")
                i, rest = i + 1, rest - 1
        return "".join(out)


def aligned(turns: Turns) -> tuple[int, str]:
    """Least cost and its ASCII-least audit, over the targets of every feasible length."""
    table = Table(turns, incumbent(turns))
    starts = [(table.cost(0, rest), "", 0, rest) for rest in table.rests(0) if rest % 2 == 0]
    for i, cost in turns.openings():
        head = "D" * i + "K"
        starts += [(cost + table.cost(i + 1, rest), head, i + 1, rest) for rest in table.rests(i + 1) if rest and rest % 2 == 0]
    least = min(s[0] for s in starts)
    return least, min(head + table.trace(i, rest) for cost, head, i, rest in starts if cost == least)


def folded(turns: Turns) -> tuple[int, str]:
    """The same for long conversations: rests of one parity are one column."""
    n = len(turns)
    # Rests that are even, odd, and even but not zero.
    even, odd, some = (array("q", bytes(8 * (n + 1))) for _ in range(3))
    even[n], odd[n], some[n] = 0, INSERT, 2 * INSERT
    for i in range(n - 1, -1, -1):
        user, other = turns.stay(i, sign(2)), turns.stay(i, sign(1))
        e, o = min(even[i + 1] + DELETE, odd[i + 1] + user), min(odd[i + 1] + DELETE, even[i + 1] + other)
        even[i], odd[i] = min(e, o + INSERT), min(o, e + INSERT)
        some[i] = min(some[i + 1] + DELETE, odd[i] + INSERT, odd[i + 1] + user)
    openings = {i: cost + some[i + 1] for i, cost in turns.openings()}
    least = min([even[0], *openings.values()])

    def trace(out: list[str], i: int, column: array) -> str:
        while i < n or column[i]:
            cost, (inserted, wanted) = column[i], (even, sign(1)) if column is odd else (odd, sign(2))
            if i < n and column[i + 1] + DELETE == cost:
                out.append("D")
                i += 1
            elif inserted[i] + INSERT == cost:
                out.append("I")
                column = inserted
            else:
                out.append("K" if turns.initials[i] == wanted else "R")
                i, column = i + 1, inserted
        return "".join(out)

    audits = [trace([], 0, even)] if even[0] == least else []
    # Of audits that open with different system turns, the one with most deletions in front is least.
    opens = [i for i, cost in openings.items() if cost == least]
    if opens:
        audits.append(trace(["D" * opens[-1] + "K"], opens[-1] + 1, some))
    return least, min(audits)


def audit(turns: Turns) -> tuple[int, str]:
    return aligned(turns) if len(turns) < LONG else folded(turns)


def edited(audit_text: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, from the audit and the turns in order; deleted ones are left out."""
    length = len(audit_text) - audit_text.count("D")
    placed = 0
    for edit in audit_text:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if sign(length - placed) == 1 else "assistant"
        placed += 1
        yield edit, role, text


def damaged(talks: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults where a hash of id and turn says so, for measuring repairs.

    crc32 of `id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes
    it a user's. Nulls count as one space, in the hash too.
    """
    space = F.lit(" ")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in (key, turn)])
    rows = talks.select(
        F.col(key).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        (F.crc32(named.cast("binary")) % 20).alias("_code"),
    ).where("_code <> 0")
    body = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"),
        body.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plain(rows: DataFrame) -> DataFrame:
    """The four columns, ids as long or string, without null roles and texts."""
    whole = isinstance(rows.schema["conv_id"].dataType, T.IntegralType)
    space = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("long" if whole else "string"),
        F.col("turn").cast("long"),
        *[F.coalesce(F.col(c), space).alias(c) for c in ("role", "text")],
    )


def _in_order(first: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order, behind its row of `first`."""
    both = first.withColumn("_kind", F.lit(0)).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = ["conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "text"]
    return both.repartition("conv_id").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(id, rows) of each conversation; rows must be read before the next one."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            # Texts of one slice at a time become Python strings.
            for a in range(0, batch.num_rows, 512):
                yield from zip(*[c.to_pylist() for c in batch.slice(a, 512).columns])

    rows, ahead = flat(), []

    def own(first: tuple) -> Iterator[tuple]:
        yield first
        for row in rows:
            if row[0] != first[0]:
                ahead.append(row)
                return
            yield row

    for first in rows:
        while True:
            group = own(first)
            yield first[0], group
            for _ in group:
                pass
            if not ahead:
                break
            first = ahead.pop()


def _batched(rows: Iterator[tuple], schema: T.StructType, size: int = 1024) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields]
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*part), kinds)], names=schema.names)


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, the counts above and the audit of every conversation; of every id of `ids` too, if given."""
    rows = _plain(rows)
    key = rows.schema["conv_id"]
    named = rows.select("conv_id") if ids is None else ids.select(F.col("conv_id").cast(key.dataType))
    schema = T.StructType([key, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])

    def judged(conv: object, group: Iterator[tuple]) -> tuple:
        turns, seen, numbers = Turns(), set(), set()
        blanks = duplicates = cuts = illegal = 0
        before = None
        for _, kind, turn, initial, blank, cut, mark in group:
            if not kind:
                continue
            if turn is not None:
                numbers.add(turn)
            again = mark in seen
            seen.add(mark)
            code = CODES.get(initial, 0)
            illegal += before is not None and (before, code) not in LEGAL
            before = code
            blanks += blank
            duplicates += again and not blank
            cuts += cut and not blank and not again
            turns.add(code, blank or again, cut)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        return (conv, gaps, blanks, duplicates, cuts, illegal, *audit(turns))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((judged(*c) for c in _conversations(batches)), schema)

    narrow = _in_order(named.distinct(), rows).select(
        "conv_id",
        "_kind",
        "turn",
        F.substring("role", 1, 1).alias("_initial"),
        (~F.col("text").rlike(f"[^{SPACES}]")).alias("_blank"),
        (~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")).alias("_cut"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("_mark"),
    )
    return narrow.mapInArrow(judge, schema)


def _with_audits(rows: DataFrame, judged: DataFrame) -> DataFrame:
    return _in_order(judged, _plain(rows)).select(*judged.columns, "_kind", "role", "text")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, counts, audit and repaired_sha256 of the repaired turns as `role:text` lines."""
    judged = audits(rows, ids)
    schema = T.StructType([*judged.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def hashed(conv: object, group: Iterator[tuple]) -> tuple:
        first = next(group)[: len(schema) - 1]
        made, between = hashlib.sha256(), ""
        for _, role, text in edited(first[-1], (row[-2:] for row in group)):
            made.update(f"{between}{role}:{text}".encode())
            between = "\n"
        return (*first, made.hexdigest())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((hashed(*c) for c in _conversations(batches)), schema)

    return _with_audits(rows, judged).mapInArrow(digest, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of the repaired conversations."""
    judged = audits(rows).select("conv_id", "audit")
    schema = T.StructType.fromDDL("conv_id long, place long, edit string, role string, text string")
    schema["conv_id"].dataType = judged.schema["conv_id"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for conv, group in _conversations(batches):
                first = next(group)
                for place, turn in enumerate(edited(first[1], (row[-2:] for row in group))):
                    yield (conv, place, *turn)

        yield from _batched(turns(), schema)

    return _with_audits(rows, judged).mapInArrow(write, schema)
