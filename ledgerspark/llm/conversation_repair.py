"""Cheapest edits that make a conversation alternate, decided by one integer minimum.

A valid conversation has role initials ``(s?(ua)+)?``. Rows can be kept (0), given the role user
or assistant (2) or deleted (3; the only choice for blank and duplicate rows); rows of empty text
can be inserted anywhere (2); a truncated row that stays adds 1. Of the cheapest edits, the one
whose letters (Keep, Rerole, Delete, Insert) are ASCII-least counts.

Both decisions are one number. The nodes of a directed acyclic graph are (rows read, state), the
states being: nothing yet, after system, after user, after assistant. An edge reads one row, after
zero to two inserts (three never pay: they come back to a state that one insert reaches). Its
weight has the cost in the high digits and the edge's letters in the row's own three low digits,
padded with zeros at the end. No edge's letters begin another's, because each ends with the letter
of the row that it reads, so comparing the digits row by row is comparing the strings; inserts
after the last row stand last, where the zeros make the shorter string the lesser one. The least
sum of weights is the answer, and its digits without zeros are the audit letters. State and role
of every row follow from the letters.

Long conversations are not one task's work: rows are dealt by ranges of (conversation, turn, role,
digest), a run of rows becomes a four by four matrix of least weights, and a conversation's
matrices are joined in order (the minimum over the middle state of shifted sums), a few numbers
for every ``CHUNK`` rows. Only the digest of the repaired text has to read its text in one stream;
it is never held.

Defined cases: nulls in turn sort first and in role, text and the crc's key count as one space;
rows of one turn are taken by role, then by the SHA-256 of the text; equal rows are counted
before the shuffle; a null conv_id is a conversation of its own; turns that span more than a
bigint give null gaps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one conversation in one matrix.
CHUNK = 512
#: Rows that the reading task emits at a time.
EMIT = 2000

START, SYSTEM, USER, ASSISTANT = range(4)
ROW = 9  # bits of a row's letters: three octal digits
LETTERS = "\0DIKR"  # ASCII order; zero is the padding
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
#: What follows a state for each initial of a row, and for a row that may get either role.
TAKES = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
FREE = [USER, USER, ASSISTANT, USER]
ENDS = (START, ASSISTANT)
BLANK = r"^[\x20\x09-\x0D]*\z"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

Matrix = dict[tuple[int, int], int]  # (state before, state after) -> least weight


def _code(letters: str) -> int:
    """Up to three letters as one row's digits, zeros at the end."""
    return sum(LETTERS.index(c) << 3 * (2 - i) for i, c in enumerate(letters))


@cache
def edges(initial: str, gone: bool, cut: bool) -> tuple[tuple[int, int, int, int], ...]:
    """(state, next state, cost, digits) of the ways to read a row, the least one between two states."""
    found: dict[tuple[int, int], tuple[int, int]] = {}

    def add(begin: int, then: int, cost: int, digits: int) -> None:
        found[begin, then] = min(found.get((begin, then), (cost, digits)), (cost, digits))

    for begin in range(4):
        state, letters = begin, ""
        for _ in range(3):
            cost = COSTS["I"] * len(letters)
            add(begin, state, cost + COSTS["D"], _code(letters + "D"))
            if not gone:
                add(begin, FREE[state], cost + COSTS["R"] + cut, _code(letters + "R"))
                if initial in TAKES[state]:
                    add(begin, TAKES[state][initial], cost + cut, _code(letters + "K"))
            state, letters = FREE[state], letters + "I"
    return tuple((*ends, *weight) for ends, weight in found.items())


def matrix(rows: list[tuple[str, bool, bool]], begins: tuple[int, ...]) -> Matrix:
    """Least weights of reading ``rows`` (initial, gone, cut) from each of ``begins``: a minimum over paths of the graph."""
    high, out = ROW * len(rows), {}
    for begin in begins:
        best = {begin: 0}
        for i, row in enumerate(rows):
            place, after = ROW * (len(rows) - 1 - i), {}
            for state, then, cost, digits in edges(*row):
                if state in best:
                    weight = best[state] + (cost << high) + (digits << place)
                    if then not in after or weight < after[then]:
                        after[then] = weight
            best = after
        out |= {(begin, end): weight for end, weight in best.items()}
    return out


def joined(left: Matrix, n_left: int, right: Matrix, n_right: int) -> Matrix:
    """The matrix of two runs of rows: costs add up, the left digits stand before the right ones."""
    a, b, out = ROW * n_left, ROW * n_right, {}
    for (begin, middle), x in left.items():
        for (other, end), y in right.items():
            if other == middle:
                weight = (x << b) + (y >> b << a + b) + (y & (1 << b) - 1)
                if (begin, end) not in out or weight < out[begin, end]:
                    out[begin, end] = weight
    return out


def decided(found: Matrix, n: int) -> tuple[int, str]:
    """Cost and letters of the least path from nothing to a valid end, with inserts after the last row."""
    best, high = None, ROW * (n + 1)
    for (begin, end), weight in found.items():
        cost, digits = weight >> ROW * n, weight & (1 << ROW * n) - 1
        for inserts in range(3 if begin == START else 0):
            if end in ENDS:
                whole = (cost + COSTS["I"] * inserts << high) + (digits << ROW) + _code("I" * inserts)
                best = whole if best is None else min(best, whole)
            end = FREE[end]
    octal = f"{best & (1 << high) - 1:o}"
    return best >> high, octal.translate({48: None} | {48 + i: LETTERS[i] for i in range(1, 5)})


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of every row: the crc of ``conv_id:turn`` decides; n is how often the row is there, 0 for dropped ones."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    return conversations.withColumn("_kind", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


ORDER = ["conv_id", "turn", "role", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows, with their number n and faults: blank, first (of its role and text), cut. No texts.

    The first row of a role and text is found by an aggregate and meets its row in a second one, so
    a phrase that fills a conversation is no hot key.
    """
    plain = _keyed(rows).select(*ORDER, "n", F.col("text").rlike(BLANK).alias("blank"), F.col("text").rlike(CUT).alias("cut"), F.lit(False).alias("first"))
    there = plain.where("n > 0 AND NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    there = there.select("conv_id", "at.turn", "role", "digest", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("cut"), F.lit(True).alias("first"))
    return plain.unionByName(there).groupBy(*ORDER).agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))


_KEY = "conv_id bigint, turn bigint, role string, digest binary, seq bigint"
_PIECE = "n bigint, least binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"
_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _arrow(fields: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _packed(found: Matrix) -> bytes:
    """State before, state after, length and digits of each weight, one after another."""
    out = bytearray()
    for (begin, end), weight in found.items():
        data = weight.to_bytes((weight.bit_length() + 7) // 8, "big")
        out += bytes((begin, end)) + len(data).to_bytes(4, "big") + data
    return bytes(out)


def _unpacked(data: bytes) -> Matrix:
    at, out = 0, {}
    while at < len(data):
        size = int.from_bytes(data[at + 2 : at + 6], "big")
        out[data[at], data[at + 1]] = int.from_bytes(data[at + 6 : at + 6 + size], "big")
        at += 6 + size
    return out


class _Run:
    """Counts and rows of one run of a conversation, in order."""

    def __init__(self, key: tuple, begins: tuple[int, ...]) -> None:
        self.key, self.begins, self.rows = key, begins, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn: int | None, role: str, n: int, blank: bool, first: bool, cut: bool) -> None:
        """``n`` equal rows, of which the first one may be the first of its role and text."""
        initial, truncated = role[:1], first and cut
        self.rows += [(initial, not first, truncated)] + [(initial, True, False)] * (n - 1)
        self.illegal += (n - 1) + (self.tail is not None and self.tail + initial not in ("su", "ua", "au"))
        self.blank += n * blank
        self.duplicate += (n - first) * (not blank)
        self.truncated += truncated
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.head, self.tail = initial if self.head is None else self.head, initial

    def row(self) -> tuple:
        least = _packed(matrix(self.rows, self.begins))
        return (*self.key, len(self.rows), least, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.turns)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted rows in runs. The first conversation of a task may have begun in another one, so it is read from every state."""
    run, begins, conv, seq = None, tuple(range(4)), None, 0
    for conv_id, turn, role, digest, n, blank, cut, first in rows:
        if run is not None and conv_id != conv:
            yield run.row()
            run, begins = None, (START,)
        conv = conv_id
        while True:
            if run is None or len(run.rows) >= CHUNK:
                if run is not None:
                    yield run.row()
                    begins = tuple(range(4))
                run, seq = _Run((conv_id, turn, role, digest, seq), begins), seq + 1
            some = min(n, CHUNK - len(run.rows))
            if some:
                run.add(turn, role, some, blank, first, cut)
            n, first = n - some, False
            if not n:
                break
    if run is not None:
        yield run.row()


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= EMIT:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return _in_batches(_runs(rows), _arrow(f"{_KEY}, {_PIECE}"))


class _Conversation:
    """Joins a conversation's matrices in order, two of about equal length at a time; then reads its texts by the letters."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.stack = conv_id, [({(START, START): 0}, 0)]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.tail = self.low = self.high = self.cost = None
        self.hash, self.state, self.at, self.began = hashlib.sha256(), START, 0, False

    def piece(self, piece: dict) -> None:
        if not piece["n"]:
            return
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + piece[name])
        self.illegal += self.tail is not None and self.tail + piece["head"] not in ("su", "ua", "au")
        self.tail = piece["tail"]
        if piece["low"] is not None:
            self.turns -= self.high == piece["low"]
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]
        self.stack.append((_unpacked(piece["least"]), piece["n"]))
        while len(self.stack) > 2 and self.stack[-2][1] <= self.stack[-1][1]:
            self._join()

    def _join(self) -> None:
        (left, n), (right, m) = self.stack[-2:]
        self.stack[-2:] = [(joined(left, n, right, m), n + m)]

    def decide(self) -> None:
        while len(self.stack) > 1:
            self._join()
        self.cost, self.audit = decided(*self.stack.pop())

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.began}{role}:{text}".encode())
        self.began = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = FREE[self.state], self.at + 1
            self._write("user" if self.state == USER else "assistant", "")

    def text(self, role: str, text: str) -> None:
        if self.cost is None:
            self.decide()
        self._inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = TAKES[self.state][role[:1]]
            self._write(role, text)
        elif letter == "R":
            self.state = FREE[self.state]
            self._write("user" if self.state == USER else "assistant", text)

    def row(self) -> tuple:
        if self.cost is None:
            self.decide()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _results(rows: Iterator[tuple]) -> Iterator[tuple]:
    now = None
    for conv_id, role, n, text, piece in rows:
        if now is None or conv_id != now.conv_id:
            if now is not None:
                yield now.row()
            now = _Conversation(conv_id)
        if piece is not None:
            now.piece(piece)
        else:
            for _ in range(n):
                now.text(role, text)
    if now is not None:
        yield now.row()


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return _in_batches(_results(rows), _arrow(_RESULT))


def repairs(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit letters and digest of the repaired text of every conversation in ``rows`` (conv_id, turn, role, text, n)."""
    dealt = faults(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    pieces = dealt.mapInArrow(_pieces, f"{_KEY}, {_PIECE}")
    pieces = pieces.select(*ORDER, "seq", F.lit(None).cast("string").alias("text"), F.struct(*[f.split()[0] for f in _PIECE.split(", ")]).alias("piece"))
    texts = _keyed(rows.where("n > 0")).select(*ORDER, F.col("n").alias("seq"), "text", F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"))
    both = pieces.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("piece").isNull(), "turn", "role", "digest", "seq")
    return both.select("conv_id", "role", "seq", "text", "piece").mapInArrow(_repairs, _RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """``repairs`` of the conversations after ``damage``: one row for every original conv_id."""
    return repairs(damage(conversations))
