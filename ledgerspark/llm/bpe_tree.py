"""Byte-level BPE of whole texts, exactly as the tokenizers library encodes and decodes them.

A text is cut only where the library's own splitting surely cuts: before a space after a printable
ASCII character (no token of its pattern holds white space behind another character, and the
special token holds no space). The units in between repeat so often that each goes through the
library once per task and is then looked up.

A text beyond ``leaf`` characters is not one task's work: it is cut into leaves that other tasks
encode. Where it offers no cut, its library tokens' boundaries serve; a single unsplit run beyond
``leaf`` bytes is halved until the halves fit, the halves are encoded in parallel by the merges
alone, and the tree is joined upwards: a window of tokens around each join is encoded again and
grown until its first and last token are those that both sides had. A sequence of tokens is a
text's encoding if and only if each two neighbours are the encoding of their own text; agreement
at both ends leaves only such neighbours, so the join is exact, and the tests hold it against the
library.

Defined cases: null text is empty and has no ids; repeated rows and ids are texts of their own; an
empty table gives an empty result; the text of a special token becomes that token, as in the
library's default; other columns than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text (bytes of an unsplit run) that one leaf has at most, where it can be cut.
LEAF = 1 << 16
#: Units of text that a task remembers at least (twice as many at most), and the longest one that it does.
HELD_UNITS, LONGEST_UNIT = 200_000, 64
#: Tokens on each side of a join that are encoded first.
WINDOW = 4
#: Characters that go through the splitting at once.
BLOCK = 1 << 20

CUT = re.compile(r"(?<=[!-~])(?= )")

PLAIN, WHOLE, PART = 0, 1, 2  # leaves: text; library tokens, one a line; a part of one library token


def _byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """One tokenizer file in one task. Ids are bytes, four a token, little-endian."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        letters, self.bytes, self.names = _byte_letters(), [], []
        for i in range(self.tokenizer.get_vocab_size()):
            name = self.tokenizer.id_to_token(i)
            self.names.append(name)
            self.bytes.append(bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode())
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _known(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units: remembered ones, and new ones through the library."""
        known = {u: self.held[u] for u in units & self.held.keys()}
        rest = units - known.keys()
        again = {u: self.older[u] for u in rest & self.older.keys()}
        new = list(rest - again.keys())
        again.update(zip(new, (_ids(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        if len(self.held) > HELD_UNITS:
            self.held, self.older = {}, self.held
        self.held.update((u, ids) for u, ids in again.items() if len(u) <= LONGEST_UNIT)
        return known | again

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [CUT.split(t) if t else [] for t in texts]
        known = self._known(set().union(*split) if split else set())
        return [b"".join(map(known.__getitem__, units)) for units in split]

    def decode(self, ids: bytes) -> str:
        """The library's decoding without skipping special tokens: bytes of the tokens, read as UTF-8."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def merges(self, run: str) -> bytes:
        """Ids of one unsplit run, written in the letters of the vocabulary."""
        return _ids([t.id for t in self.model.tokenize(run)]) if run else b""

    def joined(self, left: bytes, right: bytes) -> bytes:
        """Ids of the run that two encoded runs make up."""
        size = WINDOW
        while left and right:
            a, b = left[-4 * size :], right[: 4 * size]
            again = self.merges("".join(self.names[i] for i in np.frombuffer(a + b, "<u4").tolist()))
            if (len(a) == len(left) or again[:4] == a[:4]) and (len(b) == len(right) or again[-4:] == b[-4:]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            size *= 2
        return left + right

    def tree(self, parts: list[bytes]) -> bytes:
        """Parts of one run, joined two by two."""
        while len(parts) > 1:
            parts = [self.joined(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def leaf(self, kind: int, text: str) -> bytes:
        if kind == PLAIN:
            return self.encode_all([text])[0]
        return b"".join(map(self.merges, text.split("\n"))) if kind == WHOLE else self.merges(text)

    def leaves(self, text: str, leaf: int = LEAF) -> Iterator[tuple[int, int, str]]:
        """(run, kind, text) of a text's leaves in order; parts of one library token have a run's number in common."""
        low, run = 0, 0
        while low < len(text):
            high = len(text)
            if high - low > leaf:
                cut = text.rfind(" ", low + 1, low + leaf)
                while cut > low and not "!" <= text[cut - 1] <= "~":
                    cut = text.rfind(" ", low + 1, cut)
                if cut <= low:
                    found = CUT.search(text, low + leaf)
                    cut = found.start() if found else high
                high = cut
            if high - low <= leaf:
                yield run, PLAIN, text[low:high]
            else:
                for kind, piece in self._uncut(text[low:high], leaf):
                    run += kind != PART
                    yield run, kind, piece
                run += 1
            low, run = high, run + 1

    def _uncut(self, text: str, leaf: int) -> Iterator[tuple[int, str]]:
        """Leaves of a text without cuts: special tokens, library tokens together, halves of a long one (each begun by an empty WHOLE)."""
        for k, piece in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield PLAIN, piece
                continue
            group, size = [], 0
            for name, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece) if piece else []:
                if group and size + len(name) > leaf:
                    yield WHOLE, "\n".join(group)
                    group, size = [], 0
                if len(name) <= leaf:
                    group.append(name)
                    size += len(name) + 1
                else:
                    yield WHOLE, ""
                    yield from ((PART, half) for half in _halves(name, leaf))
            if group:
                yield WHOLE, "\n".join(group)


def _halves(run: str, leaf: int) -> Iterator[str]:
    if len(run) <= leaf:
        yield run
    else:
        yield from _halves(run[: len(run) // 2], leaf)
        yield from _halves(run[len(run) // 2 :], leaf)


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, some at a time."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (binary: unsigned 32-bit, little-endian) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.char_length("text") > leaf, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            at = 0
            for texts in _texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], pa.array(bpe.encode_all(texts), pa.binary())], names=["doc_id", "ids"])
                at += len(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            for k in range(batch.num_rows):
                for no, (run, kind, text) in enumerate(bpe.leaves(batch.column(2)[k].as_py(), leaf)):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], *(pa.array([x]) for x in (no, run, kind)), pa.array([text])], names=["row", "doc_id", "no", "run", "kind", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            for k in range(batch.num_rows):
                ids = bpe.leaf(batch.column(4)[k].as_py(), batch.column(5)[k].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[k : k + 1] for i in range(5)), pa.array([ids], pa.binary())], names=["row", "doc_id", "no", "run", "kind", "ids"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, key, runs = None, None, []
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            for k in range(batch.num_rows):
                row, doc_id, run, kind, ids = (batch.column(i)[k].as_py() for i in (0, 1, 3, 4, 5))
                if key is not None and row != key[0]:
                    yield _whole(bpe, key, runs, batch.schema)
                    runs = []
                key = row, doc_id
                if runs and runs[-1][0] == run and kind == PART:
                    runs[-1][1].append(ids)
                else:
                    runs.append((run, [ids]))
        if key is not None:
            yield _whole(bpe, key, runs, batch.schema)

    few = rows.where(~is_long).mapInArrow(short, f"doc_id {id_type}, ids binary")
    key = f"row bigint, doc_id {id_type}, no bigint, run bigint, kind bigint"
    parts = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, f"{key}, text string")
    parts = parts.repartition("row", "no").mapInArrow(leaves, f"{key}, ids binary")
    whole = parts.repartition("row").sortWithinPartitions("row", "no").mapInArrow(grown, f"doc_id {id_type}, ids binary")
    return few.unionByName(whole)


def _whole(bpe: ByteBpe, key: tuple, runs: list[tuple[int, list[bytes]]], schema: pa.Schema) -> pa.RecordBatch:
    ids = b"".join(bpe.tree(parts) for _, parts in runs)
    return pa.RecordBatch.from_arrays([pa.array([key[1]], schema.field(1).type), pa.array([ids], pa.binary())], names=["doc_id", "ids"])


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``ids`` with the decoded text of every row (doc_id, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or ByteBpe(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(x.as_py()) for x in batch.column(1)], pa.string())], names=["doc_id", "ids", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
