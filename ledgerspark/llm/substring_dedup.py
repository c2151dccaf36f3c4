"""Substring dedup: removes passages that already stand in a document with a smaller id.

A window is ``window`` consecutive words of one document. A word goes when some window that
covers it also starts, word for word, in a document with a smaller id.

1. Anchors. Each window is filed under one of its own 10-word grams, the one with the least
   hash. Equal windows have equal anchors, so only texts that share an anchor can repeat one
   another. Neighbouring windows with the same anchor make one context, about 90 words, of
   which only hashes are shuffled.
2. Reference shards. An anchor with more than one context is a shard of the reference: its
   contexts, put in the order of their first documents, are streamed through a suffix
   automaton of those of smaller documents. Matching statistics of ``window`` or more mark the
   windows to remove. The reference is the corpus itself and grows with it, so a shard's
   automaton is built in the task that holds the shard instead of being broadcast. Contexts
   that are equal stand for one.
3. An anchor with more contexts than one automaton should hold is settled by grouping hashes
   of its whole windows, with the same result.

Words are compared by 64-bit hashes; a window counts as equal when its anchor and all its word
hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm._automaton import SuffixAutomaton
from ledgerspark.llm._tables import by_ids, kept
from ledgerspark.llm._words import _BASE_WORD, Block, blocks, gram_hashes, i64, mix, span_hashes

WINDOW = 50
GRAM = 10
#: Contexts that one automaton holds at most; each has under 2 * window words.
SHARD_CONTEXTS = 2048
_POSITION_BITS = 24
_PIECE_WORDS = 1 << 23


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def _contexts(words: np.ndarray, bound: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, context, first window (index of its first word in ``words``), windows: one row for each run of windows with one anchor."""
    found = []
    document = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    for begin in range(0, len(words), _PIECE_WORDS):
        part = words[begin : begin + _PIECE_WORDS + window - 1]
        if len(part) < window:
            break
        grams = gram_hashes(part, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        anchor = (_least((grams & ~low) | place, window - gram + 1) & low).astype(np.int64)
        start = np.arange(len(anchor))
        start = start[start + begin + window <= bound[1:][document[start + begin]]]
        if not len(start):
            continue
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)
        first = np.flatnonzero(new)
        a, b, at = start[first], start[np.append(first[1:], len(start)) - 1], anchor[first]
        content = span_hashes(part, _BASE_WORD, a, b + window)
        found.append((grams[at], mix(content + (at - a).astype(np.uint64)), a + begin, b - a + 1))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2


def _anchors(window: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in blocks(part["text"]):
                anchor, context, at, n = _contexts(b.hashes(), b.bound, window, gram)
                if len(at):
                    doc = np.searchsorted(b.bound, at, "right") - 1
                    row = pa.array(doc + b.first)
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"].take(row), part["text_hash"].take(row), *(pa.array(x) for x in (i64(anchor), i64(context), (at - b.bound[doc]).astype(np.int32), n.astype(np.int32)))],
                        ["doc_id", "text_hash", "anchor", "context", "at", "n"],
                    )

    return run


def _fetch(window: int):
    """The word hashes of the asked contexts of each document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in blocks(part["text"]):
                words = b.hashes()
                out = []
                for k in range(len(b)):
                    own = words[b.bound[k] : b.bound[k + 1]]
                    doc_id = part["doc_id"][b.first + k].as_py()
                    for x in part["asked"][b.first + k].as_py():
                        out.append((x["anchor"], x["context"], doc_id, own[x["at"] : x["at"] + x["n"] + window - 1].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "context", "first_doc", "words"])

    return run


def _shard(window: int):
    """Rows sorted by anchor, first_doc: the windows of each context that earlier documents' contexts hold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = doc = None
        automaton, waiting = SuffixAutomaton(), []
        for part in parts:
            out: list[tuple[int, int, list[int]]] = []
            for key, context, first_doc, held in zip(*(part[c].to_pylist() for c in ("anchor", "context", "first_doc", "words")), strict=True):
                if key != anchor:
                    automaton, waiting, anchor, doc = SuffixAutomaton(), [], key, first_doc
                elif first_doc != doc:
                    for words in waiting:
                        automaton.add(words)
                    waiting, doc = [], first_doc
                words = np.frombuffer(held, np.uint64).tolist()
                if len(automaton.next) > 1:
                    hit = [i - window + 1 for i, size in enumerate(automaton.statistics(words)) if size >= window]
                    if hit:
                        out.append((key, context, hit))
                waiting.append(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["anchor", "context", "hit"])

    return run


def _windows(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                row = part.slice(i, 1)
                grams = gram_hashes(np.frombuffer(row["words"][0].as_py(), np.uint64), window)
                n = pa.array(np.zeros(len(grams), np.int64))
                yield pa.RecordBatch.from_arrays([*(row[c].take(n) for c in ("anchor", "context", "first_doc")), pa.array(np.arange(len(grams), dtype=np.int32)), pa.array(i64(grams))], ["anchor", "context", "first_doc", "i", "content"])

    return run


def _remaining(b: Block, k: int, spans: list[dict] | None) -> tuple[int, int, str]:
    """Words, words removed, and the digest of the others, for document k of a block."""
    lo, hi = b.bound[k], b.bound[k + 1]
    keep = np.ones(hi - lo + 1, np.int32)
    if spans:
        edge = np.zeros(hi - lo + 1, np.int32)
        np.add.at(edge, [s["a"] for s in spans], 1)
        np.add.at(edge, [s["b"] for s in spans], -1)
        keep = (np.cumsum(edge) == 0).astype(np.int32)
    words = bytes(b.data[b.offsets[k] : b.offsets[k + 1]]).split()
    left = [w for w, stays in zip(words, keep, strict=False) if stays] if spans else words
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        spans = part["spans"].to_pylist() if "spans" in part.schema.names else [None] * len(part)
        rows = [_remaining(b, k, spans[b.first + k]) for b in blocks(part["text"]) for k in range(len(b))]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, text_hash, spans: the word spans [a, b) to remove, for documents that have any. ``docs``: doc_id, text_hash, text."""
    found = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _anchors(window, gram), "doc_id bigint, text_hash bigint, anchor bigint, context bigint, at int, n int"
    )
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    found = kept(found.join(shared, "anchor", "left_semi"), "anchors")
    contexts = kept(found.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "text_hash", "at", "n")).alias("x")).select("anchor", "context", "x.*"), "contexts")
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    asked = kept(contexts.join(several, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "context", "at", "n")).alias("asked")), "asked")
    wanted = by_ids(docs, asked.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    words = kept(wanted.dropDuplicates(["doc_id", "text_hash"]).join(asked, ["doc_id", "text_hash"]).select("doc_id", "text", "asked").mapInArrow(_fetch(window), "anchor bigint, context bigint, first_doc bigint, words binary"), "words")
    large = several.where(F.col("held") > shard_contexts).select("anchor")
    small = words.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "first_doc", "context")
    hits = small.mapInArrow(_shard(window), "anchor bigint, context bigint, hit array<int>")
    each = words.join(large, "anchor", "left_semi").mapInArrow(_windows(window), "anchor bigint, context bigint, first_doc bigint, i int, content bigint")
    earliest = each.groupBy("anchor", "content").agg(F.min("first_doc").alias("earliest"))
    more = each.join(earliest, ["anchor", "content"]).where("earliest < first_doc").groupBy("anchor", "context").agg(F.collect_list("i").alias("hit"))
    firsts = contexts.select("anchor", "context", F.col("doc_id").alias("first_doc")).join(hits.unionByName(more), ["anchor", "context"], "left")
    spans = found.join(firsts, ["anchor", "context"]).select(
        "doc_id",
        "text_hash",
        F.when(F.col("doc_id") > F.col("first_doc"), F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n") + (window - 1)).alias("b"))))
        .otherwise(F.transform("hit", lambda i: F.struct((F.col("at") + i).alias("a"), (F.col("at") + i + window).alias("b"))))
        .alias("own"),
    )
    return spans.where("own IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("own")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space): one row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts have no
    words. Rows with one doc_id never remove from each other, also where their texts differ.
    A row with a null doc_id neither loses words nor makes others lose any. An empty table gives
    no rows.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spans = kept(repeated_spans(docs, window, gram, shard_contexts), "spans")
    keys = ["doc_id", "text_hash"]
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    ids = spans.select(*keys)
    touched = by_ids(docs, ids, keys, "left_semi").join(spans, keys).select("doc_id", "text", "spans").mapInArrow(_digest, out)
    return touched.unionByName(by_ids(docs, ids, keys, "left_anti").select("doc_id", "text").mapInArrow(_digest, out))
