"""Packing: documents are cut and laid out in sequences of fixed length beside lexically near ones.

Every document becomes token ids and one end id. Document frequencies are counted over the
whole corpus and, as terms are vocabulary ids, are a table of fixed size. Documents are dealt to
shards by content: each goes to the nearest of as many centres as there are shards (fitted on a
bounded sample of documents, by BM25 weights projected to a few dimensions), and a crowded centre
has several shards. Inside a shard an inverted index over all terms of all its documents ranks, by
BM25, the unused neighbours of a seed. They fill its sequence greedily;
the last one is cut to fit and what is left of it seeds the next sequence. The rest of a shard
falls into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm._tables import give_back, kept
from ledgerspark.llm._words import _BASE_BYTE, _BYTE_VALUE, Block, _views, blocks, span_hashes

#: Ids of a sequence; ids of a shard, about; places of a task's cache of units, and ids that it holds; see ``_Index``.
LENGTH, SHARD_IDS, CACHE, CACHE_IDS, DENSE = 2048, 1_500_000, 1 << 20, 1 << 23, 16
#: Neighbours of a seed that are sorted first.
FIRST = 16
#: Documents that centres are fitted on, about; centres at most; dimensions.
SAMPLE, CENTRES, DIMENSIONS = 4096, 4096, 64
END = 1
_WHOLE, _LETTER, _DIGIT, _OTHER, _SPACE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x20, *range(9, 14)]] = _SPACE
_KIND[[39, *range(128, 256)]] = _WHOLE  # apostrophes may be of contractions
_KINDS, _LOWERS = _KIND.tobytes(), bytes(range(256)).lower()
#: The characters that stand for bytes in the vocabulary: printable ones of Latin-1 for themselves, the others from 256 on; the space stays.
_CHARACTER = np.arange(256, dtype="<u4")
_odd = [*range(33), *range(127, 161), 173]
_CHARACTER[_odd] = 256 + np.arange(len(_odd))
_CHARACTER[0x20] = 0x20


def _units(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of a block's words, the lower-cased bytes, whether a unit is a plain run of letters, and the number of units before each document.

    The tokenizer splits words into runs of letters, single digits and runs of anything else, and
    lower-cases each letter by itself. Words in ASCII and Latin-1 letters are split so; words with
    other characters, contractions or the marks of special tokens stay whole.
    """
    n, data, raw = len(b.data), b.data, bytearray(b.data)
    kind, lower = np.frombuffer(raw.translate(_KINDS), np.uint8), np.frombuffer(raw.translate(_LOWERS), np.uint8)
    # two-byte letters of Latin-1: C3 80..BF but the signs 97 and B7; 80..9E are upper case
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    latin = (follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)
    lead, follow = lead[latin], follow[latin]
    kind[lead] = kind[lead + 1] = _LETTER
    lower[lead[follow <= 0x9E] + 1] += 32
    # whole words: other alphabets, contractions, special tokens
    odd = kind == _WHOLE
    if b"<|" in raw:
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    runs = odd.copy()  # where runs of odd bytes begin, in each word anew
    runs[1:] &= ~odd[:-1]
    runs[b.start] = odd[b.start]
    whole = np.zeros(len(b.start), bool)
    whole[np.searchsorted(b.start, np.flatnonzero(runs), "right") - 1] = True
    begins, begins_word = np.empty(n, bool), np.zeros(n, bool)
    begins[:1] = False
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _DIGIT
    begins &= kind != _SPACE
    size = b.end[whole] - b.start[whole]
    begins[np.repeat(b.start[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())] = False
    begins[b.start] = begins_word[b.start] = True
    start = np.flatnonzero(begins)
    word = np.flatnonzero(begins_word[start])  # first units of words
    end = np.append(start[1:], n)[: len(start)]
    end[np.append(word[1:], len(start))[: len(word)] - 1] = b.end
    plain = kind[start] == _LETTER
    plain[word[whole]] = False
    return start, end, lower, plain, np.append(word, len(start))[b.bound]


class _Encoder:
    """Ids of whole texts from ids of the units of their words, each encoded once while the cache holds it.

    Words are split at ASCII white space, which the tokenizer drops and nothing of which takes
    part in any token, so the ids of a text are those of its units in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would each hold memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case runs of letters with single spaces between them, in the vocabulary's characters: nothing to normalise, and the spaces alone split them
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(1 << 16, bool)  # tokens that end a run of letters
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        """The cache: a unit's hash, and where its ids are, stand in the place that the hash's last bits name; a later unit takes an earlier one's place. The first id is the end id."""
        self.hash = np.arange(1, CACHE + 1, dtype=np.uint64)  # of no unit of that place
        self.at, self.size, self.ids, self.used = np.zeros(CACHE, np.int32), np.zeros(CACHE, np.int32), np.full(1 << 16, END, np.uint16), 1

    def _encoded(self, units: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the units, their ids in it, and how many each has; plain runs of letters go through the tokenizer's merges many at once, told apart by their last tokens."""
        order, ids, size = [], [], []
        letters, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        for i in range(0, len(letters), 512):
            some = letters[i : i + 512]
            text = _CHARACTER[np.frombuffer(" ".join([units[k] for k in some]).encode(), np.uint8)].tobytes().decode("utf-32-le")
            own = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.last[own]) + 1
            if len(ends) == len(some):
                order += some
                ids.append(own)
                size.append(np.diff(ends, prepend=0))
            else:
                rest += some
        for i in range(0, len(rest), 512):
            some = rest[i : i + 512]
            own = [x.ids for x in self.tokenizer.encode_batch_fast([units[k] for k in some], add_special_tokens=False)]
            order += some
            ids.append(np.array([t for x in own for t in x], np.uint16))
            size.append(np.array([len(x) for x in own], np.int64))
        return np.array(order), np.concatenate(ids), np.concatenate(size)

    def __call__(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's documents, one after another and each with the end id, and where they begin."""
        start, end, lower, plain, before = _units(b)
        key = span_hashes(_BYTE_VALUE[lower], _BASE_BYTE, start, end)
        if self.used > CACHE_IDS:
            self._reset()
        place = key & np.uint64(CACHE - 1)
        at, size, new = self.at[place], self.size[place], np.flatnonzero(self.hash[place] != key)
        if len(new):
            distinct, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            letters = plain[first]
            raw = np.empty(len(first), object)
            raw[letters] = _spaced(lower, start[first[letters]], end[first[letters]])
            # a whole word goes as it stands, as its letters may need the tokenizer's own lower-casing
            rest = first[~letters]
            raw[~letters] = [b.data[s:e].tobytes().decode() for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            order, ids, n = self._encoded(raw.tolist(), letters)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint16)])
            self.ids[self.used : self.used + len(ids)] = ids
            own_at, own_size = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            own_at[order], own_size[order] = self.used + np.cumsum(n) - n, n
            self.used += len(ids)
            at[new], size[new] = own_at[which], own_size[which]
            self.hash[place[first]], self.at[place[first]], self.size[place[first]] = distinct, own_at, own_size
        at, size = np.insert(at, before[1:], 0), np.insert(size, before[1:], 1)  # an end id after each document
        done = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=done[1:])
        return self.ids[np.repeat(at - done[:-1], size) + np.arange(done[-1])], done[before + np.arange(len(before))]


def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The texts data[start:end], none of which holds a space."""
    if not len(start):
        return []
    size = end - start + 1
    bound = np.cumsum(size)
    text = data[np.minimum(np.repeat(start - bound + size, size) + np.arange(bound[-1]), len(data) - 1)]
    text[bound - 1] = 0x20
    return text[:-1].tobytes().decode().split(" ")


def _bags(ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each document ids[bound[k]:bound[k+1]], ascending, how often each stands there, and where the documents' terms begin."""
    terms, counts, sizes = [ids[:0]], [bound[:0]], [np.zeros(1, np.int64)]
    first, docs = 0, len(bound) - 1
    while first < docs:  # as many documents at once as the sort holds near, or one
        last = max(first + 1, min(first + (1 << 16), int(np.searchsorted(bound, bound[first] + (1 << 17), "right")) - 1))
        key = ids[bound[first] : bound[last]].astype(np.uint32)
        key |= np.repeat(np.arange(last - first, dtype=np.uint32) << np.uint32(16), np.diff(bound[first : last + 1]))
        key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        terms.append(key[at].astype(np.uint16))  # the last 16 bits
        counts.append(np.diff(at, append=len(key)))
        sizes.append(np.bincount(key[at] >> np.uint32(16), minlength=last - first))
        first = last
    return np.concatenate(terms), np.concatenate(counts), np.cumsum(np.concatenate(sizes))


_encoders: dict[str, _Encoder] = {}


def _tokenised(path: str):
    """Rows of the documents, and one of each task with its terms and how many of its documents hold them."""
    made = lambda n, **columns: pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in _TYPES.items()], list(_TYPES))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        count = np.zeros(1 << 16, np.int64)
        for part in parts:
            for b in blocks(part["text"]):
                ids, bound = _encoders[path](b)
                count += np.bincount(_bags(ids, bound)[0], minlength=1 << 16)
                column = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(2 * bound), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
                yield made(len(b), doc_id=part["doc_id"].slice(b.first, len(b)), doc_tokens=pa.array(np.diff(bound)), ids=column)
            give_back()
        terms = np.flatnonzero(count)
        yield made(1, terms=pa.array([terms.astype(np.int32)]), documents=pa.array([count[terms]]))

    return run


TOKENISED = "doc_id bigint, doc_tokens bigint, ids binary, terms array<int>, documents array<bigint>"
_TYPES = {"doc_id": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "terms": pa.list_(pa.int32()), "documents": pa.list_(pa.int64())}


def tokenised(docs: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, doc_tokens, ids of the documents; term, n: how many documents hold a term, in rows of each task, written in the same pass."""
    rows = kept(docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer_path), TOKENISED), "ids")
    held = rows.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "documents")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.documents").alias("n"))
    return rows.where("doc_tokens IS NOT NULL").select("doc_id", "doc_tokens", "ids"), held


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def _weights(ids: np.ndarray, bound: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' terms and their BM25 weights, and where those of each document begin."""
    own, n, begin = _bags(ids, bound)
    length = np.repeat(0.25 + 0.75 * np.diff(bound) / mean, np.diff(begin))
    return own, idf[own] * n * 2.2 / (n + 1.2 * length), begin


_projections: dict[int, np.ndarray] = {}


def _vectors(column: pa.Array, idf: np.ndarray, mean: float) -> np.ndarray:
    """The documents' BM25 weights, projected by fixed random signs and of length 1."""
    if DIMENSIONS not in _projections:
        _projections[DIMENSIONS] = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (1 << 16, DIMENSIONS))
    made, (data, at) = np.zeros((len(column), DIMENSIONS), np.float32), _views(column)
    for k in range(0, len(column), 128):
        bound = at[k : k + 129]
        own, weight, begin = _weights(data[bound[0] : bound[-1]].view("<u2"), (bound - bound[0]) // 2, idf, mean)
        weight = weight.astype(np.float32)
        for i, (first, last) in enumerate(pairwise(begin.tolist()), k):
            made[i] = weight[first:last] @ _projections[DIMENSIONS][own[first:last]]
    return made / (np.linalg.norm(made, axis=1, keepdims=True) + 1e-9)


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of unit vectors by spherical k-means."""
    if not len(x):
        return np.zeros((1, DIMENSIONS), np.float32)
    rng = np.random.default_rng(7)
    centre = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(10):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(total.any(1, keepdims=True), total, centre)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    return centre


def _projected(idf: np.ndarray, mean: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part["doc_tokens"], pa.array([x.tobytes() for x in _vectors(part["ids"], idf, mean)], pa.binary())], ["n", "vector"])

    return run


def _dealt(idf: np.ndarray, mean: float, centres: np.ndarray):
    """The documents with the nearest centre."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = np.zeros(0, np.int64)
            for i in range(0, len(part), 1024):
                near = np.append(near, (_vectors(part["ids"].slice(i, 1024), idf, mean) @ centres.T).argmax(1))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(near.astype(np.int32))], ["doc_id", "ids", "near"])

    return run


class _Index:
    """BM25 over all terms of a shard's documents; used documents drop out, and leave the postings when half of them are used.

    Terms that at least every DENSE-th document holds have a row of all documents' weights, other
    terms have a list: so rows take no more than DENSE places for each posting.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.unused, self.alive = np.ones(len(docs), bool), np.arange(len(docs))
        term, weight, begin = _weights(np.concatenate(docs), np.cumsum([0, *map(len, docs)]), idf, mean)
        self.terms = np.split(term, begin[1:-1])
        order = np.argsort(term, kind="stable")
        self._set(term[order], np.repeat(np.arange(len(docs)), np.diff(begin))[order], weight.astype(np.float32)[order])

    def _set(self, term: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        self.posting = term, owner, weight
        count = np.bincount(term, minlength=1 << 16)
        often = count * DENSE >= max(len(self.alive), 1)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), len(self.alive)), np.float32)
        dense = often[term]
        self.rows[self.row[term[dense]], owner[dense]] = weight[dense]
        self.owner, self.weight = owner[~dense], weight[~dense]
        self.at = np.searchsorted(term[~dense], np.arange((1 << 16) + 1))

    def ranked(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; few are asked for, so those after the first ones are sorted only then."""
        held = self.unused[self.alive]
        if 2 * np.count_nonzero(held) < len(held):
            term, owner, weight = self.posting
            keep, place = held[owner], np.cumsum(held) - 1
            self.alive = self.alive[held]
            self._set(term[keep], place[owner[keep]], weight[keep])
            held = np.ones(len(self.alive), bool)
        own = self.terms[seed]
        row = self.row[own]
        score = self.rows[row[row >= 0]].sum(0)
        own = own[row < 0]
        first, size = self.at[own], self.at[own + 1] - self.at[own]
        part = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        score += np.bincount(self.owner[part], self.weight[part], len(score)).astype(np.float32)
        found = np.flatnonzero((score > 0) & held)
        alive, score = self.alive[found], -score[found]
        least = np.partition(score, FIRST)[FIRST] if len(score) > FIRST else np.inf
        for part in (score <= least, score > least):
            yield from alive[part][np.argsort(score[part], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill sequences of ``length``, but for the last few, whose lengths are powers of two."""
    index, pieces = _Index(docs, idf, mean), []
    sequence = used = 0
    queue = np.argsort([-len(d) for d in docs], kind="stable").tolist()[::-1]
    current: list[tuple[int, int]] = []  # documents and how far they are laid out, the seed first

    def lay(doc: int, start: int) -> int:
        """Fills the sequence from a document; where that stops."""
        nonlocal sequence, used
        n = min(length - used, len(docs[doc]) - start)
        pieces.append((doc, start, n, sequence, used))
        used += n
        if used == length:
            sequence, used = sequence + 1, 0
        return start + n

    while True:
        if current:
            doc, start = current.pop()
        else:
            while queue and not index.unused[queue[-1]]:
                queue.pop()
            if not queue:
                break
            doc, start = queue.pop(), 0
            index.unused[doc] = False
        while start < len(docs[doc]):
            start = lay(doc, start)
        if not used:
            continue
        for near in index.ranked(doc):
            index.unused[near] = False
            start = lay(near, 0)
            if not used:
                if start < len(docs[near]):
                    current.append((near, start))
                break
    if used:  # the unfilled rest: powers of two
        rest, pieces = [p for p in pieces if p[3] == sequence], [p for p in pieces if p[3] != sequence]
        sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        room, offset = sizes[0], 0
        for doc, start, n, _, _ in rest:
            while n:
                take = min(n, room - offset)
                pieces.append((doc, start, take, sequence, offset))
                start, n, offset = start + take, n - take, offset + take
                if offset == room:
                    sizes.pop(0)
                    sequence, offset, room = sequence + 1, 0, sizes[0] if sizes else 0
    return pieces


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packer(idf: np.ndarray, mean: float, length: int):
    """A task's rows are one shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, docs = TaskContext.get().partitionId(), [], []
        for part in parts:
            keys += part["doc_id"].to_pylist()
            docs += _ids(part["ids"])
        if docs:
            rows = []
            for doc, start, n, sequence, offset in pack_shard(docs, idf, mean, length):
                data = docs[doc][start : start + n].astype("<u4")
                rows.append((keys[doc], start, n, zlib.crc32(data), len(docs[doc]), (shard << 32) + sequence, offset))
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def sharded(made: DataFrame, held: DataFrame, shard_ids: int) -> tuple[DataFrame, np.ndarray, float]:
    """The documents (doc_id, ids) of tokenised ``made``, whose terms ``held`` counts, a partition for each shard; the idf of all terms; the mean length."""
    total = made.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("ids"), F.count(F.lit(1)).alias("docs")).first()
    frequency = held.groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each vocabulary id at most
    n = np.zeros(1 << 16)
    for r in frequency:
        n[r.term] = r.n
    idf, mean = np.log1p((total.docs - n + 0.5) / (n + 0.5)), max(1.0, total.ids / max(1, total.docs))
    shards = max(1, -(-int(total.ids) // shard_ids))
    some = made.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(max(1, total.docs // SAMPLE))) == 0).limit(2 * SAMPLE)
    rows = sorted(some.mapInArrow(_projected(idf, mean), "n bigint, vector binary").collect())
    vectors = np.frombuffer(b"".join(r.vector for r in rows), np.float32).reshape(-1, DIMENSIONS)
    centres = _centres(vectors, min(shards, CENTRES))
    share = np.bincount((vectors @ centres.T).argmax(1), [r.n for r in rows], len(centres)) / max(1, sum(r.n for r in rows))
    parts = np.maximum(1, np.ceil(share * total.ids / shard_ids)).astype(int)
    near = made.select("doc_id", "ids").mapInArrow(_dealt(idf, mean, centres), "doc_id bigint, ids binary, near int")
    place = lambda x: F.array(*map(F.lit, x.tolist()))[F.col("near")]
    shard = place(np.cumsum(parts) - parts) + F.pmod(F.xxhash64("ids", "doc_id"), place(parts))
    near = near.repartitionById(int(parts.sum()), shard.cast("int"))
    return near.sortWithinPartitions(F.xxhash64("ids"), "doc_id").select("doc_id", "ids"), idf, mean


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, shard_ids: int = SHARD_IDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts are the end
    id alone. Repeated rows are packed each by itself. Each id lies in exactly one piece, and
    sequences are ``length`` long or a power of two. The tokenizer's ids must be below 65,536.
    An empty table gives no rows.
    """
    made, held = tokenised(docs, tokenizer_path)
    dealt, idf, mean = sharded(made, held, shard_ids)
    return dealt.mapInArrow(_packer(idf, mean, length), PIECE)
