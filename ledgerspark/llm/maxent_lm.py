"""LM scoring with a hashed maximum-entropy model of word classes.

P(word | context) = P(class | context) * P(word | class). The class comes from a softmax over
hashed features of the context: the class before, the two classes before, the word before (an
n-gram feature) and the word before that (a skip feature). Inside a class, a word has the
probability (count + 1) / (tokens + words + 1) of its class, so each class keeps one place for
unseen words and all probabilities add up to 1. The commonest words and the end are classes of
their own, other words go by their last two bytes.

The training rows are dealt into shards by a hash, as many as their tokens ask for; a task takes
a shard in the order of the hash and makes AdaGrad steps from the same start, and the shards'
weights are averaged, row by row, by the tokens they have seen. So the model follows from the rows
alone, not from how they were partitioned.
Word counts stay distributed. Words above a fixed share of all tokens, so many at most, are
broadcast; the tokens of all other words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm._tables import kept
from ledgerspark.llm._words import Block, blocks, i64, mix

#: A word is common when it makes up more than 1 / COMMON of the training tokens: there are fewer than COMMON such words.
COMMON = 1 << 16
SINGLE, SUFFIX, ROWS = 23, 40, 1 << 12
CLASSES = SINGLE + SUFFIX + 1
END = np.uint64(0x5851F42D4C957F2D)
BATCH, RATE = 2048, 0.25  # a batch's rows of all classes fit in a core's cache
#: A shard's tokens, and the least and greatest number of shards.
SHARD_TOKENS, SHARDS = 1 << 22, (8, 1 << 12)
#: Tokens counted together before they leave a task.
COUNT_TOKENS = 1 << 20
_FEATURES = CLASSES + 1 + (CLASSES + 1) ** 2 + 2 * ROWS


@dataclass
class Common:
    """Common words: sorted hashes, their counts, and the class of those that are classes of their own (else -1)."""

    word: np.ndarray
    count: np.ndarray
    single: np.ndarray


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each document, their suffix classes, and where documents begin."""
    words, n = b.hashes(lower=True), np.diff(b.bound)
    low = b.data | np.where((b.data >= 65) & (b.data <= 90), 32, 0).astype(np.uint8)
    last = low[b.end - 1].astype(np.uint64)
    before = np.where(b.end - b.start > 1, low[np.maximum(b.end - 2, 0)], 0).astype(np.uint64)
    suffix = (mix(last * np.uint64(256) + before) % np.uint64(SUFFIX)).astype(np.int64) + SINGLE
    bound = b.bound + np.arange(len(b.bound))
    at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
    token, kind = np.full(bound[-1], END), np.full(bound[-1], CLASSES - 1)
    token[at], kind[at] = words, suffix
    return token, kind, bound


def _looked_up(common: Common, token: np.ndarray) -> np.ndarray:
    """Index among the common words, or -1."""
    if not len(common.word):
        return np.full(len(token), -1)
    at = np.minimum(np.searchsorted(common.word, token), len(common.word) - 1)
    return np.where(common.word[at] == token, at, -1)


def _features(token: np.ndarray, kind: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Four rows of the weights for each token; what stands before a document is a class and word of its own."""
    n = len(token)
    first = np.zeros(n, bool)
    first[bound[:-1]] = True
    second = np.zeros(n, bool)
    second[np.minimum(bound[:-1] + 1, n - 1)] = True
    one, two = np.full(n, CLASSES), np.full(n, CLASSES)
    w1, w2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], w1[1:] = kind[:-1], token[:-1]
    two[2:], w2[2:] = kind[:-2], token[:-2]
    one[first] = two[first | second] = CLASSES
    w1[first] = w2[first | second] = 0
    rows = np.uint64(ROWS)
    k = CLASSES + 1
    return np.stack([one, k + one * k + two, k + k * k + (mix(w1) % rows).astype(np.int64), k + k * k + ROWS + (mix(w2 ^ END) % rows).astype(np.int64)])


def _exponents(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exponents of the classes, the largest of each token 0."""
    z = weights[at[0]]
    for row in at[1:]:
        z += weights[row]
    z -= z.max(1, keepdims=True)
    return z


def _picked(weights: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Log probability of each token's class."""
    z = _exponents(weights, at)
    own = z[np.arange(len(kind)), kind]
    return own - np.log(np.exp(z, out=z).sum(1))


def _step(weights: np.ndarray, square: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
    """One AdaGrad step on a batch of tokens."""
    slope = _exponents(weights, at)
    np.exp(slope, out=slope)
    slope /= slope.sum(1, keepdims=True)
    slope[np.arange(len(kind)), kind] -= 1
    pairs = slope.view(np.complex64)  # two columns are summed as one number
    for row in at.astype(np.uint16):  # so short that it is sorted by counting
        order = np.argsort(row, kind="stable")
        own = row[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        own = own[first].astype(np.intp)
        total = np.add.reduceat(pairs.take(order, 0), first).view(np.float32)
        so_far = square.take(own, 0)
        so_far += total * total
        square[own] = so_far
        so_far += 1e-6
        total /= np.sqrt(so_far, out=so_far)
        total *= RATE
        weights[own] -= total


def _classes(common: Common, token: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _looked_up(common, token)
    single = np.where(at >= 0, common.single[at], -1) if len(common.word) else at
    return np.where(single >= 0, single, kind), at


def _counter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, held = [], 0

    def counts() -> pa.RecordBatch:
        word, first, n = np.unique(np.concatenate([t for t, _ in found]), return_index=True, return_counts=True)
        kind = np.concatenate([k for _, k in found])[first]
        return pa.RecordBatch.from_arrays([pa.array(i64(word)), pa.array(kind.astype(np.int32)), pa.array(n)], ["word", "kind", "n"])

    for part in parts:
        for b in blocks(part["text"]):
            token, kind, _ = _tokens(b)
            found.append((token, kind))
            held += len(token)
            if held >= COUNT_TOKENS:
                yield counts()
                found, held = [], 0
    if found:
        yield counts()


def _trainer(held, start):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weights = held.value, start.value.copy()
        square, seen = np.zeros_like(weights), np.zeros(len(weights))
        for part in parts:
            for b in blocks(part["text"]):
                token, kind, bound = _tokens(b)
                kind, _ = _classes(common, token, kind)
                at = _features(token, kind, bound)
                for row in at:
                    seen += np.bincount(row, minlength=len(seen))
                for i in range(0, len(token), BATCH):
                    _step(weights, square, at[:, i : i + BATCH], kind[i : i + BATCH])
        rows = np.flatnonzero(seen)
        if len(rows):
            columns = [pa.array(rows.astype(np.int32)), pa.array(seen[rows])] + [pa.array((weights[rows, c] * seen[rows]).astype(np.float64)) for c in range(CLASSES)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "seen", *(f"w{c}" for c in range(CLASSES))])

    return run


def _scorer(held, model):
    """Each row's tokens, and what the common words and the classes add to the scores."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, (weights, inside) = held.value, model.value
        for part in parts:
            for b in blocks(part["text"]):
                token, kind, bound = _tokens(b)
                kind, known = _classes(common, token, kind)
                at = _features(token, kind, bound)
                picked = np.concatenate([_picked(weights, at[:, i : i + BATCH], kind[i : i + BATCH]) for i in range(0, len(token), BATCH)]).astype(float)
                count = np.where(known >= 0, common.count[known], 0) if len(common.word) else np.zeros(len(token))
                sums = [np.add.reduceat(x, bound[:-1]) for x in (np.log10(count + 1.0), (known >= 0).astype(np.int64), picked / np.log(10) - inside[kind])]
                own = part.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["row_key"], pa.array(np.diff(bound)), *map(pa.array, sums)], ["doc_id", "row_key", "n_tokens", "common_log", "common_n", "class_log"])

    return run


def _rare(held):
    """The tokens of words that are not common, counted for each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for part in parts:
            for b in blocks(part["text"]):
                token, _, bound = _tokens(b)
                doc = np.repeat(np.arange(len(b)), np.diff(bound))
                rare = _looked_up(common, token) < 0
                doc, token = doc[rare], token[rare]
                order = np.lexsort((token, doc))
                doc, token = doc[order], token[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))
                first = np.flatnonzero(new[: len(doc)])
                if len(first):
                    m = np.diff(np.append(first, len(doc)))
                    yield pa.RecordBatch.from_arrays([part["row_key"].take(pa.array(doc[first] + b.first)), pa.array(i64(token[first])), pa.array(m.astype(np.int32))], ["row_key", "word", "m"])

    return run


def training(column: str) -> F.Column:
    """Rows that the model learns from: crc32 of the id as text, modulo 7, is not 2 (null ids: none)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 7 != 2


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts consist of
    the end alone. Words are lower-cased (A-Z) runs without ASCII white space, told apart by
    64-bit hashes. Rows with a null doc_id teach nothing and are not held out. Equal texts get
    equal scores, and another partitioning of the table gives the same scores. Scores are log10
    probabilities: base_score of the add-one unigram model, score of the maximum-entropy model. With no training row, every word is unseen.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    taught = docs.where(training("doc_id")).select("row_key", "text")
    counts = kept(taught.select("text").mapInArrow(_counter, "word bigint, kind int, n bigint").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    top = counts.where(F.col("n") * COMMON > total.tokens).toArrow()  # fewer than COMMON rows
    word, count = top["word"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy()
    order = np.argsort(word)
    single = np.full(len(word), -1)
    best = [i for i in np.lexsort((word, -count)) if word[i] != END][:SINGLE]
    single[best] = np.arange(len(best))
    held = spark.sparkContext.broadcast(Common(word[order], count[order], single[order]))
    own = F.lit(None).cast("int")
    for i in best:
        own = F.when(F.col("word") == int(word[i : i + 1].view(np.int64)[0]), int(single[i])).otherwise(own)
    sizes = counts.groupBy(F.coalesce(own, F.col("kind")).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    inside, share = np.zeros(CLASSES), np.ones(CLASSES)
    for r in sizes:
        inside[r["class"]], share[r["class"]] = np.log10(r.n + r.v + 1), r.n + 1
    start = np.zeros((_FEATURES, CLASSES), np.float32)
    start[: CLASSES + 1] = np.log(share / share.sum())  # each row of the class before
    begin = spark.sparkContext.broadcast(start)
    columns = [f"w{c}" for c in range(CLASSES)]
    shards = max(SHARDS[0], min(SHARDS[1], total.tokens // SHARD_TOKENS))
    by_hash = F.xxhash64(F.lit(9), F.col("row_key"))
    dealt = taught.repartitionById(shards, F.pmod(by_hash, F.lit(shards)).cast("int")).sortWithinPartitions(by_hash, "text").select("text")
    trained = dealt.mapInArrow(_trainer(held, begin), "row int, seen double, " + ", ".join(f"{c} double" for c in columns))
    mean = trained.groupBy("row").agg(*((F.sum(c) / F.sum("seen")).alias(c) for c in columns)).toArrow()  # _FEATURES rows at most
    weights = start.copy()
    if mean.num_rows:
        weights[mean["row"].to_numpy()] = np.stack([mean[c].to_numpy() for c in columns], 1).astype(np.float32)
    model = spark.sparkContext.broadcast((weights, inside))

    rows = docs.mapInArrow(_scorer(held, model), "doc_id bigint, row_key bigint, n_tokens bigint, common_log double, common_n bigint, class_log double")
    rare = docs.mapInArrow(_rare(held), "row_key bigint, word bigint, m int")
    rare = rare.join(counts.select("word", "n"), "word").groupBy("row_key").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("m").alias("rare_n"))
    rows = kept(rows, "scored")
    copies = rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    found = rows.join(copies, "row_key").join(rare, "row_key", "left")
    logs = F.col("common_log") + F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0))
    return found.select(
        "doc_id",
        F.coalesce(~training("doc_id"), F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("common_n") + F.coalesce((F.col("rare_n") / F.col("copies")).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(total.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total.tokens + total.words + 1))).alias("base_score"),
        (logs + F.col("class_log")).alias("score"),
    )
