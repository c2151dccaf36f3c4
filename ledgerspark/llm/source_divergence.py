"""Divergence of the sources of a language: a tree of term rows with shared paths.

Every (lang, source) group gives each kept term of its language a smoothed share p. The distance
of two groups is a sum over all kept terms of ``f(p, q) = floor((p-q)**2 / (p+q))``. Nearly all
counts of a wide vocabulary are zero, so the sum is taken apart, exactly, in whole numbers:

* every term as if neither group had it: ``V * f(p0, q0)``;
* plus, for a group that has the term, ``f(p, q0) - f(p0, q0)``: once per distinct p of a group;
* plus, where both have it, ``f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)``: the pair correction.

The pair corrections come from a frequent-pattern tree. A term's row is the list of its nonzero
groups in source order. Equal rows are counted first (multiplicities); then rows are dealt to
tasks by ranges of their sorted paths, so rows that share a beginning meet in one task and no
path is too hot to be split. A task inserts its rows in order: a node stands for a shared
beginning, carries the number of terms below it and gives one correction per ancestor.

Defined cases: null text, lang and source count as ''; repeated rows and repeated ids count as
documents of their own; groups without terms get value 0 where their language keeps none, and
zero counts otherwise; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm._tables import kept
from ledgerspark.llm._words import BLOCK_BYTES

#: Counters that a task holds before it emits them.
HELD_TERMS = 200_000
#: Cells (rows times the longest path) of the rows that go into one tree at a time.
TREE_CELLS = 1 << 21

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS_ARROW = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("correction", pa.int64())])


def terms(text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Runs of ASCII letters, lower-cased, and of characters beyond ASCII, as UTF-8; a long text in blocks."""
    data, low = text.encode().translate(_LETTERS), 0
    while low < len(data):
        high = data.find(b" ", low + block_bytes)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def _flush(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        found = list(n)
        m = len(found) + 1  # the last row, without a term, says that the group is there
        names = pa.array([t.decode() for t in found] + [None], pa.string())
        numbers = [pa.array([c[t] for t in found] + [0], pa.int64()) for c in (n, docs)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), names, *numbers], schema=_COUNTS_ARROW)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            here: Counter = Counter()
            for block in terms(text.as_py()):
                here.update(block)
            before = len(n)
            for term, k in here.items():
                n[term] += k
                docs[term] += 1
            size += len(n) - before
            if size > HELD_TERMS:
                yield from _flush(held)
                held, size = {}, 0
    yield from _flush(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); a row without a term for every group."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = named.mapInArrow(_count, _COUNTS)
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, size: str) -> F.Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * size)), exact also beyond 64 bits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({total} + 2 * {size} as decimal(20, 0))")


def distance(p: str, q: str) -> F.Column:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PathTree:
    """Sorted rows of items as a tree: ``row`` and ``depth`` of each node's first item, ``weight`` of the rows through it.

    A node's ancestors are the earlier items of its first row, as all rows through it begin alike.
    """

    def __init__(self, item: np.ndarray, length: np.ndarray, weight: np.ndarray) -> None:
        n, width = item.shape
        inside = np.arange(width) < length[:, None]
        same = np.zeros((n, width), bool)
        same[1:] = (item[1:] == item[:-1]) & inside[1:] & inside[:-1]
        opens = inside & ~np.logical_and.accumulate(same, axis=1)
        first = np.maximum.accumulate(np.where(opens, np.arange(n)[:, None], -1), axis=0)
        below = np.zeros((n, width), np.int64)
        at_row, at_depth = np.nonzero(inside)
        np.add.at(below, (first[at_row, at_depth], at_depth), weight[at_row])
        self.row, self.depth = np.nonzero(opens)
        self.weight = below[self.row, self.depth]


def corrections(name: np.ndarray, p: np.ndarray, p0: np.ndarray, group: np.ndarray, length: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (group, ancestor's name, node's name) and their sums over one tree. Matrices hold a row's items from the left."""
    item = np.unique(np.stack([np.broadcast_to(group[:, None], name.shape), name, p]).reshape(3, -1), axis=1, return_inverse=True)[1].reshape(name.shape)
    tree = PathTree(item, length, weight)
    keys, sums = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, name.shape[1]):
        far = tree.depth >= step
        row, low, high, weights = tree.row[far], tree.depth[far], tree.depth[far] - step, tree.weight[far]
        a, a0, b, b0 = p[row, high], p0[row, high], p[row, low], p0[row, low]
        each = (_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0)) * weights
        key, place = np.unique(np.stack([group[row], name[row, high], name[row, low]], axis=1), axis=0, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place.reshape(-1), each)
        keys.append(key)
        sums.append(total)
    return np.concatenate(keys), np.concatenate(sums)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).dictionary_encode()
        path = batch.column(1)
        length_all = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = path.flatten()
        sources = flat.field(0).dictionary_encode()
        code, p_all, p0_all = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sources.indices, flat.field(1), flat.field(2)))
        lang_all, weight_all = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        start_all = np.cumsum(length_all) - length_all
        rows = max(1, TREE_CELLS // max(1, int(length_all.max())))
        for low in range(0, batch.num_rows, rows):
            some = slice(low, low + rows)
            length, start = length_all[some], start_all[some]
            inside = np.arange(max(1, int(length.max()))) < length[:, None]
            at = np.where(inside, start[:, None] + np.arange(inside.shape[1]), 0)
            name, p, p0 = (np.where(inside, x[at], -1) for x in (code, p_all, p0_all))
            key, total = corrections(name, p, p0, lang_all[some], length, weight_all[some])
            if len(key):
                columns = [langs.dictionary.take(pa.array(key[:, 0])), sources.dictionary.take(pa.array(key[:, 1])), sources.dictionary.take(pa.array(key[:, 2])), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, schema=_SUMS_ARROW)


def pair_corrections(shares: DataFrame) -> DataFrame:
    """lang, a, b, correction (a before b) out of shares (lang, term, source, p, p0)."""
    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("path")).where("size(path) > 1")
    many = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("weight"))
    dealt = many.repartitionByRange(F.col("lang"), F.col("path")).sortWithinPartitions("lang", "path")
    found = dealt.mapInArrow(_trees, "lang string, a string, b string, correction bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))


def divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for every (lang, source) group of ``docs``."""
    counted = term_counts(docs)
    rows = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("items"))
    rows = kept(rows.where(F.col("term").isNull() | (F.col("docs") >= min_docs)), "divergence-terms")
    cells = rows.where("term IS NOT NULL").select("lang", "term", "total", F.inline("items"))
    groups = rows.where("term IS NULL").select("lang", F.inline("items")).select("lang", "source")
    sizes = rows.groupBy("lang").agg(F.count("term").alias("size"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("total"))), F.lit(0)).alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").select("lang", "source", F.coalesce("n", F.lit(0)).alias("group_total"), "lang_total", "size")
    groups = kept(groups.withColumn("p0", F.when(F.col("size") > 0, share("0", "group_total", "size"))), "divergence-groups")

    shares = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "group_total", "size"))
    both = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = both.join(other, "lang").where("item <> source").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (distance("p", "q0") - distance("p0", "q0"))).alias("alone"))
    shared = pair_corrections(shares)

    def ends(found: DataFrame, a: str, b: str, value: str) -> DataFrame:
        return found.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), F.col(value).alias("more"))

    more = ends(alone, "source", "item", "alone").unionByName(ends(alone, "item", "source", "alone")).unionByName(ends(shared, "a", "b", "correction")).unionByName(ends(shared, "b", "a", "correction"))
    more = more.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    base = groups.select("lang", "source", "p0", "size").join(other, "lang").where("item <> source")
    pair = base.join(more, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("size") > 0, F.col("size") * distance("p0", "q0") + F.coalesce("more", F.lit(0))).otherwise(0).alias("value"))
    term = shares.withColumn("q", share("total", "lang_total", "size")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top_terms))
