"""N-gram Jaccard join: exact links between documents whose sets of word n-grams are alike.

Universe partition and pigeonhole. Sets of about one size form a band. Within a band the
n-gram hashes are dealt into segments, the same ones for all its sets. A segment is granted
nothing (its content's hash is the key) or one element (the hashes with one element left out
are keys too); ``plan_band`` grants by cost. A set keys its segments in their order until the
grants of those that hold anything exceed H, the most elements in which it may differ from a
partner of that band. Of two sets take the one that stops first: its partner differs from it in
at most H elements, so in one of its keyed segments by no more than was granted there, and that
segment is keyed by both. A set that runs out of segments keys its empty ones as well, so two
such sets meet too. Small H means few keys: a set of n elements has about n * (1 - t) of them.
Further grants, as many for all sets of a band, let every set leave out its costliest keys, those
of the largest buckets. All sets rank keys alike, so of the keys that two sets have in common the
left-out ones are the first few, and one at least stays.

A bucket of one key is never expanded into all its pairs at first: its members are compared
with one hub, the member that shares most with others, and linked members form components.
In buckets that still hold several components, sets are ruled out that have too many n-grams
that no other set of such buckets has (they count against any partner, which ends the matter for
most variants of one much-copied text). Of the others, all pairs between different components are
taken, each once, but for those whose sizes, own n-grams or sketches forbid it. So no link
between components is lost.

Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm._components import components
from ledgerspark.llm._tables import by_ids, kept
from ledgerspark.llm._words import Block, blocks, gram_hashes, i64, mix

#: Keys that a set may leave out, as a share of the differences that it may have.
LEFT_OUT = 0.1
#: Cost of a segment of one element at most, in keys: its key meets others by chance.
THIN = 0.5
_BAND_BITS = 10
SKETCH = [f"sketch{i}" for i in range(8)]
_SEGMENT, _BAND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Band:
    """Set sizes low..high-1, dealt into ``segments``, of which the first ``near`` are granted one element; keys to leave out."""

    number: int
    low: int
    high: int
    segments: int
    near: int
    left_out: int


def differences(r: int, percent: int) -> int:
    """Elements in which a set of r elements and a larger one that reaches the threshold differ at most."""
    return (r + r * 100 // percent) * (100 - percent) // (100 + percent)


def plan_band(number: int, low: int, high: int, percent: int) -> Band:
    """Grants for a band at the least cost: keys to shuffle, and chance matches of thin segments."""
    left_out = math.ceil(LEFT_OUT * (differences(low, percent) + 1))
    need = differences(high - 1, percent) + left_out + 1
    best: tuple[float, Band] | None = None
    for m in range((need + 1) // 2, need + 12 + need // 2, 1 + need // 400):
        empty = m * (1 - 1 / m) ** low if m > 1 else 0.0
        near = max(0, need + math.ceil(empty + 2 * math.sqrt(empty)) - m)
        if near > m:
            continue
        fill = (low + high) / 2 / m
        thin = m * (1 + low / m) * math.exp(-low / m)
        cost = m + near * fill + THIN * thin
        if best is None or cost < best[0]:
            best = cost, Band(number, low, high, m, near, left_out)
    return best[1] if best else Band(number, low, high, need, 0, left_out)


@lru_cache(8)
def _edges(percent: int) -> tuple[int, ...]:
    low, found = 1, []
    while low < 1 << 31:
        found.append(low)
        low = max(low + 1, math.ceil(low * (100 / percent) ** 2))
    if len(found) > 1 << _BAND_BITS:
        raise ValueError(f"too many bands at {percent} percent")
    return tuple(found)


@lru_cache(4096)
def band(number: int, percent: int) -> Band:
    edges = _edges(percent)
    return plan_band(number, edges[number], edges[number + 1], percent)


def gram_sets(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document of a block, one after another, and where each document's begin."""
    words = b.hashes(lower=True)
    grams = gram_hashes(words, n)
    own, size = [], np.zeros(len(b) + 1, np.int64)
    for k in range(len(b)):
        lo, hi = b.bound[k], b.bound[k + 1]
        if hi - lo >= n:
            x = np.sort(grams[lo : hi - n + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        else:
            x = gram_hashes(words[lo:hi], int(hi - lo))[:1] if hi > lo else words[:0]
        own.append(x)
        size[k + 1] = len(x)
    return np.concatenate(own) if own else np.zeros(0, np.uint64), np.cumsum(size)


def _sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each key, modulo 2**64 (both halves stay exact in doubles)."""
    low = np.bincount(key, (values & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
    high = np.bincount(key, (values >> np.uint64(32)).astype(float), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def _classes(grams: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A hash of each document's whole set."""
    size = np.diff(bound)
    owner = np.repeat(np.arange(len(size)), size)
    return mix(_sums(owner, mix(grams), len(size)) + size.astype(np.uint64) * _BAND)


def _keys(grams: np.ndarray, bound: np.ndarray, which: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) for the documents ``which``."""
    edges = np.array(_edges(percent))
    docs, bands, most = [], [], []
    for k in which:
        n = int(bound[k + 1] - bound[k])
        last = int(np.searchsorted(edges, n, "right")) - 1
        first = int(np.searchsorted(edges, -(-n * percent // 100), "right")) - 1
        for x in range(first, last + 1):
            docs.append(k)
            bands.append(band(x, percent))
            smaller = int(edges[x + 1]) - 1  # in an earlier band, partners are smaller sets
            most.append(differences(n, percent) if x == last else (n + smaller) * (100 - percent) // (100 + percent))
    if not docs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.array(docs)
    number, m, near, out = (np.array([getattr(x, f) for x in bands]) for f in ("number", "segments", "near", "left_out"))
    size = bound[doc + 1] - bound[doc]
    job = np.repeat(np.arange(len(doc)), size)
    at = np.arange(len(job)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bound[doc], size)
    base = np.cumsum(m) - m
    value = mix(grams[at])
    segment = (mix(grams[at] ^ _SEGMENT) % m[job].astype(np.uint64)).astype(np.int64)
    cell = base[job] + segment
    total = int(m.sum())
    content, count = _sums(cell, value, total), np.bincount(cell, minlength=total)
    owner = np.repeat(np.arange(len(doc)), m)
    place = np.arange(total) - base[owner]
    salt = mix((number[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + _SEGMENT)
    one_off = place < near[owner]
    # what a segment covers: an empty one nothing, as others have that key too; one of a single element keys no empty rest
    covers = np.minimum(count, 1 + one_off)
    so_far = np.cumsum(covers) - covers
    so_far -= so_far[base][owner]
    need = np.array(most) + out
    thin = np.bincount(owner, covers, len(doc)) <= need
    keyed = (so_far <= need[owner]) | thin[owner]
    exact = keyed & ((count > 0) | thin[owner])
    drop = (keyed & one_off)[cell] & ((count[cell] > 1) | thin[job])
    key = np.concatenate([mix(content[exact] ^ salt[exact]), mix((content[cell[drop]] - value[drop]) ^ salt[cell[drop]])])
    bits = np.uint64((1 << _BAND_BITS) - 1)
    of = np.concatenate([owner[exact], job[drop]])
    return (key & ~bits) | (number[of].astype(np.uint64) & bits), doc[of]


def _sketches(grams: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Eight words of bits of each document: a bit tells whether an odd number of its grams fall on it.

    Every element that only one of two sets has turns one bit, so as many bits as their sketches
    differ in, at least as many elements do the sets.
    """
    size, spread = np.diff(bound), mix(grams ^ _BAND)
    cell = np.repeat(np.arange(len(size)), size) * 512 + (spread % np.uint64(512)).astype(np.int64)
    odd = (np.bincount(cell, minlength=512 * len(size)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 512), axis=1).view(np.uint64)


def _may_reach(n: F.Column, m: F.Column, other: str, percent: int) -> F.Column:
    """Whether two sets of n and m elements may reach the threshold, by their sketches (the second one's with ``other`` behind the names)."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(x + other))) for x in SKETCH), F.lit(0))
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _rows(n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in blocks(part["text"]):
                grams, bound = gram_sets(b, n)
                own = part.slice(b.first, len(b))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["text_hash"], pa.array(np.diff(bound)), pa.array(i64(_classes(grams, bound)))], ["doc_id", "text_hash", "n_shingles", "class"])

    return run


def _signatures(n: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen: set[int] = set()  # of this batch alone: copies in it need their keys once
            for b in blocks(part["text"]):
                grams, bound = gram_sets(b, n)
                classes = _classes(grams, bound)
                which = [k for k, (c, size) in enumerate(zip(classes.tolist(), np.diff(bound), strict=True)) if size and not (c in seen or seen.add(c))]
                key, doc = _keys(grams, bound, np.array(which, int), percent)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(i64(key)), pa.array(i64(classes[doc]))], ["key", "class"])

    return run


def _sets(n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in blocks(part["text"]):
                grams, bound = gram_sets(b, n)
                sketch = [pa.array(x) for x in i64(_sketches(grams, bound)).T]
                yield pa.RecordBatch.from_arrays([pa.array(i64(_classes(grams, bound))), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(i64(grams))), *sketch], ["class", "grams", *SKETCH])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that may reach the threshold, with the sizes of intersection and union."""
    sketch = sets.select("class", F.size("grams").alias("size"), *SKETCH)
    second = sketch.select(F.col("class").alias("b"), F.col("size").alias("size_b"), *(F.col(x).alias(x + "_b") for x in SKETCH))
    some = pairs.join(sketch.withColumnRenamed("class", "a"), "a").join(second, "b").where(_may_reach(F.col("size"), F.col("size_b"), "_b", percent)).select("a", "b")
    both = some.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b")
    met = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", met.alias("met"), (F.size("ga") + F.size("gb") - met).alias("whole"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(F.col("met") * 100 >= F.col("whole") * percent).select("a", "b")


def _unsettled(buckets: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, with the components as they now are."""
    held = buckets.drop("component").join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return kept(held.join(mixed, "key", "left_semi"), "buckets")


def _hubs(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("key").agg(F.max(F.struct("weight", "class", "component")).alias("hub"))


def _to_hub(buckets: DataFrame, hubs: DataFrame) -> DataFrame:
    met = buckets.join(hubs, "key").where("class <> hub.class AND component <> hub.component")
    return met.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()


def _bucketed(keys: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, band, class, n, weight, component for the keys that several of the classes (class, n, component) share, less those left out.

    Keys are shuffled once; all but the shared ones go in the same stage.
    """
    same = Window.partitionBy("key")
    marked = keys.select("key", "class", F.min("class").over(same).alias("x"), F.max("class").over(same).alias("y"), F.count(F.lit(1)).over(same).alias("size"))
    shared = marked.where("x <> y").groupBy("key", "class").agg(F.max("size").alias("size"))
    held = shared.withColumn("band", F.col("key").bitwiseAND((1 << _BAND_BITS) - 1).cast("int")).join(classes, "class")
    rank = F.row_number().over(Window.partitionBy("class", "band").orderBy(F.desc("size"), "key"))
    held = held.withColumn("rank", rank).where(F.col("rank") > _left_out(percent))
    weight = F.sum("size").over(Window.partitionBy("class"))
    return kept(held.select("key", "band", "class", "n", weight.alias("weight"), "component"), "buckets")


def _left_out(percent: int) -> F.Column:
    """Keys that the set of a row leaves out in the row's band."""
    return F.array(*(F.lit(band(i, percent).left_out) for i in range(len(_edges(percent)) - 1)))[F.col("band")]


def _shared_grams(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """class, common: how many of a class's n-grams some other of these classes has."""
    grams = sets.join(classes.select("class").distinct(), "class", "left_semi").select("class", F.explode("grams").alias("gram"))
    alone = grams.groupBy("gram").agg(F.max("class").alias("class"), F.count(F.lit(1)).alias("n")).where("n = 1")
    own = alone.groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    return classes.select("class", "n").distinct().join(own, "class", "left").select("class", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))


def _pairs_left(buckets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of different components that may reach the threshold, each from the least key that both have."""
    lists = buckets.groupBy("class", "band").agg(F.collect_set("key").alias("keys"))  # no more than a set has in all
    rows = buckets.join(lists, ["class", "band"])
    other = rows.select(F.col("key").alias("same"), F.col("class").alias("b"), F.col("component").alias("to"), F.col("n").alias("m"), F.col("common").alias("out"), F.col("keys").alias("others"), *(F.col(x).alias(x + "_b") for x in SKETCH))
    met = F.array_intersect("keys", "others")
    chance = (F.col("class") < F.col("b")) & (F.col("component") != F.col("to")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    chance &= F.least("common", "out") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    chance &= _may_reach(F.col("n"), F.col("m"), "_b", percent)
    chance &= F.col("key") == F.array_min(met)
    return rows.join(other, (F.col("key") == F.col("same")) & chance).select(F.col("class").alias("a"), "b").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes of equal sets that give the same components as all links: the stars of the links to hubs, and the links found after them."""
    sized = classes.select("class", F.col("n_shingles").alias("n"), F.col("class").alias("component"))
    buckets = _bucketed(docs.mapInArrow(_signatures(shingle, percent), "key bigint, class bigint"), sized, percent)
    rep = kept(buckets.select("class").distinct().join(classes, "class").select("text_hash").distinct(), "rep")
    some = by_ids(docs, rep, ["text_hash"], "left_semi").dropDuplicates(["text_hash"])
    sets = kept(some.mapInArrow(_sets(shingle), "class bigint, grams array<bigint>, " + ", ".join(f"{x} bigint" for x in SKETCH)).dropDuplicates(["class"]), "sets")
    tried = kept(_compared(_to_hub(buckets, _hubs(buckets)), sets, percent), "compared")
    known = components(_linked(tried, percent))
    left = _unsettled(buckets, known)
    for _ in range(2):  # without the sets ruled out first, more n-grams are some set's own
        common = kept(_shared_grams(left, sets), "common")
        left = left.drop("common").join(common, "class").where(F.col("common") * 100 >= F.col("n") * percent)
    left = left.join(sets.select("class", *SKETCH), "class")
    rest = kept(_pairs_left(left, percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    stars = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stars.unionByName(_linked(kept(_compared(rest, sets, percent), "compared"), percent))


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links): one row for each row of ``docs``.

    ``docs`` needs doc_id and text. A document's set holds its distinct ``shingle``-word
    sequences, A-Z lower-cased, and for fewer words the whole sequence. Two documents link when
    100 * intersection >= ``percent`` * union. Null and empty texts, and texts of white space,
    have empty sets and link with nothing. Rows that repeat a doc_id are vertices of their own.
    Null doc_ids never become a component_id while a linked row has an id.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = kept(docs.mapInArrow(_rows(shingle), "doc_id bigint, text_hash bigint, n_shingles bigint, class bigint"), "rows")
    classes = kept(rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("n_shingles").alias("n_shingles")), "classes")
    links = link_classes(docs, classes, shingle, percent)
    known = components(links)
    grouped = classes.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "component").select("class", "component_id")
    return rows.join(ids, (rows["class"] == ids["class"]) & (F.col("n_shingles") > 0), "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
