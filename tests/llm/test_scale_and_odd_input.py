"""Long chains, far outliers, hot ids, other partitionings, clashing names and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import chat_tools, document_fingerprints, maxent_lm, quality_compression, warc_writer
from ledgerspark.llm._tables import shared_folder

CALLS = "call_id string, conversation bigint, seq bigint, name string, arguments string, needs array<string>"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def levels(spark, needs):
    calls = spark.createDataFrame([(c,) for c in needs], "call_id string")
    pairs = spark.createDataFrame([(c, n) for c, ns in needs.items() for n in set(ns)], "call_id string, need string")
    return {r.call_id: r.level for r in chat_tools.levels(calls, pairs).collect()}


def slow_levels(needs):
    level, found = {}, True
    while found:
        found = {c: max((level[n] + 1 for n in ns), default=0) for c, ns in needs.items() if c not in level and all(n in level for n in ns)}
        level.update(found)
    return level


def test_levels_of_a_chain_of_a_thousand_calls(spark):
    needs = {f"c{i}": [f"c{j}" for j in (i - 1, i - 2) if j >= 0] for i in range(1000)}
    assert levels(spark, needs) == {f"c{i}": i for i in range(1000)}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_random_needs(spark, seed):
    rng = random.Random(seed)
    needs = {f"c{i}": [f"c{rng.randrange(max(0, i - 30), i)}" for _ in range(rng.choice([0, 1, 1, 2, 6, 25]))] if i else [] for i in range(150)}
    needs |= {"wide": [f"c{i}" for i in range(150)], "after": ["wide"], "lost": ["nobody"], "behind": ["lost", "c3"], "self": ["self"]}
    needs |= {f"r{i}": [f"r{(i + 1) % 3}", "c9"] for i in range(3)} | {"ring": ["r1"]}
    assert levels(spark, needs) == slow_levels(needs)


def test_shards_of_far_and_hot_page_ids(spark):
    rows = [(i, f"http://a/{i}", "x" * 400 + str(i)) for i in range(200)]
    far = [*rows, (2**63 - 1, "http://far/", "y"), (-(2**63) + 5, "http://low/", "z"), *((77, f"http://hot/{k}", "h" * 400 + str(k)) for k in range(100)), *((None, f"http://null/{k}", f"n{k}" * 200) for k in range(50))]
    shards = {}
    for name, of in (("near", rows), ("far", far)):
        folder = f"{shared_folder(spark)}/test-shards-{name}"
        manifest = warc_writer.write_warc(spark.createDataFrame(of, "page_id bigint, url string, html string"), folder, shard_bytes=10_000, file_bytes=1 << 20)
        files = manifest.collect()
        assert sum(r.records for r in files) == len(of) and len({r.shard for r in files}) == len(files)
        got = warc_writer.read_warc(manifest, folder).collect()
        assert Counter((r.page_id, r.url, r.payload_bytes) for r in got) == Counter((i, u, len(h)) for i, u, h in of) and all(r.whole for r in got)
        shards[name] = max(r.records for r in files)
    assert shards["near"] <= 12 and shards["far"] <= 20  # 10,000 bytes are some eleven such records


@pytest.mark.parametrize("step", [1, 2**40])
def test_next_text_of_any_ids(spark, step):
    ids = [i * step for i in range(-40, 60)]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in document_fingerprints.with_next_text(docs).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"text {ids.index(down[(k + 1) % len(down)])}" for k, i in enumerate(down)}


def test_fingerprints_beside_clashing_names(spark):
    rows = [("A  b", 1, "p", "q", 2.0), ("a B", 2, "r", "s", 3.0), (None, 3, None, None, None), ("", 4, "", "", 0.0)]
    docs = spark.createDataFrame(rows, "text string, number int, __canon string, canon string, `own.x` double").withColumn("fingerprint", F.lit("old"))
    for of in (document_fingerprints.digest, lambda c: F.lit("same")):
        got = document_fingerprints.fingerprints(docs, of)
        assert got.columns == ["text", "number", "__canon", "canon", "own.x", "fingerprint"]
        found = {r.number: r for r in got.collect()}
        assert len(found) == 4 and found[1].fingerprint == found[2].fingerprint != found[3].fingerprint == found[4].fingerprint
        assert (found[1]["__canon"], found[2].canon, found[2]["own.x"]) == ("p", "s", 3.0)


def test_edited_fingerprints_of_a_weak_digest(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two"), (None, "one"), (5, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in document_fingerprints.edited_fingerprints(docs, lambda c: F.lit("same")).collect()}
    assert got[2].fingerprint == got[3].fingerprint and got[1].fingerprint == got[None].fingerprint
    assert len({got[i].fingerprint for i in (1, 2, 5)}) == 3
    assert (got[3].near_next, got[3].near_edited, got[2].near_next) == (1.0, 0.0, 0.0)


def test_scores_do_not_follow_the_partitioning(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in maxent_lm.scores(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and all(abs(many[i] - s) <= 1e-4 * max(1.0, abs(s)) for i, s in one.items())


def test_class_probabilities_add_up_to_one():
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(maxent_lm._FEATURES, maxent_lm.CLASSES)).astype(np.float32)
    at = rng.integers(0, maxent_lm._FEATURES, (4, 50))
    total = sum(np.exp(maxent_lm._picked(weights, at, np.full(50, k))) for k in range(maxent_lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert document_fingerprints.fingerprints(empty).count() == 0
    schemas = spark.createDataFrame([], "name string, field string, type string, required boolean")
    assert chat_tools.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], "call_id string, content string"), schemas).count() == 0
    folder = f"{shared_folder(spark)}/test-no-pages"
    manifest = warc_writer.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert manifest.count() == 0 and warc_writer.read_warc(manifest, folder).count() == 0
    model = quality_compression.fit(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert quality_compression.score(empty, model).count() == 0
