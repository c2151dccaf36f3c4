"""The pipeline's stages one after another on the smallest tables, with planted rows whose fate is known."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import secret_crf


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    base = docs.where("length(text) BETWEEN 1500 AND 4000").orderBy("doc_id").limit(3).collect()
    copy = [(900001, base[0].text, base[0].lang, base[0].source, base[0].n_chars)]
    leak = [(900002, base[1].text + " password = hunter2hunter2 end.", base[1].lang, base[1].source, base[1].n_chars)]
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    taken = [(900003, base[2].text + " " + item, base[2].lang, base[2].source, base[2].n_chars)]
    rows = docs.unionByName(spark.createDataFrame(copy + leak + taken, docs.schema))
    out, folder = [rows], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], data).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return dict(zip(["documents", *(name for name, _ in corpus_pipeline.STAGES)], out, strict=True)), base


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_lose_rows(stages):
    frames = list(stages[0].values())
    for before, after in zip(frames[:-2], frames[1:-1], strict=True):
        assert after.columns == before.columns and ids(after) <= ids(before)
    assert len(frames) == 6


def test_each_decision_takes_effect(stages):
    frames, base = list(stages[0].values()), stages[1]
    unique = ids(frames[2])
    assert not {base[0].doc_id, 900001} <= unique  # one of two equal texts stays
    assert len(unique & {base[0].doc_id, 900001}) == len(ids(frames[1]) & {base[0].doc_id, 900001}) - 1 or not ids(frames[1]) & {base[0].doc_id, 900001}
    if 900003 in unique:
        assert 900003 not in ids(frames[3])
    texts = [r.text or "" for r in frames[4].select("text").collect()]
    assert not any("hunter2hunter2" in t for t in texts) and not any(secret_crf.pattern_spans(t) for t in texts)


def test_every_kept_document_is_packed_whole(stages):
    frames = list(stages[0].values())
    pieces = frames[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert ids(frames[5]) == ids(frames[4]) and pieces.where("n <> all").count() == 0
