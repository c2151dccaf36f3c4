"""The ten operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import chat_tools, document_fingerprints, lexical_packing, maxent_lm, ngram_jaccard, quality_compression, secret_crf, substring_dedup, template_decontamination, warc_writer
from ledgerspark.llm._automaton import SuffixAutomaton
from ledgerspark.llm._tables import shared_folder
from ledgerspark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9004, "One"), (9005, "ONE"), (None, "null id"), (9006, "naïve ß ÀÉ " * 30), (9007, "x " * 3000)]
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `key` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0, "k") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def rows(spark, data):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    base = max((t for _, t in found if len(t) < 4000), key=len).split()
    near = [(8000 + k, " ".join(w if (i + k) % 83 else "changed" for i, w in enumerate(base))) for k in range(6)]
    return found + near + [(8100, " ".join(base[40:160])), (8101, "intro " + " ".join(base[100:150]) + " end")] + ODD


def test_suffix_automaton_statistics():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, 30).tolist() for _ in range(4)]
    automaton = SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    grams = {tuple(t[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
    probe = rng.integers(0, 3, 60).tolist()
    want = [max((n for n in range(1, i + 2) if tuple(probe[i + 1 - n : i + 1]) in grams), default=0) for i in range(60)]
    assert list(automaton.statistics(probe)) == want


@pytest.mark.parametrize("shard", [2048, 1])
def test_substring_dedup(spark, rows, shard):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table(spark, rows), shard_contexts=shard).collect())
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for j in range(len(w) - 49):
                key = tuple(w[j : j + 50])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, w in split:
        gone = set()
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        left = [x for j, x in enumerate(w) if j not in gone]
        want[i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_jaccard(spark, rows, n, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.near_copies(table(spark, rows), n, percent).collect())
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            met = len(sets[a] & sets[b])
            if met and 100 * met >= percent * (len(sets[a]) + len(sets[b]) - met):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    assert got == Counter((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows))


def test_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert ngram_jaccard.near_copies(empty).count() == 0
    assert document_fingerprints.edited_fingerprints(empty).count() == 0
    assert template_decontamination.contaminated(empty, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert lexical_packing.pack(empty, tokenizer_path()).count() == 0
    assert maxent_lm.scores(empty).count() == 0
    assert secret_crf.scan(empty, secret_crf.fit(empty)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\n", ""), (None, "http://d/", "<p>é</p>"), (5, "u", "y" * 5000), (5, "u", "y" * 5000)]
    folder = f"{shared_folder(spark)}/test-warc"
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int")
    manifest = warc_writer.write_warc(pages, folder, shard_bytes=2000, file_bytes=300)
    got = warc_writer.read_warc(manifest, folder).collect()
    assert len(got) == len(rows) and all(r.whole for r in got)
    by = {}
    for i, _, h in rows:
        d = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        by.setdefault(d, []).append(i)
    for r in got:
        most = max((i for i in by[r.payload_digest] if i is not None), default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == most else ("revisit", most))
    again = warc_writer.write_warc(pages.repartition(3), folder + "2", shard_bytes=2000, file_bytes=300)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in manifest.collect())


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    got = lexical_packing.pack(table(spark, rows), tokenizer_path(), shard_ids=20_000).toPandas()
    sums = got.groupby("sequence_id")["length"].sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in sums) and sums.max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i] if i is not None else got[got.doc_id.isna()]
        if i == 9004:
            continue
        own = own.sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes()) == r.ids_crc32 for r in own.itertuples())


def test_fingerprints(spark, rows):
    told = document_fingerprints.fingerprints(table(spark, rows + [(9100, "Café  X"), (9101, "café x")]), lambda c: F.substring(document_fingerprints.digest(c), 1, 1)).collect()
    import unicodedata

    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())
    groups = {}
    for r in told:
        groups.setdefault(r.fingerprint, set()).add(canon(r.text))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({canon(r.text) for r in told})
    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in document_fingerprints.edited_fingerprints(table(spark, rows)).collect() if r.doc_id is not None)
    assert got == want


def test_decontamination_finds_copies_and_renamed_questions(spark):
    item = "if the man named Anna buys 12 apples and gives 5 kg of them to her friend Bob how many are left for the cake"
    renamed = item.replace("Anna", "Carla").replace("Bob", "Dirk").replace("12", "31").replace("5 kg", "7 lb")
    docs = table(spark, [(1, "before " + item + " after"), (2, "before, " + renamed + " after"), (3, "a text of its own about nothing in particular that goes on"), (4, None), (5, "")])
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "three words only", 1)], "item_id bigint, text string, n int")
    got = {(r.doc_id, r.item_id, r.kind) for r in template_decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 7, "exact"), (2, 7, "renamed")}


def test_decontamination_judges_each_occurrence(spark):
    item = "if the man named Anna buys 12 apples and gives 5 kg of them to her friend Bob how many are left for the cake"
    other = item.replace("Anna", "Carla").replace("Bob", "Dirk").replace("12", "31").replace("5 kg", "7 lb")
    third = item.replace("Anna", "Emil").replace("Bob", "Frida").replace("12", "44").replace("5 kg", "9 g")
    padded = other.replace("of them", "of them " + "and so on " * 12)
    torn = item.replace("Anna", "Carla") + " " + "filler " * 3 + item[:40]
    texts = [item + " " + other, other + " and then " + third, item + " " + padded, padded + " " + third.replace("friend", "old friend"), " ".join([other, third, item]), torn, item.replace("12", "13")]
    docs = table(spark, list(enumerate(texts)))
    bench = spark.createDataFrame([(7, item), (8, third)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in template_decontamination.contaminated(docs, bench).collect()}
    want = {(0, 7): "exact", (1, 7): "renamed", (2, 7): "exact", (3, 7): "renamed", (4, 7): "exact", (1, 8): "exact", (4, 8): "exact", (5, 7): "renamed", (6, 7): "renamed"}
    assert {k: got.get(k) for k in want} == want
    assert {d for d, _ in got} == set(range(len(texts)))


def test_decontamination_reads_names_at_the_start_of_sentences(spark):
    item = "Anna buys twelve apples and gives her brother 5 kg. Bob then counts what is left for the 3 cakes."
    short = "Anna walks 5 km every single day."
    named = lambda x, a, b: x.replace("Anna", a).replace("Bob", b)
    plain = "The river rises in the north and runs past two old mills. Nobody has ever drawn a map of it for the town."
    texts = [
        named(item, "Carla", "Dirk"), "Question:\n" + named(item, "Carla", "Dirk").replace("5 kg", "7 lb"), 'he asked "' + named(item, "Will", "Mark") + '"', named(item, "Carla", "Carla"), item, item.lower(),
        "It was said that " + named(item, "Carla", "Dirk"), "intro. " + named(short, "Carla", ""), "Well, " + short.lower(), plain, plain.lower(), "THE river" + plain[9:], "And then the river" + plain[9:], plain.replace("Nobody", "Somebody"),
        "- " + named(item, "Carla", "Dirk").replace("twelve apples", "old pears").replace("counts what", "eats all that"),
    ]
    bench = spark.createDataFrame([(1, item), (2, short), (3, plain)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in template_decontamination.contaminated(table(spark, list(enumerate(texts))), bench).collect()}
    want = {(k, 1): "exact" if k in (4, 5) else "renamed" for k in range(7)} | {(7, 2): "renamed", (8, 2): "exact", (9, 3): "exact", (10, 3): "exact", (11, 3): "exact", (12, 3): "exact"}
    assert got.pop((13, 3)) in ("exact", "renamed")
    assert {k: v for k, v in got.items() if k[0] != 3} == {k: v for k, v in want.items() if k[0] != 3}


def test_secret_scan(spark, rows):
    secrets = [(7000 + k, f"some words before password = {hashlib.sha1(str(k).encode()).hexdigest()} and after it more words of the text " * 2) for k in range(40)]
    docs = table(spark, rows + secrets + [(7100, 'TOKEN: "abc" api-key=abcdef AKIA' + "Q" * 16)])
    field = secret_crf.fit(docs)
    for r in secret_crf.scan(docs, field).collect():
        t = r.text or ""
        spans = [(m.start(), 0, m.end()) for m in secret_crf.ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if spans:
            assert "[SECRET]" in r.masked and text.split(",")[0] in r.spans


def test_viterbi_and_its_shortcut():
    rng = np.random.default_rng(5)
    field = secret_crf.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = rng.normal(size=(300, 3)) * 2
    scores[rng.random(300) < 0.5, 0] += 30
    bound = np.array([0, 40, 41, 41, 200, 300])
    want = [t for a, b in zip(bound, bound[1:], strict=False) if b > a for t in secret_crf.viterbi(scores[a:b], field.steps, field.first)]
    assert secret_crf.tagged(field, scores, bound).tolist() == want


def test_quality(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_compression.fit(docs, labels)
    scored = quality_compression.score(docs, model).join(labels, "doc_id").where(~quality_compression.learnable("doc_id")).toPandas()
    assert ((scored["score"] >= 0.5) == (scored["quality"] == 1)).mean() > 0.9
    odd = quality_compression.score(table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_language_model(spark, rows):
    rows = [r for r in rows if r[0] != 9004]
    got = {r.doc_id: r for r in maxent_lm.scores(table(spark, rows)).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    taught = Counter(w for i, t in tokens.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(taught.values()), len(taught)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in taught for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((taught.get(w, 0) + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tool_calls(spark):
    calls = [("a", 1, 0, "search", '{"q": "x", "n": 2}', None), ("b", 1, 1, "search", '{"n": "2"}', ["a"]), ("c", 1, 2, "search", "{", ["b", "a"]), ("d", 1, 3, "nope", "{}", []), ("e", 1, 4, "search", None, ["f"]), ("f", 1, 5, "search", '{"q":"y"}', ["e"]), ("g", 1, 6, "search", '{"q":"y"}', ["zz"]), ("a", 2, 9, "search", "{}", None), (None, 1, 1, "search", "{}", None)]
    schemas = spark.createDataFrame([("search", "q", "string", True), ("search", "n", "integer", False)], "name string, field string, type string, required boolean")
    got = chat_tools.link_tool_calls(spark.createDataFrame(calls, "call_id string, conversation bigint, seq bigint, name string, arguments string, needs array<string>"), spark.createDataFrame([("a", 'he said "hi"'), ("q", "lost"), (None, "z")], "call_id string, content string"), schemas).collect()
    by = {(r.call_id, r.status): r for r in got}
    assert (by["a", "ok"].level, by["b", "invalid"].level, by["c", "invalid"].level) == (0, 1, 2)
    assert by["b", "invalid"].problems == "missing:q,type:n" and by["c", "invalid"].problems == "not_json" and by["d", "invalid"].problems == "unknown_tool"
    assert json.loads(by["a", "ok"].json) == {"arguments": {"n": 2, "q": "x"}, "id": "a", "name": "search", "result": 'he said "hi"'}
    assert {k for k in by if k[1] in ("circular", "duplicate", "orphan")} == {("e", "circular"), ("f", "circular"), ("g", "circular"), ("a", "duplicate"), ("q", "orphan"), (None, "orphan")}


