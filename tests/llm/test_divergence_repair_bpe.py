"""Source divergence, conversation repair and tree BPE against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import bpe_tree, conversation_repair, queries, source_divergence

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, item string, value bigint, ids binary"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, b"") for r in rows], DOC)


def divergence_by_hand(rows, min_docs, top):
    """The contract, term by term and pair by pair."""
    held = defaultdict(lambda: defaultdict(Counter))  # lang -> source -> term -> count
    docs = defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        held[lang][source].update(found)
        docs[lang].update(set(found))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, groups in held.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("min_docs", [1, 3, 50])
def test_divergence(spark, min_docs):
    rng = random.Random(4)
    words = ["Alpha", "beta", "été", "naïve", "x1y", "中文 字", "it's", "A", "", "\x85z", "omega-3"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 9]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "ß"])) for i in range(120)]
    rows += [(None, None, "empty", "only"), (1, "12 34", "empty", "other"), (5, "beta " * 4000, "en", "s1"), rows[0], rows[0]]
    got = source_divergence.divergence(documents(spark, rows), min_docs=min_docs).collect()
    assert {tuple(r) for r in got} == divergence_by_hand(rows, min_docs, 10) and len(got) == len(set(got))


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(documents(spark, [])).count() == 0


def test_terms_of_long_texts_are_whole():
    text = "Ab-cé " * 50
    assert [w for block in source_divergence.terms(text, 7) for w in block] == [w for block in source_divergence.terms(text) for w in block]


def test_paths_share_nodes():
    item = np.array([[1, 2, 3], [1, 2, 4], [1, 5, -1], [6, 2, 3]])
    tree = source_divergence.PathTree(item, np.array([3, 3, 2, 3]), np.array([10, 1, 5, 2]))
    assert sorted(zip(tree.row.tolist(), tree.depth.tolist(), tree.weight.tolist(), strict=True)) == [(0, 0, 16), (0, 1, 11), (0, 2, 10), (1, 2, 1), (2, 1, 5), (3, 0, 2), (3, 1, 2), (3, 2, 2)]


def repair_by_hand(rows):
    """Least (cost, letters) by strings, over every number of inserts up to four before each row."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        given[conv] += [(turn, "user" if key == 4 else role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    out = {}
    for conv, found in given.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in found:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))

        def inserts(best):
            now, every = list(best.items()), list(best.items())
            for _ in range(4):
                now = [(after[s][r[0]], (c + 2, a + "I", o + [r + ":"])) for s, (c, a, o) in now for r in ("user", "assistant") if r[0] in after[s]]
                every += now
            return every

        best = {"": (0, "", [])}
        for (_, role, text), fault in zip(found, faults, strict=True):
            ways, more = [], int(fault == "truncated")
            for s, (c, a, o) in inserts(best):
                ways.append((s, (c + 3, a + "D", o)))
                if fault not in ("blank", "duplicate"):
                    ways += [(after[s][role[:1]], (c + more, a + "K", o + [f"{role}:{text}"]))] if role[:1] in after[s] else []
                    ways += [(after[s][r[0]], (c + 2 + more, a + "R", o + [f"{r}:{text}"])) for r in ("user", "assistant") if r[0] in after[s]]
            best = {}
            for s, way in ways:
                best[s] = min(best.get(s, way), way, key=lambda w: w[:2])
        cost, audit, lines = min((w for s, w in inserts(best) if s in ("", "a")), key=lambda w: w[:2])
        turns = {t for t, _, _ in found if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURN = "conv_id bigint, turn bigint, role string, text string, n bigint, digest string, piece int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 9, "d", 1) for r in rows], TURN)


def test_repair(spark):
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"], ["Hi.", "no", "", " \t", None, "yes! ", "cut", "a\x85", "\x85", "b.\x0b", "d?", ".", " "]
    rows = [(c or None, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in range(300) for _ in range(rng.randrange(14))]
    rows += [(7777, t, rng.choice(roles), f"{rng.choice(texts)}{rng.randrange(400)}" if rng.random() < 0.7 else "hot.") for t in range(1300)]  # several runs of one conversation
    rows += [(8888, 5, "user", "same.")] * 1200 + [(8889, t, "user", "same.") for t in range(700)] + [(9, -(2**62), "user", "far."), (9, 2**62, "assistant", "away.")]
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repaired(conversations(spark, rows)).collect()}
    want = repair_by_hand(rows)
    assert {k: v for k, v in got.items() if k != 9} == {k: v for k, v in want.items() if k != 9}
    assert got[9][0] is None or want[9][0] < 2**63


def test_repair_of_nothing(spark):
    assert conversation_repair.repaired(conversations(spark, [])).count() == 0


def test_runs_join_like_one():
    rng = random.Random(2)
    rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.3) for _ in range(60)]
    every = tuple(range(4))
    whole = conversation_repair.matrix(rows, every)
    for cut in (0, 1, 17, 59, 60):
        parts = conversation_repair.matrix(rows[:cut], every), conversation_repair.matrix(rows[cut:], every)
        assert conversation_repair.joined(parts[0], cut, parts[1], 60 - cut) == whole


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_conversation_repair"])
def test_sql(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.fixture(scope="module")
def bpe():
    return bpe_tree.ByteBpe(queries.tokenizer_path("byte_bpe_50k.json"))


PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "文", "'s", "'", "1", "23", "!", "?", "<|endoftext|>", "the", "ing", "\t", " ", " ", " ", "😀", "́", "A", "'ll", "\x1c", "\x85", "..", "www", "=", "-", "\x00"]


def library(bpe, text):
    return np.array(bpe.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def by_tree(bpe, text, leaf):
    runs = []
    for run, kind, piece in bpe.leaves(text, leaf):
        if runs and runs[-1][0] == run and kind == bpe_tree.PART:
            runs[-1][1].append(bpe.leaf(kind, piece))
        else:
            runs.append((run, [bpe.leaf(kind, piece)]))
    return b"".join(bpe.tree(parts) for _, parts in runs)


def test_bpe_agrees_with_the_library(bpe):
    rng = random.Random(5)
    for _ in range(3000):
        some = rng.sample(PIECES, rng.randrange(1, 12))
        text = "".join(rng.choice(some) for _ in range(rng.randrange(60)))
        want = library(bpe, text)
        assert bpe.encode_all([text]) == [want] and by_tree(bpe, text, rng.choice([1, 2, 3, 5, 8, 20])) == want
        assert bpe.decode(want) == bpe.tokenizer.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 30001, "ab" * 9000 + "中" * 2000, "".join(random.Random(1).choice("abcdefgh") for _ in range(40000)), "=" * 5000 + "the" * 5000])
def test_long_runs_are_joined_exactly(bpe, text):
    assert by_tree(bpe, text, 512) == library(bpe, text)


def test_decoding_of_broken_bytes(bpe):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(bpe.tokenizer.get_vocab_size()) for _ in range(rng.randrange(9))]
        assert bpe.decode(np.array(ids, "<u4").tobytes()) == bpe.tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, bpe):
    rng = random.Random(8)
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "One two.", "en", "s"), (3, "One two.", "en", "s"), (None, "null id <|endoftext|> x", None, None), (4, "word " * 3000, "en", "s"), (5, "".join(rng.choice("abcde") for _ in range(9000)), "en", "s"), (6, "x\n\n y " * 900 + "z" * 4000, "en", "s"), (6, "中文字" * 2000, "en", "s")]
    path = queries.tokenizer_path("byte_bpe_50k.json")
    found = bpe_tree.decoded(bpe_tree.encoded(documents(spark, rows), path, leaf=1000), path)
    got = Counter((r.doc_id, bytes(r.ids), r.text) for r in found.collect())
    assert got == Counter((i, library(bpe, t or ""), t or "") for i, t, _, _ in rows)
    assert bpe_tree.encoded(documents(spark, []), path).count() == 0
    wide = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert bpe_tree.encoded(wide, path).where("doc_id = '3'").count() == 2
