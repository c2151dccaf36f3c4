"""Packing: what a document costs. Units met again are not encoded again, terms are counted in the pass that writes the ids, few neighbours are sorted."""

from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerspark.llm import lexical_packing
from ledgerspark.llm._words import blocks
from ledgerspark.llm.queries import tokenizer_path


def _word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_units_met_again_are_not_encoded_again():
    encoder, asked = lexical_packing._Encoder(tokenizer_path()), []
    encoded = encoder._encoded
    encoder._encoded = lambda units, plain: asked.append(len(units)) or encoded(units, plain)
    texts = pa.array([" ".join(map(_word, range(i, i + 1000))) for i in range(0, 200_000, 1000)])
    for _ in range(2):
        for b in blocks(texts):
            encoder(b)
    assert sum(asked) < 1.2 * 200_000


def test_odd_words_beside_others_keep_the_librarys_ids():
    encoder = lexical_packing._Encoder(tokenizer_path())
    texts = ["ж", "<|endoftext|> a", "", "a<", "|b", "it's", "'", "ÀÉ×é 9a9", "中", "中文 ab.cd", "ſ İ", "", "x" * 3000]
    found = [ids.tolist() for b in blocks(pa.array(texts)) for made, bound in [encoder(b)] for ids in np.split(made, bound[1:-1])]
    assert found == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, lexical_packing.END] for t in texts]


def test_bags_are_distinct_terms_and_their_counts():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << 16, n).astype(np.uint16) % m for n, m in ((5, 3), (0, 1), (200_000, 65_535), (300, 20), (0, 1))] + [np.ones(1, np.uint16)] * 70_000
    terms, counts, begin = lexical_packing._bags(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    for k in [*range(10), len(docs) - 1]:
        own, n = np.unique(docs[k], return_counts=True)
        assert terms[begin[k] : begin[k + 1]].tolist() == own.tolist() and counts[begin[k] : begin[k + 1]].tolist() == n.tolist()
    assert len(begin) == len(docs) + 1 and begin[-1] == len(terms)


def test_terms_are_counted_in_the_pass_that_writes_ids(spark):
    texts = ["a b a", None, "", "b c " * 40, "a b a"] * 9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    made, held = lexical_packing.tokenised(docs, tokenizer_path())
    rows = made.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    want = Counter(t for r in rows for t in set(np.frombuffer(r.ids, "<u2").tolist()))
    assert {r.term: r.n for r in held.groupBy("term").sum("n").toDF("term", "n").collect()} == want and want[lexical_packing.END] == len(texts)


def test_neighbours_come_in_the_order_of_a_full_sort():
    rng = np.random.default_rng(4)
    docs = [rng.integers(2, 60, rng.integers(1, 40)).astype(np.uint16) for _ in range(150)] * 2  # copies tie
    idf = np.full(1 << 16, 0.5)
    index = lexical_packing._Index(docs, idf, 20.0)
    index.unused[[0, 7, 9]] = False
    bag = [dict(zip(own.tolist(), n.tolist(), strict=True)) for own, n in (np.unique(d, return_counts=True) for d in docs)]
    score = [sum(0.5 * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / 20)) for t, n in b.items() if t in bag[0]) for b, d in zip(bag, docs, strict=True)]
    found = list(index.ranked(0))
    assert sorted(found) == [k for k, s in enumerate(score) if s and k not in (0, 7, 9)]
    assert all(score[a] > score[b] - 1e-4 for a, b in zip(found, found[1:], strict=False))
    assert all(a < b for a, b in zip(found, found[1:], strict=False) if a % 150 == b % 150)
    asked = index.ranked(0)
    assert [next(asked) for _ in range(40)] == found[:40]
