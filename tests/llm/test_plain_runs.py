"""Packing: plain runs of letters skip the tokenizer's normalisation and splitting, with the same ids."""

import random

import numpy as np
import pyarrow as pa

from ledgerspark.llm import lexical_packing
from ledgerspark.llm._words import blocks
from ledgerspark.llm.queries import tokenizer_path

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")


def _texts(n):
    rng = random.Random(11)
    run = lambda: "".join(rng.choice(LETTERS + "eeeaaann") for _ in range(rng.randrange(1, 14)))
    return [" ".join(rng.choice((run, lambda: run().title(), lambda: run() + str(rng.randrange(99)) + "-" + run()))() for _ in range(rng.randrange(1, 60))) for _ in range(n)] + ["", "ÀÉ Öß ÿ", "it's <|endoftext|> naïve", "éte Ångström", "ĳ ŉ ǆ"]


def test_ids_are_the_librarys():
    encoder, texts = lexical_packing._Encoder(tokenizer_path()), _texts(400)
    found = [ids for b in blocks(pa.array(texts)) for made, bound in [encoder(b)] for ids in np.split(made, bound[1:-1])]
    assert [x.tolist() for x in found] == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, lexical_packing.END] for t in texts]


def test_plain_runs_do_not_meet_the_regular_expressions():
    encoder = lexical_packing._Encoder(tokenizer_path())
    encoder.tokenizer = None
    runs = sorted({w for t in _texts(200) for w in t.split() if w and all(c in LETTERS for c in w)})
    order, ids, size = encoder._encoded(runs, np.ones(len(runs), bool))
    assert len(order) == len(runs) and size.sum() == len(ids)
