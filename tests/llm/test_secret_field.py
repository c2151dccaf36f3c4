"""The field finds secrets that no pattern catches, of shapes and after words that its training does not make, and leaves the corpus alone."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from ledgerspark.llm import secret_crf

ALL = string.ascii_letters + string.digits
HELD_OUT = {
    "ghp_": lambda r: "ghp_" + "".join(r.choices(ALL, k=36)),
    "sk-": lambda r: "sk-" + "".join(r.choices(ALL, k=48)),
    "xoxb-": lambda r: "xoxb-" + "".join(r.choices(string.digits, k=12)) + "-" + "".join(r.choices(ALL, k=24)),
    "base64": lambda r: "".join(r.choices(ALL + "+/", k=40)),
    "upper hex": lambda r: "".join(r.choices("0123456789ABCDEF", k=40)),
    "digits": lambda r: "".join(r.choices(string.digits, k=22)),
    "three parts": lambda r: "eyJ" + ".".join("".join(r.choices(ALL + "_-", k=k)) for k in (20, 40, 43)),
    "AIza": lambda r: "AIza" + "".join(r.choices(ALL + "_-", k=35)),
}
CUES = ("passphrase", "aws_key", "Bearer", "connection", "deploy_key", "")


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text]


@pytest.fixture(scope="module")
def field(texts):
    return secret_crf.fit_field(*secret_crf.training_windows(texts[:500], windows=2500), rounds=40)


def found(field, text):
    return [s for s in secret_crf.all_spans(text, next(iter(secret_crf.crf_spans(field, pa.array([text]))))) if s[0] == "crf"]


@pytest.mark.parametrize("kind", sorted(HELD_OUT))
def test_recall_on_kinds_that_no_pattern_catches(field, texts, kind):
    rng, hit, n = random.Random(kind), 0, 0
    for text in texts[600:650]:
        full, spans = secret_crf.planted(text, rng, plants=2, decoys=1, secret=HELD_OUT[kind], cues=CUES)
        assert not any(a <= s < b for k, s, _ in secret_crf.pattern_spans(full) if k == "access" for a, b in spans)
        mine = found(field, full)
        n += len(spans)
        hit += sum(any(s < b and a < e and e - s >= 0.8 * (b - a) for _, s, e in mine) for a, b in spans)
    assert hit / n >= 0.9


def test_clean_texts_are_left_alone(field, texts):
    assert sum(len(found(field, t)) for t in texts[600:]) <= 0.02 * len(texts[600:])


def test_planted_spans_hold_the_secrets():
    rng = random.Random(1)
    for _ in range(200):
        secret = []
        full, spans = secret_crf.planted("naïve ß words 中文 here " * 3, rng, secret=lambda r: secret.append(secret_crf.made_secret(r)) or secret[-1])
        assert [full[a:b] for a, b in spans] == secret
        features, labels = secret_crf._labelled(full, spans)
        assert (labels == secret_crf.BEGIN).sum() == len(spans) and features.shape[1] == len(labels)


def test_short_and_empty_samples():
    features, labels = secret_crf.training_windows(["a b", "", "c " * 100, "d e f " * 20], windows=10)
    assert features.shape[1:] == labels.shape and len(labels) <= 10 and labels.any()
    assert secret_crf.training_windows([], 10)[1].shape == (0, secret_crf.WINDOW)


def test_spans_that_touch_a_pattern_are_left_out():
    text = "é token=abcdefgh1 AKIA" + "Q" * 16 + " ü x9 AAbb11"
    at = lambda piece: (len(text[: text.index(piece)].encode()), len(text[: text.index(piece)].encode()) + len(piece.encode()))
    tagged = [at("é"), at("abcdefgh1"), at("QQ"), at("x9"), at("AAbb11")]
    assert [(k, text[a:b]) for k, a, b in secret_crf.all_spans(text, tagged)] == [("crf", "é"), ("assign", "token=abcdefgh1"), ("access", "AKIA" + "Q" * 16), ("crf", "x9"), ("crf", "AAbb11")]


def test_many_spans_take_linear_time():
    text = "deadbeef00112233445566778899aabb " * 20000
    tagged = [(33 * i, 33 * i + 5) for i in range(20000)]
    assert len(secret_crf.all_spans(text, tagged)) == 20000
    assert np.all(np.diff([a for _, a, _ in secret_crf.all_spans(text, tagged)]) == 33)
