"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits and ``+/_.-``. Each is tagged begin, inside or outside of a
secret from its shape, its neighbouring words and separators, and features of its text, by the
best path (Viterbi). The field is fitted on windows of a bounded sample of texts into which made-up
secrets of many shapes are put, with and without a word that announces them; those and the fixed
patterns' spans are its labels, everything else of the corpus, and made-up links, versions, dates and
names, is not secret. Its spans are added to the patterns'.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm._tables import give_back, kept
from ledgerspark.llm._words import _BASE_BYTE, _BYTE_VALUE, _LOWER, _views, span_hashes

# The patterns, their order, and the least lengths of what they must catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

#: Texts sampled of either kind, with and without a pattern's match; tokens of a training window; most windows of a fit.
SAMPLE, WINDOW, WINDOWS = 600, 32, 6000
#: Made-up secrets and look-alikes put into each sampled text.
PLANTS, DECOYS = 4, 3
#: Bytes of text whose features are held at once (a longer text is alone), and texts whose results are.
BLOCK_BYTES, TEXTS = 1 << 17, 512
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")  # the runs of HEX that are long enough
_LOWER_CASE, _UPPER_CASE, _DIGIT, _SYMBOL, _OTHER = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER_CASE, _UPPER_CASE, _DIGIT, _OTHER
_KIND[[ord(c) for c in "+/_.-"]] = _SYMBOL
_IS_HEX = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdef"])
_LENGTHS, _WORDS = np.array([3, 6, 10, 16, 20, 24, 40]), 2048
_SIZES = (256, 40, 48, _WORDS, _WORDS, _WORDS, 16, 4, 16)
_STARTS = np.cumsum((0, *_SIZES))[:-1]
OUT, BEGIN, INSIDE = 0, 1, 2


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the fixed patterns' matches, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """What the matches hold as secret: the value of an assignment, the whole of others."""
    parts = [m.span() for p in (ACCESS, _HEX_RUN) for m in p.finditer(text) if len(m[0]) >= 20]
    return parts + [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    bound: np.ndarray
    features: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of some documents (bytes data, documents at offsets) and a row of features for each."""
    n = len(data)
    kind = _KIND[data]
    word = kind > 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start, end = np.flatnonzero(word & (~before | cut[:-1])), np.flatnonzero(word & (~after | cut[1:])) + 1
    bound = np.searchsorted(start, offsets)
    if not len(start):
        return Tokens(start, end, bound, np.zeros((len(_SIZES), 0), np.int64))

    def held(mask: np.ndarray, a: np.ndarray = start, b: np.ndarray = end) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[b] - total[a]

    size = end - start
    length = np.searchsorted(_LENGTHS, size, "right")
    digits, changed = held(kind == _DIGIT), np.zeros(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    shape = length * 32 + (digits > 0) * 16 + (held(kind == _UPPER_CASE) > 0) * 8 + (held(kind == _LOWER_CASE) > 0) * 4 + (held(kind == _SYMBOL) > 0) * 2 + (held(_IS_HEX[data]) == size)
    doc = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    name = span_hashes(_BYTE_VALUE[_LOWER[data]], _BASE_BYTE, start, end)

    def neighbour(step: int) -> np.ndarray:
        at = np.arange(len(start)) + step
        inside = (at >= bound[doc]) & (at < bound[doc + 1])
        return np.where(inside, (name[np.clip(at, 0, len(start) - 1)] % np.uint64(_WORDS - 1)).astype(np.int64) + 1, 0)

    gap = np.maximum(np.append(0, end[:-1]), offsets[doc])
    quote, line = np.isin(data, (34, 39)), data == 10
    left = held(data == 61, gap, start) > 0, held(data == 58, gap, start) > 0, held(quote, gap, start) > 0, held(line, gap, start) > 0
    until = np.minimum(np.append(start[1:], n), offsets[doc + 1])
    right = held(quote, end, until) > 0, held(line, end, until) > 0
    share = np.bincount(doc, digits > 0, len(bound) - 1) / np.maximum(1, np.diff(bound))
    text = np.searchsorted((0.01, 0.05, 0.2), share) * 4 + np.searchsorted((20, 200, 2000), np.diff(bound))
    columns = (
        shape,
        np.searchsorted((0.05, 0.2, 0.4, 0.7), digits / size) * 8 + length,
        np.searchsorted((0.05, 0.15, 0.3, 0.5, 0.7), np.maximum(held(changed) - 1, 0) / size) * 8 + length,
        neighbour(-1),
        neighbour(-2),
        neighbour(1),
        sum(x.astype(np.int64) << i for i, x in enumerate(left)),
        right[0] + 2 * right[1],
        text[doc],
    )
    return Tokens(start, end, bound, np.stack([c + s for c, s in zip(columns, _STARTS, strict=True)]))


@dataclass
class Field:
    """weights: a row of three scores for each feature; steps: scores from tag to tag; first: of the first tag."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray


def _emissions(field: Field, features: np.ndarray) -> np.ndarray:
    scores = field.weights[features[0]]
    for row in features[1:]:
        scores = scores + field.weights[row]
    return scores


def viterbi(scores: np.ndarray, steps: np.ndarray, first: np.ndarray) -> list[int]:
    """Best path of tags through the scores (tokens x 3)."""
    best, back = first + scores[0], []
    for row in scores[1:]:
        reach = best[:, None] + steps
        back.append(reach.argmax(0))
        best = reach.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def tagged(field: Field, scores: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The best path of each document.

    Where a token's score for outside leads by more than any two steps can differ, every best
    path is outside there; only the stretches between such tokens need a search.
    """
    tags = np.zeros(len(scores), np.int8)
    spread = field.steps.max() - field.steps.min()
    edge = np.ptp(field.first) + spread
    sure = scores[:, OUT] - scores[:, 1:].max(1) > max(2 * spread, edge)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    doc = np.searchsorted(bound, open_, "right")
    cut = np.flatnonzero(np.append(True, (np.diff(open_) != 1) | (np.diff(doc) != 0)))
    for a, b in zip(open_[cut], open_[np.append(cut[1:], len(open_)) - 1] + 1, strict=True):
        lo, hi = int(bound[np.searchsorted(bound, a, "right") - 1]), int(bound[np.searchsorted(bound, a, "right")])
        head = field.first if a == lo else field.steps[OUT]
        part = scores[a:b]
        if b < hi:
            part = part.copy()
            part[-1] += field.steps[:, OUT]
        tags[a:b] = viterbi(part, field.steps, head)
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit_field(windows: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-5) -> Field:
    """Maximum likelihood on windows (features x windows x tokens) of equal length, by AdaGrad."""
    count, length = labels.shape
    field = Field(np.zeros((sum(_SIZES), 3)), np.zeros((3, 3)), np.zeros(3))
    squares = [np.full_like(x, 1e-6) for x in (field.weights, field.steps, field.first)]
    gold = np.eye(3)[labels]
    pairs = np.einsum("ntx,nty->xy", gold[:, :-1], gold[:, 1:])
    for _ in range(rounds):
        e = _emissions(field, windows)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = field.first + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + field.steps, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _log_sum(field.steps + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        norm = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - norm[:, None, None])
        ahead = e + beta - norm[:, None, None]
        # token by token, as all at once takes nine times the memory of a window's tags
        edge = sum(np.exp(alpha[:, t - 1, :, None] + field.steps + ahead[:, t, None, :]).sum(0) for t in range(1, length))
        miss = (node - gold).reshape(-1, 3)
        slope = np.stack([sum(np.bincount(row.ravel(), miss[:, k], len(field.weights)) for row in windows) for k in range(3)], 1)
        slopes = slope / count + ridge * field.weights, (edge - pairs) / count, (node[:, 0] - gold[:, 0]).mean(0)
        for x, g, s in zip((field.weights, field.steps, field.first), slopes, squares, strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
    return field


_LOWER_LETTERS, _UPPER_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALL = _LOWER_LETTERS + _UPPER_LETTERS + _DIGITS
#: Words that announce a secret in made-up texts; an empty one announces nothing.
CUES = ("password", "passwd", "secret", "token", "api_key", "key", "pwd", "pass", "credential", "auth", "private_key", "access_key", "client_key", "session", "login", "pin", "code", "signature", "authorization", "cookie", "", "", "", "")
_LINKS = (" = ", "=", ": ", ":", " ", ' = "', "='", " is ", ' "', "\n", " -> ", '":"')


def made_secret(rng: random.Random) -> str:
    """One made-up secret: random letters and digits of some alphabet, with or without a prefix, in one piece or several."""
    text = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    kind = rng.randrange(9)
    if kind == 0:
        return text(_LOWER_LETTERS, 2, 5) + rng.choice("_-") + rng.choice(["", text(_LOWER_LETTERS, 3, 5) + rng.choice("_-")]) + text(_ALL, 16, 40)
    if kind == 1:
        return text(_ALL + "+/", 28, 72)
    if kind == 2:
        return text("0123456789ABCDEF", 20, 64)
    if kind == 3:
        return text(_DIGITS, 20, 32)
    if kind == 4:
        return "-".join(text(rng.choice(["0123456789abcdef", "0123456789ABCDEF", _UPPER_LETTERS + _DIGITS]), n, n) for n in rng.choice([(8, 4, 4, 4, 12), (5, 5, 5, 5), (4, 4, 4, 4)]))
    if kind == 5:
        return ".".join(text(_ALL + "_-", 14, 50) for _ in range(3))
    if kind == 6:
        return text(_LOWER_LETTERS + _DIGITS + _DIGITS, 20, 40)
    if kind == 7:
        return text(_ALL, 16, 44)
    return text(_UPPER_LETTERS, 2, 5) + text(_UPPER_LETTERS + _DIGITS, 12, 24)


def made_decoy(rng: random.Random) -> str:
    """Something that is no secret but has digits, capitals or marks: a link, path, version, date, number, name."""
    word = lambda: "".join(rng.choice(_LOWER_LETTERS) for _ in range(rng.randint(3, 9)))
    number = lambda n: "".join(rng.choice(_DIGITS) for _ in range(n))
    return rng.choice([
        lambda: f"https://www.{word()}.{word()[:3]}/{word()}/{word()}-{number(rng.randint(1, 5))}", lambda: f"/{word()}/{word()}/{word()}_{number(2)}.{word()[:3]}", lambda: f"v{number(1)}.{number(2)}.{number(1)}", lambda: f"{word()}.{word()}@{word()}.com",
        lambda: f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"+{number(2)}-{number(3)}-{number(3)}-{number(4)}", lambda: number(rng.randint(1, 19)), lambda: number(16), lambda: word().title() + word().title() + word().title(), lambda: "_".join(word() for _ in range(rng.randint(2, 5))),
        lambda: "-".join(word() for _ in range(rng.randint(2, 4))), lambda: word().upper() + "_" + word().upper(), lambda: f"{number(3)}.{number(2)}.{number(1)}.{number(3)}", lambda: word().upper(), lambda: word() + number(rng.randint(1, 4)), lambda: word() + word() + word() + word(),
    ])()


def planted(text: str, rng: random.Random, plants: int = PLANTS, decoys: int = DECOYS, secret=made_secret, cues=CUES) -> tuple[str, list[tuple[int, int]]]:
    """The text with secrets and look-alikes put between its words, and the secrets' spans in it."""
    words = text.split(" ")
    at = sorted((rng.randrange(len(words) + 1), rng.random(), k < plants) for k in range(plants + decoys))
    out, spans, size, before = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for place, _, is_secret in at:
        put("".join(w + " " for w in words[before:place]))
        before = place
        cue = rng.choice(cues)
        cue = rng.choice([cue, cue.upper(), cue.title(), rng.choice(words)[:12]]) if cue else ""
        link = rng.choice(_LINKS) if cue else ""
        put(cue + link)
        value = secret(rng) if is_secret else made_decoy(rng)
        if is_secret:
            spans.append((size, size + len(value)))
        put(value + ('"' if link.endswith('"') else "'" if link.endswith("'") else "") + rng.choice([" ", " ", "\n", ", ", ". "]))
    put(" ".join(words[before:]))
    return "".join(out), spans


def _labelled(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of a text's tokens; spans are code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    t = tokens(data, np.array([0, len(data)]))
    labels = np.zeros(len(t.start), np.int64)
    places = np.cumsum([0, *(len(c.encode()) for c in text)]) if len(data) != len(text) else np.arange(len(text) + 1)
    for a, b in sorted(spans):
        own = np.flatnonzero((t.start < places[b]) & (t.end > places[a]) & (labels == 0))
        labels[own] = INSIDE
        labels[own[:1]] = BEGIN
    return t.features, labels


def training_windows(texts: list[str], windows: int = WINDOWS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of windows of equal length out of texts with planted secrets; short texts are joined to reach a window.

    Of the windows with a tag up to three in four, and of those without what is left of ``windows``, are taken, evenly over all.
    """
    rng = random.Random(seed)
    with_, without, held = [], [], ""
    for text in texts:
        held = f"{held}\n{text}" if held else text
        if held.count(" ") < WINDOW:
            continue
        full, spans = planted(held, rng)
        spans, held = spans + [x for x in _secret_parts(full) if not any(x[0] < b and a < x[1] for a, b in spans)], ""
        features, labels = _labelled(full, spans)
        n = len(labels)
        for i in range(0, n, WINDOW) if n >= WINDOW else ():
            i = min(i, n - WINDOW)
            part = slice(i, i + WINDOW)
            (with_ if labels[part].any() else without).append((features[:, part], labels[part]))
    evenly = lambda found, most: found if len(found) <= most else [found[int(k * len(found) / most)] for k in range(most)]
    chosen = evenly(with_, windows * 3 // 4)
    chosen = chosen + evenly(without, windows - len(chosen))
    if not chosen:
        return np.zeros((len(_SIZES), 0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    return np.stack([f for f, _ in chosen], 1), np.stack([x for _, x in chosen])


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, chars: int = 20_000) -> Field:
    """A field from at most ``sample`` texts with a match and as many without, those of the least hashes; none found: a field that tags nothing.

    The sample is bounded: ``chars`` characters of a text, ``windows`` windows. Scoring is not: every whole text is tagged.
    """
    hit = F.col("text").rlike(rf"(?i){ASSIGN.pattern}") | F.col("text").rlike("AKIA[A-Z0-9]{16}") | F.col("text").rlike("[0-9a-f]{24}")
    ids = kept(docs.select(F.xxhash64("text").alias("draw"), hit.alias("hit")).where("hit IS NOT NULL"), "draws").distinct()
    few = [ids.where(F.col("hit") == h).orderBy("draw").limit(sample) for h in (True, False)]
    chosen = F.broadcast(few[0].unionByName(few[1]).select("draw"))
    rows = docs.select(F.substring("text", 1, chars).alias("text"), F.xxhash64("text").alias("draw")).join(chosen, "draw").dropDuplicates(["draw"]).orderBy("draw").collect()  # 2 * sample rows at most
    features, labels = training_windows([r.text for r in rows], windows)
    if not labels.any():
        return Field(np.zeros((sum(_SIZES), 3)), np.zeros((3, 3)), np.array([1.0, 0.0, 0.0]))
    return fit_field(features, labels)


def crf_spans(field: Field, column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """For each text, the byte spans that the field tags as secrets."""
    data, at = _views(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        t = tokens(data[at[first] : at[last]], at[first : last + 1] - at[first])
        tags = tagged(field, _emissions(field, t.features), t.bound) if len(t.start) else np.zeros(0, np.int8)
        on = np.flatnonzero(tags)
        doc = np.searchsorted(t.bound, on, "right") - 1
        found: list[list[tuple[int, int]]] = [[] for _ in range(last - first)]
        before = -2
        for i, d in zip(on.tolist(), doc.tolist(), strict=True):
            a, b = int(t.start[i] - at[first + d] + at[first]), int(t.end[i] - at[first + d] + at[first])
            if tags[i] == INSIDE and before == i - 1 and found[d]:
                a = found[d].pop()[0]
            found[d].append((a, b))
            before = i
        yield from found
        first = last


def all_spans(text: str, tagged_: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The patterns' spans and, of the tagged byte spans (ascending), those that touch none of them."""
    base = pattern_spans(text)
    if not tagged_:
        return base
    data, more, at, chars = text.encode(), [], 0, 0
    for a, b in tagged_:
        chars += len(data[at:a].decode(errors="ignore"))
        at, size = a, len(data[a:b].decode(errors="ignore"))
        more.append(("crf", chars, chars + size))
    ends = list(accumulate((e for _, _, e in base), max))  # how far the first so many spans reach
    starts = [s for _, s, _ in base]
    free = [m for m in more if not (n := bisect_left(starts, m[2])) or ends[n - 1] <= m[1]]
    return sorted(base + free, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of ``docs`` and n_assign, n_access, n_hex, n_crf, base_sha256, spans, masked (the text with each secret as [SECRET]).

    ``docs`` needs text; columns of those names are replaced. Null counts as empty: no spans,
    the digest of nothing, and masked stays null. Spans are kind:start:end in code points, by
    start, then kind in the order assign, access, hex, crf. Equal texts have equal spans.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    types = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_crf", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())]

    def some(column: pa.Array) -> pa.Array:
        rows = []
        for text, found in zip(column.to_pylist(), crf_spans(held.value, column), strict=True):
            spans = all_spans(text or "", found)
            base = [s for s in spans if s[0] != "crf"]
            n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), masked(text, spans)))
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])

    def run(column: pa.Array) -> pa.Array:
        found = pa.concat_arrays([some(column.slice(i, TEXTS)) for i in range(0, max(1, len(column)), TEXTS)])
        give_back()
        return found

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    result = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_crf:bigint,base_sha256:string,spans:string,masked:string>"
    names = ("n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans", "masked")
    return docs.drop(*names).withColumn("__scan", F.arrow_udf(result)(run)("text")).select("*", "__scan.*").drop("__scan")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]
