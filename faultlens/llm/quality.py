"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Votes are counted by pattern over
all documents, and expectation-maximisation over the patterns estimates each labeller's accuracy and
the share of good texts without any true label. The posterior of a text's pattern is the label on
which a hashed linear scorer (logistic regression) is trained; the scorer decides.

Everything is counted in code points and by classes of characters that are the same for all scripts:
letters by their case if they have one, and signs of other scripts as the ASCII sign of their use. In
scripts without spaces each letter counts as a word. Labellers that need what a script lacks (cases,
lengths of words that are like Latin ones) abstain, and the scorer sees an ordinary text's value instead.

Features of the scorer: shares of the trigrams of character classes, hashed, and binned statistics of
the text, hashed. Both are made of the whole text. Each text is measured once for the label model and once
for the scorer, as keeping the measures would take more room than the text.

Defined results: a null, empty or blank text has score 0 and is rejected; when nothing could be learned
(no text, or a single class) the posterior is the score; rows that repeat give repeated results; a null
doc_id is scored like any other; extra columns are ignored; an empty table gives no rows; a score
that equals the threshold is kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import place, staged
from faultlens.llm.ngram_join import word_sums

BAD, GOOD, NONE = 0, 1, 2


#: Signs of other scripts by the ASCII sign of their use.
LIKE = {".": "。．｡।॥۔…‥։።", "?": "？؟;", "!": "！", ",": "，、､،﹐", ";": "；؛", ":": "：", "'": "‘’‚‹›＇", '"': "“”„«»「」『』《》〈〉＂", "(": "（【〔", ")": "）】〕", "-": "‐‑–—―－·"}
WHITE_, LOWER, UPPER, DIGIT, OTHER, UNSPACED = 0, 1, 2, 3, 40, 41
N_CLASSES = 42
#: Scripts that don't put spaces between words, as ranges of code points: Thai to Tibetan's end, Myanmar, Khmer, kana, Han.
NO_SPACES = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Beyond, a full stop ends a sentence whatever follows it.
FULL_WIDTH = 0x2E80
#: Share of Latin letters from which on lengths of words are compared.
LATIN = 0.8


def _classes() -> np.ndarray:
    """Code point -> class: white space, letter without case or lower case, upper case, digit, or the sign itself."""
    out = np.full(0x110000, OTHER, np.uint8)
    sign = 4
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = WHITE_
        elif ch.isalpha():
            out[c] = UPPER if ch.isupper() else LOWER
        elif ch.isdigit():
            out[c] = DIGIT
        elif c < 128:
            if ch.isprintable():
                out[c] = sign
                sign += 1
        elif unicodedata.category(ch) in ("Mn", "Mc", "Cf"):  # marks and joiners are of the letter before
            out[c] = LOWER
    for a, z in NO_SPACES:
        part = out[a : z + 1]
        part[part == LOWER] = UNSPACED
    for ascii_, others in LIKE.items():
        for ch in others:
            out[ord(ch)] = out[ord(ascii_)]
    return out


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def _of(signs: str) -> np.ndarray:
    """Which classes are those of these ASCII signs."""
    out = np.zeros(N_CLASSES, bool)
    out[_table()[[ord(x) for x in signs]]] = True
    return out


@dataclass(frozen=True)
class Stats:
    """What labellers and scorer see of a text."""

    words: int
    repeated: float  # words that equal the one before
    distinct: float  # distinct words, of as many as a text of that length can be expected to have
    upper: float | None  # upper-case among letters with a case
    signs: float  # signs other than plain punctuation, a word
    bars: float  # words that are only signs
    short: float | None  # runs of letters of at most three
    mean: float | None  # length of a run of letters
    ends: float  # sentence ends, a word
    overlong: float  # words in stretches of more than 110 without a sentence end, of all


def measure(text: str) -> tuple[Stats, np.ndarray]:
    """The statistics and the classes of a text's characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32) if not text.isascii() else np.frombuffer(text.encode(), np.uint8)
    c = _table()[points]
    inside = c > WHITE_
    if not inside.any():
        return Stats(0, 0, 0, None, 0, 0, None, None, 0, 0), c
    alone = c == UNSPACED
    spaced = not alone.any()
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] if spaced else ~inside[:-1] | alone[1:] | alone[:-1] & (c[1:] <= DIGIT)
    first = np.flatnonzero(starts[inside])  # of each word, among the characters that aren't white space
    n = len(first)
    kept = c[inside]
    w = _hashes(text, points, inside, first)
    counts = np.bincount(c, minlength=N_CLASSES)
    letters = counts[LOWER] + counts[UPPER] + counts[UNSPACED]
    plain = _of(".,;:?'\"()-")
    signs = counts[4:UNSPACED].sum() - counts[plain].sum()
    letter = (kept <= DIGIT) | (kept == UNSPACED)
    bare = np.add.reduceat(letter, first, dtype=np.int64) == 0
    # a sentence end: before white space, a closing sign or the end, or a full-width one
    end = _of(".?!")[c]
    blank = np.append(~inside[1:], True)
    if end.any():
        end &= blank | np.append(_of("'\")")[c[1:]], True) | (points >= FULL_WIDTH)
    if not spaced:  # where words have no spaces, one ends a sentence
        end |= alone & blank
    stop = np.unique(np.cumsum(starts)[end]) - 1
    gaps = np.diff(np.concatenate([[-1], stop, [n - 1]]))
    distinct = len(np.unique(w)) / min(n, 20 + 4 * n**0.5)
    latin = letters and np.count_nonzero(points[(c == LOWER) | (c == UPPER)] < 0x250) >= LATIN * letters
    short, mean = None, None
    if latin:
        a, z = _runs((c >= LOWER) & (c <= DIGIT))
        lengths = z - a
        short, mean = float((lengths <= 3).mean()), float(lengths.mean())
    cased = counts[UPPER] >= 0.02 * letters or latin
    upper = counts[UPPER] / max(1, counts[LOWER] + counts[UPPER]) if cased else None
    return Stats(n, float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0, min(1.0, distinct), upper, signs / n, float(bare.mean()), short, mean, len(stop) / n, float(gaps[gaps > 110].sum() / n)), c


def _hashes(text: str, points: np.ndarray, inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in lower case where that keeps the places of characters."""
    low = text.lower()
    if len(low) == len(text):
        points = np.frombuffer(low.encode(), np.uint8) if low.isascii() else np.frombuffer(low.encode("utf-32-le"), np.uint32)
    return word_sums(points[inside], first)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def votes(s: Stats) -> tuple[int, ...]:
    """One vote of each labeller; between the fixed thresholds, and on texts too short to tell, there is none."""
    few, some = s.words < 5, s.words < 20
    return (
        NONE if few else BAD if s.repeated > 0.2 else GOOD if s.repeated < 0.08 else NONE,
        NONE if few else BAD if s.distinct < 0.5 else GOOD if s.distinct > 0.7 else NONE,
        NONE if few or s.upper is None else BAD if s.upper > 0.5 else GOOD if s.upper < 0.15 else NONE,
        NONE if few else BAD if s.signs > 0.25 else GOOD if s.signs < 0.1 else NONE,
        NONE if few else BAD if s.signs > 0.7 else GOOD if s.signs < 0.2 else NONE,
        NONE if few else BAD if s.bars > 0.2 else GOOD if s.bars < 0.05 else NONE,
        NONE if some or s.short is None else BAD if s.short < 0.08 else GOOD if s.short > 0.2 else NONE,
        NONE if some or s.mean is None else BAD if s.mean > 9.0 else GOOD if s.mean < 6.0 else NONE,
        NONE if some else BAD if s.ends > 0.5 or s.ends < 0.01 and s.words > 60 else GOOD if 0.015 < s.ends < 0.4 else NONE,
        BAD if s.overlong > 0.5 and s.words > 160 else GOOD if s.overlong < 0.2 and not few else NONE,
    )


#: What the scorer sees of a text where a measure says nothing.
ORDINARY = {"upper": 0.03, "short": 0.4, "mean": 4.8}


def features(s: Stats, c: np.ndarray, dims: int) -> np.ndarray:
    """The hashed feature vector of a text."""
    out = np.zeros(dims, np.float32)
    c = c.astype(np.int64)
    alone = np.flatnonzero(c == UNSPACED)
    if len(alone):  # as if every fourth letter ended a word
        c[alone] = LOWER
        c = np.insert(c, alone[3::4] + 1, WHITE_)
    if len(c) > 2:
        code = (c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]
        counts = np.bincount((code * 2654435761 >> 7) % dims, minlength=dims)
        out += np.sqrt(counts / len(code)).astype(np.float32)
    upper, short, mean = (ORDINARY[k] if (v := getattr(s, k)) is None else v for k in ("upper", "short", "mean"))
    for k, v in enumerate((s.repeated, s.distinct, upper, min(s.signs, 4) / 4, min(s.signs, 0.5) * 2, s.bars, short, min(mean, 12) / 12, min(1.0, s.ends * 2), s.overlong, min(1.0, s.words / 50))):
        for at in range(1 + int(v * 9.999)):  # a staircase: each step adds its weight
            out[((k * 16 + at + 1) * 40503) % dims] += 0.3
    return out


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of good for each vote pattern. Labellers are independent given the class; no vote says nothing."""
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([k for _, k in patterns], float)
    share = (v == GOOD).sum(1) / np.maximum(1, (v != NONE).sum(1))
    # at the start a bad vote is strong: labellers are made to be precise in what they reject
    post = np.where((v == BAD).any(1), 0.3 * share, 0.9)
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.02, 0.98)
        log = np.full(len(n), np.log(prior) - np.log(1 - prior))
        for j in range(v.shape[1]):
            weight = lambda which, cls, j=j: (n * cls * (v[:, j] == which)).sum()
            good = (weight(GOOD, post) + 2) / (weight(GOOD, post) + weight(BAD, post) + 2.5)
            bad = (weight(BAD, 1 - post) + 0.5) / (weight(GOOD, 1 - post) + weight(BAD, 1 - post) + 2)
            log += np.where(v[:, j] == GOOD, np.log(good / (1 - bad)), np.where(v[:, j] == BAD, np.log((1 - good) / bad), 0.0))
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes at equal weight, by accelerated gradient steps."""
    weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).sum()), 0.5 / max(1e-9, (y <= 0.5).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    step = 4.0 / max(1e-9, float((weight[:, None] * x * x).sum(0).sum() + weight.sum()))
    for k in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40))) - y)
        nw, nb = vw - step * (x.T @ g + decay * vw), vb - step * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


@dataclass
class Scorer:
    """What both models have learned."""

    posterior: dict[str, float]
    linear: tuple[np.ndarray, float] | None
    dims: int

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Scores, posteriors and votes."""
        found = [measure(t or "") for t in texts]
        v = ["".join(map(str, votes(s))) for s, _ in found]
        post = np.array([self.posterior.get(x, 0.5) for x in v])
        p = post.copy()
        if self.linear and found:
            x = np.array([features(s, c, self.dims) for s, c in found])
            p = 1 / (1 + np.exp(-np.clip(x @ self.linear[0] + self.linear[1], -40, 40)))
        p[[not s.words for s, _ in found]] = 0.0
        return p, post, v


def learn(docs: DataFrame, dims: int = 2048, sample: int = 4000) -> Scorer:
    """The label model of all documents, and the scorer trained on ``sample`` of them, picked by a hash of their ids."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                v = ["".join(map(str, votes(measure(t or "")[0]))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v)], ["doc_id", "votes"])

    voted = staged(rows.mapInArrow(vote, "doc_id long, votes string"), "votes")
    counted = voted.groupBy("votes").count().collect()  # 3 to the number of labellers at most
    patterns = sorted((tuple(map(int, r["votes"])), r["count"]) for r in counted)
    posterior = em(patterns)
    of = {"".join(map(str, p)): x for p, x in posterior.items()}
    # enough by far, so that what is ranked doesn't grow with the table
    ids = voted.agg(F.approx_count_distinct("doc_id")).first()[0]
    few = voted.select("doc_id").filter(place("doc_id") < 8.0 * sample / max(1, ids))
    picked = staged(few.distinct().orderBy(place("doc_id"), "doc_id").limit(sample), "picked")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([features(s, c, dims).tobytes() for s, c in found], pa.binary()), pa.array([of["".join(map(str, votes(s)))] for s, _ in found])], ["x", "y"])

    one = rows.join(picked, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that share an id
    train = one.select("text").mapInArrow(featured, "x binary, y double").collect()  # ``sample`` rows
    y = np.array([r["y"] for r in train])
    linear = None
    if len(train) and (y > 0.5).any() and (y <= 0.5).any():
        linear = fit_scorer(np.array([np.frombuffer(r["x"], np.float32) for r in train], np.float64), y)
    return Scorer(of, linear, dims)


def classify(docs: DataFrame, dims: int = 2048, sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, kept, posterior, votes for each row of ``docs`` (doc_id, text); kept from a score of ``threshold`` on."""
    scorer = learn(docs, dims, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("kept", pa.bool_()), ("posterior", pa.float64()), ("votes", pa.string())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                p, post, v = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold), pa.array(post), pa.array(v)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(score, "doc_id long, score double, kept boolean, posterior double, votes string")


def keep_good(docs: DataFrame, dims: int = 2048, sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    scorer = learn(docs, dims, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(scorer.score(part.column(at).to_pylist())[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)
