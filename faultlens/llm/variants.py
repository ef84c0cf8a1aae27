"""Spelling variants: words one edit apart, by two-dimensional range reporting over wavelet trees.

1. Runs of letters are counted in the tasks that read the texts, words of enough occurrences are kept.
2. Two words of m code points that differ at place i have the first i and the last m - i - 1 code points in common, and a word
   with one more has the first i and the last m - i. In an index of words of one length those with a
   prefix are an interval of the words in forward order, those with a suffix an interval of the words in reverse order; the
   words with both are the points of a rectangle, which a wavelet tree over (forward rank, reverse rank) reports.
3. The edit lies in the second half of the shorter word, and both have its first half, or in its first half, and both have
   its second. So words are dealt by either half, and a task asks the trees of its halves only: for places in the
   second half those of the first half's words, and the other way round. A half of very many words is dealt in
   cells of at most ``BLOCK`` words that are asked by at most ``BLOCK`` words.
4. A word's form is its near word of most occurrences; roots by pointer doubling.

Defined results: words are of A-Z, a-z and U+00C0 to U+00FF, only A-Z are lower-cased; null has none; a null doc_id is
written as an empty one in the hash; repeated rows count each; of near words with the same n the first in code-point order
is the form; extra columns are ignored; without words there are no rows. A text is read as a whole, however
long; a task holds one text, the words that it has counted (``HELD`` at most) and one index.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import staged, utf8
from faultlens.llm.decontaminate import hot_join

#: Words that an index holds, and that ask one, before further ones are dealt to others.
BLOCK = 1 << 16
#: Distinct words that a task counts before it hands them over.
HELD = 200_000

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
FOUND = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
FOUND_DDL = "word string, n long, near string, near_n long"


def _counts(least: int, every: int):
    """(word, n) of a task's texts, each word perhaps several times. Of runs whose hash ``every`` divides one code point is left out."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTS)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # few texts as Python objects at a time
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    lowered = text.lower().decode("utf-8")  # bytes are lower-cased in A-Z only
                    found = runs.findall(lowered) if len(text) < 1 << 22 else (m.group() for m in runs.finditer(lowered))
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), before)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                    if len(held) > HELD:
                        yield made()
                        held.clear()
        if held:
            yield made()

    return run


def vocabulary(docs: DataFrame, least: int = 5, occurrences: int = 3, every: int = 97) -> DataFrame:
    """(word, n): words of at least ``least`` code points and how often they occur in ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = texts.mapInArrow(_counts(least, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class WaveletTree:
    """A sequence of the numbers 0 to n - 1 as a wavelet tree, level by level: how many of the first i of a level go to the left."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, (len(values) - 1).bit_length())
        self.left: list[np.ndarray] = []
        for level in reversed(range(self.depth)):
            bit = (values >> level) & 1 == 1
            self.left.append(np.concatenate([[0], np.cumsum(~bit)]))
            values = np.concatenate([values[~bit], values[bit]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, value) for each value from c[k] to below d[k] at the places from a[k] to below b[k]."""
        k = np.flatnonzero((a < b) & (c < d))
        a, b, low = a[k], b[k], np.zeros(len(k), np.int64)
        for left, level in zip(self.left, reversed(range(self.depth)), strict=True):
            middle = low + (1 << level)
            a0, b0 = left[a], left[b]
            a1, b1 = left[-1] + a - a0, left[-1] + b - b0
            down, up = (a0 < b0) & (c[k] < middle), (a1 < b1) & (d[k] > middle)
            k, a, b, low = (np.concatenate([x[down], y[up]]) for x, y in ((k, k), (a0, a1), (b0, b1), (low, middle)))
        return k, low


def _interval(ordered: np.ndarray, asked: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted words ``ordered`` begin with the first ``m`` code points of each of ``asked``; both a matrix with a word in each row."""
    if m == 0:
        return np.zeros(len(asked), np.int64), np.full(len(asked), len(ordered), np.int64)
    keys, wanted = (np.ascontiguousarray(x[:, :m]).view(f"S{m}").ravel() for x in (ordered, asked))
    return np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")


class PairIndex:
    """Words of one length, as rows of a matrix of Latin-1 code points, in forward and in reverse order."""

    def __init__(self, words: np.ndarray):
        size = words.shape[1]
        self.words = words
        forward = np.argsort(words.view(f"S{size}").ravel(), kind="stable")
        back = np.ascontiguousarray(words[:, ::-1])
        self.reverse = np.argsort(back.view(f"S{size}").ravel(), kind="stable")
        self.forward_words, self.reverse_words = words[forward], back[self.reverse]
        rank = np.empty(len(words), np.int64)
        rank[self.reverse] = np.arange(len(words))
        self.tree = WaveletTree(rank[forward])

    def between(self, asked: np.ndarray, prefix: int, suffix: int, more_than: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(k, word): the words that begin with the first ``prefix`` and end with the last ``suffix`` code points of asked[k].

        Not asked where the words with either are no more than ``more_than``.
        """
        a, b = _interval(self.forward_words, asked, prefix)
        many = np.flatnonzero(b - a > more_than)
        if not len(many):
            return many, many
        c, d = _interval(self.reverse_words, asked[many, ::-1], suffix)
        limit = more_than if isinstance(more_than, int) else more_than[many]
        enough = d - c > limit
        many, c, d = many[enough], c[enough], d[enough]
        k, rank = self.tree.report(a[many], b[many], c, d)
        return many[k], self.reverse[rank]


def near_pairs(asked: np.ndarray, own: np.ndarray, same: np.ndarray, longer: np.ndarray, places: range) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Pairs one edit apart: ("same", k, i) for asked[k] and same[i], ("longer", k, i) for asked[k] and longer[i], each pair once.

    ``places`` are those of the code point replaced, or before which one is inserted, of words of m code
    points; ``own`` says which of ``asked`` is among ``same`` too.
    """
    m = asked.shape[1]
    by_length = PairIndex(same) if len(same) else None
    one_more = PairIndex(longer) if len(longer) else None
    for i in places:
        if by_length and i < m:
            k, w = by_length.between(asked, i, m - i - 1, own.astype(np.int64))
            other = same[w, i] != asked[k, i]  # not the word itself
            yield "same", k[other], w[other]
        if one_more:
            k, w = one_more.between(asked, i, m - i)
            if i < m:  # of the places where the insertion gives the same word the last one counts
                last = longer[w, i] != asked[k, i]
                k, w = k[last], w[last]
            yield "longer", k, w


def _near():
    """Rows (size, side, cell, half, word, n, ask, hold), sorted by the first four -> ``FOUND``.

    A group's halves are gathered to indexes of about ``BLOCK`` words; ``size`` is the length of the
    shorter words, ``side`` 0 where words have their first half in common.
    """

    def found(group: tuple, words: list[str], n: list[int], ask: list[bool], hold: list[bool]) -> Iterator[pa.RecordBatch]:
        size, side = group[:2]
        length = np.fromiter(map(len, words), np.int64, len(words))
        n, ask, hold = np.array(n, np.int64), np.array(ask), np.array(hold)
        at = [np.flatnonzero(x) for x in (ask, hold & (length == size), hold & (length == size + 1))]
        asked, same, longer = (np.frombuffer("".join(words[i] for i in x).encode("latin-1"), np.uint8).reshape(len(x), size + (x is at[2])) for x in at)
        half = size // 2
        for kind, k, w in near_pairs(asked, hold[at[0]], same, longer, range(half, size + 1) if side == 0 else range(half)):
            a, b = at[0][k], at[1 if kind == "same" else 2][w]
            if kind == "longer":  # these ask for no shorter ones
                a, b = np.concatenate([a, b]), np.concatenate([b, a])
            if len(a):
                names = pa.array(words, pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), pa.array(n[a]), names.take(pa.array(b)), pa.array(n[b])], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, half, rows = None, None, ([], [], [], [])
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*cols[:3], strict=True))
            for i in range(batch.num_rows):
                if keys[i] != group or (cols[3][i] != half and len(rows[0]) >= BLOCK):
                    if rows[0]:
                        yield from found(group, *rows)
                    group, rows = keys[i], ([], [], [], [])
                half = cols[3][i]
                for r, c in zip(rows, cols[4:], strict=True):
                    r.append(c[i])
        if rows[0]:
            yield from found(group, *rows)

    return run


def near_words(words: DataFrame, least: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): each two of ``words`` (word, n) that are one edit apart, both ways."""
    length = F.length("word")
    sizes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).filter(F.col("size") >= least)
    half = F.floor(F.col("size") / 2).cast("int")
    halves = sizes.select("word", "n", "size", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")), F.struct(F.lit(1).alias("side"), F.right("word", F.col("size") - half).alias("half")))).alias("x")).select("word", "n", "size", "x.side", "x.half")
    group = ["size", "side", "half"]
    large = halves.groupBy(*group).agg(F.count("*").alias("words")).filter(F.col("words") > block).select(*group, F.ceil(F.col("words") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    rows = halves.join(large, group, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    # a cell (i, j) holds the words of block i, and those of block j ask
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.array_union(F.transform(each, lambda x: F.col("own") * F.col("blocks") + x), F.transform(each, lambda x: x * F.col("blocks") + F.col("own")))
    rows = rows.withColumn("cell", F.explode(cells))
    hold, ask = F.floor(F.col("cell") / F.col("blocks")) == F.col("own"), (F.col("cell") % F.col("blocks") == F.col("own")) & (F.length("word") == F.col("size"))
    rows = rows.select("size", "side", "cell", "half", "word", "n", ask.alias("ask"), hold.alias("hold")).filter("ask or hold")
    dealt = rows.repartition("size", "side", "cell", "half").sortWithinPartitions("size", "side", "cell", "half")
    return dealt.mapInArrow(_near(), FOUND_DDL)


def spelling_variants(words: DataFrame, times: int = 2, least: int = 5, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of ``words`` (word, n).

    The form is the near word of most occurrences, if these are at least ``times`` the word's; the root is the last one when forms are followed.
    """
    words = staged(words.select("word", "n"), "words")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), "near"))).alias("best")
    of_word = near_words(words, least, block).unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    form = F.when(-F.col("best.n") >= times * F.col("n"), F.struct(F.col("best.near").alias("word"), (-F.col("best.n")).alias("n")))
    forms = staged(of_word.select("word", "n", "n_near", form.alias("form")).select("word", "n", "n_near", F.col("form.word").alias("form"), F.col("form.n").alias("form_n")), "forms")
    to = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(hot_join(to, further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        to = after.select("word", "root")
        if not after.filter("moved").take(1):
            return forms.join(to, "word").select("word", "n", "n_near", "form", "form_n", "root")
