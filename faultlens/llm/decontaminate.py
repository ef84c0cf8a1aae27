"""Benchmark decontamination by winnowing: which words of a document lie in a passage of a benchmark item.

1. Of every ``span`` consecutive words the smallest hash of their ``gram``-word grams is the fingerprint. A
   shared run of ``span`` words or more has the same grams on both sides and hence at least one fingerprint
   in common: that is the guarantee, and no document needs to be compared by all of its grams.
2. Fingerprints of documents are joined with those of the benchmark. A Bloom filter of the benchmark's
   fingerprints and windows, of ``filter_bytes`` at most, keeps most others from being written; a benchmark
   that is too large for it costs more rows in the shuffle and changes no result.
3. Hits are extended to the windows of ``span`` words that chose the fingerprint, and these are joined with
   the benchmark's windows. Windows that follow each other become one run of words.
4. Items: windows with the same items form a class, and documents with the same classes a signature. Items are
   listed once for each signature, so that a passage in very many documents or items isn't paired with each.

An item of fewer words than ``span`` is one window of its own length; as any place of a document can match it,
each gram of that length is a fingerprint (winnowing over windows of one gram).

Keys that many rows share (a common passage, a signature) are counted first; those of over a ``HOT``-th of all rows, of which
there are fewer than ``HOT``, are joined by a broadcast and the others by a shuffle.

Defined results: words are runs of ASCII letters, lower-cased, digits and signs beyond ASCII; null has no words; every
row is a document of its own, rows that are the same get the same result each; a null item_id marks words but isn't listed;
rows of one item_id are one item; other columns are ignored; empty tables give no rows, or rows without hits.
Texts are read as a whole, however long: a task holds one text with about 80 bytes a word, and some 40 MB of work space.
Words, grams and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import staged, utf8
from faultlens.llm.ngram_join import _BASE, _grams, _mix, word_sums

#: What words are made of, once A-Z are lower-cased.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words of more bytes are hashed one by one.
LONG = 4096
#: A key of over this part of all rows is joined by a broadcast.
HOT = 200

BENCH = pa.schema([("item_id", pa.string()), ("print", pa.int64()), ("window", pa.int64()), ("width", pa.int32())])
BENCH_DDL = "item_id string, print long, window long, width int"
SCAN = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("print", pa.int64()), ("start", pa.int64()), ("windows", pa.list_(pa.int64()))])
SCAN_DDL = "key binary, doc_id long, n_words long, print long, start long, windows array<long>"


def words_of(text: bytes, together: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words and where they start, hashed about ``together`` bytes at a time."""
    b = np.frombuffer(text.lower(), np.uint8)
    inside = _IS_WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "big")
        inside[starts[i] : ends[i]] = False
    short = np.flatnonzero(ends - starts <= LONG)
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(starts[short], starts[short[at]] + together)))
        part = short[at:to]
        lengths = ends[part] - starts[part]
        piece = slice(starts[part[0]], ends[part[-1]])
        out[part] = word_sums(b[piece][inside[piece]], np.cumsum(lengths) - lengths)
        at = to
    return out, starts


def smallest(grams: np.ndarray, of: int) -> np.ndarray:
    """The smallest of each ``of`` grams that follow each other."""
    if len(grams) < of:
        return grams[:0]
    out = grams[: len(grams) - of + 1].copy()
    for i in range(1, of):
        np.minimum(out, grams[i : len(grams) - of + 1 + i], out=out)
    return out


def _items(span: int, gram: int):
    """The windows of items, each with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                w = words_of(text)[0]
                if not len(w):
                    continue
                width = min(span, len(w))
                windows = _grams(w, width)
                prints = smallest(_grams(w, gram), span - gram + 1) if width == span else windows
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(windows), pa.string()), pa.array(prints.view(np.int64)), pa.array(windows.view(np.int64)), pa.array(np.full(len(windows), width, np.int32))], schema=BENCH)

    return run


class PrintFilter:
    """A Bloom filter over 64-bit hashes: two bits a hash."""

    def __init__(self, hashes: DataFrame, most_bytes: int):
        n = hashes.count()
        self.words = max(1, min(most_bytes // 8, n // 4 + 1))  # 16 bits a hash
        h = F.col("h")
        word = lambda i: F.pmod(F.shiftrightunsigned(h, 13 * i).bitwiseAND(2**40 - 1), F.lit(self.words))
        bit = lambda i: F.shiftrightunsigned(h, 58 - 6 * i).bitwiseAND(63).cast("int")
        marks = hashes.select(F.explode(F.array(*(F.struct(word(i).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)).alias("bits")) for i in range(2)))).alias("x"))
        found = marks.groupBy("x.word").agg(F.bit_or("x.bits").alias("bits")).toArrow()  # a number for each word of the filter
        bits = np.zeros(self.words, np.int64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.bits = bits.view(np.uint64)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for i in range(2):
            word = (h >> np.uint64(13 * i)) & np.uint64(2**40 - 1)
            bit = (h >> np.uint64(58 - 6 * i)) & np.uint64(63)
            out &= (self.bits[(word % np.uint64(self.words)).astype(np.int64)] >> bit) & np.uint64(1) == 1
        return out


def _scan(span: int, gram: int, short: list[int], prints, together: int = 1 << 20):
    """For each text a row with its number of words, and rows of its fingerprints that the filter holds.

    ``windows`` are those from word ``start`` on that follow each other and have the fingerprint.
    """

    def rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        may = prints.value.may_hold
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        w, starts = words_of(b" ".join(texts))
        cuts = np.searchsorted(starts, begins)
        of = np.repeat(np.arange(len(texts)), np.diff(cuts))
        keys = [hashlib.sha256(f"{i}:".encode() + t).digest()[:16] for i, t in zip(ids, texts, strict=True)]
        found = []  # (first words, fingerprints, windows, how many windows of each)
        if len(w) >= span:
            least = smallest(_grams(w, gram), span - gram + 1)
            run = np.ones(len(least), bool)
            np.not_equal(least[1:], least[:-1], out=run[1:])
            at = np.flatnonzero(run)
            s = np.flatnonzero(np.repeat(may(least[at]), np.diff(np.append(at, len(least)))))
            s = s[of[s] == of[s + span - 1]]
            total = np.full(len(s), span, np.uint64)
            if len(s):
                windows = _grams_at(w, s, span, total)
                keep = may(windows)
                s, windows = s[keep], windows[keep]
            else:
                windows = total
            if len(s):
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1] + 1) | (least[s[1:]] != least[s[:-1]]) | (of[s[1:]] != of[s[:-1]])
                first = np.flatnonzero(new)
                found.append((s[first], least[s[first]], windows, np.diff(np.append(first, len(s)))))
        for width in short:
            grams = _grams(w, width)
            s = np.flatnonzero(may(grams))
            s = s[of[s] == of[s + width - 1]]
            if len(s):
                found.append((s, grams[s], grams[s], np.ones(len(s), np.int64)))
        n = len(texts)
        first, fingerprints, windows, many = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        docs = of[first]
        nulls = np.concatenate([np.ones(n, bool), np.zeros(len(first), bool)])
        row = np.concatenate([np.arange(n), docs])
        offsets = np.concatenate([np.zeros(n, np.int64), np.cumsum(np.append(0, many))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.binary()).take(pa.array(row)),
                pa.array(ids, pa.int64()).take(pa.array(row)),
                pa.array(np.diff(cuts)[row]),
                pa.array(np.concatenate([np.zeros(n, np.int64), fingerprints.view(np.int64)]), mask=nulls),
                pa.array(np.concatenate([np.zeros(n, np.int64), first - cuts[docs]])),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(windows.view(np.int64))),
            ],
            schema=SCAN,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i in range(0, batch.num_rows, 256):  # few texts as Python objects at a time
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    if texts and size + len(text) > together:
                        yield rows(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text) + 1
            if texts:
                yield rows(ids, texts)

    return run


def _grams_at(w: np.ndarray, s: np.ndarray, k: int, total: np.ndarray) -> np.ndarray:
    """The hashes of the ``k``-word grams that start at ``s``, as ``_grams`` has them."""
    for i in range(k):
        total = _mix(total * _BASE + w[s + i])
    return total


def hot_join(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """An inner join with a table that is unique by ``on``; its hot keys are told to every task."""
    counts = rows.groupBy(on).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = F.broadcast(table.join(F.broadcast(counts.filter(F.col("n") * HOT > total).select(on)), on))
    rest = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(table, on))


class Benchmark:
    """The staged windows of a benchmark (item_id, text), their fingerprints, and the filter over both."""

    def __init__(self, items: DataFrame, span: int = 10, gram: int = 5, filter_bytes: int = 16 << 20):
        self.span, self.gram = span, gram
        texts = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
        raw = staged(texts.mapInArrow(_items(span, gram), BENCH_DDL).distinct(), "benchmark-windows")
        of_window = raw.groupBy("print", "window", "width").agg(F.count("item_id").alias("n"), F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("item_id", F.lit(2))).alias("y"))
        of_window = staged(of_window, "benchmark-signatures")
        same = ["n", "x", "y"]
        classes = of_window.groupBy(*same).agg(F.min("window").alias("cls"))  # by one of its windows
        #: (print, window, width, cls), one row a window
        self.windows = staged(of_window.join(classes, same).select("print", "window", "width", "cls"), "benchmark-classes")
        #: (cls, item_id)
        self.items = staged(raw.filter("item_id is not null").join(classes.select(F.col("cls").alias("window")), "window").select(F.col("window").alias("cls"), "item_id").distinct(), "benchmark-items")
        #: widths of the items that have fewer words than ``span``
        self.short = sorted(r.width for r in self.windows.select("width").distinct().collect() if r.width < span)
        self.prints = self.windows.select("print").distinct()
        self.filter = PrintFilter(self.prints.union(self.windows.select("window")).select(F.col("print").alias("h")), filter_bytes)


def contamination(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, spans, n_items, items, items_sha256.

    ``spans`` are the hit words as runs (start, end), counted from 0, ``items`` the ids, sorted as strings.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scan = _scan(benchmark.span, benchmark.gram, benchmark.short, spark.sparkContext.broadcast(benchmark.filter))
    scanned = staged(texts.mapInArrow(scan, SCAN_DDL), "fingerprints")
    heads = scanned.filter("print is null").groupBy("key", "doc_id", "n_words").agg(F.count("*").alias("copies"))
    # rows that are the same have the same key and the same hits
    hits = staged(hot_join(scanned.filter("print is not null").dropDuplicates(["key", "start", "print"]), benchmark.prints, "print"), "fingerprint-hits")
    each = hits.select("key", "start", F.posexplode("windows").alias("i", "window")).select("key", (F.col("start") + F.col("i")).alias("start"), "window")
    found = staged(hot_join(each, benchmark.windows.select("window", "width", "cls"), "window").select("key", "start", (F.col("start") + F.col("width")).alias("end"), "cls"), "window-hits")

    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = found.select("key", "start", "end").withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)))
    numbered = cut.withColumn("run", F.count_if("new").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    of_doc = staged(found.select("key", "cls").distinct(), "classes-of-documents")
    signature = of_doc.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(2))).alias("y"))
    signature = staged(signature.select("key", F.sha2(F.concat_ws(",", "n", "x", "y"), 256).alias("signature")), "signatures")
    one = signature.groupBy("signature").agg(F.min("key").alias("key"))
    listed = of_doc.join(one, "key").join(benchmark.items, "cls").select("signature", "item_id").distinct()
    listed = listed.groupBy("signature").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    listed = listed.select("signature", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    told = hot_join(signature, one.select("signature").join(listed, "signature", "left"), "signature")

    out = heads.join(spans, "key", "left").join(told, "key", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        none("spans", "array<struct<start:bigint,end:bigint>>"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        none("items", "array<string>"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        "copies",
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
