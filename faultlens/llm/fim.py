"""Fill-in-middle: texts cut into prefix, middle and suffix at token borders and rearranged around three marks.

Each text is decoded to an array of UTF-32 code points. Where the class of neighbours changes from other
signs to white space a token ends; the places of these changes, by ``flatnonzero``, are the borders, and
the ranks that a row's hash chooses are looked up in them. The pieces are slices of the array, encoded again.

The hash is the SHA-256 of ``seed:doc_id``, so that a row gets the same form whatever the partitions, and
again after an executor is lost. The output has one way back: marks don't occur in the pieces, since a
text that contains one is left plain, and no mark can arise over the border of a piece and a mark.

Defined results: null text is empty; an empty text, or one with a mark, is plain, its output is the text
and its pieces are null; a null doc_id is hashed as an empty one; repeated rows give the same result each;
other columns are ignored; an empty table gives no rows. A text is read as a whole, however long: a task
holds one text as code points (4 bytes each) and the outputs of a batch of at most ``BATCH`` bytes or one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import WHITE, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Outputs are handed over once they have this many bytes.
BATCH = 8 << 20

OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def borders(points: np.ndarray) -> np.ndarray:
    """Where the tokens of a text of code points start, and its end: n + 1 places, the first is 0."""
    if not len(points):
        return np.zeros(1, np.int64)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1  # a token is white space and what follows it up to the next white space
    return np.concatenate([[0], ends, [len(points)]])


def chosen(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits for a row."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(text: bytes, h: tuple[int, int, int, int], rate: int = 50, suffix_first: int = 80) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix and of the middle, output) of a text."""
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    at = borders(points)
    n = len(at) - 1
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not len(points) or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted(int(at[x % (n + 1)]) for x in h[:2])
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le").encode("utf-8") for i, j in ((0, a), (a, b), (b, len(points))))
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle))
    return n, "psm", a, b - a, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle))


def _transform(seed: int, rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.large_binary() if f.name == "output" else f.type).cast(f.type) for f, c in zip(OUT, zip(*rows, strict=True), strict=True)], schema=OUT)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # few texts as Python objects at a time
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    rows.append((doc_id, *rearranged(text, chosen(seed, doc_id), rate, suffix_first)))
                    size += len(text)
                    if size >= BATCH:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of each row of ``docs`` (doc_id, text).

    ``rate`` of 100 texts are rearranged, ``suffix_first`` of 100 of those with the suffix first.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_transform(seed, rate, suffix_first), DDL)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)  # nothing, then the pieces in the output's order
    in_order = lambda *k: F.concat(*(F.get(parts, F.lit(i)) for i in k))
    return F.when(form == "psm", in_order(1, 3, 2)).when(form == "spm", in_order(2, 3, 1)).otherwise(output)
