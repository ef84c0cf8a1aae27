"""Unigram encoding with the pieces and scores of a SentencePiece model, and decoding.

White space: a marker precedes the text and stands for each space; here the trie holds pieces with the
marker as a space, so that a marker which is itself in a text is no piece and comes back as it was.
Encoding is the segmentation of the highest total score (Viterbi) over a double-array trie of the
pieces' UTF-8 bytes; a character that no piece begins is spelt in byte pieces. Of equal totals the path
whose last piece starts earliest wins, at each position. No piece of a vocabulary spans the start of a
later word, so words are segmented by themselves, each once as long as the cache of a task holds it;
many words are segmented together, position by position, in arrays. If a vocabulary does have such
pieces, whole texts are segmented instead.

Scores are log probabilities. A Unigram model has them; a BPE model has the ranks of its merges instead,
which are by frequency, so that a piece of rank r counts as likely as Zipf's law has it: in proportion
to 1 / (r + 1), over all pieces 1. No score is learned from texts. Ids of a BPE model are therefore those of the likeliest segmentation, not those
of its merges.

Words longer than ``LONG`` bytes are segmented one by one: pieces are matched at many positions together,
and the best totals go on from position to position, so that time grows with length alone.

Defined results: a null or empty text has no pieces and decodes to an empty text; every text decodes to
itself; rows that repeat give repeated results; a null doc_id is encoded like any other; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import utf8

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: What a character without a piece costs below the lowest score.
PENALTY = 10.0
#: Bytes from which on a word is segmented by itself, and positions that are matched together.
LONG, WINDOW = 2048, 1 << 16
_WORD = re.compile(rb" +[^ ]*|[^ ]+")


@dataclass
class DoubleArray:
    """Trie of byte strings: a child of state s by byte c is at base[s] + c if check there is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in sorted(keys.items()):
            at = 0
            for c in key:
                nxt = nodes[at].get(c)
                if nxt is None:
                    nxt = nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nxt
            ends[at] = value
        size = 2 * len(nodes) + 1024
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        free = bytearray(b"\x01") * size
        free[0] = 0
        check[0] = 0
        queue, low = [(0, 0)], 1
        for node, state in queue:
            if node in ends:
                value[state] = ends[node]
            kids = sorted(nodes[node].items())
            if not kids:
                continue
            while not free[low]:
                low += 1
            first = kids[0][0]
            at = low
            while True:
                b = at - first
                if b >= 0 and all(free[b + c] for c, _ in kids):
                    break
                at = free.index(1, at + 1)
            base[state] = b
            for c, kid in kids:
                free[b + c], check[b + c] = 0, state
                queue.append((kid, b + c))
        used = int(np.flatnonzero(check >= 0).max()) + 257
        return cls(base[:used], check[:used], value[:used])


def log_probabilities(scores: np.ndarray, proper: np.ndarray) -> np.ndarray:
    """Scores as they are, or, where those of ``proper`` pieces are ranks (whole numbers, as in BPE models), log probabilities by Zipf's law."""
    ranks = -scores[proper]
    if not len(ranks) or (ranks != np.round(ranks)).any() or (ranks < 0).any() or ranks.max() < len(ranks) - 1:
        return scores
    out = scores.copy()
    out[proper] = -np.log(ranks + 1) - np.log((1 / (ranks + 1)).sum())
    return out


@dataclass
class Pieces:
    trie: DoubleArray
    scores: np.ndarray
    spelling: list[bytes]  # of each id; a space for the marker
    byte_ids: np.ndarray
    unknown: float
    by_word: bool

    @classmethod
    def load(cls, model: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        scores = log_probabilities(scores, np.array([not x for x in special]))
        return cls.of([(t, s, None if not x else "byte" if sp.is_byte(i) else "control") for i, (t, s, x) in enumerate(zip(texts, scores, special, strict=True))])

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str | None]]) -> Pieces:
        """From (piece, score, kind): kind is None, "byte" (piece <0xHH>) or "control"."""
        spelling, keys, byte_ids = [], {}, np.full(256, -1, np.int64)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_ids[int(text[3:5], 16)] = i
                spelling.append(bytes([int(text[3:5], 16)]))
            elif kind == "control":
                spelling.append(b"")
            else:
                spelling.append(text.replace(MARKER, " ").encode())
                keys.setdefault(spelling[-1], i)
        scores = np.array([s for _, s, _ in pieces], float)
        lowest = min((scores[i] for i in keys.values()), default=0.0)
        return cls(DoubleArray.build(keys), scores, spelling, byte_ids, lowest - PENALTY, not any(b" " in k.lstrip(b" ") for k in keys))

    def longest(self) -> int:
        return max(map(len, self.spelling))

    def segment(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Words of like length are segmented together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            longest, end = len(words[order[at]]), at
            if longest > LONG:
                out[order[at]] = self._viterbi_long(words[order[at]])
                at += 1
                continue
            while end < len(order) and len(words[order[end]]) <= min(LONG, longest + 4 + longest // 4) and (end - at) * longest < 400_000:
                end += 1
            part = order[at:end]
            for i, ids in zip(part, self._viterbi([words[i] for i in part]), strict=True):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max(initial=0))
        text = np.zeros((len(words), width + 1), np.int64)
        text[np.repeat(np.arange(len(words)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((len(words), width + 1), np.int32), np.full((len(words), width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((lengths > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            # length of the character here, and whether it is a piece by itself
            lead = text[rows, i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(len(rows), bool)
            here, state, place, k = rows, np.zeros(len(rows), np.int64), np.arange(len(rows)), i
            while len(here):
                nxt = base[state] + text[here, k]
                ok = (k < lengths[here]) & (check[nxt] == state) & (nxt > 0)
                here, state, place = here[ok], nxt[ok], place[ok]
                k += 1
                if not len(here):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    r, p, v = here[hit], place[hit], v[hit]
                    alone[p[char[p] == k - i]] = True
                    total = best[r, i] + self.scores[v]
                    up = total > best[r, k]
                    r, v = r[up], v[up]
                    best[r, k], start[r, k], piece[r, k] = total[up], i, v
            spelt = ~alone
            r, c = rows[spelt], char[spelt]
            total, to = best[r, i] + self.unknown, np.minimum(i + c, lengths[r])
            up = total > best[r, to]
            r, to = r[up], to[up]
            best[r, to], start[r, to], piece[r, to] = total[up], i, -1
        out = []
        for w, n, s, p in zip(words, lengths.tolist(), start.tolist(), piece.tolist(), strict=True):
            ids: list[int] = []
            while n:
                a = s[n]
                if p[n] >= 0:
                    ids.append(p[n])
                else:
                    ids.extend(self.byte_ids[list(w[a:n])][::-1].tolist())
                n = a
            out.append(np.array(ids[::-1], np.int32))
        return out

    def _matches(self, text: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces that start in text[at:end], by start; a character that no piece is has piece -1."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        here = np.arange(at, end)
        lead = text[here]
        char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        begins = (lead < 0x80) | (lead >= 0xC0)
        here = here[begins]
        alone = np.zeros(end - at, bool)
        state, k, found = np.zeros(len(here), np.int64), 0, []
        while len(here):
            inside = here + k < len(text)
            here, state = here[inside], state[inside]
            nxt = base[state] + text[here + k]
            ok = (check[nxt] == state) & (nxt > 0)
            here, state = here[ok], nxt[ok]
            k += 1
            hit = value[state] >= 0
            if hit.any():
                found.append((here[hit], np.full(hit.sum(), k), value[state[hit]]))
                alone[here[hit][char[here[hit] - at] == k] - at] = True
        spelt = np.flatnonzero(begins & ~alone)
        found.append((spelt + at, np.minimum(char[spelt], len(text) - at - spelt), np.full(len(spelt), -1)))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], length[order], piece[order]

    def _viterbi_long(self, word: bytes) -> np.ndarray:
        text = np.frombuffer(word, np.uint8).astype(np.int64)
        n = len(text)
        best, first, last = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
        best[0] = 0
        reach = max(4, self.longest())
        for at in range(0, n, WINDOW):
            end = min(n, at + WINDOW)
            start, length, piece = self._matches(text, at, end)
            score = np.where(piece >= 0, self.scores[piece], self.unknown)
            total, a, p = (x[at : end + reach].tolist() for x in (best, first, last))
            for i, k, v, x in zip((start - at).tolist(), length.tolist(), piece.tolist(), score.tolist(), strict=True):
                t = total[i] + x
                if t > total[i + k]:
                    total[i + k], a[i + k], p[i + k] = t, i + at, v
            best[at : end + reach], first[at : end + reach], last[at : end + reach] = total, a, p
        ids: list[int] = []
        while n:
            a = int(first[n])
            if last[n] >= 0:
                ids.append(int(last[n]))
            else:
                ids.extend(self.byte_ids[list(word[a:n])][::-1].tolist())
            n = a
        return np.array(ids[::-1], np.int32)

    def words(self, text: bytes) -> list[bytes]:
        return ([b" " + text] if not self.by_word else _WORD.findall(b" " + text)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))[1:]


#: Bytes that an entry of the cache of words takes beside its word and ids.
ENTRY = 200


def encode(docs: DataFrame, model: str | Pieces = DEFAULT_MODEL, cache_bytes: int = 128 << 20) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids array<int>, n_pieces, n_byte_pieces, ids_sha256 (of little-endian 32-bit ids), text_sha256.

    The pieces go to the tasks with the function; a task keeps segmented words of ``cache_bytes`` at most, and none longer than ``LONG``,
    as a text in a script without spaces is one word.
    """
    pieces = Pieces.load(model) if isinstance(model, str) else model
    is_byte = np.zeros(len(pieces.spelling), bool)
    is_byte[pieces.byte_ids[pieces.byte_ids >= 0]] = True
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_sha256", pa.string()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                split = [pieces.words(t) for t in utf8(part.column(1))]
                new = list({w for words in split for w in words if w not in known})
                if held > cache_bytes:
                    known, held = {}, 0
                    new = list({w for words in split for w in words})
                known.update(zip(new, (x.tobytes() for x in pieces.segment(new)), strict=True))
                raw = [b"".join(map(known.__getitem__, words)) for words in split]
                for w in new:
                    if len(w) > LONG:
                        del known[w]
                    else:
                        held += len(w) + len(known[w]) + ENTRY
                ids = np.frombuffer(b"".join(raw), np.int32)
                cuts = np.cumsum([0, *(len(r) // 4 for r in raw)])
                spelt = np.concatenate([[0], np.cumsum(is_byte[ids])])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(cuts), pa.int64()), pa.array(np.diff(spelt[cuts]), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), part.column(2)], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, ids_sha256 string, text_sha256 string")


def decode(encoded: DataFrame, model: str | Pieces = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with a column ids -> the same columns with ``decoded``, the text, in the place of ids."""
    pieces = Pieces.load(model) if isinstance(model, str) else model
    rest = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cuts = part.column(0).offsets.to_numpy()
                ids = part.column(0).values.to_numpy(zero_copy_only=False)
                texts = [pieces.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.binary()).cast(pa.string())], [*rest, "decoded"])

    schema = encoded.select(*rest).schema.add("decoded", "string")
    return encoded.select("ids", *rest).mapInArrow(run, schema)
