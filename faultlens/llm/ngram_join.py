"""N-gram Jaccard join over prefix trees, and its connected components.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes. Equal sets are met first
   (one representative each), so that groups of copies cost one member.
2. Two sets that link share one of the first ``n - ceil(t n) + 1`` shingles of either in a global order.
   In ascending document frequency these are mostly unique to their text, which rules out most texts.
   Frequencies are first counted in a fixed share of the hash universe, which comes before the rest; the
   texts that stay are then ordered by the frequencies of all their shingles among themselves.
3. Of each shared first shingle the text that has it earliest is the hub. A hub is looked up in tries of
   its members: sets in one global order, the shingles that most texts have first, form a prefix tree; a
   traversal carries the overlaps of many probes along shared paths, and a subtree is pruned once the
   remaining lengths can't reach the overlap needed.
4. Members that don't link with their hub are loose. Pairs of a loose text and any other under the same
   first shingle, of another component, are found by tries of the loose ones, in blocks: by shingle and
   band of sizes, as sizes of linked texts differ by the threshold at most. Texts that can link with
   none in their bands, for what remains behind the shingle, are left out, and so are those that are far
   from the hub against those that link with it (triangle inequality of the Jaccard distance). So no
   pairs are emitted within groups that hang together, and no link between different components is lost.
5. Components of the verified links, by star rounds over staged edges.

Hubs with many members, and blocks with many probes, are salted; frequencies and hubs are pre-aggregated
before the shuffle. Where very many texts under one shingle are alike but for less than the threshold, and
none links with its hub, the tries of step 4 test each block against each block, spread over all tasks.

Defined results: a text is lower-cased in A-Z and split at ASCII white space; one with fewer words than
a shingle has its whole sequence as one; a null, empty or blank text has no shingles, links with
nothing and is its own component; rows that repeat an id are one document, with the least of its texts by
code points (null only if all are), and each gets that one's result; a null id links with
nothing and has a null component; extra columns are ignored; an empty table gives no rows.
A text is read as a whole, however long; its set is one row. Words and shingles are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import WHITE, components, discard, staged, utf8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_WHITE = np.isin(np.arange(256), list(WHITE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased text: the sum of random numbers for each byte at its place in the word."""
    return _words(text)[0]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and where they start."""
    b = np.frombuffer(text.lower(), np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~_IS_WHITE[b]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    return word_sums(b[word[1:-1].view(bool)], np.cumsum(ends - starts) - (ends - starts)), starts


def word_sums(signs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes of words whose bytes or code points follow each other, each from ``first`` on."""
    lengths = np.diff(np.append(first, len(signs)))
    place = np.arange(len(signs), dtype=np.uint64) - np.repeat(first.astype(np.uint64), lengths)
    return _mix(np.add.reduceat(_at_place(signs.astype(np.uint64), place), first) + lengths.astype(np.uint64) * _BASE)


#: Random numbers for each byte at the first places of a word; others are made as they are needed.
_SHORT = 32
_RANDOM: list[np.ndarray] = []


def _at_place(signs: np.ndarray, place: np.ndarray) -> np.ndarray:
    if not _RANDOM:
        _RANDOM.append(_mix((np.arange(256 * _SHORT, dtype=np.uint64) + np.uint64(1)) * _BASE))
    far = (place >= _SHORT) | (signs >= 256)
    key = place * np.uint64(256) + signs
    if not far.any():
        return _RANDOM[0][key.astype(np.int64)]
    out = _RANDOM[0][np.where(far, 0, key).astype(np.int64)]
    out[far] = _mix((place[far] * np.uint64(0x110000) + signs[far] + np.uint64(1)) * _BASE + np.uint64(1))
    return out


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    total = np.full(max(0, len(w) - k + 1), k, np.uint64)
    for i in range(k):
        total = _mix(total * _BASE + w[i : len(w) - k + 1 + i])
    return total


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return shingle_sets([text], words)[0]


def shingle_sets(texts: list[bytes], words: int, together: int = 1 << 20) -> list[np.ndarray]:
    """``shingles`` of many texts, hashed about ``together`` bytes at a time."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < together):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        begins = np.cumsum([0, *(len(t) + 1 for t in part)])
        w, starts = _words(b" ".join(part))
        cuts = np.searchsorted(starts, begins).tolist()
        every = _grams(w, words)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = every[a : b - words + 1].copy() if b - a >= words else _grams(w[a:b], b - a) if b > a else w[:0]
            s.sort()
            if len(s) > 1:
                first = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=first[1:])
                s = s[first]
            out.append(s)
        at = end
    return out


def needed(n: int, threshold: tuple[int, int]) -> int:
    """The least overlap of a set of n with any that it links with."""
    return -(-threshold[0] * n // threshold[1])


def _limit(share: float) -> int:
    """The hash below which the counted share of the universe lies."""
    return min(int(share * 2.0**64), 2**64 - 1)


def _profile(words: int, threshold: tuple[int, int], share: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("counted", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = shingle_sets(utf8(part.column(1)), words)
                counted = [_first_of_order(s, threshold, share)[0] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(counted, pa.int64()), pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary())], schema=schema)

    return run


def _first_of_order(s: np.ndarray, threshold: tuple[int, int], share: float) -> tuple[int, int]:
    """(how many shingles of a sorted set are in the counted share, how many are to be emitted)."""
    counted = int(np.searchsorted(s, np.uint64(_limit(share))))
    return counted, max(counted, len(s) - needed(len(s), threshold) + 1)


def _postings(words: int, threshold: tuple[int, int], share: float):
    """(token, doc_id) of the counted share and, where that is shorter, of the first shingles of a set."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = shingle_sets(utf8(part.column(1)), words)
                found = [(d, s[: _first_of_order(s, threshold, share)[1]]) for d, s in zip(part.column(0).to_pylist(), sets, strict=True) if d is not None and len(s)]
                if found:
                    ids = np.repeat(np.array([d for d, _ in found], np.int64), [len(s) for _, s in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for _, s in found]).view(np.int64)), pa.array(ids)], schema=schema)

    return run


class SetTrie:
    """A prefix tree of sets, given in one global order, as sorted rows and the depth that each shares with the row before it."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.values, at = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)
        cuts = np.cumsum([0, *(len(sets[i]) for i in self.order)]).tolist()
        self.rows = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.shared = [0]
        for a, b in zip(self.rows[:-1], self.rows[1:], strict=True):
            m = min(len(a), len(b))
            other = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(other[0]) if len(other) else m)
        self.longest = max(map(len, self.rows))

    def overlaps(self, probes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        """Overlap of each set (row) with each probe (column); -1 where it was seen to be below ``least``, of the same shape."""
        inside = np.zeros((len(self.values), len(probes)), np.int8)
        for k, p in enumerate(probes):
            at = np.minimum(np.searchsorted(self.values, p), len(self.values) - 1)
            inside[at[self.values[at] == p], k] = 1
        # so many elements of a path may be outside a probe: what its longest set has more than the least overlap
        spare = self.longest - least.min(axis=0)
        out = np.full(least.shape, -1, np.int32)
        path = np.zeros((self.longest + 1, len(probes)), np.int32)  # overlaps of the first d elements of the current path
        depth, dead = 0, None
        for i, row, shared in zip(self.order, self.rows, self.shared, strict=True):
            if dead is not None:
                if shared >= dead:  # still in the pruned subtree
                    continue
                dead = None
            shared = min(shared, depth)
            part = path[shared + 1 : len(row) + 1]
            np.cumsum(inside[row[shared:]], axis=0, out=part)
            part += path[shared]
            depth = len(row)
            outside = np.arange(shared + 1, depth + 1)[:, None] - part
            hopeless = (outside > spare).all(axis=1)
            if hopeless.any():
                depth = dead = shared + 1 + int(hopeless.argmax())
                continue
            out[i] = path[len(row)]
        out[out < least] = -1
        return out


def least_overlap(n: np.ndarray, m: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The overlap from which on sets of n and m elements link."""
    return -(-threshold[0] * (n + m) // sum(threshold))


FOUND = pa.schema([("doc_id", pa.int64()), ("hub", pa.int64()), ("both", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])
FOUND_DDL = "doc_id long, hub long, both long, n long, m long"


def _verify(threshold: tuple[int, int], chunk: int, elements: int = 1 << 20, together: int = 16):
    """Rows (group, probe, doc_id, c, n, tokens), sorted so that a group's sets come before its probes -> ``FOUND``.

    A pair of the same c isn't looked for. Tries hold at most ``chunk`` sets and, but for a single one, ``elements`` elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        tries: list[tuple[SetTrie, np.ndarray, np.ndarray, np.ndarray]] = []
        sets: list[tuple] = []
        probes: list[tuple] = []
        size = 0
        found: list[tuple[np.ndarray, ...]] = []

        def columns(rows: list[tuple]) -> list[np.ndarray]:
            return [np.array(x, np.int64) for x in zip(*(r[:3] for r in rows), strict=True)]

        def build() -> None:
            nonlocal sets, size
            if sets:
                tries.append((SetTrie([r[3] for r in sets]), *columns(sets)))
            sets, size = [], 0

        def look_up() -> None:
            nonlocal probes
            if probes:
                ids, cs, ms = columns(probes)
                for trie, of, of_c, of_n in tries:
                    least = least_overlap(of_n[:, None], ms[None, :], threshold)
                    both = trie.overlaps([r[3] for r in probes], least)
                    i, k = np.nonzero((both >= 0) & (of_c[:, None] != cs[None, :]))
                    found.append((of[i], ids[k], both[i, k].astype(np.int64), of_n[i], ms[k]))
            probes = []

        for batch in batches:
            flat, cuts = batch.column(5).flatten().to_numpy(zero_copy_only=False), batch.column(5).offsets.to_numpy() - batch.column(5).offsets[0].as_py()
            for k, (g, probe, doc_id, c, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                if g != group:
                    look_up()
                    tries.clear()
                    group, sets, size = g, [], 0
                row = (doc_id, c, n, flat[cuts[k] : cuts[k + 1]].copy())
                if probe:
                    build()
                    probes.append(row)
                    if len(probes) == together:
                        look_up()
                    continue
                if sets and (len(sets) == chunk or size + len(row[3]) > elements):
                    build()
                sets.append(row)
                size += len(row[3])
            if sum(len(x[0]) for x in found) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=FOUND)
                found = []
        look_up()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=FOUND)

    return run


def _looked_up(rows: DataFrame, sets: DataFrame, threshold: tuple[int, int], chunk: int) -> DataFrame:
    """Verified pairs of ``rows`` (group, probe, doc_id, c), each group with the sets of its tries and its probes, staged."""
    whole = rows.join(sets, "doc_id").repartition("group").sortWithinPartitions("group", "probe")
    return staged(whole.select("group", "probe", "doc_id", "c", "n", "tokens").mapInArrow(_verify(threshold, chunk), FOUND_DDL), "verified")


def _at_hubs(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], chunk: int, per_salt: int) -> DataFrame:
    """Verified pairs among ``pairs`` (doc_id, hub). Hubs of more than ``per_salt`` members are spread."""
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("members")).withColumn("salts", F.ceil(F.col("members") / per_salt).cast("int"))
    members = pairs.join(sizes, "hub").select(F.struct("hub", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt")).alias("group"), F.lit(False).alias("probe"), "doc_id", F.lit(0).cast("long").alias("c"))
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(F.struct("hub", "salt").alias("group"), F.lit(True).alias("probe"), F.col("hub").alias("doc_id"), F.lit(1).cast("long").alias("c"))
    return _looked_up(members.union(heads), sets, threshold, chunk)


def jaccard_components(docs: DataFrame, words: int = 4, threshold: tuple[int, int] = (85, 100), chunk: int = 256, per_salt: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text); links where intersection / union >= threshold.

    ``chunk`` bounds a trie, ``per_salt`` the members of a hub in one group and, times 4, the probes of a block.
    """
    num, den = threshold
    share = min(1.0, 1.6 * (1 - num / den))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profile = staged(source.mapInArrow(_profile(words, threshold, share), "doc_id long, n long, counted long, key binary"), "profile")
    source, profile = _one_text(source, profile, words, threshold, share)
    classes = profile.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("counted").alias("counted"), F.count("*").alias("docs"))
    reps = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n"), F.max("counted").alias("counted"))

    candidates = staged(_candidates(source, reps, words, threshold, share), "candidates")
    texts = source.join(candidates.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = staged(texts, "texts")
    sets = staged(_ordered(texts, candidates, words, threshold), "sets")
    discard(texts)
    firsts = staged(_firsts(sets, threshold), "firsts")
    sets = sets.select("doc_id", "n", F.reverse("tokens").alias("tokens"))  # in a trie what most texts have comes first

    earliest = firsts.groupBy("token").agg(F.min(F.struct("pos", "doc_id", "n")).alias("h"), F.count("*").alias("docs")).filter("docs > 1")
    at_hub = firsts.join(earliest.select("token", F.col("h.doc_id").alias("hub"), F.col("h.pos").alias("hub_pos"), F.col("h.n").alias("hub_n")), "token")
    pairs = at_hub.filter("doc_id <> hub").filter(_may_link("n", "pos", "hub_n", "hub_pos", threshold)).select("doc_id", "hub").distinct()
    pairs = staged(pairs, "pairs")
    # a member less similar to its hub than this can't link with a member that links with the hub
    near = _at_hubs(pairs, sets, (max(1, 2 * num - den), den), chunk, per_salt)
    linked = den * F.col("both") >= num * (F.col("n") + F.col("m") - F.col("both"))
    links = near.filter(linked).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    found = staged(components(links), "hub-components")

    seen = near.select("doc_id", "hub", F.when(linked, LINKED).otherwise(NEAR).alias("kind"))
    known = pairs.join(seen, ["doc_id", "hub"], "left").select("doc_id", "hub", F.coalesce("kind", F.lit(FAR)).alias("kind"))
    more = _looked_up(_rest(at_hub, known, found, threshold, chunk, 4 * per_salt), sets, threshold, chunk)
    for passed in (candidates, firsts, pairs):
        discard(passed)
    if more.take(1):
        found = components(links.union(more.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))))
    of_class = staged(classes.join(found, classes.rep == found.id, "left").select("key", F.coalesce("component", "rep").alias("component"), "docs"), "classes")
    # sets of over a LARGE-th of all rows, fewer than LARGE, are told to every task; the rows of any other are few enough for one
    large = F.col("docs") * LARGE > profile.count()
    hot = F.broadcast(of_class.filter(large).drop("docs"))
    out = profile.join(hot, "key").unionByName(profile.join(hot.select("key"), "key", "left_anti").join(of_class.filter(~large).drop("docs"), "key", "left"))
    # a blank text links with nothing, a null id has no component
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _one_text(source: DataFrame, profile: DataFrame, words: int, threshold: tuple[int, int], share: float) -> tuple[DataFrame, DataFrame]:
    """Texts and profiles in which the rows of an id that has several sets have the least of its texts, whatever the order of rows."""
    of_id = profile.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"))
    mixed = staged(of_id.filter("least <> most").select("doc_id", "rows"), "mixed-ids")
    if not mixed.take(1):
        discard(mixed)
        return source, profile
    one = staged(source.join(mixed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "least-texts")
    own = one.mapInArrow(_profile(words, threshold, share), "doc_id long, n long, counted long, key binary").join(mixed, "doc_id")
    rows = own.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(profile.columns)
    return source.join(mixed, "doc_id", "left_anti").unionByName(one), staged(profile.join(mixed, "doc_id", "left_anti").unionByName(rows), "profile")


def _candidates(source: DataFrame, reps: DataFrame, words: int, threshold: tuple[int, int], share: float) -> DataFrame:
    """(doc_id, n) of the representatives with a first shingle that another text has too."""
    num, den = threshold
    postings = source.mapInArrow(_postings(words, threshold, share), "token long, doc_id long")
    frequency = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    limit = _limit(share)
    # a token is an unsigned hash in a signed column; those below the limit come first
    early = (F.col("token") >= 0) & (F.col("token") < limit) if limit < 2**63 else (F.col("token") >= 0) | (F.col("token") < limit - 2**64)
    shared = postings.join(frequency, "token").groupBy("doc_id").agg(F.count_if(early).alias("common"), F.count_if(~early).alias("later"))
    first = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    # what no other text has precedes everything that is shared
    return reps.join(shared, "doc_id").filter((F.col("later") > 0) | (first > F.col("counted") - F.col("common"))).select("doc_id", "n")


def _ordered(texts: DataFrame, candidates: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, n, tokens): the shingles of each candidate that another has too, in ascending order of frequency among candidates."""
    postings = texts.mapInArrow(_postings(words, threshold, 1.0), "token long, doc_id long")
    frequency = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = postings.join(frequency, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
    return ordered.join(candidates, "doc_id").select("doc_id", "n", F.col("x.token").alias("tokens"))


def _firsts(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(token, doc_id, n, pos): of each set the shared ones of its first shingles, and their places among all."""
    num, den = threshold
    own = F.col("n") - F.size("tokens")  # these are of one text only and come before
    many = F.greatest(F.lit(0), F.floor(F.col("n") - F.ceil(F.col("n") * num / den) + 1 - own)).cast("int")
    return sets.select("doc_id", "n", own.alias("own"), F.posexplode(F.slice("tokens", F.lit(1), many)).alias("place", "token")).select("token", "doc_id", "n", (F.col("own") + F.col("place")).alias("pos"))


def _may_link(n: str, pos: str, m: str, m_pos: str, threshold: tuple[int, int]):
    """Whether sets of n and m elements can link if the first that they share is at these places."""
    num, den = threshold
    n, pos, m, m_pos = (F.col(c) for c in (n, pos, m, m_pos))
    overlap = F.ceil((n + m) * num / (num + den))
    return (n - pos >= overlap) & (m - m_pos >= overlap)


#: What is known of a text under a shingle: it links with the hub, it is near enough to link with such, or it is neither.
LINKED, NEAR, FAR = 0, 1, 2
#: Copies of one set are joined by a broadcast where they are over this part of all rows.
LARGE = 200


def _rest(at_hub: DataFrame, known: DataFrame, found: DataFrame, threshold: tuple[int, int], chunk: int, most: int) -> DataFrame:
    """(group, probe, doc_id, c): tries of loose texts, and the probes under the same shingle that may link with one of another component."""
    num, den = threshold
    label = found.select(F.col("id").alias("doc_id"), "component")
    rows = at_hub.join(known, ["doc_id", "hub"], "left").join(label, "doc_id", "left")
    kind = F.when(F.col("doc_id") == F.col("hub"), LINKED).otherwise(F.coalesce("kind", F.lit(NEAR)))  # a pair that wasn't looked up may be near
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9) if num < den else F.col("n")
    rows = rows.select("token", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("c"), kind.alias("kind"), band.cast("long").alias("band"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("docs"), F.sum(F.pmod(F.xxhash64("doc_id"), F.lit(2**31))).alias("who")).filter("least <> most")
    # of the shingles that the same texts have among their first one is enough
    once = mixed.groupBy("who", "docs", "least", "most").agg(F.min("token").alias("token"))
    once = once.select("token", F.ceil(F.col("docs") / most).cast("int").alias("cells"))
    rows = staged(rows.join(once, "token").withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(2)), "cells").cast("int")), "mixed")

    def each_cell(few: DataFrame) -> DataFrame:
        """Rows of a shingle lie in cells; what is known of the shingle is told to each."""
        return few.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")

    most_cells = F.max("cells").alias("cells")

    # the smallest set that one of a band can link with: in its own band or the next ones
    bands = rows.groupBy("token", "band").agg(F.min("n").alias("least_n"), most_cells)
    around = bands.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "least_n", "cells").groupBy("token", "band").agg(F.min("least_n").alias("least_n"), most_cells)
    other = F.greatest("least_n", F.ceil(F.col("n") * num / den))
    live = rows.join(each_cell(around), ["token", "band", "cell"]).filter(F.col("n") - F.col("pos") >= F.ceil((F.col("n") + other) * num / (num + den))).drop("least_n")

    loose = live.filter(F.col("kind") != LINKED)
    tries = loose.groupBy("token", "band", "kind").agg(F.count("*").alias("sets"), most_cells).withColumn("blocks", F.ceil(F.col("sets") / chunk).cast("int")).drop("sets")
    tries = tries.withColumnRenamed("kind", "of").withColumnRenamed("band", "of_band")
    # all kinds are looked up among the near ones, but only far ones among the far
    probes = live.select("*", F.explode(F.when(F.col("kind") == FAR, F.array(F.lit(NEAR), F.lit(FAR))).otherwise(F.array(F.lit(NEAR)))).alias("of"))
    own = F.col("kind") == F.col("of")  # then one order of bands is enough
    probes = probes.withColumn("of_band", F.explode(F.when(own, F.array(F.col("band") - 1, F.col("band"))).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))))
    at = ["token", "of_band", "of"]
    spread = probes.groupBy(*at).agg(F.count("*").alias("probes")).join(tries, at).withColumn("salts", F.ceil(F.col("probes") / most).cast("int")).select(*at, "blocks", "salts", "cells")
    spread, by_cell = each_cell(spread), [*at, "cell"]
    block, salt = F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "salts").cast("int")
    sets = loose.withColumnRenamed("kind", "of").withColumnRenamed("band", "of_band").join(spread, by_cell).withColumn("block", block).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = probes.join(spread, by_cell).withColumn("salt", salt).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.struct(*at, "block", "salt").alias("group")
    return sets.select(group, F.lit(False).alias("probe"), "doc_id", "c").union(asked.select(group, F.lit(True).alias("probe"), "doc_id", "c"))
