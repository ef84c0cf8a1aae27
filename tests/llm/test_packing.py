import random
from collections import defaultdict

from faultlens.llm import packing as p

SCHEMA = "doc_id long, length long, source string, cluster string, bin_id string, piece string"


def naive(items, capacity):
    bins = []  # [room, sources and clusters]
    out = []
    for length, source, cluster in items:
        own = {("s", source)} - {("s", None)} | {("c", cluster)} - {("c", None)}
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= length and not b[1] & own]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set()])
        bins[i][0] -= length
        bins[i][1] |= own
        out.append(i)
    return out


def test_same_as_naive_best_fit():
    rng = random.Random(0)
    for _ in range(60):
        items = sorted(((rng.randint(0, 50), rng.choice(["a", "b", "c", None]), rng.choice([None, "x", "y", str(rng.random())])) for _ in range(80)), key=lambda x: -x[0])
        assert p.best_fit(items, 60) == naive(items, 60)


def test_bins_hold_no_conflicts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 3, 40, 100, 250, 1000]), "hot" if i % 3 == 0 else f"s{rng.randint(0, 6)}", f"c{rng.randint(0, 150)}", "x", "x") for i in range(600)]
    rows += [(None, 5, None, None, "x", "x"), (700, None, None, None, "x", "x"), rows[3], rows[3]]
    got = p.pack(spark.createDataFrame(rows, SCHEMA), capacity=256, shard_items=100).collect()
    whole = defaultdict(int)
    for r in got:
        whole[r.doc_id] += r.length
    want = defaultdict(int)
    for i, n, *_ in rows:
        want[i] += n or 0
    assert whole == want
    of = {i: (s, c) for i, _, s, c, *_ in rows}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for members in bins.values():
        assert sum(r.length for r in members) <= 256
        for k in (0, 1):
            seen = [of[r.doc_id][k] for r in members if of[r.doc_id][k] is not None]
            assert len(seen) == len(set(seen))


def test_long_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "x" * 1000, "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.piece): (r.start, r.length) for r in p.pack_documents(docs, capacity=400).collect()}
    assert got == {(1, 0): (0, 400), (1, 1): (400, 400), (1, 2): (800, 200), (2, 0): (0, 0), (3, 0): (0, 0)}
    assert p.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bins_do_not_depend_on_the_tables_partitions(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 3, 40, 100, 250, 1000]), f"s{rng.randint(0, 6)}", f"c{rng.randint(0, 150)}", "x", "x") for i in range(500)]
    rows += [rows[5]] * 300
    table = spark.createDataFrame(rows, SCHEMA)
    one, other = (sorted(map(tuple, p.pack(t, capacity=256, shard_items=100).collect()), key=str) for t in (table.coalesce(1), table.orderBy(p.F.rand(1)).repartition(7)))
    assert one == other
    bins = [b for i, *_, b in one if i == rows[5][0]]
    assert len(bins) == 301 * max(1, -(-rows[5][1] // 256)) and len(bins) == len(set(bins)) and len({b >> 32 for b in bins}) >= 3


def test_documents_of_very_many_pieces_are_spread(spark):
    docs = spark.createDataFrame([(i, 64 * 5000 + i, "s" if i else None, None, "x", "x") for i in range(3)], SCHEMA)
    got = p.pack(docs, capacity=64, shard_items=500).groupBy((p.F.col("bin_id") / 2**32).cast("long").alias("shard")).agg(p.F.count("*").alias("n"), p.F.count_distinct("doc_id").alias("docs")).collect()
    assert len(got) >= 25 and max(r.n for r in got) < 900 and all(r.docs == 3 for r in got) and sum(r.n for r in got) == 15002
