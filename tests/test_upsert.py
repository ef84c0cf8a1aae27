import random
import time

import pytest
from pyspark.sql import functions as F

from faultlens.operators import upsert as u
from faultlens.streaming import groups as g

MIN = 60_000_000
HOUR = 60 * MIN
T0 = 1_700_000_000_000_000
EVENTS = "application_id long, error_hash string, " + u.EVENT_DDL
GROUPS = "application_id long, error_hash string, " + u.GROUP_DDL


def steps(*events, groups=(), rules=u.Rules()):  # noqa: B008
    state = u.KeyState((1, "h"), rules, list(groups))
    return [state.apply(T0 + at, kind, target, 2, None) for at, kind, target in events], state


def test_opens_counts_and_opens_again():
    out, _ = steps((0, "occurrence", None), (HOUR, "occurrence", None), (24 * HOUR, "occurrence", None), (24 * HOUR + 1, "occurrence", None))
    assert [(o[3], o[7]) for o in out] == [("created", 1), ("recurred", 2), ("recurred", 3), ("created", 1)]
    assert out[0][2] == out[2][2] != out[3][2]


def test_reopens_the_closed_group_seen_last_once():
    closed = [u.Group(i, T0 - 900 * HOUR, T0 - 500 * HOUR + i, 3, status == "resolved", status) for i, status in ((7, "resolved"), (8, "wont_fix"))]
    out, _ = steps((0, "occurrence", None), (1, "occurrence", None), (2, "occurrence", None), (3, "occurrence", None), groups=closed)
    # a reopened group keeps its beginning, so that the next occurrence doesn't find it
    assert [(o[3], o[2], o[9]) for o in out[:2]] == [("reopened", 8, "new"), ("reopened", 7, "new")]
    assert [o[3] for o in out[2:]] == ["created", "recurred"] and out[0][11] == T0


def test_wont_fix_within_the_window_just_counts():
    out, _ = steps((0, "occurrence", None), (1, "wont_fix", None), (2, "occurrence", None), (3, "resolve", None), (4, "occurrence", None))
    assert [(o[3], o[9]) for o in out] == [("created", "new"), ("wont_fix", "wont_fix"), ("recurred", "wont_fix"), ("resolve", "resolved"), ("reopened", "new")]


def test_notifies_by_milestone_cooldown_and_mute():
    out, _ = steps(*[(i, "occurrence", None) for i in range(12)])
    assert [o[7] for o in out if o[12]] == [1, 10]
    again = [(0, "occurrence", None), (1, "resolve", None), (MIN, "occurrence", None), (MIN + 1, "resolve", None), (6 * MIN, "occurrence", None)]
    out, _ = steps(*again)
    assert [o[12] for o in out] == [True, False, False, False, True]
    out, _ = steps((0, "occurrence", None), (1, "mute", None), *[(2 + i, "occurrence", None) for i in range(9)], (50, "unmute", None), *[(60 + i, "occurrence", None) for i in range(40)])
    assert [o[7] for o in out if o[12]] == [1, 50]
    assert steps((0, "occurrence", None), rules=u.Rules(least="critical"))[0][0][12] is False


def test_changes_of_unknown_groups_do_nothing():
    out, _ = steps((0, "resolve", None), (1, "occurrence", None), (2, "resolve", 5), (3, "dance", None))
    assert [o and o[3] for o in out] == [None, "created", None, None]


class Scanned(u.KeyState):
    """The same by a look at every group for every event."""

    def _index(self, at):
        self.seen = self.fresh = self.closed = []
        self.of_id = {g.id: [i] for i, g in enumerate(self.groups)}

    def _top(self, heap, holds):
        return max((i for i, g in enumerate(self.groups) if holds(g)), key=lambda i: (self.groups[i].last, self.groups[i].id), default=None)

    def _occurred(self, at):
        self.seen, self.fresh, self.closed = [], [], []
        return super()._occurred(at)


@pytest.mark.parametrize("seed", range(8))
def test_heaps_find_what_a_look_at_every_group_finds(seed):
    groups, events = traffic(seed, 500)
    own = [x for x in groups if x[1] == "h0"]
    mine = sorted((e[2:] for e in events), key=g._order)
    mine += mine[100:200]  # and times that don't ascend
    a, b = (kind((1, "h0"), u.Rules(), [u.Group(*x[2:]) for x in own]) for kind in (u.KeyState, Scanned))
    assert [a.apply(*e) for e in mine] == [b.apply(*e) for e in mine]


def test_an_event_costs_little_however_many_groups_there_are():
    n = 20_000
    groups = [u.Group(i, T0 - 1000 * HOUR, T0 - 500 * HOUR + i, 1, i % 2 == 0, "resolved" if i % 2 == 0 else "new") for i in range(n)]
    state, began = u.KeyState((1, "h"), u.Rules(), groups), time.process_time()
    out = [state.apply(T0 + i, "occurrence", None, 2, None) for i in range(n)]
    assert [o[3] for o in out] == ["reopened"] * (n // 2) + ["created"] + ["recurred"] * (n // 2 - 1)
    assert time.process_time() - began < 20  # a look at every group takes minutes


def test_groups_that_no_event_can_find_stay_behind(spark):
    old = T0 - 900 * HOUR
    rows = [(1, "h", i, old, old + i, 1, i % 2 == 0, "resolved" if i % 2 == 0 else "new", False, None) for i in range(100)]
    rows += [(1, "h", 200, T0 - HOUR, old, 1, False, "new", False, None), (2, "h", 300, T0, T0, 1, False, "new", False, None)]
    events = [(1, "h", T0 + i, "occurrence", None, 2, "c") for i in range(3)]
    needed = lambda more: {r.id for r in u._needed(spark.createDataFrame(rows, GROUPS), spark.createDataFrame(events + more, EVENTS), u.Rules()).collect()}
    assert needed([]) == {200, 99, 98, 96, 94}  # within its window, seen last, closed
    assert needed([(1, "h", T0, "mute", 7, 2, "c")]) == {*range(100), 200}


def traffic(seed, n=400):
    rng = random.Random(seed)
    groups, events = [], []
    for k in range(6):
        for i in range(rng.randint(0, 3)):
            last = T0 - rng.randint(0, 60) * HOUR
            groups.append((1, f"h{k}", 100 * k + i, last - rng.randint(0, 30) * HOUR, last, rng.randint(1, 60), rng.random() < 0.4, rng.choice(["new", "resolved", "wont_fix"]), rng.random() < 0.2, None))
    for i in range(n):
        kind = rng.choices(u.KINDS, [20, 2, 1, 1, 1])[0]
        target = rng.choice([None, None, 100, 201])
        events.append((1, f"h{rng.randint(0, 6)}", T0 + rng.randint(0, 100 * 60) * MIN, kind, None if kind == "occurrence" else target, rng.randint(0, 3), f"c{i}"))
    return groups, events


def plain(groups, events):
    out = []
    for key in {e[:2] for e in events}:
        state = u.KeyState(key, u.Rules(), [u.Group(*x[2:]) for x in groups if x[:2] == key])
        mine = sorted((e[2:] for e in events if e[:2] == key), key=g._order)
        out += [o for e in mine if (o := state.apply(*e))]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_is_the_plain_sequence(spark, seed):
    groups, events = traffic(seed)
    nulls = [(None, None, T0, "occurrence", None, 2, "n"), (1, "h0", None, "occurrence", None, 2, "never")]
    got = u.outcomes(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(events + nulls, EVENTS).repartition(3))
    want = plain(groups, events + nulls[:1])
    assert sorted(map(tuple, got.collect()), key=str) == want and {o[3] for o in want} == {"created", "recurred", "reopened", "resolve", "wont_fix", "mute", "unmute"}
    last = {}
    for o in sorted(want, key=lambda o: o[13]):
        last[o[:3]] = (o[5], o[6], o[7], o[8], o[9], o[10], o[11])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in u.latest(got).collect()} == last


def test_stream_is_the_batch_over_reordered_batches_and_a_restart(spark, tmp_path):
    groups, events = traffic(3, 240)
    want = plain(groups, events)
    rng = random.Random(9)
    by_hour = sorted(events, key=lambda e: e[2] + rng.randint(0, 50) * MIN)  # out of order by less than an hour
    clock = [(0, "clock", T0 + 2000 * HOUR, "occurrence", None, 0, "tick")]
    batches = [by_hour[i : i + 60] for i in range(0, len(by_hour), 60)] + [clock]
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("at_us"))
        out = g.upserted(stream, spark.createDataFrame(groups, GROUPS), late="1 hour")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(150)
        assert not q.isActive

    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.json(str(tmp_path / f"part{i}"))
        part = next((tmp_path / f"part{i}").glob("*.json"))
        part.rename(tmp_path / "in" / f"{i}.json")
        time.sleep(0.02)
        if i == 1:
            run()  # the others come after a restart
    run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.error_hash != "clock"]
    assert sorted(got, key=str) == want
