import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from weftline.functions.instants import parse_instant
from weftline.operators import changefeed as C

SCHEMA = "feed_no long, event_id string, target_type string, target_id string, event_type string, to_status string, created_at string, op string, instant string"


def feed(spark, events):
    return spark.createDataFrame([(*e, "clash", "clash") for e in events], SCHEMA)


def test_instants(spark):
    texts = ["2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05.5", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+05:30", "2024-01-02T03:04:05-0130", "2024-01-02", "1704164645000", " 1704164645000 ", "", None, "n/a", "2024-13-45T00:00:00", "12345678901234567890", "2024-01-02T03:04"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(parse_instant(F.col("t")))).collect()]
    at = int(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc).timestamp()) * 10**6
    assert got == [at, at + 500000, at, at - 19800 * 10**6, at + 5400 * 10**6, at - (3 * 3600 + 245) * 10**6, at, at, None, None, None, None, None, at - 5 * 10**6]


def test_replay_rules(spark, rows):
    t = "2024-01-01T00:00:0"
    f = feed(spark, [
        (1, "a", "task", "1", "created", " Pending ", f"{t}1"), (5, "a", "task", "1", "created", "pending", f"{t}1Z"),
        (2, "c", "task", "1", "started", "RUNNING", f"{t}3"), (3, "b", "task", "1", "paused", "paused", f"{t}2"), (4, "d", "task", "1", "heartbeat", None, f"{t}4"),
        (6, "e", "job", "1", "started", "running", f"{t}1"),  # its insert is missing
        (7, "f", "task", "2", "enqueued", "queued", f"{t}1"), (8, "g", "task", "2", "deleted", "x", f"{t}2"), (9, "h", "task", "2", "started", "running", f"{t}3"),
        (10, "i", "task", "3", "purged", None, f"{t}1"), (11, "j", "task", "3", "created", None, f"{t}2"),
        (12, "k", "task", "4", "created", "a", f"{t}1"), (13, "l", "task", "4", "started", "b", "n/a"), (14, "m", "task", None, "created", "a", f"{t}1"), (15, "n", None, "9", "created", "a", f"{t}1"),
        (16, "y", "task", "5", "created", "late", f"{t}1"), (17, "x", "task", "5", "created", "early", f"{t}1"), (18, None, "task", "6", "created", "s", f"{t}1"),
    ])
    assert rows(C.replay(f)) == [("task", "1", "running"), ("task", "3", None), ("task", "4", "a"), ("task", "5", "late"), ("task", "6", "s")]
    assert C.replay(f.limit(0)).count() == 0


def brute(events):
    seen, state = {}, {}
    for e in sorted(events, key=lambda e: e[0]):
        seen.setdefault(e[1], e)
    for _, eid, tt, ti, kind, status, at in sorted(seen.values(), key=lambda e: (e[6], e[1])):
        if kind in C.INSERTS:
            state[tt, ti] = status
        elif kind in C.DELETES:
            state.pop((tt, ti), None)
        elif (tt, ti) in state and status is not None:
            state[tt, ti] = status
    return sorted(((*k, v) for k, v in state.items()), key=repr)


def test_replay_against_one_by_one_and_in_batches(spark, rows):
    rng = random.Random(4)
    kinds = ["created", "enqueued", "deleted", "purged", "started", "heartbeat", "paused"]
    events = [(i, f"e{rng.randrange(400):03}", "task", f"t{0 if rng.random() < 0.4 else rng.randrange(30)}", None, None, None) for i in range(600)]
    by_id = {}
    full = []
    for e in events:
        if e[1] not in by_id:
            by_id[e[1]] = (e[3], rng.choice(kinds), rng.choice(["a", "b", None]), f"2024-01-01T00:00:{rng.randrange(60):02}.000000+00:00")
        t, k, s, at = by_id[e[1]]
        full.append((e[0], e[1], "task", t, k, s, at))
    df = feed(spark, full)
    assert rows(C.replay(df)) == brute(full)
    halves = [C.fold(C.assemble(df.where(F.col("feed_no") % 2 == k))) for k in (0, 1)]
    assert rows(C.present(C.merge(*halves))) == brute(full)


def test_watermark_holds_what_follows_a_gap(spark, rows):
    t = "2024-01-01T00:00:0"
    f = feed(spark, [(n, f"e{n}", "task", str(n), "created", "s", f"{t}1") for n in (1, 2, 3, 5, 6)])
    assert C.contiguous_watermark(f) == 3
    assert C.contiguous_watermark(f, block=2) == 3
    assert C.contiguous_watermark(f, start=0) is None
    assert C.contiguous_watermark(f.limit(0)) is None
    assert [r[1] for r in rows(C.replay(f, closed=False))] == ["1", "2", "3"]
    assert C.contiguous_watermark(spark.range(1, 1001).withColumnRenamed("id", "feed_no"), block=100) == 1000


def test_closing_a_feed_releases_what_was_held(spark, rows):
    t = "2024-01-01T00:00:0"
    f = feed(spark, [(1, "a", "task", "1", "created", "s", f"{t}1"), (3, "b", "task", "1", "started", "late", f"{t}2"), (4, "a", "task", "1", "deleted", None, f"{t}5"), (None, "c", "task", "2", "created", "n", f"{t}1")])
    assert rows(C.replay(f, closed=False)) == [("task", "1", "s")]
    assert rows(C.replay(f)) == [("task", "1", "late"), ("task", "2", "n")]


def test_batches_hold_gaps_and_know_events_of_earlier_batches(spark, rows, tmp_path):
    from weftline.streaming.incremental import changefeed_batches, changefeed_state

    t, home = "2024-01-01T00:00:0", f"file://{tmp_path}/feed"
    batch, state = changefeed_batches(spark, home, 1), lambda **k: rows(changefeed_state(spark, home, **k))
    batch(feed(spark, [(1, "e1", "task", "1", "created", "new", f"{t}1"), (3, "e3", "task", "1", "started", "held", f"{t}3")]), 0)
    assert state() == [("task", "1", "new")] and state(closed=True) == [("task", "1", "held")]
    batch(feed(spark, [(4, "e1", "task", "1", "created", "other", f"{t}9")]), 1)  # e1 again, saying something else
    assert state() == [("task", "1", "new")] and state(closed=True) == [("task", "1", "held")]
    batch(feed(spark, [(2, "e2", "task", "2", "created", "two", f"{t}2")]), 2)
    assert state() == [("task", "1", "held"), ("task", "2", "two")]
    batch(feed(spark, [(2, "e2", "task", "2", "created", "two", f"{t}2")]), 2)  # the batch is played again
    batch(feed(spark, []), 3)
    assert state() == [("task", "1", "held"), ("task", "2", "two")]
