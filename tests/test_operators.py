import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.operators import follow, governance, incremental, policy, quality, schedule, shape


def test_policy_lists_every_violation(spark):
    data = ["https://a.example/x?utm_source=1", "https://bad.a.example/x", "https://other.test/x", "https://a.example/private/1", "/local", None, "https://sub.a.example/x", "https://a.example/robots/no"]
    df = spark.createDataFrame([(i, u, i % 3) for i, u in enumerate(data)], "n long, url string, depth int")
    p = policy.Policy(max_requests=6, max_depth=1, allowed=("a.example",), denied=("bad.a.example",), exclude=("/private/",), robots={"a.example": "User-agent: *\nDisallow: /robots/"}, robots_enabled=True, robots_block=True, robots_unavailable="warn")
    d = {r.n: r for r in policy.decide(df, "url", p, ["n"], "depth").collect()}
    assert d[0].allowed and d[0].normalized_url == "https://a.example/x"
    assert d[1].violations == ["denied domain: bad.a.example"]
    assert d[2].violations == ["max_depth exceeded: 1", "outside allowed domain scope: other.test"] and d[2].robots == "skipped_local"
    assert d[3].violations == ["url matched exclude_url_patterns"]
    assert d[4].robots == "skipped_local" and d[5].violations == ["max_depth exceeded: 1"]
    assert d[6].violations == ["max_requests exceeded: 6"] and d[6].robots == "allowed"
    assert d[7].violations[-1].startswith("robots disallow") and d[7].robots == "disallowed"
    s = policy.summary(policy.decide(df, "url", p, ["n"], "depth"), "url").first()
    assert (s.policy_checked_urls, s.policy_blocked_urls) == (8, 6)
    assert policy.estimate(2, 3, None, True, policy.Policy(max_requests=100)) == 12


def test_ranked_equals_sorted_position(spark):
    rng = random.Random(1)
    values = [(rng.randrange(50), i) for i in range(500)]
    got = {r.i: r.n for r in policy.ranked(spark.createDataFrame(values, "v int, i int").repartition(7), ["v", "i"], "n").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted(values), 1)}
    assert policy.ranked(spark.createDataFrame([], "v int"), ["v"], "n").count() == 0


def test_incremental_order_of_tests(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 3), (4, "c", None), (5, "d", 8), (6, None, 9)], "pos long, k string, v int")
    index = spark.createDataFrame([("d",)], "k string")
    got = incremental.process(df, ["k"], ["pos"], index, F.col("v"), 4, missing="skip")
    assert rows(got, "pos") == [(1,), (4,)]
    marked = incremental.process(df, ["k"], ["pos"], index, skip_existing=False, missing="skip")
    assert rows(marked, "pos", "is_duplicate") == [(1, False), (2, True), (3, False), (4, False), (5, True)]
    with pytest.raises(Exception):
        incremental.process(df, ["k"], ["pos"], index).collect()
    assert rows(incremental.first_by(df, ["k"], ["pos"]), "pos") == [(1,), (3,), (4,), (5,), (6,)]
    assert incremental.candidate(df, F.col("v"), F.col("v").cast("string")).first()[0] == "9"


def test_stop_prefix_keeps_the_page_that_stops(spark, rows):
    df = spark.createDataFrame([("s", p, v) for p, v in [(1, 9), (1, 8), (2, 7), (2, 1), (3, 9)]], "s string, p int, v int")
    assert rows(incremental.stop_prefix(df, "s", "p", F.col("v") <= 5), "p", "v") == [(1, 8), (1, 9), (2, 1), (2, 7)]


def test_rate_limit_equals_recurrence(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    data = [(i, rng.choice("ab"), t0 + timedelta(seconds=rng.randrange(60))) for i in range(80)]
    got = {r.i: r.wait_us for r in governance.rate_limit(spark.createDataFrame(data, "i int, k string, t timestamp"), ["k"], "t", 5_000_000, "i").collect()}
    nxt = {}
    for i, k, t in sorted(data, key=lambda r: (r[2], r[0])):
        at = max(t, nxt.get(k, t))
        nxt[k] = at + timedelta(seconds=5)
        assert got[i] == (at - t) / timedelta(microseconds=1)


def test_governance(spark, rows):
    df = spark.createDataFrame([("u", 1, 500), ("u", 2, 200), ("u", 3, 500), ("v", 1, 404), ("v", 2, None)], "url string, n int, status int")
    ok = F.coalesce(governance.succeeded(F.col("status")), F.lit(False))
    assert rows(governance.outcomes(df, ["url"], ["n"], ok)) == [("u", 2, True), ("v", 2, False)]
    assert rows(governance.failure_runs(df, ["url"], ["n"], ok, 2), "url", "n", "failures", "cooldown") == [("u", 1, 1, False), ("u", 2, 0, False), ("u", 3, 1, False), ("v", 1, 1, False), ("v", 2, 2, True)]
    assert [r[0] for r in df.select(governance.retryable(F.lit("http_status"), F.col("status"), ["http_status"], [500])).collect()] == [True, False, True, False, False]
    assert [r[0] for r in spark.range(1, 6).select(governance.backoff(F.col("id"), 1, 5)).collect()] == [1, 2, 4, 5, 5]


def test_cron(spark):
    assert schedule.parse_cron("*/15 1-3,5 * * 7")[0] == {0, 15, 30, 45} and schedule.parse_cron("5/10 * * * *")[0] == {5} and schedule.parse_cron("* * * * 7")[4] == {0}
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "3-1 * * * *"):
        with pytest.raises(ValueError):
            schedule.parse_cron(bad)

    def by_minute(expression, t):
        m, h, d, mo, w = schedule.parse_cron(expression)
        t = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 1440):
            if t.minute in m and t.hour in h and t.day in d and t.month in mo and t.isoweekday() % 7 in w:
                return t
            t += timedelta(minutes=1)
        return None

    rng = random.Random(2)
    times = [datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86400 * 60)) for _ in range(12)]
    for expression in ("30 4 * * *", "*/20 * * * 1-5", "0 0 13 * 5", "15,45 8,20 * * 1,3,5", "0 12 29 2 *"):
        df = spark.createDataFrame([(t,) for t in times], "t timestamp")
        assert [r[0] for r in df.select(schedule.next_cron(expression, F.col("t"))).collect()] == [by_minute(expression, t) for t in times], expression


def test_queue(spark, rows):
    df = spark.createDataFrame([("a", 1, None, 1, "q"), ("b", 5, 3, 1, "q"), ("c", 5, None, 2, "q"), ("d", 9, 99, 1, "x")], "job_id string, priority int, run_after int, created_at int, status string")
    assert [r.job_id for r in schedule.claim_order(df, F.lit(10), 2).orderBy("claim_no").collect()] == ["c", "b"]
    assert rows(schedule.queue_stats(df, ["q", "x", "z"], F.lit(10))) == [("q", 3, 3), ("x", 1, 0), ("z", 0, 0)]
    moves = spark.createDataFrame([("t", 1, "new"), ("t", 2, "run"), ("t", 3, "new"), ("t", 4, "new")], "k string, n int, s string")
    assert [(r.from_state, r.to_state) for r in schedule.illegal_moves(moves, ["k"], ["n"], "s", {"new": ["run"], "run": ["done"]}).collect()] == [("run", "new")]


def test_follow_strategies(spark):
    rec = spark.createDataFrame([(1, ["u1", "u2", "u1", None], "base"), (2, ["gone"], "base"), (3, None, "base"), (4, ["u3"], "base")], "k long, links array<string>, t string")
    pages = spark.createDataFrame([("u1", "p1"), ("u2", "p2"), ("u3", None)], "url string, t string")
    got = {r.k: r.t for r in follow.follow(rec, ["k"], F.col("links"), pages, "url", ["t"]).collect()}
    assert got == {1: "p2", 2: "base", 3: "base", 4: None}  # a page that was found replaces, even by null
    ns = {r.k: [x.t for x in r.d] for r in follow.follow(rec, ["k"], F.col("links"), pages, "url", ["t"], "namespace", "d").collect()}
    assert ns == {1: ["p1", "p2"], 2: [], 3: [], 4: [None]}


def test_walk_pages_stops_at_loops(spark, rows):
    nxt = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, to string")
    start = spark.createDataFrame([(1, "a"), (2, "x"), (3, "z")], "source long, url string")
    step = lambda f: f.join(nxt, "url").select("source", F.col("to").alias("url"))
    assert rows(follow.walk_pages(start, step, 9)) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (2, 2, "y"), (3, 1, "z")]
    assert rows(follow.walk_pages(start, step, 2), "source", "url") == [(1, "a"), (1, "b"), (2, "x"), (2, "y"), (3, "z")]


def test_quality(spark, rows):
    df = spark.createDataFrame([("a", None, ["x"]), ("", "b", []), ("c", None, None)], "t string, u string, l array<string>")
    q = quality.field_quality(df, ["t", "u", "l"], ["t"], samples=1, order=["t"])
    assert rows(q, "field", "non_empty", "empty", "empty_rate", "status") == [("l", 1, 2, 0.6667, "warning"), ("t", 2, 1, 0.3333, "warning"), ("u", 1, 2, 0.6667, "warning")]
    assert quality.overall_status(q).first()[0] == "warning" and quality.overall_status(q.limit(0)).first()[0] == "unknown"
    assert {r.status for r in quality.field_quality(df.limit(0), ["t"], ["t"]).collect()} == {"unknown"}
    m = spark.createDataFrame([("c", "counter", 2.0, 1, "a"), ("c", "counter", None, 2, "b"), ("g", "gauge", 5.0, 2, "a"), ("g", "gauge", 4.0, 2, "b"), ("", "x", 1.0, 1, "a")], "name string, kind string, value double, timestamp int, metric_id string")
    assert rows(quality.roll_up(m), "kind", "name", "n", "total", "last") == [("counter", "c", 2, 2.0, 0.0), ("gauge", "g", 2, 9.0, 4.0)]
    assert [r[0] for r in spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T00:00:01.5Z"), ("x", "y"), ("2024-01-02", "2024-01-01")], "a string, b string").select(quality.duration_ms(F.col("a"), F.col("b"))).collect()] == [1500, None, 0]


def test_shape(spark):
    df = spark.createDataFrame([(1, ("n", "secret", ["a", None]), {"api_key": "k", "Token": "t", "x": "y"}, [("p", "q")], "m")], "id int, s struct<name:string,password:string,tags:array<string>>, m map<string,string>, l array<struct<a:string,cookie:string>>, _meta string")
    r = shape.redact(df).first()
    assert (r.s.password, r.m["Token"], r.m["api_key"], r.l[0].cookie, r.l[0].a) == (shape.MASK, shape.MASK, "k", shape.MASK, "p")
    assert shape.redact(df, api=True).first().m["api_key"] == shape.MASK
    f = shape.flatten(shape.redact(df)).first().asDict()
    assert f["s_tags"] == '["a", null]' and f["s_name"] == "n" and json.loads(f["l"]) == [{"a": "p", "cookie": shape.MASK}]
    assert shape.flatten(df, lists="join", list_separator="|").first().s_tags == "a|"
    assert shape.select_fields(df, include=["id", "none"], aliases={"id": "key"}).first().asDict() == {"key": "1", "none": ""}
    assert "_meta" not in shape.select_fields(df, metadata=False).columns
    assert shape.page_info(df, 1, 0).first().has_more is False


def test_domains(spark):
    df = spark.createDataFrame([("a.b.example",), ("example",), ("xexample",), (None,)], "h string")
    assert [r[0] for r in df.select(policy.in_domains(F.col("h"), ("example",))).collect()] == [True, True, False, None]
    assert [r[0] for r in df.select(urls.domain_matches(F.col("h"), "b.example")).collect()] == [True, False, False, None]
