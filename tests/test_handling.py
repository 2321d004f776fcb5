from pyspark.sql import functions as F

from weftline.operators import governance as G
from weftline.operators import handling as H
from weftline.operators import quality


def test_aliases_cookies_and_overlays(spark):
    df = spark.createDataFrame([(" Canceled ", '{"a": "1", "b": "2"}'), ("running", '[{"name": "a", "value": "1"}, {"value": "x"}, {"name": "a", "value": "3"}]'), (None, "a=1\\n# no=1\\n b = x=y ".replace("\\n", chr(10))), ("", None)], "s string, c string")
    got = df.select(H.alias(F.col("s"), H.JOB_STATES).alias("s"), H.cookies(F.col("c")).alias("c")).collect()
    assert [r.s for r in got] == ["cancelled", "running", None, ""]
    assert [r.c for r in got] == [{"a": "1", "b": "2"}, {"a": "3"}, {"a": "1", "b": "x=y"}, None]
    r = df.limit(1).select(H.overlay(F.expr("map('a','1','b','2')"), F.expr("cast(null as map<string,string>)"), F.expr("map('b','3')")).alias("m"), H.page_hint(F.lit("https://x.test/a?offset=20&cursor=z%3D1")).alias("p"), H.trace_id(F.lit(None), F.lit("t")).alias("t")).first()
    assert r.m == {"a": "1", "b": "3"} and r.p.asDict() == {"offset": 20, "cursor": "z=1"} and r.t == "t"


def test_proxies_copies_and_counts(spark, tmp_path, rows):
    (tmp_path / "p.txt").write_text("p2\n# remark\n\np3\np1\n")
    assert [r.proxy for r in H.proxies(spark, ["p1", " p2 ", "p1"], str(tmp_path / "p.txt")).orderBy("pos").collect()] == ["p1", "p2", "p3"]
    again = H.runs_again(spark.createDataFrame([("t1", "failed", 3)], "task_id string, status string, attempt int"), "task_id", F.concat("task_id", F.lit("-r")), status=F.lit("pending"), attempt=F.lit(0)).first()
    assert (again.task_id, again.source_task_id, again.status, again.attempt) == ("t1-r", "t1", "pending", 0)
    df = spark.createDataFrame([(i, i % 3 != 0) for i in range(20)], "i long, ok boolean")
    assert rows(H.running_counts(df, ["i"], F.col("ok")), "i", "seen", "records") == sorted([(i, i + 1, sum(k % 3 != 0 for k in range(i + 1))) for i in range(20)], key=repr)


def test_one_key_spans_several_tasks(spark):
    """Running values of a key that holds nine tenths of the rows, against a walk over them."""
    data = [(i, "hub" if i % 10 else None, i * 7 % 1000, i % 4 == 0 or i % 11 == 0) for i in range(400)]
    df = spark.createDataFrame(data, "i long, k string, t long, ok boolean").withColumn("at", F.timestamp_micros("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = G._ranges(df, ["k"], ["t", "i"]).groupBy("k").agg(F.count_distinct("_part").alias("n")).where("k = 'hub'").first()
        assert parts.n > 1
        waits = {r.i: r.wait_us for r in G.rate_limit(df, ["k"], "at", 5, "i").collect()}
        before = {r.i: r.p for r in G.previous(df, ["k"], ["t", "i"], F.when(F.col("ok"), F.col("i")), "p").collect()}
        fails = {r.i: r.failures for r in G.failure_runs(df, ["k"], ["t", "i"], F.col("ok"), 3).collect()}
        peak = {r.k: r.peak for r in G.concurrency_peak(df, ["k"], F.col("t"), F.col("t") + 40, "i").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for key in ("hub", None):
        rows = sorted((t, i, ok) for i, k, t, ok in data if k == key)
        free, last, run = -(10**9), None, 0
        for t, i, ok in rows:
            start = max(t, free)
            assert waits[i] == start - t and before[i] == last
            free, last, run = start + 5, i if ok else last, 0 if ok else run + 1
            assert fails[i] == run
        events = sorted([(t, 1) for t, _, _ in rows] + [(t + 40, -1) for t, _, _ in rows], key=lambda e: (e[0], e[1]))
        now = best = 0
        for _, d in events:
            now += d
            best = max(best, now)
        assert peak[key] == best


def test_samples_of_a_field_are_bounded(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None, f"v{i % 7}") for i in range(60)], "i long, g string, v string")
    got = {(r.g, r.field): r.samples for r in quality.field_quality(df, ["v"], by=["g"], samples=3, order=["i"]).collect()}
    assert got == {("a", "v"): ["v1", "v3", "v5"], (None, "v"): ["v0", "v2", "v4"]}
