import gzip
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.__main__ import main
from weftline.plans import engine, job
from weftline.sinks import export
from weftline.sinks.state import State
from weftline.sources import pages, seeds, store
from weftline.streaming import incremental as streaming


def test_seeds(spark, tmp_path, rows):
    assert rows(seeds.inline(spark, [" a ", "b", "", "a"])) == [("a", 0), ("b", 1)]
    (tmp_path / "s.csv").write_text("url;n\nu1;1\nu2;2\nu1;3\n")
    assert [r[0] for r in seeds.read(spark, {"type": "csv", "path": str(tmp_path / "s.csv"), "delimiter": ";"}).orderBy("pos").collect()] == ["u1", "u2"]
    (tmp_path / "s.json").write_text(json.dumps({"links": [{"url": "a"}, "b", {"links": "c"}, {"x": 1}]}))
    assert [r[0] for r in seeds.read(spark, {"kind": "json", "file": str(tmp_path / "s.json"), "field": "links"}).orderBy("pos").collect()] == ["a", "b", "c"]
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><x:urlset xmlns:x="u"><x:url><x:loc> http://a/?b=1&amp;c </x:loc></x:url><url><loc>http://d</loc></url></x:urlset>')
    assert [r[0] for r in seeds.read(spark, {"type": "sitemap", "source": str(tmp_path / "s.xml")}, limit=9).orderBy("pos").collect()] == ["http://a/?b=1&c", "http://d"]
    with pytest.raises(ValueError):
        seeds.read(spark, {"type": "ftp"})
    with pytest.raises(ValueError):
        seeds.inline(spark, ["a", 1])


def test_pages(spark, tmp_path, rows):
    (tmp_path / "a.html").write_text("<p>x")
    r = pages.local_files(spark, str(tmp_path)).first()
    assert (r.status_code, r.body, r.content_type) == (200, "<p>x", "text/html")
    requests = spark.createDataFrame([("u", 1), ("u", 2), ("u", 5), ("v", 1)], "url string, attempt int")
    answers = spark.createDataFrame([("u", 1, 500), ("u", 2, 200)], "url string, attempt int, status int")
    assert rows(pages.scripted(requests, answers), "url", "attempt", "status") == [("u", 1, 500), ("u", 2, 200), ("u", 5, 200), ("v", 1, None)]
    data = [(gzip.compress(b"x"), "gzip"), (zlib.compress(b"y"), "deflate"), (zlib.compress(b"z")[2:-4], "deflate"), (b"w", None), (None, "gzip")]
    assert [r[0] for r in spark.createDataFrame(data, "b binary, e string").select(pages.decompress(F.col("b"), F.col("e"))).collect()] == [b"x", b"y", b"z", b"w", None]
    assert [r[0] for r in spark.createDataFrame([(" [1]",), ("{x",), ("text",), (None,)], "b string").select(pages.sniff_json(F.col("b"))).collect()] == [" [1]", None, None, None]


def test_store(spark, tmp_path, rows):
    f = tmp_path / "r.jsonl"
    f.write_text('{"a": 1}\n{"a": \n\n{"a": 3}\n')
    assert rows(store.json_lines(spark, str(f), "a int", strict=False)) == [(1,), (3,)]
    with pytest.raises(Exception):
        store.json_lines(spark, str(f), "a int").collect()
    assert [r.line for r in store.corrupt_lines(spark, str(f)).collect()] == ['{"a": ']
    assert rows(store.integrity(spark, {"r": str(f)})) == [("r", 3, 1)]
    logs = spark.createDataFrame([("task", "1", "1", "INFO"), ("job", "2", "1", "error"), ("job", "3", None, "ERROR")], "scope string, target_id string, task_id string, level string")
    assert store.scan_logs(logs, target="1").count() == 2 and store.scan_logs(logs, "jobs", "3", "error").count() == 1 and logs.where(store.at_least("warning")).count() == 2


LIST = '<ul>{}</ul><a class="next" href="{}">more</a>'
ITEM = '<li class="item" data-id="{0}"><a href="/d/{0}">Item  {0}</a><i>1,{0}00</i></li>'
PAGES = [
    ("http://h.example/list", 200, LIST.format(ITEM.format(1) + ITEM.format(2), "/list2")),
    ("http://h.example/list2", 200, LIST.format(ITEM.format(3) + ITEM.format(1) + '<li class="item"><i>9</i></li>', "")),
    ("http://h.example/d/1", 200, "<h1>One</h1>"), ("http://h.example/d/3", 200, "<h1>Three</h1>"), ("http://h.example/d/2", 404, "gone"), ("http://h.example/broken", 500, "x"),
]
JOB = {
    "id": "shop", "schema_version": "1.0", "mode": "http", "start_urls": ["http://h.example/list?utm_source=x", "http://h.example/broken", "http://no.example/"], "item_selector": "li.item",
    "fields": [
        {"name": "key", "type": "attribute", "selector": "a", "attribute": "href", "required": True},
        {"name": "title", "selector": "a", "transforms": ["normalize_space", "upper"]},
        {"name": "price", "selector": "i", "transforms": ["number_parse"]},
        {"name": "note", "selector": "b", "default": " none ", "transforms": ["strip"]},
    ],
    "pagination": {"type": "next_button", "next_selector": "a.next", "next_attribute": "href", "max_pages": 2},
    "detail": {"url_field": "key", "fields": [{"name": "heading", "selector": "h1"}]}, "dedup": {"enabled": True, "keys": ["key"]}, "crawl_policy": {"enabled": True},
}


def test_job_end_to_end(spark, rows, tmp_path, capsys):
    frame = spark.createDataFrame(PAGES, "url string, status_code int, body string")
    got = engine.run(spark, job.load(JOB), frame)
    assert rows(got.records, "key", "title", "price", "note", "heading") == [("/d/1", "ITEM 1", 1100.0, "none", "One"), ("/d/2", "ITEM 2", 1200.0, "none", None), ("/d/3", "ITEM 3", 1300.0, "none", "Three")]
    assert rows(got.rejects) == [("http://h.example/broken", "http_status"), ("http://h.example/list2", "field_required"), ("http://no.example/", "network")]
    again = engine.run(spark, job.load(JOB), frame, index=got.index_delta)
    assert again.records.count() == 0
    frame.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "job.json").write_text(json.dumps(JOB))
    assert main(["validate", str(tmp_path / "job.json")]) == 0
    assert main(["run", str(tmp_path / "job.json"), "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "out"), "--format", "jsonl"]) == 0
    assert '"rows_count": 3' in capsys.readouterr().out and spark.read.json(str(tmp_path / "out")).count() == 3
    assert main(["plan", str(tmp_path / "job.json")]) == 0


def test_json_job(spark, rows):
    body = json.dumps({"data": {"items": [{"id": 1, "t": "a", "tags": ["x", "y"], "at": "2024-01-02"}, {"id": 2, "t": None, "at": "2024-01-05"}, {"id": 3, "t": "c", "at": None}]}})
    config = {"id": "j", "request": {"url": "http://h.example/api"}, "items_json_path": "data.items[]", "fields": [{"name": "id", "type": "json_path", "json_path": "id", "transforms": ["int"]}, {"name": "t", "type": "json_path", "json_path": "t", "default": "?"}, {"name": "tags", "type": "json_path", "json_path": "tags", "many": True, "join_with": "+"}, {"name": "at", "type": "json_path", "json_path": "at"}], "watermark": {"enabled": True, "field": "at", "type": "string"}}
    frame = spark.createDataFrame([("http://h.example/api", 200, body)], "url string, status_code int, body string")
    got = engine.run(spark, job.load(config), frame, bound="2024-01-02")
    assert rows(got.records, "id", "t", "tags") == [(2, "?", None), (3, "c", None)]
    assert got.watermark.first()[0] == "2024-01-05"


def test_config_collects_all_problems():
    bad = {"fields": [{"name": "", "type": "css"}, {"name": "x", "type": "regex", "pattern": "("}, {"name": "y", "selector": "a", "transforms": ["nope"]}], "pagination": {"type": "spiral", "max_pages": 0}, "dedup": {"enabled": True}, "scheduler": {"type": "cron", "cron": "x"}, "export": {"formats": ["pdf"]}, "detail": {"fields": [], "detail": {"merge": "mix"}}}
    with pytest.raises(job.ConfigError) as e:
        job.load(bad)
    paths = [p for p, _ in e.value.issues]
    assert {"id", "start_urls", "fields[0].name", "fields[0].selector", "fields[1].pattern", "fields[2].transforms[0]", "pagination.type", "pagination.max_pages", "dedup.keys", "scheduler.cron", "export.formats[0]", "detail.url_field", "detail.detail.merge"} <= set(paths)
    assert job.canonical({"mode": "api", "type": "x"}) == {"type": "x"} and job.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert json.loads(job.dump({"b": 1, "a": 2})) == {"a": 2, "b": 1}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b", None, [1, 2]), ('q"', 5, None)], "z string, a int, l array<int>").coalesce(1)
    assert export.pick_format(None, "x.csv") == "csv" and export.pick_format(None, "x") == "jsonl"
    with pytest.raises(ValueError):
        export.pick_format("pdf", "x")
    m = export.export(df, str(tmp_path / "o.json"))
    assert m["format"] == "json" and m["rows_count"] == 2
    assert json.loads((tmp_path / "o.json").read_text()) == [{"z": "b", "a": None, "l": [1, 2]}, {"z": 'q"', "a": 5, "l": None}]
    export.write(df, str(tmp_path / "o.jsonl"))
    line = next((tmp_path / "o.jsonl").glob("part-*")).read_text().splitlines()[0]
    assert line == '{"a":null,"l":[1,2],"z":"b"}'
    export.write(df, str(tmp_path / "o.csv"))
    assert next((tmp_path / "o.csv").glob("part-*")).read_text().splitlines()[:2] == ["z,a,l", 'b,,"[1,2]"']
    export.excel_csv(df, str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    export.write(df, str(tmp_path / "o.xlsx"))
    sheet = zipfile.ZipFile(tmp_path / "o.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert 'r="C2"' in sheet and "[1, 2]" in sheet and "q&quot;" in sheet or 'q"' in sheet
    assert [export.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    export.append_manifest(spark, m, str(tmp_path / "manifests"))


def test_state_is_visible_only_after_commit(spark, tmp_path, rows):
    s = State(spark, f"file://{tmp_path}/state")
    s.stage(1, "t", spark.createDataFrame([("a", 1)], "k string, v int"))
    assert s.read("t", "k string, v int").count() == 0
    s.commit(1)
    s.commit(1)
    s.stage(2, "t", spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int"))
    s.commit(2)
    assert s.commits() == [1, 2] and rows(s.latest("t", "k string, v int", ["k"])) == [("a", 2), ("b", 1)]


def test_streams(spark, tmp_path, rows):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 1)], "pos long, k string, v int").coalesce(1).write.parquet(str(src))

    def go():
        batch = streaming.dedup_batches(spark, f"file://{tmp_path}/state", ["k"], ["pos"], F.col("v"), value_type="int")
        q = spark.readStream.schema("pos long, k string, v int").parquet(str(src)).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    spark.createDataFrame([(4, "b", 9), (5, "c", 3), (6, "d", 10)], "pos long, k string, v int").coalesce(1).write.mode("append").parquet(str(src))
    go()
    s = State(spark, f"file://{tmp_path}/state")
    assert rows(s.read("results", "pos long, k string, v int"), "pos") == [(1,), (3,), (6,)]

    feed = "feed_no long, event_id string, target_type string, target_id string, event_type string, to_status string, created_at string"
    batch = streaming.changefeed_batches(spark, f"file://{tmp_path}/feed")
    batch(spark.createDataFrame([(1, "b", "t", "1", "started", "run", "2024-01-02")], feed), 0)
    batch(spark.createDataFrame([(2, "a", "t", "1", "created", "new", "2024-01-01")], feed), 1)
    batch(spark.createDataFrame([(2, "a", "t", "1", "created", "new", "2024-01-01")], feed), 1)
    assert rows(streaming.changefeed_state(spark, f"file://{tmp_path}/feed")) == [("t", "1", "run")]


def test_windows(spark, rows):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.5), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "b", 1.0)], "t string, k string, v double")
    assert rows(streaming.windows(df, "t", "5 minutes", ["k"], "v"), "k", "n", "total") == [("a", 2, 3.5), ("b", 1, 1.0)]


def test_stored_pages_go_through_the_whole_job(spark, rows, tmp_path):
    from weftline.plans import reference_queries

    page = "<h1> {} </h1><a href='/{}'>x</a>"
    stored = [
        (9, "http://a.example/9", 200, page.format("Same", 9)), (2, "http://a.example/2?utm_source=x", 200, page.format("Same", 2)), (3, "http://a.example/3", 404, page.format("Gone", 3)), (1, "http://a.example/1", 500, page.format("Same", 1)),
        (4, "http://a.example/4", None, None), (5, "http://b.other/5", 200, page.format("Outside", 5)), (6, "http://a.example/6", 503, "busy"), (7, "http://a.example/6", 200, page.format("Later", 6)), (8, "http://a.example/2#top", 200, page.format("Again", 8)), (10, None, 200, page.format("Nowhere", 0)),
    ]
    spark.createDataFrame(stored, "response_id long, url string, status_code int, body string").write.parquet(str(tmp_path / "http_responses.parquet"))
    got = reference_queries.job_over_stored_pages(spark, str(tmp_path))
    assert rows(got, "headline", "first_link", "source_url") == [("Later", "/6", "http://a.example/6"), ("Same", "/2", "http://a.example/2")]
    rejects = reference_queries.job_rejects_of_stored_pages(spark, str(tmp_path))
    assert rows(rejects) == [("http://a.example/1", "http_status"), ("http://a.example/3", "http_status"), ("http://a.example/4", "network"), ("http://b.other/5", "policy")]


def test_addresses_that_become_equal_share_a_page(spark, rows):
    frame = spark.createDataFrame(PAGES[:1], "url string, status_code int, body string")
    starts = spark.createDataFrame([("http://h.example/list#a", 1), ("http://h.example/list#b", 0)], "url string, pos long")
    config = {"id": "twice", "seed": {"type": "table"}, "item_selector": "li.item", "fields": JOB["fields"], "crawl_policy": {"enabled": True}}
    assert rows(engine.run(spark, job.load(config), frame, starts=starts).records, "pos", "key") == [(0, "/d/1"), (0, "/d/2"), (1, "/d/1"), (1, "/d/2")]


API = {
    "id": "api", "start_urls": ["https://x.test/api?offset=0&limit=2"], "items_json_path": "items", "fields": [{"name": "id", "type": "json_path", "json_path": "id", "transforms": ["int"]}],
}


def _api(spark, pages, pagination, **more):
    frame = spark.createDataFrame([(u, 200, b) for u, b in pages.items()], "url string, status_code int, body string")
    config = job.load({**API, "pagination": pagination, **more})
    return sorted((r.pos, r.page_index, r.item_pos, r.id) for r in engine.run(spark, config, frame).records.collect())


def test_offsets_by_page_size_parameter_and_by_what_a_page_holds(spark):
    pages = {"https://x.test/api?offset=0&limit=2": '{"items":[{"id":1},{"id":2}]}', "https://x.test/api?limit=2&offset=2": '{"items":[{"id":3}]}', "https://x.test/api?limit=2&offset=4": '{"items":[]}', "https://x.test/api?limit=2&offset=6": '{"items":[{"id":9}]}'}
    want = [(0, 1, 0, 1), (0, 1, 1, 2), (0, 2, 0, 3)]
    assert _api(spark, pages, {"type": "offset", "page_size_param": "limit", "max_pages": 4}) == want
    assert _api(spark, pages, {"type": "offset", "page_size": 2, "max_pages": 4}) == want
    pages["https://x.test/api?limit=2&offset=3"] = '{"items":[{"id":7}]}'
    assert _api(spark, pages, {"type": "offset", "max_pages": 4})[:3] == want[:2] + [(0, 2, 0, 3)]
    assert _api(spark, pages, {"type": "offset", "page_size": 2, "max_pages": 1}) == want[:2]


def test_numbered_pages_and_cursors(spark):
    start = ["https://x.test/list?page=1"]
    pages = {f"https://x.test/list?page={n}": f'{{"items":[{{"id":{n}}}]}}' for n in (1, 2, 3, 5)}
    assert _api(spark, pages, {"type": "page", "page_param": "page", "max_pages": 5}, start_urls=start) == [(0, 1, 0, 1), (0, 2, 0, 2), (0, 3, 0, 3)]
    assert _api(spark, pages, {"type": "page", "max_pages": 9, "max_records": 2}, start_urls=start) == [(0, 1, 0, 1), (0, 2, 0, 2)]
    pages = {"https://x.test/api": '{"items":[{"id":1}],"next":"/api?cursor=abc"}', "https://x.test/api?cursor=abc": '{"items":[{"id":2}],"next":null,"after":"z"}', "https://x.test/api?cursor=z": '{"items":[],"next":"/api"}'}
    start = ["https://x.test/api"]
    assert _api(spark, pages, {"type": "cursor", "next_json_path": "next", "max_pages": 9}, start_urls=start) == [(0, 1, 0, 1), (0, 2, 0, 2)]
    assert _api(spark, pages, {"type": "cursor", "cursor_json_path": "after", "next_json_path": "next", "max_pages": 9}, start_urls=start) == [(0, 1, 0, 1), (0, 2, 0, 2)]


def test_child_records_and_lists_of_links(spark):
    html = '<article><div class="seller"><span class="name">Acme</span><span>rating: 5</span><a href="/a">x</a></div><div class="seller"><span class="name">bolt works</span></div></article>'
    children = [{"name": "name", "selector": ".name", "transforms": ["title"]}, {"name": "rating", "type": "regex", "pattern": r"rating:\s*(\d+)", "transforms": ["int"]}, {"name": "link", "type": "attribute", "selector": "a", "attribute": "href", "transforms": ["urljoin"], "default": "/none"}]
    fields = [{"name": "seller", "selector": ".seller", "children": children}, {"name": "seller", "selector": ".missing", "default": "ignored", "override": False}, {"name": "all", "selector": ".seller", "many": True, "children": children}, {"name": "none", "selector": ".nobody", "many": True, "children": children}, {"name": "links", "type": "attribute", "selector": "a", "attribute": "href", "many": True, "transforms": ["urljoin", "canonical_url"]}, {"name": "texts", "selector": "span", "many": True, "transforms": ["title", "html_to_text"]}]
    config = job.load({"id": "c", "start_urls": ["https://x.test/p"], "fields": fields})
    r = engine.run(spark, config, spark.createDataFrame([("https://x.test/p", 200, html)], "url string, status_code int, body string")).records.first()
    assert r.seller.asDict() == {"name": "Acme", "rating": 5, "link": "https://x.test/a"}
    assert [x.asDict() for x in r["all"]] == [r.seller.asDict(), {"name": "Bolt Works", "rating": None, "link": "https://x.test/none"}]
    assert r["none"] is None and r.links == ["https://x.test/a"] and r.texts == ["Acme", "Rating: 5", "Bolt Works"]


def test_configurations_say_what_cannot_run():
    base = {"id": "a", "start_urls": ["u"]}
    paths = lambda **more: [p for p, _ in job.check({**base, **more})]
    assert paths(pagination={"type": "next_button"}) == ["pagination.next_selector"]
    assert paths(pagination={"type": "cursor"}) == ["pagination.next_json_path"]
    assert paths(pagination={"type": "page", "urls": ["v"]}) == ["pagination.urls"]
    assert paths(fields=[{"name": "x", "type": "children"}]) == ["fields[0].children"]
    assert paths(fields=[{"name": "x", "type": "regex", "pattern": "a", "children": [{"name": "y", "selector": "b"}]}]) == ["fields[0].type"]


def test_paging_stops_when_records_get_older(spark):
    pages = {f"https://x.test/list?page={n}": json.dumps({"items": [{"id": n * 10 + k, "at": at} for k, at in enumerate(ats)]}) for n, ats in enumerate((["2024-01-05", "2024-01-04"], ["2024-01-03", "2024-01-01"], ["2024-01-09"]), 1)}
    frame = spark.createDataFrame([(u, 200, b) for u, b in pages.items()], "url string, status_code int, body string")
    fields = [{"name": "id", "type": "json_path", "json_path": "id", "transforms": ["int"]}, {"name": "at", "type": "json_path", "json_path": "at"}]
    run = lambda **w: sorted(r.id for r in engine.run(spark, job.load({**API, "start_urls": ["https://x.test/list?page=1"], "fields": fields, "pagination": {"type": "page", "max_pages": 3}, "watermark": {"enabled": True, "field": "at", **w}}), frame, bound="2024-01-02").records.collect())
    assert run() == [10, 11, 20, 30]
    assert run(stop_when_older=True) == [10, 11, 20]
