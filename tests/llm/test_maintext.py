from datetime import datetime

from weftline.llm import maintext as M

PAGE = """<!doctype html>
<html><head><title>Bees like <b>clover</b> - Site</title>
<script>var x = '<p>not text</p>';</script>
</head><body>
<div class="a1"><li><a href="/">Home</a></li>
<li><a href="/x">Latest</a></li></div>
<div><a href="/">Home</a> / <a href="/x">Bees</a></div>
<div class="b2">
<h1>Bees like clover</h1>
<div>Ann · 01.02.2024 · 4 min</div>
<p>Bees have been seen on clover in every month of the summer, and nobody knows
why they prefer it to the thyme on the hill.</p>
<div class="n"><div>We use cookies to make this site work.</div>
<button>Accept all</button></div>
<ul><li>They fly early in the day.</li></ul>
<table><tr><td>June</td><td>14</td></tr></table>
<div>You may also like: Wasps do not like it</div>
</div>
<div>Share this page A B C</div>
<section><h3>Leave a comment</h3>
<p>I saw twelve of them yesterday near the old mill and they did not mind me at all, not even when I came close.</p>
</section>
<footer><p>A long story about the people who made this site, told in many words. All rights reserved.</p></footer>
</body></html>"""


def test_page():
    assert M.page_lines(PAGE) == [9, 11, 12, 15, 16]
    assert M.page_lines(PAGE.replace("</title>", "").replace("<title>", "")) == [9, 11, 12, 15, 16]


def test_unclosed_and_cut():
    assert M.page_lines(PAGE.replace("</li></div>", "</li>")) == [9, 11, 12, 15, 16]
    assert M.page_lines(PAGE[: PAGE.index("why they")]) == [9, 11]
    assert M.page_lines("<p><div><<<") == [] and M.page_lines("<html>") == []


def test_text_lines():
    text = "Skip to content\nHome | Latest | Shop\nHome › Shop › Tea\nTea is older than this town\nAnn · 01.02.2024 · 4 min\nIt came on a ship that nobody had ordered.\n- It was green.\nJune\t14\nShare this page A B\nA note of the house. All rights reserved.\n"
    assert M.text_lines(text) == [4, 6, 7, 8]


def test_no_main_content():
    for args in [(None,), ("",), ("  \n ",), ('{"a": 1}', 200, "application/json"), ("[1, 2]",), (PAGE, 404), (PAGE, 304), ("<h1>Please log in to read on</h1>", 200)]:
        assert M.lines_of(*args) == [], args


def test_corpus_takes_out_lines_that_a_host_repeats(spark):
    schema = "response_id long, host string, url string, status_code int, body string, headers map<string,string>, content_type string, final_url string, fetched_at timestamp, line_no string, line_hash string"
    own = "The same long line that stands on every page of this host and on no other one."
    body = lambda n: f"Title number {n} of the pages\nA sentence that only page {n} has, long enough to count here.\n{own}\n"
    data = [(n, "h", f"u{n}", 200, body(n), {}, "text/plain", None, datetime(2024, 1, 1), "clash", "clash") for n in range(12)]
    data += [(100, None, None, None, body(100), None, None, None, None, None, None), (101, "h", "u1", 200, None, None, None, None, None, None, None), (102, "i", "v", 200, "x" * 300_000, None, "text/plain", None, None, None, None)]
    df = spark.createDataFrame(data, schema)
    got = sorted((r.response_id, r.line_no) for r in M.main_lines(df).collect())
    assert got == sorted([(n, k) for n in range(12) for k in (1, 2)] + [(100, k) for k in (1, 2, 3)])
    assert M.main_lines(df.limit(0)).count() == 0
