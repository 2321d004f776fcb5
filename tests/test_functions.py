import hashlib
import json
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import hashing, htmlquery, jsonpath, transforms, urls
from weftline.functions.htmlquery import Page


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


TEXTS = ["", "  a  b ", "\t x y\x1c\n", "1,299.50 USD", "1.2万", "3亿", "12 km", "5k", "-7", "none", "YES", " on ", "0", "$ 1,000", "￥5.5", None, "é ", "a,b,, c "]


def test_text_transforms_equal_python(spark):
    assert column(spark, TEXTS, transforms.strip) == [t if t is None else t.strip() for t in TEXTS]
    assert column(spark, TEXTS, transforms.normalize_space) == [t if t is None else " ".join(t.split()) for t in TEXTS]
    assert column(spark, TEXTS, transforms.to_bool) == [t if t is None else t.strip().lower() in {"1", "true", "yes", "y", "on"} for t in TEXTS]
    assert column(spark, TEXTS, lambda c: transforms.split_text(c)) == [t if t is None else [p.strip() for p in t.split(",") if p.strip()] for t in TEXTS]
    assert column(spark, ["o'neil ab-cd 3d", None], transforms.title_case) == ["O'Neil Ab-Cd 3D", None]


def test_numbers(spark):
    got = column(spark, TEXTS, transforms.currency_parse)
    want = [None, None, None, 1299.5, 12000.0, 3e8, 12e6 if "12 km".endswith("m") else 12.0, 5000.0, -7.0, None, None, None, 0.0, 1000.0, 5.5, None, None, None]
    assert got == want
    chain = lambda c, *t, **k: transforms.apply_chain(c, list(t), **k)[0]
    assert column(spark, ["SKU 12", "1,200"], lambda c: chain(c, "int")) == [12, 1200]
    assert column(spark, ["12.50", "x"], lambda c: chain(c, "int", strict=False)) == [None, None]
    with pytest.raises(Exception):
        column(spark, ["12.50"], lambda c: chain(c, "int"))
    with pytest.raises(Exception):
        column(spark, ["x"], lambda c: chain(c, "float"))


def test_chains_on_arrays(spark):
    run = lambda v, *t, **k: column(spark, [v], lambda c: transforms.apply_chain(c, list(t), is_array=True, **k)[0], "array<string>")[0]
    assert run([" a ", "B"], "strip", "lower") == ["a", "b"]
    assert run(["a", "b"], "first") == "a" and run(["a", "b"], "last") == "b" and run([], "first") == ""
    assert run(["a", "b", "c"], {"type": "list_index", "index": -2}) == "b" and run(["a"], {"type": "list_index", "index": 4, "default": "d"}) == "d"
    assert run(["a", None], {"type": "join", "value": "|"}) == "a|None"
    assert run(["a", None], join_with="|") == "a|"
    assert run(["abc"], "length") == [3] and run(["x-1"], {"type": "regex_extract", "pattern": r"(\w)-(?P<n>\d)", "group": "n"}) == ["1"]
    assert run(["aab"], {"type": "replace", "pattern": "(a)", "replacement": r"<\1>$"}) == ["<a>$<a>$b"]
    assert run(["v"], "no_such_transform") == ["v"]
    transforms.register("shout", lambda c, o: F.concat(F.upper(c), F.lit("!")))
    assert run(["v"], "shout") == ["V!"]


def test_regex_and_defaults(spark):
    one = lambda v, t: column(spark, [v], lambda c: transforms.apply_chain(c, [t])[0])[0]
    assert one("id: 7\nx", {"type": "regex_extract", "pattern": r"id: (\d+)"}) == "7"
    assert one("nothing", {"type": "regex_extract", "pattern": r"id: (\d+)", "default": "?"}) == "?"
    assert one("", {"type": "default_if_empty", "value": "d"}) == "d"
    assert one("pre-x", {"type": "remove_prefix", "value": "pre-"}) == "x" and one("x.html", {"type": "remove_suffix", "value": ".html"}) == "x"
    assert one("a<b>c</b>d", "html_to_text") == "a d c"


URLS = ["HTTP://User@Ex.Example:80/A/b?utm_source=x&b=1&&c&Fbclid=2&d=a b#f", "//host/p?q", "/only/path?x=1#y", "https://h?gclid=1", "mailto:a@b", "", "http://a_b.example/ü?k=%20+é&utm_medium", "https://h/p;x?a=b=c"]


def test_urls_equal_the_standard_library(spark):
    def normal(u):
        p = urlsplit(u)
        q = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in urls.TRACKING]) if p.query else ""
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path, q, ""))

    assert column(spark, URLS, urls.normalize) == [normal(u) for u in URLS]
    assert column(spark, URLS, urls.host) == [urlsplit(u).hostname for u in URLS]
    assert column(spark, URLS, urls.strip_query) == [urlunsplit((*urlsplit(u)[:3], "", "")) for u in URLS]
    assert column(spark, ["x/y", "http://h/p", "//h/p", " h.example/a "], urls.ensure_scheme) == ["https://x/y", "http://h/p", "https://h/p", "https://h.example/a"]
    assert column(spark, ["../b", "?q", "//h/x", "http://o/", ""], lambda c: urls.join(F.lit("http://s/a/c"), c)) == [urljoin("http://s/a/c", u) for u in ["../b", "?q", "//h/x", "http://o/", ""]]
    assert column(spark, ["HTTP://H/a/../b?x#y"], urls.canonical) == ["http://h/b?x"]
    assert column(spark, ["http://h/p?page=3&x=y", "http://h/p"], lambda c: urls.int_param(c, "page")) == [3, None]
    assert column(spark, ["http://h/p?a=1"], lambda c: urls.add_params(c, F.create_map(F.lit("b"), F.lit("c d")))) == ["http://h/p?a=1&b=c+d"]
    assert column(spark, ["http://h/p?a=1&b=2#f"], lambda c: urls.drop_query(c, ["a"])) == ["http://h/p?b=2#f"]
    assert column(spark, ["*.Ex.example", "http://ex.example:8/x", ".ex.example"], urls.clean_domain) == ["ex.example"] * 3
    assert column(spark, ["http://h:1/x", "/seg/x", ""], urls.rate_key) == ["h:1", "seg", "local"]


DOC = {"a": {"b": [{"c": 1, "d": [{"e": 2}, {}]}, {"c": None}, {}]}, "l": [10, 20], "t": "x"}


@pytest.mark.parametrize("path, want", [
    ("", DOC), ("$", DOC), ("$.t", "x"), ("a.b[].c", [1, None, None]), ("a.b[]", DOC["a"]["b"]), ("a.b.c", [1, None, None]), ("a.b[0].c", 1), ("a.b[-1]", {}), ("a.b[9]", None),
    ("l.1", 20), ("l[]", [10, 20]), ("t[]", []), ("no.such", None), ("a.b[].d[].e", [[2, None], [], []]), ("a.b.0.d.0.e", 2),
])
def test_json_paths(path, want):
    assert jsonpath.evaluate(DOC, path) == want


def test_json_items_and_values(spark, rows):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, "{broken"), (3, None), (4, json.dumps({"a": {"b": 5}}))], "k long, body string")
    assert rows(jsonpath.items(df, ["k"], "body", "a.b[]"), "k", "item_pos") == [(1, 0), (1, 1), (1, 2)]
    assert rows(jsonpath.items(df, ["k"], "body", "a.b"), "k", "item") [-1] == (4, "5")
    assert rows(jsonpath.values(df, ["k"], "body", {"t": "t"})) == [(1, '"x"'), (2, None), (3, None), (4, None)]
    assert rows(df.select("k", jsonpath.scalar(F.col("body"), "a.b[0].c")))[0] == (1, "1")
    assert jsonpath.is_scalar("a.b") and not jsonpath.is_scalar("a[].b")


PAGE = """<div id=top class="a b"><p>one <b>two</b> three</p><br><p data-k="en-GB" lang=en>four
five</p></div><div class="b"><div class="b"><i>six</i></div></div><p>seven"""


def test_selectors():
    p = Page(PAGE)
    text = lambda s: [p.text(n) for n in p.select(s)]
    assert text("div.a p") == ["one three two", "four five"]
    assert text("#top > p") == [] and text("p:first-child") == []
    assert text(".b .b") == ["six"] and text("div i") == ["six", "six"]
    assert [len(p.select(f"p[{x}]")) for x in ("data-k", "data-k=en-GB", "data-k*='n-'", 'data-k^="en"', "data-k$=GB", "data-k|=en", "lang~=en", "data-k=en")] == [1, 1, 1, 1, 1, 1, 1, 0]
    assert p.select("") == [0] and text("P")[0] == "one three two"
    assert htmlquery.xpath(p, "//p/@lang") == ["", "en", ""] and htmlquery.xpath(p, "string(//i)") == ["six"]
    assert [p.text(n) for n in htmlquery.xpath(p, "//*[@id='top']")][0].startswith("one") and len(htmlquery.xpath(p, "//div[contains(@class,'b')]")) == 3
    assert htmlquery.xpath(p, "//a/b/c") == []
    assert p.outer(p.select("i")[0]) == "<i>six</i>"


def test_extract_rules(spark, rows):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>x" * 3000)], "k long, html string")
    got = rows(htmlquery.extract(df, "k", "html", {"t": {"selector": "p"}, "l": {"selector": "p", "attribute": "lang"}}, "div.a"))
    assert got == [(1, 0, ["one three two", "four five"], ["en"])]
    assert htmlquery.extract(df, "k", "html", {"t": {"selector": "p"}}).count() == 3


VALUES = st.dictionaries(st.sampled_from(["b", "a", "Z"]), st.one_of(st.none(), st.booleans(), st.integers(-(2**40), 2**40), st.text(st.characters(min_codepoint=32, max_codepoint=0x2FFF, exclude_characters="  \x7f"), max_size=8)), min_size=1)


@settings(max_examples=12, deadline=None)
@given(record=VALUES)
def test_record_hash_equals_sorted_json(spark, record):
    kind = {bool: T.BooleanType(), int: T.LongType(), str: T.StringType(), type(None): T.StringType()}
    schema = T.StructType([T.StructField(k, kind[type(v)]) for k, v in record.items()])
    df = spark.createDataFrame([tuple(record.values())], schema)
    got = df.select(hashing.record_hash({k: (F.col(k), schema[k].dataType) for k in record})).first()[0]
    assert got == hashlib.sha256(json.dumps(record, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_patterns_are_translated():
    assert transforms.java_pattern(r"(?P<a>x)\Z") == r"(?sU)(?<a>x)\z"
    assert re.compile(r"(?P<a>x)").groupindex["a"] == 1
