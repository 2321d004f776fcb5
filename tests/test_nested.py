import json

from weftline.operators import nested as N
from weftline.plans import data_queries


def brute(value, path=(), pos=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, (*path, k), pos)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, dict):
                yield ".".join(path), ".".join(map(str, (*pos, i)))
            yield from brute(v, path, (*pos, i))


DOCS = {
    "a": {"x": [{"y": [{"z": 1}, None, {}]}, 5, None, {"y": []}], "n": {"m": [{}]}},
    "b": {"x": [[{"q": 1}], [None, {"q": [{"w": 2}]}]], "replies": [{"replies": [{"replies": [{}]}]}]},
    "c": [{"k": 1}],
    "d": {"plain": "text", "list": [1, 2]},
}


def test_json_elements_against_walk(spark, rows):
    data = [(k, json.dumps(v), "clash") for k, v in DOCS.items()]
    data += [("a", json.dumps(DOCS["a"]), "clash"), ("e", json.dumps(json.dumps(DOCS["a"])), "clash"), ("f", '{"x": [{"a"', "clash"), ("g", None, "clash"), ("h", "", "clash"), ("i", "x" * 100_000, "clash")]
    df = spark.createDataFrame(data, "id string, body string, path string")
    want = [(k, *e) for k, v in {**DOCS, "e": DOCS["a"]}.items() for e in brute(v)]
    assert rows(N.json_elements(df, "id", "body", fields=False)) == sorted(want, key=repr)
    assert N.json_elements(df.limit(0), "id", "body").count() == 0


def test_shred_links_parents_and_shares_recursive_tables(spark, rows):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in DOCS.items()], "id string, body string")
    el = N.json_elements(df, "id", "body").cache()
    keys = {(r.record_key, r.path, r.pos) for r in el.collect()}
    for r in el.collect():
        assert (r.record_key, r.parent_path, r.parent_pos) in keys or (r.parent_path, r.parent_pos) == ("", "")
    graph = {r.table_path: r for r in N.schema_graph(el).collect()}
    assert graph["replies"].recursive and graph["replies"].n_rows == 3
    tables = N.shred(el)
    assert rows(tables["x.y"], "record_key", "pos", "parent_pos", "z") == [("a", "0.0", "0", "1"), ("a", "0.2", "0", None)]


def test_struct_elements(spark, rows):
    ddl = "id long, pos array<struct<u:string>>, playlists array<struct<label:string, files array<struct<f:string, h:int>>>>, n struct<deep array<struct<k:int>>>, tags array<string>, m map<string,string>"
    data = [
        (1, [("a",), None, (None,)], [("l", [("f", 1), None]), None, ("m", None)], ([(1,)],), ["t"], {"a": "b"}),
        (1, [("a",), None, (None,)], [("l", [("f", 1), None]), None, ("m", None)], ([(1,)],), ["t"], {"a": "b"}),
        (2, None, [], None, None, None), (3, [], None, (None,), [None], None),
    ]
    df = spark.createDataFrame(data, ddl)
    assert rows(N.struct_elements(df, "id", fields=False)) == [("1", "n.deep", "0"), ("1", "playlists", "0"), ("1", "playlists", "2"), ("1", "playlists.files", "0.0"), ("1", "pos", "0"), ("1", "pos", "2")]
    got = {(r.path, r.pos): r for r in N.struct_elements(df, "id").collect()}
    assert got["playlists.files", "0.0"].parent_path == "playlists" and got["playlists.files", "0.0"].fields == {"f": "f", "h": "1"}
    assert N.struct_elements(df.select("id", "tags"), "id").count() == 0


def test_struct_elements_of_maps_and_variants(spark, rows):
    """Maps are objects of JSON, wherever they stand; a variant is read by what it holds."""
    ddl = (
        "m map<string,array<struct<u:string, at:map<string,int>>>>, am array<map<string,string>>, n struct<mm map<int,map<string,array<array<struct<k:int>>>>>>, "
        "s array<struct<`a.b`:int, a:struct<b:int>, x map<string,map<string,int>>, deep:map<string,struct<w:int, l:array<struct<z:int>>>>>>, plain map<string,string>"
    )
    data = [
        ({"x": [("1", {"p": 1, "q": None}), None], "y.z": [(None, None)], "none": None}, [{"f": "g", "h": None}, None, {}], ({7: {"t": [[(1,)], None, [None, (2,)]]}, 8: None},), [(1, (2,), {"a": {"b.c": 1}, "a.b": {"c": 1}}, {"d": (5, [(6,), None]), "e": None}), (3, (None,), None, {})], {"a": "b"}),
        ({}, [], None, None, None),
        (None, None, (None,), [], {}),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)] + [(0, *data[0])], f"id long, {ddl}")
    text = df.where("id is not null").selectExpr("id", "to_json(struct(m, am, n, s, plain)) as body")
    shown = lambda el: sorted((r.record_key, r.path, r.pos, r.parent_path, r.parent_pos, sorted(r.fields.items())) for r in el.collect())
    want = shown(N.json_elements(text, "id", "body"))
    assert {w[1] for w in want} == {"m.x", "m.y.z", "am", "n.mm.7.t", "s", "s.deep.d.l"}
    assert shown(N.struct_elements(df, "id")) == want
    assert rows(N.struct_elements(df, "id", fields=False)) == sorted((w[:3] for w in want), key=repr)
    variant = text.selectExpr("id", "parse_json(body) as v", "array(named_struct('o', 1)) as typed")
    more = [(str(i), "typed", "0", "", "", [("o", "1")]) for i in range(3)]
    assert shown(N.struct_elements(variant, "id")) == sorted(more + [(k, f"v.{p}", pos, up and f"v.{up}", at, f) for k, p, pos, up, at, f in want])
    assert len(rows(N.struct_elements(variant, "id", fields=False))) == len(want) + 3


def test_records_with_maps_are_told_apart(spark):
    """Records of a key that differ in their maps alone are two, however little they differ."""
    sql = "select 1L as id, array(map('k', timestamp'2024-01-01 00:00:00.0001')) as a union all select 1L, array(map('k', timestamp'2024-01-01 00:00:00.0002'))"
    twice = spark.sql(f"{sql} union all {sql}")
    assert sorted(r.fields["k"] for r in N.struct_elements(twice, "id").collect()) == ["2024-01-01 00:00:00.0001", "2024-01-01 00:00:00.0002"]
    swapped = spark.sql("select 1L as id, array(map('k', 1, 'l', 2)) as a union all select 1L, array(map('l', 2, 'k', 1))")
    assert N.struct_elements(swapped, "id").count() == 1


def test_p4_found_makes_whole_element_tables(spark):
    """Foreign keys and inlined values are worked out, though the query returns keys alone."""
    found = data_queries.p4_found(spark, "/root/testdata/sf0.001")
    made = spark.read.parquet(*found.inputFiles())
    assert {"parent_path", "parent_pos", "fields"} <= set(made.columns)
    files = made.where("path = 'playlists.files'")
    assert files.count() > 0 and files.where("parent_path = 'playlists' and fields['fileUrl'] is not null").count() > 0
    assert made.count() == found.count()
