import json

from weftline.operators import drift as D

SCHEMA = "id string, spider_id string, batch_no int, body string, extra map<string,string>, path string"


def table(spark, files):
    out = []
    for (s, b), docs in files.items():
        out += [(f"{s}-{b}-{i}", s, b, d if isinstance(d, str) or d is None else json.dumps(d), {"a": "b"}, "clash") for i, d in enumerate(docs)]
    return spark.createDataFrame(out, SCHEMA)


def found(df, rows):
    return rows(D.drift(D.observe(df, "records", "spider_id", "batch_no", "body")), "spider_id", "file_no", "change_kind", "field", "old_field")


def docs(n, **fields):
    return [{k: f(i) for k, f in fields.items()} for i in range(n)]


def test_added_removed_retyped_renamed(spark, rows):
    title = lambda i: f"A long title number {i} about things"
    when = lambda i: f"2024-01-{i + 1:02}T00:00:00+00:00"
    files = {
        ("s", 0): docs(12, title=title, when=when, score=lambda i: i * 7),
        ("s", 1): docs(12, headline=title, when=when, score=lambda i: str(i * 7)),
        ("s", 3): [*docs(12, headline=title, score=lambda i: str(i), flag=lambda i: i % 2 == 0), None, "{broken", "[1]", '"text"'],
        ("t", 0): docs(3, a=lambda i: {"b": i, "c": [1]}), ("t", 1): docs(3, a=lambda i: {"b": i, "c": None, "d": {}}),
        ("u", 0): ["{broken"], ("u", 1): docs(2, z=lambda i: 1),
    }
    assert found(table(spark, files), rows) == sorted([
        ("s", 1, "renamed", "headline", "title"), ("s", 1, "retyped", "score", ""), ("s", 3, "added", "flag", ""), ("s", 3, "removed", "when", ""), ("t", 1, "removed", "a.c", ""),
    ], key=repr)


def test_majority_counts_repeated_rows_once(spark, rows):
    a = table(spark, {("s", 0): [{"k": 1}, {"k": 2}], ("s", 1): [{"k": 1}, {"k": 2}, {"k": "x"}]})
    again = a.where("id = 's-1-2'")
    assert found(a.unionByName(again).unionByName(again), rows) == []
    assert found(a.limit(0), rows) == []


def test_single_documents_are_renamed_by_value(spark, rows):
    files = {(f"s{i}", r): [c] for i in range(6) for r, c in ((1, {"type": "api", "request": {"timeout": i + 5}}), (2, {"mode": "api", "request": {"timeout_seconds": i + 5}}))}
    got = found(table(spark, files), rows)
    assert {g[2:] for g in got} == {("renamed", "mode", "type"), ("renamed", "request.timeout_seconds", "request.timeout")} and len(got) == 12


def test_unify_chains_renames(spark):
    text = lambda i: f"Some title {i} of an item"
    df = table(spark, {("s", 0): docs(9, title=text), ("s", 1): docs(9, subject=text), ("s", 2): docs(9, headline=text)})
    changes = D.drift(D.observe(df, "records", "spider_id", "batch_no", "body"))
    out = D.unify(df, changes, "records", "spider_id", "batch_no", "body")
    assert {tuple(r.fields) for r in out.collect()} == {("headline",)} and out.count() == 27
    rules = {r.file_no: [s.field for s in r.steps] for r in D.migration_rules(changes).collect()}
    assert rules == {0: ["subject", "headline"], 1: ["headline"], 2: []}


def test_unify_takes_every_step(spark):
    title = lambda i: f"Some title {i} of an item"
    note, remark = lambda i: f"note-{i:04}-{i * 7919 % 9973}", lambda i: "A remark that speaks about " + "things " * (i % 5 + 3)
    files = {
        ("s", 1): docs(12, title=title, note=note, remark=remark, ok=lambda i: i % 2 == 0, count=lambda i: str(i), tags=lambda i: ["a", f"b{i}"], at=lambda i: 1_704_067_200 + i),
        ("s", 4): docs(12, title=title, remark=remark, ok=lambda i: ["no", "yes"][i % 2], count=lambda i: float(i), tags=lambda i: f"c|d{i}", at=lambda i: f"2024-02-01T00:00:{i:02}+00:00"),
        ("s", 6): docs(12, title=title, note=remark, ok=lambda i: ["no", "yes"][i % 2], count=lambda i: "x" if i == 5 else i, tags=lambda i: f"c|d{i}", at=lambda i: f"2024-02-01T00:00:{i:02}+00:00", flag=lambda i: True),
    }
    df = table(spark, files)
    changes = D.drift(D.observe(df, "records", "spider_id", "batch_no", "body"), detailed=True)
    got = {r.id: r for r in D.unify(df, changes, "records", "spider_id", "batch_no", "body").collect()}
    assert len(got) == 36 and {tuple(sorted(r.fields)) for r in got.values()} == {("at", "count", "flag", "note", "ok", "tags", "title")}
    first, last = got["s-1-3"], got["s-6-5"]
    assert first.fields == {"title": title(3), "note": remark(3), "ok": "no", "count": "3", "tags": "a|b3", "at": "2024-01-01T00:00:03+00:00", "flag": None}
    assert [tuple(a) for a in first.aside] == [(4, "note", "removed", note(3))]
    assert got["s-4-3"].fields["count"] == "3" and last.fields["count"] is None and [tuple(a) for a in last.aside] == [(6, "count", "uncast", "x")]
    rules = {r.file_no: [(s.at, s.change_kind) for s in r.steps] for r in D.migration_rules(changes).collect()}
    assert set(rules) == {1, 4, 6} and rules[4] == [(6, "renamed"), (6, "added")] and rules[6] == [(6, "cast")]


def test_casts():
    assert [D.cast(v, "boolean") for v in ("Yes", "0", 1, ["no"])] == [True, False, True, False]
    assert [D.cast(v, "number", {"instant": "s"}) for v in (" 07", "1.50", True, "2024-01-01T00:00:00Z")] == [7, 1.5, 1, 1704067200]
    assert [D.cast(v, "array", {"joiner": "|"}) for v in ("a|b", '["a"]', "a", 1, "[broken")] == [["a", "b"], ["a"], ["a"], [1], ["[broken"]]
    assert [D.cast(v, "string", {"joiner": ","}) for v in (["a", "b"], ["a,b", "c"], 1.5, True)] == ["a,b", '["a,b", "c"]', "1.5", "true"]
    for v, to in (("maybe", "boolean"), (2, "boolean"), ("x", "number"), ("2024-01-01", "number"), ([1, 2], "number")):
        try:
            D.cast(v, to)
        except ValueError:
            continue
        raise AssertionError((v, to))


def test_versions_go_on_from_stored_ones(spark, rows, tmp_path):
    files = {("s", 0): [{"a": 1}], ("s", 1): [{"a": 2}], ("s", 2): [{"a": "x"}], ("s", 4): [{"a": "y", "b": True}], ("t", 1): [{"c": 1}]}
    fields = lambda chosen: D.file_fields(D.observe(table(spark, {k: files[k] for k in chosen}), "records", "spider_id", "batch_no", "body"))
    want = [("s", 0, 1), ("s", 1, 1), ("s", 2, 2), ("s", 4, 3), ("t", 1, 1)]
    assert rows(D.versions(fields(files)), "spider_id", "file_no", "version") == want
    D.versions(fields([("s", 0), ("s", 1), ("s", 2)])).write.parquet(str(tmp_path / "versions"))
    later = D.versions(fields([("s", 4), ("t", 1)]), spark.read.parquet(str(tmp_path / "versions")))
    assert rows(later, "spider_id", "file_no", "version") == want
