import json
import random
import re

from weftline.llm import linkage as L

SCHEMA = "id string, spider_id string, batch_no int, unique_hash string, payload_json string, cls string, words string"


def pairs(spark, items):
    df = spark.createDataFrame([(*i, "clash", "clash") for i in items], SCHEMA)
    return sorted((r.id_a, r.id_b) for r in L.link_batches(df).collect())


def doc(title, text, **more):
    return json.dumps({"id": 1, "title": title, "description": text, "author": {"name": "Somebody Else With A Long Name"}, **more})


def brute(items):
    parent = {i[0]: i[0] for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    rows = []
    for rid, spider, _, digest, payload in {i[0]: i for i in items}.values():
        d = L.read_payload(payload)
        if isinstance(d, dict) and spider is not None:
            title, text = L.title_and_text(d)
            rows.append((rid, spider, (digest or "").strip().lower(), " ".join(L.words(title or "")), set(L.words(title or "")) | set(L.words(text or "")), bool(text and L.words(text))))
    for k, a in enumerate(rows):
        for b in rows[:k]:
            if a[1] == b[1]:
                same = a[2] and a[2] == b[2] or a[5] and b[5] and len(a[4] & b[4]) >= 0.8 * len(a[4] | b[4])
                if same or a[3] and a[3] == b[3] and not (a[5] and b[5]):
                    join(a[0], b[0])
    return sorted((find(r[0]), r[0]) for r in rows if find(r[0]) != r[0])


def test_words():
    assert L.words("<p>Ünïted &amp; <b>Free</b>!</p>") == ["united", "free"]
    assert L.words("这是 test。") == ["这", "是", "test"]
    assert L.words("") == []


def test_title_and_text_under_other_names():
    long = "word " * 40
    assert L.title_and_text({"name": "A title of four", "channel": {"name": "Not this one at all"}, "summary": long}) == ("A title of four", long)
    assert L.title_and_text({"detail": {"title": "Inner title here now", "body": long}})[1] == long
    assert L.title_and_text({"überschrift": "Ein Titel mit fünf Wörtern", "inhalt": long, "url": "https://a.example/x"}) == ("Ein Titel mit fünf Wörtern", long)
    assert L.title_and_text({"id": 4, "tags": ["a"]}) == (None, None)


def test_batches_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items, texts = [], []
    for n in range(160):
        spider = "hub" if rng.random() < 0.6 else rng.choice(["s1", "s2"])
        kind = rng.random()
        if texts and kind < 0.45:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 2, 6, 20])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(60)]
        texts.append(words)
        text = " ".join(words)
        payload = doc("Title " + " ".join(words[:4]), rng.choice([text, text.upper(), f"<p>{text}.</p>"]))
        if kind > 0.97:
            payload = rng.choice([None, "{broken", "[]", json.dumps(payload)])
        if 0.9 < kind < 0.95:
            payload = doc(f"Only a title number {rng.randrange(3)}", None)
        items.append((f"r{n:04}", spider, n // 40, rng.choice([None, "", f"h{rng.randrange(200)}", f"H{rng.randrange(200)}"]), payload))
    items += items[:5] + [("z1", None, 3, "h1", doc("a b c d", "e")), ("z2", "s1", 3, "h1", None)]
    assert pairs(spark, items) == brute(items)


def test_crowds_of_near_copies_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(L, "CROWD", 10)
    rng = random.Random(5)
    base = [f"word{i}" for i in range(80)]
    items = []
    for n in range(60):  # near copies of one text, all in the same buckets
        words = list(base)
        for _ in range(rng.choice([1, 2, 9])):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        items.append((f"r{n:03}", "hub", n // 30, None, doc("The same title of all", " ".join(words))))
    items += [(f"q{n:03}", "hub", 0, None, doc("Copy title here now", " ".join(base[:40]))) for n in range(40)]
    assert pairs(spark, items) == brute(items)


def test_empty_and_extreme(spark):
    assert pairs(spark, []) == []
    long = " ".join(f"w{i}" for i in range(20_000))
    items = [("a", "s", 0, None, doc("t t t t", long)), ("b", "s", 1, None, doc("t t t t", long + " more")), ("c", "s", 1, "x", "{}"), ("d", "s", 2, " X ", "{}")]
    assert pairs(spark, items) == [("a", "b"), ("c", "d")]
    assert pairs(spark, [("a", "s", None, "x", "{}")]) == []


def test_accept_keeps_history_as_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    schema = "id string, spider_id string, batch_no int, unique_hash string, payload_json string"
    frame = lambda *items: spark.createDataFrame(items, schema)
    linker = L.Linker(spark)
    linker.accept(frame(("a", "s", 0, "h", doc("t", text)), ("b", "s", 0, None, doc("t", text.replace("w7 ", "x "))), ("c", "s", 0, None, doc("u", "nothing like it at all"))))
    assert sorted((r.id_a, r.id_b) for r in linker.repeats().collect()) == [("a", "b")]
    linker.accept(frame(("d", "s", 1, "H", doc("v", "other words here")), ("e", "other", 1, "h", doc("t", text)), ("f", "s", 1, None, doc("u", "Nothing like it, at all!"))))
    assert sorted((r.id_a, r.id_b) for r in linker.repeats().collect()) == [("a", "b"), ("a", "d"), ("c", "f")]
    linker.accept(frame().limit(0))
    assert len({r.cluster for r in linker.clusters().collect()}) == 3
    links = linker.links().collect()
    assert {r.via for r in links} == {"words", "hash"}
    assert all(r.share >= L.SIMILARITY and r.weight is not None for r in links if r.via == "words")
    linker.close(delete=True)


def test_weights_are_learned():
    counts = {((4, 2, 4), True): 400, ((4, 2, 2), True): 50, ((1, 0, 3), True): 2, ((0, 0, 1), False): 900, ((0, 0, 3), False): 100, ((1, 0, 2), False): 60}
    w = L.Weights.load(L.Weights(counts).dump())
    score = lambda p: w.prior() + sum(t[v] for t, v in zip(w.tables(), p))
    assert score((4, 2, 4)) > 0 > score((0, 0, 1))
    assert w.bar() < score((1, 0, 3)) and w.bar() <= score((0, 0, 0)) + 1e-6  # too few pairs to turn any away
    counts = {((4, 2, 4), True): 4000, ((4, 2, 3), True): 500, ((3, 0, 3), True): 20, ((0, 0, 1), False): 9000, ((0, 0, 2), False): 3000, ((1, 1, 1), False): 600}
    many = L.Weights({k: n * 10_000 for k, n in counts.items()})
    score = lambda p: many.prior() + sum(t[v] for t, v in zip(many.tables(), p))
    assert score((0, 0, 1)) < many.bar() <= score((3, 0, 3)) < score((4, 2, 4))
    lost = sum(n for (p, linked), n in many.counts.items() if linked and score(p) < many.bar())
    assert lost <= L.MISSES * sum(n for (_, linked), n in many.counts.items() if linked)


def near(n, k):
    """Text ``n`` with ``k`` words changed."""
    return " ".join(f"t{n}w{i}" if i >= k else f"t{n}x{i}" for i in range(60))


def test_a_later_session_goes_on_and_reads_its_own_sources_only(spark, tmp_path):
    schema = "id string, spider_id string, batch_no int, unique_hash string, payload_json string"
    home = f"file://{tmp_path}/linkage"
    first = L.Linker(spark, 4000, home)
    old = [(f"a{s:03}-{n}", f"s{s}", 0, None, doc(f"Title {s} {n} of this", near(s * 100 + n, 0))) for s in range(150) for n in range(3)]
    first.accept(spark.createDataFrame(old, schema))
    first.accept(spark.createDataFrame([("b1", "s7", 1, None, doc("Other words up here", near(700, 2)))], schema))
    first.close()
    # a batch that dies leaves rows that must not count
    second = L.Linker.open(spark, home)
    broken = spark.createDataFrame([("x1", "s7", 2, None, doc("Title of the dead batch", near(9999, 0)))], schema)
    second._join = None
    try:
        second.accept(broken)
    except TypeError:
        pass
    second.close()
    third = L.Linker.open(spark, home)
    assert third.step == 3 and third.state["steps"] == [1, 2]
    seen = {}
    keys = third._read("keys").count()
    similar = third._similar

    def watched():
        seen["slots"] = third._touched
        seen["keys"] = third._read("keys").where(f"step < {third.step}").count()
        seen["plan"] = third._read("keys").groupBy("slot").count()._jdf.queryExecution().toString()
        return similar()

    third._similar = watched
    third.accept(spark.createDataFrame([("c1", "s7", 3, None, doc("And other words again", near(700, 4))), ("c2", "s9", 3, None, doc("Nothing like the rest", near(8888, 0)))], schema))
    assert 0 < seen["keys"] < 0.05 * keys
    assert "SelectedBucketsCount: 2 out of 8" in seen["plan"] or "SelectedBucketsCount: 1 out of 8" in seen["plan"]
    assert sorted((r.id_a, r.id_b) for r in third.repeats().collect()) == [("a007-0", "b1"), ("a007-0", "c1")]
    third.accept(spark.createDataFrame([("d1", "s3", 4, None, doc("x", "nothing at all like anything"))], schema))
    parents = third._read("parents").groupBy("step").count().collect()
    assert {r.step: r["count"] for r in parents} == {2: 2, 4: 1}  # the first two of the cluster, then its new member
    assert {r.via for r in third.links().collect()} == {"words"}
    third.close(delete=True)


def test_order_of_batches_does_not_matter(spark):
    title = "One title of two that is rather long"
    full, bare, other = doc(title, near(1, 0)), doc(title, None), doc(title, near(2, 0))
    items = []
    for n, order in enumerate(([full, other, bare], [full, bare, other], [bare, full, other])):
        items += [(f"r{k}", f"s{n}", k, None, p) for k, p in enumerate(order)]
        items += [(f"q{k}", f"t{n}", 0, None, p) for k, p in enumerate(order)]
    items = [(f"{s}{i}", s, *rest) for i, s, *rest in items]
    assert pairs(spark, items) == sorted((f"{s}{n}{i}0", f"{s}{n}{i}{k}") for s, i in (("s", "r"), ("t", "q")) for n in range(3) for k in (1, 2))


def test_clusters_of_old_records_are_joined(spark):
    text = lambda k: doc("Some title of it all", near(5, k))  # noqa: E731  5 and 9 changed words of 60 are too far apart
    apart = doc("Some title of it all", " ".join(near(5, 0).split()[:30] + near(6, 0).split()[:30]))
    items = [("a", "s", 0, "h1", text(0)), ("b", "s", 0, "h1", text(1)), ("c", "s", 1, "h2", apart), ("d", "s", 1, "H2", doc("Quite another one", near(8, 0))), ("e", "s", 2, "h2", text(2)), ("f", "s", 3, None, text(3))]
    assert pairs(spark, items) == [("a", x) for x in "bcdef"]


def test_source_that_outgrows_its_slot(spark, monkeypatch):
    rng = random.Random(4)
    items = []
    for n in range(90):
        words = near(rng.randrange(12), rng.randrange(5))
        items.append((f"r{n:03}", "hub" if n % 3 else "small", n // 30, rng.choice([None, f"h{rng.randrange(40)}"]), doc(f"Title number {rng.randrange(9)} it is and goes on", words if n % 7 else None)))
    begin = L.Linker._begin

    def tight(self, spark, home, state):
        begin(self, spark, home, state | {"slot_rows": 4})

    monkeypatch.setattr(L.Linker, "_begin", tight)
    assert pairs(spark, items) == brute(items)
    monkeypatch.setattr(L, "CROWD", 3)
    assert pairs(spark, items) == brute(items)


def test_history_stays_where_it_lies_while_keys_are_counted(spark, monkeypatch):
    """Only rows of the batch are moved for it, also with sources over several slots and more partitions than buckets."""
    begin, write, plans = L.Linker._begin, L.materialize, []

    def tight(self, spark, home, state):
        begin(self, spark, home, state | {"slot_rows": 4})

    def watched(df, name):
        if name == "crowded":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(L.Linker, "_begin", tight)
    monkeypatch.setattr(L, "materialize", watched)
    monkeypatch.setattr(L, "CROWD", 10)
    items = [(f"r{n:03}", "hub" if n % 3 else "small", n // 30, None, doc(f"Title {n} of this", near(n % 7, n % 4))) for n in range(90)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert pairs(spark, items) == brute(items)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(plans) == 3
    for plan in plans[1:]:
        moved = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
        assert moved and not [m for m in moved if m.startswith("slot") and "key" in m]
