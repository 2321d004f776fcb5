import random

from weftline.operators.components import components


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(300, 700), rng.randrange(300, 700)) for _ in range(250)] + [(1000, x) for x in range(1001, 1040)] + [(5000, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    expected = {x: find(x) for x in linked}
    assert {r.node: r.root for r in components(df).collect()} == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several forests, so that rounds follow
    assert {r.node: r.root for r in components(df).collect()} == expected
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = df.selectExpr("cast(cast(a as string) as binary) a", "cast(cast(b as string) as binary) b")
    assert len({bytes(r.root) for r in components(text, at_once=5).collect()}) == len(set(expected.values()))
    assert components(df.limit(0)).count() == 0
