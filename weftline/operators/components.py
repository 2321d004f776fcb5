"""Connected components of a graph of links, without collecting it anywhere.

Every partition first reduces its own links to a forest (:func:`_forests`), which leaves at most one link per node and
partition. What fits into one partition is done by that. Otherwise rounds of contraction follow: every node points to
the smallest node around it, pointers are followed to their ends (each step reaches three times as far), and the graph
of those ends is contracted further. A round leaves the local minima, at most half of the nodes, so a handful of rounds
is enough; each is written to the shared folder, so lineage stays short and a lost executor costs one round. The
neighbours of a node are aggregated before the shuffle; no list of them is ever made, so a node with a third of all
links is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import discard, materialize

#: Links that a partition turns into a forest at once; a longer partition makes several.
FOREST_LINKS = 1_000_000


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forests(edges: DataFrame, at_once: int) -> DataFrame:
    """``a, b, forest``: the links of each partition as stars ``b → a`` around the smallest node of each tree."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        parent: dict = {}
        size, types = 0, None

        def find(x: object) -> object:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        def stars() -> pa.RecordBatch:
            found = [(find(x), x) for x in list(parent)]
            found = [(r, x) for r, x in found if r != x]
            name = uuid4().hex
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], types), pa.array([x for _, x in found], types), pa.array([name] * len(found), pa.string())], ["a", "b", "forest"])

        for batch in batches:
            types = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            size += batch.num_rows
            if size >= at_once:
                yield stars()
                parent, size = {}, 0
        if parent:
            yield stars()

    return edges.mapInArrow(run, f"a {kind}, b {kind}, forest string")


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = FOREST_LINKS) -> DataFrame:
    """``node, root`` of every node with a link, ``root`` being the smallest node of its component.

    ``edges`` has comparable columns ``a`` and ``b``; nulls, self links and repeats are ignored. An empty
    table gives an empty result.
    """
    stars = materialize(_forests(_links(edges.where("a is not null and b is not null")), at_once), "forests")
    pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("root"))
    if stars.select("forest").distinct().limit(2).count() < 2:  # one forest is the answer
        return stars.select(F.explode(F.array(pair("b", "a"), pair("a", "a"))).alias("x")).select("x.*").distinct()
    now: DataFrame = stars.select("a", "b")
    done: DataFrame | None = None  # nodes and what they are contracted to
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        low = materialize(ends.groupBy(F.col("e.u").alias("u")).agg(F.least(F.min("e.v"), F.first("e.u")).alias("to")), "pointers")
        far, step_files = low.select("u", F.col("to").alias("root")), low
        while True:  # each time pointers reach three times as far; those of a star are there at once
            hop = lambda df, at, far=far: df.join(far.select(F.col("u").alias(at), F.col("root").alias(f"{at}_to")), at)
            step = hop(hop(far, "root").withColumnRenamed("root_to", "x"), "x").select("u", F.col("x").alias("before"), F.col("x_to").alias("root"))
            last, step = step_files, materialize(step, "pointers")
            step_files = step
            discard(last)
            far = step.select("u", "root")
            if step.where("before <> root").isEmpty():
                break
        at = far.select("u", "root")
        mapped = now.join(at.select(F.col("u").alias("a"), F.col("root").alias("x")), "a").join(at.select(F.col("u").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        before, now = now, materialize(_forests(_links(mapped), at_once).select("a", "b"), "edges")
        discard(before)
        step = at.select(F.col("u").alias("node"), "root")
        if done is None:
            done = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
            done = materialize(done.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    if done is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return done
