"""Connected components of an edge table, in a logarithmic number of rounds (large-star / small-star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.plans.scratch import Scratch

#: Edges a task, where a round's result is written.
EDGES_A_TASK = 250_000
#: Rows of a node from which it is a hub, and the most hubs (what is broadcast): with more rows the first number grows.
HUB, HUBS = 500, 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's edges (a > b) as edges from each node to the smallest of its tree: hubs and copies shrink before a shuffle."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            before = label.copy()
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            label = label[label]
            if (label == before).all():
                break
        on = label != np.arange(len(nodes))
        yield pa.record_batch({"a": nodes[on], "b": nodes[label[on]]})


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One half round. A node's rows are pre-aggregated to its minimum and then meet it; those of hubs in many parts."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    hub = max(HUB, 2 * rows // HUBS)
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), F.floor(F.col("n") / hub).alias("k"))
    # at most HUBS nodes have that many rows
    hubs = F.broadcast(low.where("k > 0").select("u", "k"))
    dealt = both.join(hubs, "u", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("k") + 1), F.lit(0)).alias("part"))
    met = dealt.join(low.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), "k")).alias("part")), ["u", "part"])
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every end of an edge; component = smallest node reachable.

    edges: ``(a, b)`` longs; loops are single components, rows with a null end are ignored. A round is written to
    the shared folder, so long chains neither grow the plan nor depend on one executor.
    """
    scratch = Scratch(edges.sparkSession, "components")
    clean = edges.where("a is not null and b is not null").select(F.greatest(F.col("a").cast("long"), F.col("b").cast("long")).alias("a"), F.least(F.col("a").cast("long"), F.col("b").cast("long")).alias("b"))
    given = scratch.table(clean.distinct(), "given")
    now = given.where("a > b").mapInArrow(_forest, "a long, b long")
    before = None
    for _ in range(max_rounds):
        # an edge gives one edge at most in a half round, and each node one of its own
        rows = before[0] if before else now.count()
        turn = _star(_star(now, True, rows), False, 2 * rows).distinct()
        if before:
            turn = turn.coalesce(max(8, before[0] // EDGES_A_TASK))
        now = scratch.table(turn, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    low = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).unionByName(given.where("a = b").select(F.col("a").alias("node"))).distinct().join(low, "node", "left_anti")
    return low.unionByName(roots.select("node", F.col("node").alias("component")))
