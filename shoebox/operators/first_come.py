"""The order-first independent set of a conflict graph: a node stays unless an earlier neighbour stays.

``edges`` has ``later`` and ``earlier``, once per pair. What must be found is the dropped nodes; all others stay.

The choice runs through chains of any length, so it is not made by rounds over the graph. The graph falls apart into components, and
a component of at most ``TASK_EDGES`` edges is settled in one pass over its edges in order, many small ones to a task. A larger one is
settled by stretches of its order: the first ``TASK_EDGES`` edges in one task, then everything that their nodes decide is taken out. Rounds
follow the edges of the largest component over ``TASK_EDGES``, however long its chains are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators.components import components
from shoebox.session import dense_order, durable

TASK_EDGES = 1_000_000
STEP = 1 << 16  # edges that are Python numbers at a time


def _settled(table: pa.Table) -> pa.Table:
    """One pass over the edges of whole components, or of the earliest nodes of one."""
    later, earlier = (table.column(c).to_numpy() for c in ("later", "earlier"))
    order = np.argsort(later, kind="stable")
    dropped: set[int] = set()
    for k in range(0, len(order), STEP):
        here = order[k : k + STEP]
        for node, neighbour in zip(later[here].tolist(), earlier[here].tolist()):
            if neighbour not in dropped:
                dropped.add(node)
    out = np.fromiter(dropped, np.int64, len(dropped))
    out.sort()
    return pa.table({"ord": pa.array(out, pa.int64())})


def _one_task(edges: DataFrame) -> DataFrame:
    """For a checked number of edges."""
    return durable(edges.groupBy(F.lit(0).alias("_all")).applyInArrow(lambda t: _settled(t), "ord long"))


def _by_stretches(edges: DataFrame, task_edges: int) -> DataFrame:
    """Dropped nodes of components of any size."""
    parts: list[DataFrame] = []
    left = durable(edges)
    while not left.isEmpty():
        placed = dense_order(left, "later", "earlier", name="_place")
        # Up to the node that would go over the number; that node alone if it is the first.
        cut = placed.where(F.col("_place") == task_edges).agg(F.max("later")).first()[0]
        first = placed.agg(F.min("later")).first()[0]
        now = left if cut is None else left.where(F.col("later") < max(cut, first + 1))
        dropped = _one_task(now)
        parts.append(dropped)
        rest = left.where(F.col("later") >= max(cut, first + 1)) if cut is not None else left.limit(0)
        # What the settled nodes decide: edges from dropped ones go, and nodes with an earlier one that stays are dropped.
        rest = rest.join(dropped.select(F.col("ord").alias("earlier")), "earlier", "left_anti")
        stays = now.select(F.explode(F.array("later", "earlier")).alias("earlier")).distinct().join(
            dropped.select(F.col("ord").alias("earlier")), "earlier", "left_anti")
        hit = durable(rest.join(stays, "earlier", "left_semi").select(F.col("later").alias("ord")).distinct())
        parts.append(hit)
        rest = rest.join(hit.select(F.col("ord").alias("later")), "later", "left_anti")
        left = durable(rest.join(hit.select(F.col("ord").alias("earlier")), "earlier", "left_anti"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def dropped_nodes(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``ord`` of the nodes that an earlier, staying neighbour drops. ``edges`` is a durable table."""
    if edges.count() <= task_edges:
        return _one_task(edges)
    found = components(edges.select(F.col("later").alias("a"), F.col("earlier").alias("b")))
    owned = durable(edges.join(found.select(F.col("node").alias("later"), "root"), "later"))
    sizes = durable(owned.groupBy("root").agg(F.count("*").alias("_edges")))
    large = sizes.where(F.col("_edges") > task_edges).select("root")
    small = owned.join(large, "root", "left_anti")
    bins = max(1, -(-2 * edges.count() // task_edges))
    packed = small.withColumn("_bin", F.pmod(F.xxhash64("root"), F.lit(bins))).select("_bin", "later", "earlier")
    dropped = durable(packed.groupBy("_bin").applyInArrow(lambda t: _settled(t), "ord long"))
    big = durable(owned.join(large, "root", "left_semi").select("later", "earlier"))
    return dropped if big.isEmpty() else dropped.unionByName(_by_stretches(big, task_edges))
