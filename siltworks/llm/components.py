"""Connected components of an edge table, by contracting parts of it in the tasks and joining what they found.

Each round deals edges out by their larger end; a task replaces the edges it holds by stars, each node linked to the
smallest node that it is connected with there. Before edges are dealt, the tasks that read them contract them likewise,
so that of a hub no more edges meet in a task than there are tasks, and ask where the smallest nodes are dealt to whether
those are linked to smaller ones. Where they are, links jump in the next round: a node goes to what the node it is linked
to was linked to itself. Those answers are broadcast up to FEW rows and joined by a shuffle beyond, where Spark's own
skew handling splits a hub's side. A round is one to three shuffles and one written table, so lineage stays short, and
only counts, observed as it is written, reach the driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltworks.llm import common
from siltworks.llm.common import materialize

#: Edges that a task contracts at once.
AT_ONCE = 1 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges u, v in order, and for each the smallest node that it is connected with."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((above := label[label]) != label).any():
            label = above


def _contracted(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """Stars u, v (u > v) with the components of the edges in batches, AT_ONCE edges or somewhat more at a time.

    A row with u = v asks for u. own: u is the larger end of an edge here, asked: u was asked for. Where batches are
    sorted by u and hold all rows of each, a node has one row that is its own over all tasks. roots: each smallest node
    is asked for.
    """

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, least = least_reached(u, v)
        wanted = (nodes != least) | roots & np.isin(nodes, v)
        nodes, least = nodes[wanted], least[wanted]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least), pa.array(np.isin(nodes, u[u != v])), pa.array(np.isin(nodes, u[u == v]))], names=["u", "v", "own", "asked"])

    held_u, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        waiting.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(x) for x, _ in waiting) + len(held_u) >= AT_ONCE:
            u, v = (np.concatenate([held, *(w[i] for w in waiting)]) for i, held in enumerate((held_u, held_v)))
            waiting = []
            cut = int(np.flatnonzero(u != u[-1]).max(initial=-1)) + 1  # the last node's edges may go on
            if cut:
                yield stars(u[:cut], v[:cut])
            held_u, held_v = u[cut:], v[cut:]
    u, v = (np.concatenate([held, *(w[i] for w in waiting)]) for i, held in enumerate((held_u, held_v)))
    if len(u):
        yield stars(u, v)


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long, not null). Returns u, v for every node u but the smallest of each component, which is v.

    Loops and repeated edges are allowed; an empty table gives an empty one. The result is a written table.
    """
    schema = "u long, v long, own boolean, asked boolean"
    met = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(most_rounds):
        dealt = met.mapInArrow(lambda batches: _contracted(batches, roots=True), schema).select("u", "v").repartition("u").sortWithinPartitions("u")
        seen = Observation()
        found = dealt.mapInArrow(_contracted, schema).observe(seen, F.count_if(~F.col("own")).alias("strays"), F.count_if(F.col("own") & F.col("asked")).alias("jumps"))
        now = materialize(found, "stars")
        strays, jumps = seen.get["strays"], seen.get["jumps"]
        if not strays and not jumps:
            return now.select("u", "v")
        above = now.where("own and asked").select(F.col("u").alias("v"), F.col("v").alias("w"))
        met = now.select("u", "v").join(F.broadcast(above) if jumps <= common.FEW else above, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long, not null). Returns node, component (the smallest node reachable) for every node of an edge.

    Loops and repeated edges are allowed; an empty table gives an empty one. The result rests on a written table.
    """
    found = stars(edges, most_rounds)
    roots = found.select(F.col("v").alias("node")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
