"""Dependency graphs: degrees, rank, cycles, flows, diagrams. Edges are src, dst rows; repeated edges count."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.columns import GRAPH_ROOTS, diagram_id, module_name

#: Distinct edges up to which one task ranks a graph; beyond, each round is a join over the cluster.
LOCAL_EDGES = 2_000_000
DAMPING, TOLERANCE, MOST_ROUNDS = 0.85, 1e-6, 100


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir. Without that setting a temporary one on a single machine; a cluster needs it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="siltworks-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def written(df: DataFrame) -> DataFrame:
    """df written to a folder under spark.checkpoint.dir and read back: lost executors cost a task, and lineage stays short."""
    spark = df.sparkSession
    path = shared_folder(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def weighted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n_in, n_out of every node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    both = nodes.join(into, "node", "left").join(out, "node", "left")
    return both.select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def entry_points(degree: DataFrame) -> DataFrame:
    return degree.where("n_in <= 1 and n_out > 0")


def isolated(degree: DataFrame) -> DataFrame:
    return degree.where("n_in = 0 and n_out = 0")


def _rank(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    out = np.bincount(src, weights=w, minlength=n)
    share = w / out[src] if len(src) else w
    dangling = out == 0
    r = np.full(n, 1 / max(n, 1))
    for _ in range(MOST_ROUNDS):
        new = (1 - DAMPING) / n + DAMPING * (np.bincount(dst, weights=r[src] * share, minlength=n) + r[dangling].sum() / n)
        moved, r = np.abs(new - r).sum(), new
        if moved < TOLERANCE:
            break
    return r


def pagerank(nodes: DataFrame, edges: DataFrame, method: str = "auto") -> DataFrame:
    """node, score. Repeated edges weigh more; dangling nodes spread evenly. nodes must be distinct.

    auto: graphs of at most LOCAL_EDGES distinct edges and nodes are ranked in one task, larger ones by a join a round.
    """
    flow = written(weighted(edges))
    if method == "auto":
        method = "local" if flow.count() <= LOCAL_EDGES and nodes.count() <= LOCAL_EDGES else "cluster"
    return _pagerank_local(nodes, flow) if method == "local" else _pagerank_cluster(nodes, flow)


def _pagerank_local(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    kind = nodes.schema["node"].dataType.simpleString()
    rows = flow.select("src", "dst", "w").unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(0.0).alias("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        w = whole.column("w").to_numpy()
        names = whole.column("src").to_numpy(zero_copy_only=False)
        known, src = np.unique(names, return_inverse=True)
        edge = w > 0
        dst = np.searchsorted(known, whole.column("dst").filter(pa.array(edge)).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(known.tolist(), whole.schema.field("src").type), pa.array(_rank(src[edge], dst, w[edge], len(known)))], names=["node", "score"])

    # coalesce(1) rather than a sort: one task by design, of bounded size.
    return rows.repartition(1).mapInArrow(lambda b: (x for t in [list(b)] if t and sum(y.num_rows for y in t) for x in run(iter(t))), f"node {kind}, score double")


def _pagerank_cluster(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    out = flow.groupBy("src").agg(F.sum("w").alias("total"))
    share = written(flow.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    n = nodes.count()
    dangling = written(nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti"))
    rank = written(nodes.select("node", F.lit(1 / max(n, 1)).alias("score")))
    for _ in range(MOST_ROUNDS):
        spare = rank.join(dangling, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        into = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = written(rank.join(into, "node", "left").select("node", ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + spare / n)).alias("new"), F.col("score").alias("old")))
        moved = new.agg(F.coalesce(F.sum(F.abs(F.col("new") - F.col("old"))), F.lit(0.0))).first()[0]
        rank = new.select("node", F.col("new").alias("score"))
        if moved < TOLERANCE:
            break
    return rank


def cycles(edges: DataFrame, method: str = "auto") -> DataFrame:
    """node, component (least member), size of every node that lies on a cycle of several nodes.

    auto: up to LOCAL_EDGES distinct edges (counted) one task walks the graph depth first. Larger graphs are first
    trimmed on the cluster of nodes without a way in or out; if too much is left, components are found there as well.
    """
    left = written(edges.where("src <> dst").select("src", "dst").distinct())
    size = left.count()
    if method == "auto":
        if size > LOCAL_EDGES:
            left, size = _trimmed(left, size)
        method = "local" if size <= LOCAL_EDGES else "cluster"
    if method == "cluster":
        return _cycles_cluster(left)
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict = {}
        for b in batches:
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                after.setdefault(s, []).append(d)
                after.setdefault(d, [])
        rows = [(v, min(c), len(c)) for c in strong_components(after) if len(c) > 1 for v in c]
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["node", "component", "size"])

    return left.select("src", "dst").repartition(1).mapInArrow(run, f"node {kind}, component {kind}, size long")


def _trimmed(edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Edges between nodes that have a way in and a way out, and how many there are. Ends when a round removes under a hundredth."""
    for _ in range(MOST_ROUNDS):
        edges = written(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        before, size = size, edges.count()
        if size > 0.99 * before:
            break
    return edges, size


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least label of start (node, label) that reaches a node along edges (src, dst) to a fixed point."""
    now, state = start, None
    while True:
        step = now.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "label")
        now = written(now.unionByName(step).groupBy("node").agg(F.min("label").alias("label")))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first())
        if new == state:
            return now
        state = new


def _cycles_cluster(edges: DataFrame) -> DataFrame:
    """cycles() by colouring: the least node that reaches a node colours it; within a colour, what reaches that node back is
    its strong component. Found components leave the graph, and edges between colours with them."""
    kind = edges.schema["src"].dataType.simpleString()
    found = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while True:
        edges, size = _trimmed(edges, edges.count())
        if not size:
            break
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        colour = _spread(written(nodes.select("node", F.col("node").alias("label"))), edges)
        inside = edges.join(colour.select(F.col("node").alias("src"), "label"), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst").where("label = other")
        back = written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("node = label")
        mine = _spread(written(roots), back)
        found = written(found.unionByName(mine.select("node", F.col("label").alias("component"))))
        rest = inside.join(mine.select(F.col("node").alias("src")), "src", "left_anti").join(mine.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = written(rest.select("src", "dst"))
    size = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(size, "component").select("node", "component", "size")


def strong_components(after: dict) -> list[list]:
    """Two depth-first walks: finishing order, then the reversed edges in that order."""
    done, order = set(), []
    for start in sorted(after):
        if start in done:
            continue
        done.add(start)
        walk = [(start, iter(after[start]))]
        while walk:
            node, rest = walk[-1]
            step = next((x for x in rest if x not in done), None)
            if step is None:
                order.append(node)
                walk.pop()
            else:
                done.add(step)
                walk.append((step, iter(after[step])))
    before: dict = {v: [] for v in after}
    for s, ds in after.items():
        for d in ds:
            before[d].append(s)
    out, seen = [], set()
    for start in reversed(order):
        if start in seen:
            continue
        seen.add(start)
        part, stack = [], [start]
        while stack:
            v = stack.pop()
            part.append(v)
            new = [x for x in before[v] if x not in seen]
            seen.update(new)
            stack += dict.fromkeys(new)
        out.append(part)
    return out


def trace(calls: DataFrame, entry: str, most_depth: int) -> DataFrame:
    """Calls reachable from an entry symbol: from_symbol, to_symbol (each pair once), depth from 1.

    One join a level; what was seen at an earlier level is left out.
    """
    step = calls.select("from_symbol", "to_symbol").distinct()
    level = step.where(F.col("from_symbol") == entry).withColumn("depth", F.lit(1).cast("long"))
    seen = written(level)
    front = seen
    for depth in range(2, most_depth + 1):
        heads = front.select(F.col("to_symbol").alias("from_symbol")).distinct()
        front = written(step.join(heads, "from_symbol").join(seen, ["from_symbol", "to_symbol"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trace_calls(calls: DataFrame, entry: str, most_depth: int) -> DataFrame:
    """from_file, from_symbol, to_file, to_symbol, depth, place of the calls reachable from a symbol's name in any file.

    A pair of names counts once, at the first call that reaches it in breadth-first order; a call goes on from the file
    and symbol that it leads to. Order by depth, place: place lists the calls on the way, so no numbering of rows is needed.
    """
    names = ["from_file", "from_symbol", "to_file", "to_symbol"]
    pair = ["from_symbol", "to_symbol"]
    edges = calls.select(*names).distinct()
    first = lambda rows: rows.groupBy(*pair).agg(F.min_by(F.struct(*names, "place"), "place").alias("c")).select("c.*")
    front = written(first(edges.where(F.col("from_symbol") == entry).withColumn("place", F.array(F.struct(*names)))).withColumn("depth", F.lit(1).cast("long")))
    seen = front
    for depth in range(2, most_depth + 1):
        heads = front.groupBy(F.col("to_file").alias("from_file"), F.col("to_symbol").alias("from_symbol")).agg(F.min("place").alias("_way"))
        met = edges.join(heads, ["from_file", "from_symbol"]).join(seen.select(*pair), pair, "left_anti")
        front = written(first(met.withColumn("place", F.concat("_way", F.array(F.struct(*names)))).drop("_way")).withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def module_edges(edges: DataFrame, roots: tuple = GRAPH_ROOTS) -> DataFrame:
    """Pairs of different modules that some edge of paths joins."""
    pairs = edges.select(module_name(F.col("src"), roots).alias("src"), module_name(F.col("dst"), roots).alias("dst"))
    return pairs.where("src <> dst").distinct()


def diagram(module_pairs: DataFrame) -> DataFrame:
    """One row, text: the pairs as a left-to-right flow chart, sorted."""
    line = F.concat(F.lit("    "), diagram_id(F.col("src")), F.lit(" --> "), diagram_id(F.col("dst")))
    return module_pairs.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
