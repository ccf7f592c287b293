"""Exact top-k by inner product over a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its ring, a range of distances to that pivot; rows sorted by
(pivot, ring, distance) are cut into blocks of at most BLOCK vectors, one row a block. Pivots and ring edges come from a
bounded sample; every vector is indexed. Search: for each annulus (pivot and ring) the triangle inequality bounds a
query's inner product with all of its vectors. A query first expands the best annuli until they hold k vectors, which
gives its k-th score so far; then it visits exactly those others whose bound reaches that score. All other annuli are
proven to hold no result, so the answer is exact.

Components are floor(1024 * x), x as double. Vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros. Rows with equal vec_id are candidates each, but one query, and no
candidates of each other. Scores are worked out in double precision where that is exact and in whole numbers otherwise; a
score beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.llm.common import materialize

K, SCALE = 10, 1024.0
#: Fewest and most pivots, and rings a pivot (so MOST_PIVOTS * RINGS annuli at most). Pivots grow with the square root of
#: the rows. They are set on a sample of SAMPLE rows, or SAMPLE_PIVOT for each pivot.
LEAST_PIVOTS, MOST_PIVOTS, RINGS, SAMPLE, SAMPLE_PIVOT = 8, 1024, 8, 2048, 16
#: Vectors a block, queries a block, blocks of an annulus that one task holds, and queries of an annulus gathered by one.
BLOCK, QUERY_BLOCK, TASK_BLOCKS, TASK_QUERIES = 1024, 256, 4, 8192


def pivots_for(rows: int) -> int:
    return max(LEAST_PIVOTS, min(MOST_PIVOTS, int(rows**0.5 / 3)))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list<double> column, filled up with zeros to one width."""
    sizes = np.diff(column.offsets.to_numpy())
    width = width if width is not None else int(sizes.max(initial=0))
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wider(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and vec (array<double> of whole numbers) of the rows that take part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vec"))


class Pivots:
    """Pivot vectors and, for each, the ring edges."""

    def __init__(self, sample: np.ndarray, pivots: int = LEAST_PIVOTS, rings: int = RINGS):
        rng = np.random.default_rng(3)
        points = sample if len(sample) else np.zeros((1, sample.shape[1]))
        centres = points[rng.choice(len(points), min(pivots, len(points)), replace=False)]
        for _ in range(6):
            near, _ = self._nearest(points, centres)
            centres = np.stack([points[near == p].mean(axis=0) if (near == p).any() else centres[p] for p in range(len(centres))])
        self.at, self.rings = np.floor(centres), rings
        near, own = self._nearest(points, self.at)
        self.edges = np.stack([np.quantile(own[near == p], np.linspace(0, 1, rings + 1)[1:-1]) if (near == p).any() else np.zeros(rings - 1) for p in range(len(self.at))])

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        for at in range(0, len(a), QUERY_BLOCK):  # temporaries stay small beside the result
            part = a[at : at + QUERY_BLOCK]
            out[at : at + QUERY_BLOCK] = np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * part @ b.T, 0))
        return out

    @classmethod
    def _nearest(cls, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of a, which row of b is nearest and how far it is; some rows at a time."""
        found = [(np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(a), QUERY_BLOCK):
            apart = cls._apart(a[at : at + QUERY_BLOCK], b)
            near = np.argmin(apart, axis=1)
            found.append((near, apart[np.arange(len(near)), near]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def distances(self, x: np.ndarray) -> np.ndarray:
        width = max(x.shape[1], self.at.shape[1])
        return self._apart(_wider(x, width), _wider(self.at, width))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus of each row and its distance to that annulus's pivot."""
        width = max(x.shape[1], self.at.shape[1])
        near, own = self._nearest(_wider(x, width), _wider(self.at, width))
        return near * self.rings + (own[:, None] > self.edges[near]).sum(axis=1), own


class Bounds:
    """What is known of each annulus: number of vectors, range of distances to the pivot, largest norm."""

    def __init__(self, pivots: Pivots, rows: list):
        self.pivots = pivots
        self.ids = np.array([r.annulus for r in rows], np.int64)
        self.count = np.array([r.n for r in rows], np.int64)
        self.of = self.ids // pivots.rings
        #: Pivots that hold vectors, the first annulus of each, and among how many tasks its blocks are dealt.
        self.held, self.starts = np.unique(self.of, return_index=True)
        self.salts = np.maximum(1, -(-(np.add.reduceat(self.count, self.starts) if len(self.ids) else self.count) // (BLOCK * TASK_BLOCKS)))
        self.low, self.high, self.norm = (np.array([r[k] for r in rows]) for k in ("low", "high", "norm"))

    def highest(self, q: np.ndarray) -> np.ndarray:
        """[queries, annuli] upper bounds of inner products, with room for rounding."""
        apart = self.pivots.distances(q)[:, self.of]
        width = max(q.shape[1], self.pivots.at.shape[1])
        inner = (_wider(q, width) @ _wider(self.pivots.at, width).T)[:, self.of]
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        # Distances are known to about a millionth of the vectors' sizes.
        slack = 1e-6 * (size + self.norm[None] + 1)
        gap = np.maximum(np.maximum(apart - self.high[None], self.low[None] - apart) - slack, 0)
        by_gap = (size**2 + self.norm[None] ** 2 - gap**2) / 2
        by_pivot = inner + size * (self.high[None] + slack)
        by_norm = size * self.norm[None]
        best = np.minimum(np.minimum(by_gap, by_pivot), by_norm)
        return best + 1e-6 * (np.abs(best) + size * self.norm[None]) + 1

    def rings(self, visited: np.ndarray) -> np.ndarray:
        """[queries, held pivots]: the visited rings of each, one bit a ring, of [queries, annuli]."""
        return np.add.reduceat(visited * (1 << self.ids % self.pivots.rings), self.starts, axis=1)

    def dealt(self, pivot: int) -> int:
        return int(self.salts[np.searchsorted(self.held, pivot)])


def build(vectors: DataFrame) -> tuple[DataFrame, DataFrame, Bounds]:
    """Index scaled() vectors: (vectors with their annulus, block rows, bounds). Both tables are written to the shared folder."""
    wanted = pivots_for(vectors.count())
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, SAMPLE_PIVOT * wanted)).select("vec").toArrow().column("vec").combine_chunks()
    pivots = Pivots(_matrix(rows) if len(rows) else np.zeros((0, 1)), wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                annulus, apart = pivots.place(x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(annulus), pa.array(apart), pa.array(np.sqrt((x * x).sum(axis=1))), batch.column("vec")], names=["vec_id", "annulus", "apart", "norm", "vec"])

    placed = materialize(vectors.mapInArrow(place, "vec_id long, annulus long, apart double, norm double, vec array<double>"), "placed")
    bounds = Bounds(pivots, placed.groupBy("annulus").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high"), F.max("norm").alias("norm")).orderBy("annulus").collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            annulus = batch.column("annulus").to_numpy()
            at = 0
            while at < len(annulus):
                to = min(at + BLOCK, int(np.searchsorted(annulus, annulus[at], side="right")))
                pivot, ring = divmod(int(annulus[at]), pivots.rings)
                yield _packed(batch.slice(at, to - at), pivot, ring, number % bounds.dealt(pivot))
                at, number = to, number + 1

    # Sorted as a whole, so that a block holds neighbours in distance and no annulus has to fit one task.
    ordered = placed.select("vec_id", "annulus", "apart", "vec").repartitionByRange("annulus", "apart", "vec_id").sortWithinPartitions("annulus", "apart", "vec_id")
    return placed, materialize(ordered.mapInArrow(cut, PACKED), "blocks"), bounds


PACKED = "pivot long, ring long, salt long, n long, ids binary, vecs binary"


def _packed(rows: pa.RecordBatch, pivot: int, ring: int, salt: int) -> pa.RecordBatch:
    x = _matrix(rows.column("vec"))
    return pa.RecordBatch.from_arrays([pa.array([pivot]), pa.array([ring]), pa.array([salt]), pa.array([len(x)]), pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["pivot", "ring", "salt", "n", "ids", "vecs"])


def visits(q: np.ndarray, bounds: Bounds, k: int, least: np.ndarray | None = None) -> np.ndarray:
    """[queries, annuli]: which annuli a query visits. First wave: the best until k + 1 vectors are in them.

    With least, the second wave: those of the others whose bound reaches a query's k-th score so far (nan: all).
    """
    high = bounds.highest(q)
    order = np.argsort(-high, axis=1, kind="stable")
    held = np.cumsum(bounds.count[order], axis=1)
    first = np.zeros(high.shape, bool)
    np.put_along_axis(first, order, held - bounds.count[order] < k + 1, axis=1)
    return first if least is None else ~first & ~(high < least[:, None])


def _visits(queries: DataFrame, bounds: Bounds, k: int, second: bool) -> DataFrame:
    """Rows (pivot, rings, vec_id, least, vec) of visits(), some queries at a time; a vector goes to a pivot once for all its rings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if len(bounds.ids) else 0, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                least = part.column("least").to_numpy(zero_copy_only=False) if second else None
                rings = bounds.rings(visits(_matrix(part.column("vec")), bounds, k, least))
                row, col = np.nonzero(rings)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(bounds.held[col]), pa.array(rings[row, col]), part.column("vec_id").take(pa.array(row)), pa.array(least[row], from_pandas=True) if second else pa.nulls(len(row), pa.float64()), part.column("vec").take(pa.array(row))], names=["pivot", "rings", "vec_id", "least", "vec"])

    return queries.mapInArrow(run, "pivot long, rings long, vec_id long, least double, vec array<double>")


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    return (whole(q) @ whole(v).T).astype(np.int64)


def _wave(found: DataFrame, blocks: DataFrame, bounds: Bounds, k: int, asked: int) -> DataFrame:
    """Up to k best (query_id, vec_id, score) of each query and block; ties go to the smaller vec_id.

    found: visits of `asked` queries. A task holds some blocks of a pivot and streams the queries that visit it.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            at = 0
            while at < len(pivot):
                to = min(at + QUERY_BLOCK, int(np.searchsorted(pivot, pivot[at], side="right")))
                part = batch.slice(at, to - at)
                x = _matrix(part.column("vec"))
                least = np.nan_to_num(part.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                rings = part.column("rings").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(pivot[at])]), pa.array([bounds.dealt(int(pivot[at]))]), pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([rings.tobytes()], pa.binary()), pa.array([least.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["pivot", "salts", "q_ids", "q_rings", "q_least", "q_vecs"])
                at = to

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for at in range(batch.num_rows) for x in batch.slice(at, 1).to_pylist()):
                ids, q_ids, least = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_least"])
                v, q = np.frombuffer(r["vecs"]).reshape(len(ids), -1), np.frombuffer(r["q_vecs"]).reshape(len(q_ids), -1)
                here = np.flatnonzero(np.frombuffer(r["q_rings"], np.int64) >> r["ring"] & 1)
                if not len(here):
                    continue
                q_ids, least, q = q_ids[here], least[here], q[here]
                width = max(v.shape[1], q.shape[1])
                s = _exact(_wider(q, width), _wider(v, width))
                own = q_ids[:, None] == ids[None]
                fit = ~own & (s >= least[:, None])
                if len(ids) > k:  # scores below the block's k-th best can't count; equal ones stay until the ids decide
                    low = np.iinfo(np.int64).min
                    fit &= s >= np.partition(np.where(own, low, s), len(ids) - k, axis=1)[:, [len(ids) - k]]
                row, col = np.nonzero(fit)
                order = np.lexsort((ids[col], -s[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < k], col[rank < k]
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[col]), pa.array(s[row, col])], names=["query_id", "vec_id", "score"])

    deal = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked // TASK_QUERIES))))
    packed = found.repartition("pivot", deal).sortWithinPartitions("pivot", "vec_id").mapInArrow(gather, "pivot long, salts long, q_ids binary, q_rings binary, q_least binary, q_vecs binary")
    right = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    # Always a merge join: sizes are judged before vectors are packed and repeated by pivot, so either side may look small.
    pairs = blocks.join(right.hint("merge"), ["pivot", "salt"]).select("ring", "ids", "vecs", "q_ids", "q_rings", "q_least", "q_vecs")
    return pairs.mapInArrow(score, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors with is_query (over vec_id) its k best other rows, exactly.

    Fewer than k candidates give fewer rows. Repeated vec_ids among the queries count once (their least vector).
    Other columns are ignored.
    """
    placed, blocks, bounds = build(scaled(vectors, id_col, vector_col))
    queries = placed.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = queries.count()
    first = materialize(_wave(_visits(queries, bounds, k, second=False), blocks, bounds, k, asked), "first")
    best = _ranked(first, k)
    worst = F.min("score").cast("double")  # a little less, as doubles round large scores
    least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, worst - F.abs(worst) * 1e-12).alias("least"))
    waiting = queries.join(least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").select("vec_id", "vec", "least")
    second = _wave(_visits(waiting, bounds, k, second=True), blocks, bounds, k, asked)
    return _ranked(first.union(second), k).select("query_id", "rank", "vec_id", "score")
