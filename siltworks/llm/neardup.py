"""Near-duplicate detection: MinHash bands propose, odd sketches sift, full shingle sets decide.

1. Every text: its set of distinct 5-word shingles (64-bit hashes), the set's digest, SAMPLES MinHash values folded
   into BANDS band keys, and an odd sketch: a bitmap in which each (sample number, value) flips one bit. The population
   count of two sketches' XOR estimates how many samples differ, and so the similarity.
2. Texts with equal sets form a class; only its smallest doc_id goes on, so exact copies cost nothing further.
3. Classes that share a band key form a bucket; buckets with the same members in several bands are kept once (told by
   size, ends and a sum of 40-bit hashes; as a class lies in BANDS buckets only, two that differ fall together with a
   probability under 10^-9 a class). Within a bucket sketches are compared (spanning) until a spanning forest of the
   pairs that may reach the threshold is known and emitted: at most one edge a member, never all pairs. The forest's
   components are candidate families. Any two classes that share a bucket and pass the sketch lie in one family, so no
   link is lost to the forest.
4. Each family's texts are brought together (those over BLOCK members block by block, _confirm) and links are confirmed on
   full sets; again only a spanning forest of the confirmed links is emitted, which has the same components.

Bands, rows and the sketch's bound follow from the threshold (plan): a pair at it shares no band with probability 1e-6.
At 0.85 that takes 36 bands of 7 samples and at 0.80 46 of 6. A pair at 0.85 falls below the sketch's bound with
probability about 1e-5, and the bound for other thresholds is as many standard errors away; pairs of higher similarity
are safer still.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import frugal, likely, materialize, salted_join, text_chunks, with_text
from siltworks.llm.components import least_reached, stars
from siltworks.llm.textcols import lowered, split_words, text_bytes

WIDTH = 5
#: Percent of similarity from which texts are linked, where the caller names none.
THRESHOLD = 85
#: Probability that a pair at the threshold shares no band, most samples a text, and standard errors from the threshold
#: of the samples' share down to the sketch's bound.
MISSED, MOST_SAMPLES, ERRORS = 1e-6, 280, 5.8
SKETCH_BITS = 1024


def plan(threshold: int) -> tuple[int, int, float]:
    """Bands, rows a band, and the estimate under which sketch pairs are dropped, for a threshold in percent.

    Of the rows whose bands take at most MOST_SAMPLES samples, the most: the fewer chance meetings in a band.
    """
    t = threshold / 100
    if not 0.5 <= t < 1:
        raise ValueError("the threshold must be 50 to 99 percent")
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(t**rows)))
        if bands * rows <= MOST_SAMPLES:
            return bands, rows, round(t - ERRORS * math.sqrt(t * (1 - t) / (bands * rows)), 2)
    raise AssertionError("one row fits for any threshold")


BANDS, ROWS, SKETCH_BOUND = plan(THRESHOLD)
SAMPLES = BANDS * ROWS
#: Families with more members are confirmed in blocks of about half as many, and buckets with more compared in pairs of such.
BLOCK, BUCKET = 512, 8192
#: Members of a large family that go to each of its blocks, and shares that rows of one bucket or family are dealt into.
ANCHORS, SALTS = 16, 16

SIGNATURES = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z. Fewer than `width` words: the whole sequence is one."""
    import xxhash

    buf, doc = text_bytes(texts)
    w = split_words(lowered(buf), doc)
    each = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in w.vocab.to_pylist()), np.uint64, len(w.vocab))[w.codes]
    n = len(each)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        rolled = (rolled ^ each[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    out = []
    for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(rolled[a : z - width + 1]))
        elif z > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(each[a:z].tobytes(), z - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix32(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def minhashes(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """[sets, samples] MinHash values; sets must not be empty."""
    whole = np.concatenate(sets)
    folded = (whole ^ (whole >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(17)
    factors, offsets = rng.integers(0, 1 << 31, samples, np.uint32) * 2 + 1, rng.integers(0, 1 << 32, samples, np.uint32)
    out = np.empty((len(sets), samples), np.uint32)
    for j in range(samples):
        h = folded * factors[j] + offsets[j]
        h ^= h >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(h * np.uint32(0x2C1B3C6D), starts)
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """[sets, bands] keys that also hold the band's number; a band has `rows` of the values."""
    bands = values.shape[1] // rows
    keys = np.zeros((len(values), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        keys = (keys ^ values[:, j::rows]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """[sets, SKETCH_BITS / 8] parity bitmaps of the (sample number, value) pairs."""
    parity = np.zeros((len(values), SKETCH_BITS), np.uint8)
    rows = np.arange(len(values))
    for j in range(values.shape[1]):
        parity[rows, _mix32(values[:, j].copy(), j + 1) % np.uint32(SKETCH_BITS)] ^= 1
    return np.packbits(parity, axis=1)


def estimate(differing: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    flipped = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-9))
    return 1 - flipped / (2 * samples)


def _most_differing(bound: float, samples: int = SAMPLES) -> int:
    """Largest population count whose estimate reaches the bound."""
    counts = np.arange(SKETCH_BITS // 2)
    return int(counts[estimate(counts, samples) >= bound].max())


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Signature rows of doc_id, text. Texts without words have n_shingles 0 and null elsewhere."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text", 2 << 20):
                sets = shingle_hashes(part.column("text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                digests, keys, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if len(full):
                    values = minhashes([sets[i] for i in full], bands * rows)
                    for i, k, s in zip(full.tolist(), band_keys(values, rows), odd_sketches(values), strict=True):
                        digests[i], keys[i], sketches[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k, s.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.mapInArrow(run, SIGNATURES)


class Forest:
    """Union-find that remembers which edges joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above
            self.up = above

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal leading `keys` columns; batches are sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[a]) for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def spanning(n: int, linked: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of a graph on 0 to n - 1; linked(i): the nodes linked with i.

    Asks for the links of a node, then of one outside the largest tree, until all such are known. Links that are not
    asked for lie within that tree. A group whose members are nearly all linked with its first takes few questions.
    """
    forest, edges, waiting, i = Forest(n), [], np.ones(n, bool), 0
    while True:
        waiting[i] = False
        hits = linked(i)
        for j in hits[forest.roots()[hits] != forest.root(i)].tolist():
            if forest.join(i, j):
                edges.append((i, j))
        roots = forest.roots()
        rest = np.flatnonzero(waiting & (roots != np.argmax(np.bincount(roots))))
        if not len(rest):
            return edges
        i = int(rest[0])


def sift_bucket(sketches: np.ndarray, bound: int, side: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose sketches differ in at most `bound` bits.

    Pairs of one side are left out unless all are of one.
    """
    both = len(np.unique(side)) > 1
    words = np.ascontiguousarray(sketches).view(np.uint64)

    def linked(i: int) -> np.ndarray:
        near = np.bitwise_count(words ^ words[i]).sum(axis=1, dtype=np.int32) <= bound
        return np.flatnonzero(near & (side != side[i]) if both else near)

    return spanning(len(words), linked)


def confirm_family(sets: list[np.ndarray], side: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with 100 * intersection >= threshold * union; pairs of one side are left out unless all are of one."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    both = len(np.unique(side)) > 1
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    holders, starts = np.repeat(np.arange(n), sizes)[order], np.concatenate([[0], np.cumsum(np.bincount(codes))])
    ends_of = np.cumsum(sizes)

    def linked(i: int) -> np.ndarray:
        mine = codes[ends_of[i] - sizes[i] : ends_of[i]]
        shared = np.zeros(n, np.int64)
        for at in range(0, len(mine), 4096):  # holders of some shingles at a time, as long texts in large families have many
            some = mine[at : at + 4096]
            count = starts[some + 1] - starts[some]
            place = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            shared += np.bincount(holders[place], minlength=n)
        near = 100 * shared >= threshold * (sizes + sizes[i] - shared)
        return np.flatnonzero(near & (side != side[i]) if both else near)

    return spanning(n, linked)


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept (doc_id = component_id).

    Texts of a similarity (shared share of all their distinct shingles) of threshold percent or more are linked.

    Null and empty texts have no shingles, are linked with nothing and are kept. Repeated rows have equal sets and one
    component; rows with the same doc_id are kept or not together. Other columns are ignored. Writes tables to the
    shared folder on the way.
    """
    texts = with_text(docs, id_col, text_col)
    bands, rows, least = plan(threshold)
    signed = materialize(signatures(texts, bands, rows), "signatures")
    worded = signed.where("n_shingles > 0 and doc_id is not null")
    # Bands and sketch follow from the set, so those of any row of a class will do.
    classes = worded.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")

    # Buckets: keys of several classes; of buckets with the same members one is enough.
    keyed = classes.select(F.explode("bands").alias("key"), "rep")
    full = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.sum(F.pmod(F.xxhash64("rep"), F.lit(1 << 40))).alias("h")).where("n > 1 and least <> most")
    keys = materialize(full.groupBy("n", "least", "most", "h").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    # Dealt by rep once, for distinct and the join.
    members = _dealt(salted_join(keyed, keys, "key", ["rep"], "inner", SALTS, keys.count()).repartition("rep").distinct(), "key", BUCKET).join(classes.select("rep", "sketch"), "rep")
    bound = _most_differing(least, bands * rows)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bucket in _groups(batches, 3):
            rep, side = bucket.column("rep").to_numpy(), bucket.column("side").to_numpy()
            sketches = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
            if edges := sift_bucket(sketches, bound, side):
                yield _stars(rep, edges)

    by = ("key", "low", "high")
    members = members.select(*by, "side", "rep", "sketch").repartition(*by).sortWithinPartitions(*by, "rep")
    families = stars(materialize(members.mapInArrow(sift, "u long, v long"), "sifted"))
    linked = _confirm(texts, families, threshold).select(F.col("u").alias("node"), F.col("v").alias("component"))
    # A text alone in its class and without links is its own component and needs no row here.
    placed = classes.select("digest", "rep", "copies").join(linked, classes.rep == linked.node, "left").where("copies > 1 or component is not null")
    placed = materialize(placed.select("digest", F.coalesce("component", "rep").alias("component")), "placed")
    out = salted_join(signed.select("doc_id", "n_shingles", "digest"), placed, "digest", ["doc_id"])
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _stars(rep: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    """Components of edges between places in rep: u, v for every rep u but the smallest of each component, which is v."""
    a, b = np.array(edges).T
    nodes, least = least_reached(rep[a], rep[b])
    linked = nodes != least
    return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(least[linked])], names=["u", "v"])


def _dealt(members: DataFrame, group: str, most: int) -> DataFrame:
    """Members (group, rep, n) with side, low and high: groups of up to `most` stay whole; larger ones are split into sides
    of about half as many, and every member goes to each pair (low, high) of its side with a side."""
    sides = F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") / (most // 2))).cast("int")
    sided = members.withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    paired = sided.select(group, "rep", "side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    return paired.select(group, "rep", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))


def _confirm(texts: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """Components over confirmed links within families (found: u, v as of stars()): u, v for every member u but the smallest of each component, which is v.

    A family of up to BLOCK members is settled where it is confirmed (low and high are -1). A larger one is first compared
    within blocks of about half as many, to each of which go some ANCHORS of its members too. That joins nearly all of a
    true family. What lies outside the family's largest component then meets every block; pairs within that component
    need no comparison. Only texts of members move (likely); texts in no family are most of a corpus.
    """

    def links(dealt: DataFrame) -> DataFrame:
        # Always a merge join: a broadcast of the families would fit small corpora only.
        member = likely(texts, "doc_id", dealt.select("rep")).join(dealt.hint("merge"), F.col("doc_id") == F.col("rep"))

        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, low, _), rows in _groups(batches, 3):
                rep, side = rows.column("rep").to_numpy(), rows.column("side").to_numpy()
                sets = [s for batch in rows.to_batches() for part in text_chunks(batch, "text") for s in shingle_hashes(part.column("text"))]
                if edges := confirm_family(sets, side, threshold):
                    found = _stars(rep, edges)
                    yield found.append_column("low", pa.array(np.full(found.num_rows, low, np.int32)))

        by = ("family", "low", "high")
        return member.select(*by, "side", "rep", "text").repartition(*by).sortWithinPartitions(*by, "rep").mapInArrow(run, "u long, v long, low int")

    zero, none, half = F.lit(0), F.lit(-1), BLOCK // 2
    counts = materialize(found.groupBy(F.col("v").alias("family")).agg((F.count("*") + 1).alias("n")), "family-sizes")
    families = found.select(F.col("v").alias("family"), F.col("u").alias("rep")).union(counts.select("family", "family"))
    large = counts.where(F.col("n") > BLOCK)
    n_large = large.count()
    if not n_large:
        return links(families.select("family", "rep", zero.alias("side"), none.alias("low"), none.alias("high"))).select("u", "v")
    sized = materialize(salted_join(families, large, "family", ["rep"], "left", SALTS, n_large), "sized")
    whole = sized.where("n is null").select("family", "rep", zero.alias("side"), none.alias("low"), none.alias("high"))
    blocks = F.ceil(F.col("n") / half).cast("int")
    split = sized.where("n is not null").withColumn("low", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    anchor = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("n")) < ANCHORS
    inside = split.select("family", "rep", F.explode(F.when(anchor, F.sequence(zero, blocks - 1)).otherwise(F.array("low"))).alias("low"))
    blockwise = materialize(whole.union(inside.select("family", "rep", zero, "low", F.col("low").alias("high"))), "blockwise")
    first = materialize(links(blockwise), "links")
    settled, joined = first.where("low < 0").select("u", "v"), stars(first.where("low >= 0"))
    # Members of split families outside their family's largest component.
    placed = split.join(joined, split.rep == joined.u, "left").select("family", "rep", "n", "low", F.coalesce("v", "rep").alias("part"))
    placed = materialize(placed, "placed-members")
    parts = placed.groupBy("family", "part").agg(F.count("*").alias("size"))
    main = parts.groupBy("family").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.sum("size").alias("n"), F.max("size").alias("most"))
    waits = F.ceil((F.col("n") - F.col("most")) / half).cast("int")
    told = salted_join(placed.drop("n"), main.select("family", "main", "n", waits.alias("sides")).where("sides > 0"), "family", ["rep"], "inner", SALTS, n_large)
    rest = told.where("part <> main").withColumn("s", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("sides")).cast("int"))
    rest = rest.select("family", "rep", zero.alias("side"), F.col("s").alias("low"), F.explode(F.sequence(zero, blocks - 1)).alias("high"))
    rows = told.select("family", "rep", F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("sides") - 1)).alias("s"), F.col("low").alias("high")).withColumnRenamed("s", "low")
    waiting = materialize(rest.union(rows.select("family", "rep", "side", "low", "high")), "waiting")
    if waiting.isEmpty():
        return settled.union(joined)
    return settled.union(stars(joined.union(materialize(links(waiting), "late-links").select("u", "v"))))
