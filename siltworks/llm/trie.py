"""Prefix trie of conversations, from the Cartesian tree over the LCP array of the sorted conversations.

Conversations become sequences of turn digests, sorted over the cluster into blocks. lcp[p] is how many turns conversation p
shares with the one before. The nearest smaller values to both sides of p bound the run of conversations that share
lcp[p] turns: a node of the trie; equal values in one run are one node. Within a block a stack finds them. Across blocks
each block is reduced to its minimum and the values still open at its end; folding these in order on the driver (at
most blocks x longest conversation entries) gives the stack with which each block begins, so all blocks go on in parallel
and a run is told by the block that closes it. Depths between a node and its parent are filled in from the same run.

Counts come from sums up to a position: a run's leaves and the characters that its conversations share with their
predecessors are differences of two such sums. Digests are SHA-256 of role and text; texts themselves never move.
A conversation is one row (40 bytes a turn), a block is one task's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import frugal, materialize

#: Conversations that share a head, and one more than the most turns of a head.
FAMILY, HEADS = 100, 6
BLOCK_ROWS = 100_000
NO_IDS = hashlib.sha256(b"").hexdigest()
SORTED = "block int, place long, conv_id long, lcp int, cum array<long>, summary string, first array<binary>, last array<binary>"
NODES = "l long, v int, depth int, conv_id long, parent_conv_id long, up_l long, up_v int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, crossing boolean, block int, ids string"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct key, chars) of each conversation, in the order of turns.

    conversations has conv_id, turn, role, text. Null turns come first; ties go by role, then by the turn's digest, and
    repeated rows are turns each. Null roles and texts are empty ones. Rows without conv_id are left out. Other columns
    are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("chars")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """sequences() whose first turns come from their family's first conversation.

    Conversation c gets the first crc32(c) % heads turns of conversation c - c % family (fewer, if it has fewer or isn't
    there), then its own after so many. At most heads - 1 turns a family are repeated, once a member.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    given = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = own.withColumn("base", base).join(given, "base", "left").withColumn("h", h)
    taken = F.coalesce(F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(taken, rest).alias("turns"))


@dataclass
class Run:
    """An open run: v turns shared since position l; low: least id; k: equal values; e: members with v turns; pa, pl: sums before l."""

    v: int
    l: int  # noqa: E741
    low: int
    k: int
    e: int
    pa: int
    pl: int
    ids: list = field(default_factory=list)


def step(stack: list[Run], p: int, conv: int, n: int, after: int, pa_here: int, pl_here: int, close=None) -> None:
    """Conversation p (n turns) is followed by one that shares `after` turns with it (-1: by none)."""
    ends = None
    if stack and stack[-1].v == n:
        ends = stack[-1]
        ends.e += 1
        ends.ids.append(conv)
    low, at, sums = conv, p, (pa_here, pl_here)
    while stack and stack[-1].v > after:
        run = stack.pop()
        run.low = min(run.low, low)
        if close:
            close(run, stack[-1] if stack else None)
        low, at, sums = run.low, run.l, (run.pa, run.pl)
    if after < 0:
        return
    if stack and stack[-1].v == after:
        stack[-1].k += 1
        stack[-1].low = min(stack[-1].low, low)
    else:
        stack.append(Run(after, at, low, 1, 0, *sums))
    if ends is None and n == after:
        stack[-1].e += 1
        stack[-1].ids.append(conv)


def shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _sort(seqs: DataFrame, blocks: int) -> DataFrame:
    """Blocks of sorted conversations with their lcp, and a summary row for each block."""
    schema = _schema(SORTED)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Run] = []
        place, before, pending, sums, block, first = 0, None, None, [0, 0], None, None
        for batch in batches:
            rows = []
            for block, conv, keys, chars in zip(*(batch.column(c).to_pylist() for c in ("block", "conv_id", "keys", "chars")), strict=True):
                cum = [0, *np.cumsum(chars).tolist()]
                lcp = -1
                if before is None:
                    first = (keys, cum)
                else:
                    lcp = shared(before, keys)
                    last_conv, last_n = pending
                    step(stack, place - 1, last_conv, last_n, lcp, *sums)
                    sums = [sums[0] + cum[lcp], sums[1] + (lcp < last_n)]
                rows.append((block, place, conv, lcp, cum, None, None, None))
                place, before, pending = place + 1, keys, (conv, len(keys))
            if rows:
                yield _arrow(rows, schema)
        if place:
            told = {"rows": place, "conv": pending[0], "n": pending[1], "pa": sums[0], "pl": sums[1], "first_cum": first[1], "stack": [astuple(r)[:-1] for r in stack]}
            yield _arrow([(block, place, None, None, None, json.dumps(told), first[0], before)], schema)

    ranged = seqs.repartitionByRange(blocks, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return ranged.select(F.spark_partition_id().alias("block"), "conv_id", "keys", "chars").mapInArrow(run, SORTED)


def fold(blocks: list[dict]) -> dict[int, dict]:
    """By block: how it begins (position, sums, stack of open runs) and the lcp on both its sides.

    blocks: block, first, last (keys) and the numbers of the summary, in order; blocks without rows are left out.
    """
    out, carry, start, pa_sum, pl_sum = {}, [], 0, 0, 0
    for i, b in enumerate(blocks):
        lcp = shared(blocks[i - 1]["last"], b["first"]) if i else -1
        after = shared(b["last"], blocks[i + 1]["first"]) if i + 1 < len(blocks) else -1
        pa_sum += b["first_cum"][lcp] if i else 0
        out[b["block"]] = {"start": start, "lcp": lcp, "after": after, "pa": pa_sum, "pl": pl_sum, "stack": [astuple(r)[:-1] for r in carry]}
        inside = [Run(v, at + start, low, k, e, pa_ + pa_sum, pl_ + pl_sum) for v, at, low, k, e, pa_, pl_ in b["stack"]]
        if inside:
            least = inside[0]
            while carry and carry[-1].v > least.v:
                run = carry.pop()
                least.low, least.l, least.pa, least.pl = min(least.low, run.low), run.l, run.pa, run.pl
            if carry and carry[-1].v == least.v:
                top = carry[-1]
                top.low, top.k, top.e = min(top.low, least.low), top.k + least.k, top.e + least.e
                inside = inside[1:]
            carry += inside
        step(carry, start + b["rows"] - 1, b["conv"], b["n"], after, pa_sum + b["pa"], pl_sum + b["pl"])
        start, pa_sum, pl_sum = start + b["rows"], pa_sum + b["pa"], pl_sum + b["pl"] + (after < b["n"])
    return out


def _block_nodes(block: int, begin: dict, convs: list[int], lcps: list[int], cums: list[list[int]]) -> Iterator[tuple]:
    """Rows of NODES: all depths of the runs that end in this block, of its conversations alone, and parts of ids of runs across blocks."""
    stack = [Run(*r) for r in begin["stack"]]
    lcps[0] = begin["lcp"]
    start, pa_here, pl_here = begin["start"], begin["pa"], begin["pl"]
    runs: list[tuple] = []
    least: dict[tuple, int] = {}
    parts: list[tuple] = []
    alone: list[tuple] = []
    for i, (conv, cum) in enumerate(zip(convs, cums, strict=True)):
        n, p = len(cum) - 1, start + i
        after = lcps[i + 1] if i + 1 < len(lcps) else begin["after"]
        leaves = pl_here + (after < n)
        up = (stack[-1].l, stack[-1].v) if stack and stack[-1].v >= after else (p, after) if after >= 0 else (None, None)

        def close(run: Run, above: Run | None) -> None:
            floor = max(above.v if above else -1, after)  # noqa: B023  called within this turn of the loop
            parent = (None, None) if floor < 0 else (above.l, above.v) if above and above.v >= after else (run.l, after)  # noqa: B023
            crossing = run.l < start
            least[run.l, run.v] = run.low
            if crossing and run.ids:
                parts.append((run.l, run.v, run.ids))
            ends = None if crossing and run.e else hashlib.sha256(",".join(map(str, run.ids)).encode()).hexdigest()
            runs.append((run, floor, parent, p + 1 - run.l, leaves - run.pl, pa_here - run.pa, cum, ends, crossing))  # noqa: B023

        step(stack, p, conv, n, after, pa_here, pl_here, close)
        floor = max(lcps[i], after)
        if floor < n:
            alone.append((p, n, floor, conv, up))
        pl_here = leaves
        if i + 1 < len(lcps):
            pa_here += cums[i + 1][lcps[i + 1]]
    parts += [(r.l, r.v, r.ids) for r in stack if r.ids]
    nothing = (None,) * 7
    for run, floor, parent, size, leaves, saved, cum, ends, crossing in runs:
        for d in range(floor + 1, run.v + 1):
            over, key = (run.low, (None, None)) if d > floor + 1 else (least.get(parent), (None, None) if parent in least else parent)
            deepest = d == run.v
            yield run.l, run.v, d, run.low, over, *key, size, run.k + 1 - run.e if deepest else 1, leaves, saved - (size - 1) * cum[max(d - 1, 0)], ends if deepest else NO_IDS, crossing and deepest, block, None
    for p, n, floor, conv, up in alone:
        for d in range(floor + 1, n + 1):
            over, key = (conv, (None, None)) if d > floor + 1 else (least.get(up), (None, None) if up in least else up)
            yield p, n, d, conv, over, *key, 1, int(d < n), 1, 0, NO_IDS if d < n else hashlib.sha256(str(conv).encode()).hexdigest(), False, block, None
    for at, v, ids in parts:
        yield at, v, *nothing, None, None, None, None, block, ",".join(map(str, ids))


def _nodes(ordered: DataFrame, begins: dict[int, dict]) -> DataFrame:
    schema = _schema(NODES)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, held: list[list]) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in _block_nodes(block, begins[block], *held):
                rows.append(row)
                if len(rows) >= 20_000:
                    yield _arrow(rows, schema)
                    rows = []
            if rows:
                yield _arrow(rows, schema)

        now, held = None, [[], [], []]
        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "conv_id", "lcp", "cum")), strict=True):
                if block != now:
                    if now is not None:
                        yield from told(now, held)
                    now, held = block, [[], [], []]
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if now is not None:
            yield from told(now, held)

    dealt = ordered.repartition("block").sortWithinPartitions("block", "place")
    return dealt.select("block", "conv_id", "lcp", "cum").mapInArrow(run, NODES)


def _digests(parts: DataFrame) -> DataFrame:
    """l, v, ends: digest of the ids of runs across blocks; a block's ids are one row, hashed block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for at, v, ids in zip(*(batch.column(c).to_pylist() for c in ("l", "v", "ids")), strict=True):
                if (at, v) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (at, v), hashlib.sha256()
                digest.update(ids.encode())
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield _arrow(done, _schema("l long, v int, ends string"))

    return parts.repartition("l", "v").sortWithinPartitions("l", "v", "block").select("l", "v", "ids").mapInArrow(run, "l long, v int, ends string")


def trie(seqs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every node of the trie over seqs (conv_id, turns): its members are the conversations that begin with its turns.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (null for the root); n_convs: members; n_children;
    n_leaves: nodes without children in its subtree, itself included; saved_tokens: (n_convs - 1) x characters of the last
    turn, summed over its subtree; ends_sha256: digest of the ascending, comma-joined ids of members with no further turn.
    Conversations without turns end at the root. Repeated ids count each. No conversations: no nodes.
    """
    spark = seqs.sparkSession
    plain = materialize(seqs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.key").alias("keys"), F.col("turns.chars").alias("chars")), "sequences")
    if blocks is None:
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plain.count() // BLOCK_ROWS))
    ordered = materialize(_sort(plain, blocks), "sorted")
    told = ordered.where("summary is not null").orderBy("block").collect()  # one row a block
    begins = fold([json.loads(r.summary) | {"block": r.block, "first": r.first, "last": r.last} for r in told])
    rows = materialize(_nodes(ordered.where("summary is null"), begins), "nodes")
    # Runs across blocks were open at a block's end: at most blocks x longest conversation of them.
    across = rows.where("crossing and ids is null").select(F.col("l").alias("up_l"), F.col("v").alias("up_v"), F.col("conv_id").alias("_over"))
    ends = _digests(rows.where("ids is not null"))
    nodes = rows.where("ids is null").join(F.broadcast(across), ["up_l", "up_v"], "left").join(F.broadcast(ends), ["l", "v"], "left")
    found: Column = F.when(F.col("ends_sha256").isNull(), F.col("ends")).otherwise(F.col("ends_sha256"))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "_over").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", found.alias("ends_sha256"))
