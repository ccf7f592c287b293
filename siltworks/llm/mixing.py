"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are numbered in a pseudo-random order and cut into blocks. While all sources last, block i
(from 1) of a source with share p of the weights is released at slot floor((i - 1) / p) and due by slot ceil(i / p);
each slot takes the released block with the earliest deadline (ties: the source's name). The shares sum to 1, so every
deadline is met and after any slot each source is less than one block away from its target. When a source runs out, a
new phase begins in which the others share its slots by their weights. Every document is placed once.

A phase's schedule repeats after as many slots as its weights sum to, so the whole plan follows from the sources'
counts: a few numbers for each phase and source. The data side is DataFrame functions only: a window over (source,
bucket) numbers the rows, whose buckets keep a source with a third of all rows from meeting in one task.
"""

from __future__ import annotations

import json
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents a block; buckets a source's rows are numbered in; bounds of the plan.
BLOCK_ROWS, BUCKETS, MAX_SOURCES, MAX_PERIOD = 16, 256, 256, 10_000

PLAN = "array<struct<source:string,base:bigint,used:bigint,slot:bigint,missing:bigint,weight:bigint,period:bigint,pattern:array<bigint>>>"


def pattern(weights: list[int]) -> list[list[int]]:
    """Slots of each source within one period (sum of the weights) of the earliest-deadline-first schedule."""
    period = sum(weights)
    given = [0] * len(weights)
    slots: list[list[int]] = [[] for _ in weights]
    for t in range(period):
        # Released: floor(given / p) <= t. Deadline: ceil((given + 1) / p).
        ready = [i for i, w in enumerate(weights) if given[i] * period < (t + 1) * w and given[i] < w]
        best = min(ready, key=lambda i: (-(-(given[i] + 1) * period // weights[i]), i))
        slots[best].append(t)
        given[best] += 1
    return slots


def schedule(counts: dict[str, int], weights: dict[str, int], block_rows: int, default_weight: int = 1) -> list[dict]:
    """The plan: for each phase and source its first block, number of blocks, first slot, rows missing from earlier
    partial blocks, weight, period and slots within a period."""
    names = sorted(n for n, c in counts.items() if c)
    left = {n: -(-counts[n] // block_rows) for n in names}
    short = {n: left[n] * block_rows - counts[n] for n in names}
    base = dict.fromkeys(names, 0)
    plan, slot, missing = [], 0, 0
    while active := [n for n in names if left[n]]:
        ws = [weights.get(n, default_weight) for n in active]
        shared = gcd(*ws)
        ws = [w // shared for w in ws]
        period = sum(ws)
        slots = pattern(ws)
        ends = {n: (left[n] - 1) // w * period + s[(left[n] - 1) % w] for n, w, s in zip(active, ws, slots, strict=True)}
        last = min(active, key=lambda n: ends[n])
        length = ends[last] + 1
        for n, w, s in zip(active, ws, slots, strict=True):
            used = length // period * w + sum(t < length % period for t in s)
            if used:
                plan.append({"source": n, "base": base[n], "used": used, "slot": slot, "missing": missing, "weight": w, "period": period, "pattern": s})
            base[n] += used
            left[n] -= used
        slot += length
        missing += short[last]
    return plan


def _source(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _bucket(column: str, buckets: int) -> Column:
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint"), F.lit(buckets))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, default_weight: int = 1, id_col: str = "doc_id", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """docs with {prefix}block (number within the source, from 0), {prefix}slot and {prefix}position (both from 0, positions gapless).

    weights: positive whole numbers by source; others get default_weight. A null source is the source named "". Within a
    source the order is by a hash bucket of the id, then the id, then (null or repeated ids) a hash of the whole row,
    so that a repeated task places rows alike. An empty table stays empty. More than MAX_SOURCES sources or weights that sum to more than MAX_PERIOD are
    refused, as they would make the plan unbounded. docs may have any other columns, but none with the prefix.
    """
    weights = weights or {}
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights must be positive whole numbers")
    if any(c.startswith(prefix) for c in docs.columns):
        raise ValueError(f"docs has columns that begin with {prefix}")
    s, b = f"{prefix}source", f"{prefix}bucket"
    keyed = docs.withColumn(s, _source(source_col)).withColumn(b, _bucket(id_col, BUCKETS))
    cells = docs.select(_source(source_col).alias(s), _bucket(id_col, BUCKETS).alias(b)).groupBy(s, b).agg(F.count("*").alias("n"))
    found = cells.groupBy(s).agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    counts = {r[s]: r.n for r in found}
    total = sum(weights.get(n, default_weight) for n in counts)
    if len(counts) > MAX_SOURCES or total > MAX_PERIOD:
        raise ValueError(f"at most {MAX_SOURCES} sources and weights of {MAX_PERIOD} in all; found {len(counts)} and {total}")
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(schedule(counts, weights, block_rows, default_weight))), PLAN)))
    plan = plan.select(F.col("source").alias(s), *(F.col(c).alias(f"{prefix}{c}") for c in ("base", "used", "slot", "missing", "weight", "period", "pattern")))
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(s, b, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{prefix}start"))
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in hashed))
    within = F.row_number().over(Window.partitionBy(s, b).orderBy(F.col(id_col), whole)) - 1
    numbered = keyed.withColumn(f"{prefix}row", within).join(starts, [s, b]).withColumn(f"{prefix}row", F.col(f"{prefix}row") + F.col(f"{prefix}start"))
    block = F.floor(F.col(f"{prefix}row") / F.lit(block_rows)).cast("bigint")
    c = lambda name: F.col(f"{prefix}{name}")
    placed = numbered.withColumn(f"{prefix}block", block).join(F.broadcast(plan), s).where((c("block") >= c("base")) & (c("block") < c("base") + c("used")))
    k = c("block") - c("base")
    slot = c("slot") + F.floor(k / c("weight")).cast("bigint") * c("period") + F.element_at(c("pattern"), (F.pmod(k, c("weight")) + 1).cast("int"))
    placed = placed.withColumn(f"{prefix}at", slot).withColumn(f"{prefix}position", F.col(f"{prefix}at") * block_rows + F.pmod(c("row"), F.lit(block_rows)) - c("missing"))
    return placed.select(*docs.columns, c("block"), F.col(f"{prefix}at").alias(f"{prefix}slot"), c("position"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in mixed order: range-partitioned and sorted by position. Columns stay as they are."""
    mixed = mix(docs, **options)
    at = f"{options.get('prefix', 'mix_')}position"
    return mixed.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns)


def oracle(weights: dict[str, int], block_rows: int = BLOCK_ROWS, default_weight: int = 1) -> str:
    """DuckDB SQL that plays the schedule slot by slot."""
    case = "CASE source " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in sorted(weights.items())) + f" ELSE {default_weight} END"
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT % {BUCKETS} AS bucket FROM documents),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY bucket, doc_id) - 1 AS n FROM docs),
sources AS (SELECT source, {case} AS w, (count(*) + {block_rows - 1}) // {block_rows} AS blocks FROM docs GROUP BY source),
lists AS (SELECT list(source ORDER BY source) AS names, list(w::BIGINT ORDER BY source) AS w, list(blocks ORDER BY source) AS blocks, sum(blocks) AS slots FROM sources),
play AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS tau, list_transform(w, lambda x: 0::BIGINT) AS total, list_transform(w, lambda x: 0::BIGINT) AS given, 0::BIGINT AS chosen, 0::BIGINT AS block FROM lists
  UNION ALL
  SELECT slot + 1, CASE WHEN total[pick] + 1 = blocks[pick] THEN 0 ELSE tau + 1 END,
    list_transform(total, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END),
    list_transform(given, lambda x, i: CASE WHEN total[pick] + 1 = blocks[pick] THEN 0 WHEN i = pick THEN x + 1 ELSE x END),
    pick, total[pick]
  FROM (
    SELECT p.*, l.blocks, list_sort(list_filter(list_transform(given, lambda x, i: CASE WHEN total[i] < l.blocks[i] AND x * v.sum < (tau + 1) * l.w[i] THEN {{'d': ((x + 1) * v.sum + l.w[i] - 1) // l.w[i], 'i': i::BIGINT}} END), lambda s: s IS NOT NULL))[1].i AS pick
    FROM play p, lists l, LATERAL (SELECT list_sum(list_transform(l.w, lambda y, j: CASE WHEN p.total[j] < l.blocks[j] THEN y ELSE 0 END))::BIGINT AS sum) v
    WHERE p.slot < l.slots
  ) step
),
placed AS (SELECT n.doc_id, n.source, n.n // {block_rows} AS block, p.slot - 1 AS slot, n.n FROM numbered n, lists l, play p WHERE p.chosen > 0 AND l.names[p.chosen] = n.source AND p.block = n.n // {block_rows})
SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot, (row_number() OVER (ORDER BY slot, n) - 1)::BIGINT AS position FROM placed
"""
