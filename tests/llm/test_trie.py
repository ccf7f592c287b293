"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, keys string, depth int, summary string, l long"


def sequences_brute(rows):
    """conv_id -> [(role, text)] of the rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = base[:h] + turns[h:]
    return out


def brute(seqs):
    nodes = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def below(n):
        todo, leaves, saved = [n], 0, 0
        while todo:
            x = todo.pop()
            leaves += x not in kids
            saved += (len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0)
            todo += kids.get(x, [])
        return leaves, saved

    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), *below(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def random_rows(rng, convs, words, most):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice((t, t, None)), rng.choice(("user", "assistant", None)), rng.choice(words)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 9) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 1), (2, 4), (3, 9), (4, 40)])
def test_trie(spark, seed, blocks):
    rng = random.Random(seed)
    convs = [*range(-3, 140), *range(200, 230, 7), 350, 351, 1000]
    rows = random_rows(rng, convs, ["", None, "a", "b", "é日", "z" * 40_000], 4 if seed % 2 else 9)
    rows += [rows[0], (None, 0, "user", "no id"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie")]
    rng.shuffle(rows)
    got = trie.trie(trie.rebuilt(trie.sequences(frame(spark, rows))), blocks)
    assert found(got) == brute(sequences_brute(rows))


@pytest.mark.parametrize("blocks", [1, 3, 25])
def test_shapes(spark, blocks):
    """Copies over many blocks, one long chain, nested prefixes, conversations without turns, a single one."""
    key = lambda x: hashlib.sha256(str(x).encode()).digest()
    cases = [
        {c: [1, 2, 3] for c in range(50)},
        {c: list(range(c)) for c in range(40)},
        {c: [] for c in range(20)} | {99: [5]},
        {8: []},
        {8: [1] * 300},
        {c: [0, c // 10, c // 5 % 2, c] for c in range(60)} | {100 + c: [0, c] for c in range(6)},
        {c: [9] * (c % 3) + [c % 2] for c in range(70)},
    ]
    for seqs in cases:
        rows = [(c, [(bytearray(key(x)), x) for x in turns]) for c, turns in seqs.items()]
        df = spark.createDataFrame(rows, "conv_id long, turns array<struct<key: binary, chars: long>>")
        want = brute({c: [(x, "t" * x) for x in turns] for c, turns in seqs.items()})
        assert found(trie.trie(df.repartition(3), blocks)) == want


def test_empty(spark):
    assert trie.trie(trie.rebuilt(trie.sequences(frame(spark, []))), 3).collect() == []
    assert trie.trie(trie.rebuilt(trie.sequences(frame(spark, [(None, 1, "user", "x")])))).collect() == []


def test_no_text_moves(spark):
    """Texts are digested where they are read: no exchange carries them."""
    plan = trie.sequences(frame(spark, [(1, 1, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    under = plan[plan.index("Exchange hashpartitioning(conv_id") :]
    assert "sha2" in under and "collect_list" in plan


def test_hot_first_turn(spark):
    rows = [(c, t, "user", "same" if t == 0 or c % 3 == 0 else f"{c % 17} {t}") for c in range(900) for t in range(3)]
    df = frame(spark, rows)
    assert found(trie.trie(trie.rebuilt(trie.sequences(df)), 16)) == brute(sequences_brute(rows))
    assert df.where(F.col("turn") == 0).count() == 900
