"""Registered queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import align, chat, exact, mixing, neardup, packing, pii, quality, secrets, topk, toxicity, trie, warc
from siltworks.llm.common import materialize, table
from siltworks.llm.training import crc_of_id

#: Target weights of the sources; sources not named weigh 2.
WEIGHTS, OTHER_WEIGHT = {"src0": 8, "src1": 4, "src2": 4, "src3": 3}, 2
#: Every how manyth crc32 of the id is held out from training, and every how manyth vec_id is a query.
HOLD_OUT, QUERY_EVERY = 5, 100


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS, default_weight=OTHER_WEIGHT)
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_confirmed", "n_added")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_of_id() % HOLD_OUT == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_spans", "spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), threshold=85)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of docs with their places; ids reduced to their crc32."""
    pieces = packing.tokenize(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    pieces = materialize(pieces, "pieces")
    return packing.pack(pieces, pieces.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_in_mix(docs: DataFrame) -> DataFrame:
    """As packed(), but sequences follow the mix: their numbers rise with the mixed positions of their documents.

    The positions are mixing.mix's over docs, taken from the pieces, so that no text moves for them.
    """
    pieces = packing.tokenize(docs, carry="source").select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "carried")
    pieces = materialize(pieces, "pieces")
    places = mixing.mix(pieces.where("start = 0").select("doc_id", "piece", "carried"), WEIGHTS, default_weight=OTHER_WEIGHT, source_col="carried")
    placed = pieces.drop("carried").join(places.select("piece", "mix_position"), "piece")
    return packing.pack(placed, 0, order="mix_position").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.segments(turns))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(warc.chunked(warc.records(table(spark, sf_dir, "pages"))))
    return warc.summary(warc.read(manifest, with_data=False))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))[0]


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All of them; pipeline needs corpus_pipeline.py when it runs."""
    return {f.__name__: f for f in (op1_mixing, op2_pii, op3_secrets, op4_toxicity, op5_quality, op6_neardup, op7_topk, op8_packing, op9_chat, op10_warc, op11_exact, op12_align, op13_trie, pipeline)}


OP6_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM texts),
sized AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS h, s FROM sets),
classes AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM sized WHERE n > 0 GROUP BY h),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
links AS (SELECT a.rep AS u, b.rep AS v FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u, u AS r FROM both_ways UNION SELECT b.v, reach.r FROM reach JOIN both_ways b ON b.u = reach.u WHERE reach.r < b.v),
least_of AS (SELECT u, min(r) AS c FROM reach GROUP BY u)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.c, k.rep, s.doc_id) AS component_id, s.doc_id = coalesce(l.c, k.rep, s.doc_id) AS kept
FROM sized s LEFT JOIN classes k ON k.h = s.h AND s.n > 0 LEFT JOIN least_of l ON l.u = k.rep
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(v.e, lambda x, i: x * q.e[i]))::BIGINT AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars, FALSE AS rewrites
FROM t GROUP BY conv_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * g, 5))::BIGINT >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""

OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# crc is the CRC-32 of the id's digits, bit by bit. Nodes are named by the digest of their turns' digests.
OP13_SQL = """
WITH t AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS k, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT DISTINCT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 6 AS h FROM t),
rebuilt AS (SELECT c.conv_id, 0 AS own, i, k, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h UNION ALL SELECT c.conv_id, 1, i, k, chars FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
seqs AS (SELECT c.conv_id, coalesce(list(k ORDER BY own, i) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(chars ORDER BY own, i) FILTER (k IS NOT NULL), []) AS cs FROM c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (SELECT conv_id, d, len(ks) = d AS ends, md5(array_to_string(ks[1:d], ',')) || d AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) || (d - 1) END AS up, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM seqs)),
nodes AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT m.node, sum(n.saved) AS saved, count(*) FILTER (n.node NOT IN (SELECT up FROM kids)) AS leaves FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.depth GROUP BY m.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes u ON u.node = n.up LEFT JOIN kids ON kids.up = n.node
"""


def oracle_sql() -> dict[str, str]:
    """op2, op3, op4, op5, op8, op12 and pipeline rest on trained models or a tokenizer, which SQL can't express; tests hold them against brute force."""
    return {"op1_mixing": mixing.oracle(WEIGHTS, default_weight=OTHER_WEIGHT), "op6_neardup": OP6_SQL, "op7_topk": OP7_SQL, "op9_chat": OP9_SQL, "op10_warc": OP10_SQL, "op11_exact": OP11_SQL, "op13_trie": OP13_SQL}
