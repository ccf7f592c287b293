"""From raw documents to packed sequences: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import mixing, neardup, quality, queries, secrets
from siltworks.llm.common import materialize, table

#: Percent of similarity (5-word shingles) from which documents are near-duplicates here; the query op6_neardup has 85.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: failing base rules, or a calibrated probability of good quality under the threshold.

    Null and empty texts are rejected. The model is fitted to the labelled rows of the docs at hand.
    """
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id; of equal rows, one.

    A similarity of SIMILAR percent or more makes a pair. Documents without words are in no group and stay.
    """
    found = materialize(neardup.cluster(docs, threshold=SIMILAR), "clusters")
    dropped = materialize(found.where("not kept").select("doc_id").distinct(), "dropped")
    repeated = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    stay = docs.join(dropped, "doc_id", "left_anti")
    if repeated.isEmpty():
        return stay.select(*docs.columns)
    repeated = materialize(repeated, "repeated")
    once = stay.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by [SECRET] and n_chars set anew; no document goes.

    Null and empty texts stay as they are; repeated rows are scanned each.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the order of the mix: files by range of positions, rows within them by position.

    A null source is the source named ""; rows that tie (null or repeated ids) follow by a hash of the row. Texts may be null.
    """
    return mixing.in_order(docs, weights=queries.WEIGHTS, default_weight=queries.OTHER_WEIGHT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies in which sequence; sequence numbers follow the order of the mix.

    Null and empty texts have the end id alone; repeated rows have pieces each.
    """
    return queries.packed_in_mix(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("mix sources", mix_sources), ("pack sequences", pack_sequences)]

#: The first stages rest on trained models, which SQL can't express; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
