"""Exact de-duplication by sorting content (native: DataFrame functions only).

Normalised text (A-Z to lower case; null counts as empty) is brought into content order: sampled
splitters range-partition the rows, Spark's external sort puts equal texts side by side, and the window
operator compares neighbours over their whole normalised bytes. The splitters see a bounded key, so that
the driver never holds long texts: the leading normalised bytes, then a digest of the length and of bytes
from both ends. Equal texts always share that key; unequal texts that share it are told apart by the
full comparison.

Hot keys (many rows with one key; at most ``8 * partitions`` of them, see ``heat_threshold``) get a
salt, so that a group of copies spreads over many tasks. Each salt keeps one head; heads, which are few,
are merged by a second full comparison.

Defined results: null text equals the empty text; of equal texts the largest ``doc_id`` stays; a null
``doc_id`` loses to any other and keeps its group only if all are null; of repeated rows (same id and
text) exactly one is ``kept``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower, durable, fresh, heat_threshold, shuffle_partitions, sized_broadcast, table, text_of

LEAD, ENDS = 16, 48


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        text.alias("_text"),
        ascii_lower(F.substring(text, 1, LEAD)).alias("_k1"),
        F.xxhash64(
            F.octet_length(text),
            ascii_lower(F.substring(text, LEAD + 1, ENDS)),
            ascii_lower(F.substring(text, -ENDS, ENDS)),
        ).alias("_k2"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    hot_from = heat_threshold(docs.count(), shuffle_partitions(spark))
    heat = keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_from)
    salted = keyed.join(F.broadcast(heat), ["_k1", "_k2"], "left").select(
        "doc_id",
        "_text",
        "_k1",
        "_k2",
        F.col("_n").isNotNull().alias("_hot"),
        F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / hot_from))).otherwise(F.lit(0)).alias("_salt"),
    )
    ordered = salted.repartitionByRange("_k1", "_k2", "_salt").withColumn("_norm", ascii_lower(F.col("_text")))
    group = Window.partitionBy("_k1", "_k2", "_salt", "_norm")
    local = ordered.select(
        "doc_id",
        "_hot",
        "_norm",
        F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())).alias("_rank"),
        F.max("doc_id").over(group).alias("_keep"),
        F.count("*").over(group).alias("_size"),
    ).select(
        "doc_id",
        "_hot",
        "_rank",
        "_keep",
        "_size",
        F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"),
        F.when(F.col("_hot") & (F.col("_rank") == 1), F.col("_norm")).alias("_head"),
    )
    local = durable(local)
    same = Window.partitionBy("_head")
    merged = local.filter(F.col("_head").isNotNull()).select(
        F.col("_keep").alias("_m_keep"),
        F.col("text_sha256").alias("_m_sha"),
        F.max("_keep").over(same).alias("_all_keep"),
        F.sum("_size").over(same).alias("_all_size"),
    )
    joined = local.drop("_head").join(merged, F.col("_keep").eqNullSafe(F.col("_m_keep")) & (F.col("text_sha256") == F.col("_m_sha")), "left")
    keep = F.when(F.col("_all_size").isNotNull(), F.col("_all_keep")).otherwise(F.col("_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_all_size", "_size").cast("long").alias("group_size"),
        ((F.col("_rank") == 1) & keep.eqNullSafe(F.col("_keep"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; repeated rows are left once.

    Where every row has an id of its own, the ids to drop are enough; else ids and digests are joined.
    """
    decided = durable(exact_dedup(docs))
    gone_id, kept_id, kept_sha, sha, nth = fresh(docs.columns, "_gone", "_kept_id", "_kept_sha", "_sha", "_nth")
    if decided.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1 OR doc_id IS NULL").isEmpty():
        gone = decided.filter("NOT kept").select(F.col("doc_id").alias(gone_id))
        return docs.join(sized_broadcast(gone, gone.count()), F.col("doc_id") == F.col(gone_id), "left_anti")
    kept = decided.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    one = Window.partitionBy(kept_id, kept_sha).orderBy(F.lit(1))
    named = docs.withColumn(sha, F.sha2(F.encode(ascii_lower(text_of()), "UTF-8"), 256))
    return (
        named.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)))
        .withColumn(nth, F.row_number().over(one))
        .filter(F.col(nth) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
