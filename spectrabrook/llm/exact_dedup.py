"""Exact deduplication with DataFrame functions only.

Heavy-hitter split. Misra-Gries counters (Spark's ``approx_top_k`` sketches,
merged in two rounds so that no task sees every partition's counters) name the
digests that may be frequent. A second look at the digests counts those exactly
and picks the row that stays; digests found frequent are broadcast (at most
``max_heavy`` rows) and settled map-side. All other digests go through one
ordinary shuffle, whose groups are small because the large ones are gone.
Which digests the counters name affects only speed, never the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrabrook.llm.common import ascii_lower, small, stage


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, row): SHA-256 of the normalised text, and a number for each row."""
    return docs.select(
        docs[doc_id].alias("doc_id"),
        F.sha2(ascii_lower(docs[text]), 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def heavy_digests(found: DataFrame, max_heavy: int = 1000, counters: int = 8192, min_copies: int = 64, fan_in: int = 64) -> DataFrame:
    """At most max_heavy digests with their exact group_size (min_copies or more) and the row that stays."""
    sketches = (
        found.groupBy((F.spark_partition_id() % fan_in).alias("bucket"))
        .agg(F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("sketch"))
        .groupBy((F.col("bucket") >= 0).alias("all"))  # a key, so that a task without sketches sends none
        .agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
    )
    named = sketches.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {max_heavy})")).alias("hit")).select(F.col("hit.item").alias("digest"))
    return (
        found.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays"))
        .filter(F.col("group_size") >= min_copies)
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_heavy: int = 1000, counters: int = 8192, min_copies: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest doc_id of each group is kept. A null text is the empty text. A null
    doc_id ranks below every other. Of rows that repeat both doc_id and text
    exactly one is kept. Texts are compared by digest, so very long ones cost
    no more memory than a row. An empty table gives an empty result. Other
    columns of docs, whatever their names, are not read.
    """
    found = stage(digests(docs, text, doc_id), "exact-digests")
    heavy = F.broadcast(stage(heavy_digests(found, max_heavy, counters, min_copies), "exact-heavy"))
    group = Window.partitionBy("digest")
    rest = found.join(heavy.select("digest"), "digest", "left_anti").select(
        "doc_id",
        "digest",
        "row",
        F.count(F.lit(1)).over(group).alias("group_size"),
        F.max(F.struct("doc_id", "row")).over(group).alias("stays"),
    )
    both = found.join(heavy, "digest").select("doc_id", "digest", "row", "group_size", "stays").unionByName(rest)
    return both.select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names."""
    mark = f"_d{uuid.uuid4().hex}"
    verdicts = stage(exact_dedup(docs, text, doc_id).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), F.col("kept").alias("_kept")), "exact-verdicts")
    pairs = stage(verdicts.groupBy("_id", "_digest").agg(F.max("_kept").alias("_any"), F.count(F.lit(1)).alias("_n")).filter("not _any or _n > 1"), "exact-pairs")
    lost = small(pairs.filter(~F.col("_any")).select("_id", "_digest"), 300_000)
    digest = F.sha2(ascii_lower(docs[text]), 256)
    stay = docs.join(lost, docs[doc_id].eqNullSafe(lost["_id"]) & (digest == lost["_digest"]), "left_anti")
    if not pairs.filter("_any and _n > 1").isEmpty():
        # Rows that repeat doc_id and text: equal keys meet here, and one is kept.
        stay = stay.withColumn(mark, F.sha2(ascii_lower(stay[text]), 256)).dropDuplicates([doc_id, mark]).drop(mark)
    return stay


ORACLE = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as d from documents
)
select doc_id, max(doc_id) over (partition by d) as keep_id, count(*) over (partition by d) as group_size,
       row_number() over (partition by d order by doc_id desc nulls last) = 1 as kept, d as text_sha256
from t
"""
