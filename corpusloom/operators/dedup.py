"""Exact deduplication: features of pages, groups by hash, representatives and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Parts that the rows of one hash are spread over.
SALTS = 8


def page_features(pages: DataFrame) -> DataFrame:
    """One row per page id with text and status ``done``: hashes and sizes of the raw and the normalised text.

    Pages whose normalised text is empty have none.  The text is hashed before any shuffle; rows of an
    id that stands twice are merged by the smallest of each column.
    """
    t = F.col("text")
    rows = pages.filter("id IS NOT NULL AND text IS NOT NULL AND status = 'done'").select("id", "domain_id", "same_as", "recursion_level", "text_md5", t, tx.normalized(t).alias("clean")).filter("clean <> ''")
    supplied = F.nullif(F.col("text_md5"), F.lit(""))
    md5_class = F.when(supplied.isNull() | supplied.isin("NULL", "\\N"), "missing").when(~supplied.rlike("^[0-9a-fA-F]{32}$"), "invalid").when(F.lower(supplied) == F.md5(t.cast("binary")), "match").otherwise("mismatch")
    rows = rows.select(
        F.col("id").alias("page_id"), "domain_id", "recursion_level", F.sha2(t.cast("binary"), 256).alias("raw_sha256"), F.sha2(F.col("clean").cast("binary"), 256).alias("normalized_sha256"), md5_class.alias("md5_class"),
        F.octet_length(t).cast("long").alias("raw_bytes"), F.length("clean").cast("long").alias("characters"), F.size(F.split("clean", "\n", -1)).cast("long").alias("lines"), F.size(F.split("clean", "\n\n", -1)).cast("long").alias("paragraphs"),
    )
    return rows.groupBy("page_id").agg(*[F.min(c).alias(c) for c in rows.columns if c != "page_id"])


def mark_representatives(df: DataFrame, hash_col: str, id_col: str = "page_id", *order: str) -> DataFrame:
    """``df`` with ``is_representative``: true on the smallest id of each hash, null ids last, then by ``order``.

    The smallest key is found by an aggregation with map-side combine.  A hash of one row needs no more; the
    others are joined back by hash and a part of the id, so that the rows of a hash that a third of all
    share are spread over SALTS tasks.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *[F.col(c) for c in order])
    best = df.groupBy(hash_col).agg(F.min(key).alias("best"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = df.withColumn("salt", F.pmod(F.xxhash64(id_col, *order), F.lit(SALTS)).cast("int")).join(spread, [hash_col, "salt"], "left")
    alone = F.col("best").isNull() & F.col(hash_col).isNotNull()
    return joined.withColumn("is_representative", alone | F.coalesce(key.eqNullSafe(F.col("best")), F.lit(False))).select(*df.columns, "is_representative")


def groups(df: DataFrame, hash_col: str, id_col: str = "page_id") -> DataFrame:
    """Per hash: pages, distinct known domains and the representative's id."""
    return df.groupBy(hash_col).agg(F.count("*").alias("pages"), F.countDistinct("domain_id").alias("domains"), F.min(id_col).alias("representative"))


def cluster_summary(grouped: DataFrame, stage: str) -> DataFrame:
    """Groups, groups of several pages, the largest, and those across domains."""
    many = F.col("pages") > 1
    return grouped.agg(F.lit(stage).alias("stage"), F.count("*").alias("groups"), F.count_if(many).alias("duplicate_groups"), F.max("pages").alias("largest"), F.count_if(many & (F.col("domains") > 1)).alias("cross_domain_groups"))


def group_sizes(grouped: DataFrame, stage: str) -> DataFrame:
    return grouped.groupBy(F.col("pages").alias("group_size")).agg(F.count("*").alias("group_count")).withColumn("stage", F.lit(stage)).select("stage", "group_size", "group_count")


def same_as_audit(pages: DataFrame, features: DataFrame) -> DataFrame:
    """Declared copies: whether the target exists, both texts are valid, and their hashes agree.

    A declaration is a distinct (id, same_as) pair; a null hash never agrees.
    """
    declared = pages.filter("same_as IS NOT NULL AND id IS NOT NULL").select("id", "same_as").distinct()
    target = pages.filter("id IS NOT NULL").select(F.col("id").alias("same_as")).distinct().withColumn("present", F.lit(True))
    f = features.select("page_id", "raw_sha256", "normalized_sha256")
    a = f.select(F.col("page_id").alias("id"), F.col("raw_sha256").alias("raw_a"), F.col("normalized_sha256").alias("norm_a"))
    b = f.select(F.col("page_id").alias("same_as"), F.col("raw_sha256").alias("raw_b"), F.col("normalized_sha256").alias("norm_b"))
    rows = declared.join(target, "same_as", "left").join(a, "id", "left").join(b, "same_as", "left")
    return rows.agg(
        F.count("*").alias("declared"), F.count_if(F.col("present")).alias("target_present"), F.count_if(F.col("present").isNull()).alias("target_missing"),
        F.count_if(F.col("raw_a").isNotNull() & F.col("raw_b").isNotNull()).alias("both_valid"), F.count_if(F.col("raw_a") == F.col("raw_b")).alias("d1_agreement"), F.count_if(F.col("norm_a") == F.col("norm_b")).alias("d2_agreement"),
    )
