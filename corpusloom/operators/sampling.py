"""Deterministic samples, review gates and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def priority(seed: int, key: Column) -> Column:
    """Seeded order of rows: SHA-256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stratified_sample(df: DataFrame, key: str, strata: list[str], per_stratum: int, seed: int = 73129) -> DataFrame:
    """The first ``per_stratum`` rows of each stratum in seeded order; a null stratum is one of its own.

    Each stratum is cut in 16 parts first, of which only the first rows meet, so that a large stratum
    is not sorted in one task.
    """
    rows = df.withColumn("priority", priority(seed, F.col(key)))
    part = F.pmod(F.xxhash64(key), F.lit(16))
    first = rows.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy(*strata, "part").orderBy("priority", key))).filter(F.col("r") <= per_stratum)
    return first.withColumn("r", F.row_number().over(Window.partitionBy(*strata).orderBy("priority", key))).filter(F.col("r") <= per_stratum).drop("part").withColumnRenamed("r", "sample_rank")


def balanced_sample(df: DataFrame, key: str, stratum: str, size: int, seed: int = 73129) -> DataFrame:
    """``size`` rows with ``drawn``: half in seeded order over all rows, the rest in turns over the strata.

    A turn takes the next row of each stratum in seeded order, so that small strata come in before large ones
    come again; both halves are bounded top-k plans.  ``key`` must be distinct; a null stratum is one of its own.
    """
    first = df.withColumn("priority", priority(seed, F.col(key))).orderBy("priority", key).limit(size // 2)
    rest = df.join(first.select(key), key, "left_anti")
    turns = stratified_sample(rest, key, [stratum], size - size // 2, seed).orderBy("sample_rank", "priority", key).limit(size - size // 2)
    columns = [F.col(c) for c in df.columns]
    return first.select(*columns, F.lit("seeded").alias("drawn")).unionByName(turns.select(*columns, F.lit("turn").alias("drawn")))


def wilson_lower(successes: Column, total: Column, z: float = Z) -> Column:
    """Lower bound of the score interval of a share; 0 without observations."""
    p = successes / total
    centre = p + z * z / (2 * total)
    radius = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    return F.when(total > 0, (centre - radius) / (1 + z * z / total)).otherwise(0.0)


def review_gate(labels: DataFrame, group: str, good: Column, min_precision: float = 0.95, min_lower: float = 0.90) -> DataFrame:
    """``(group, reviewed, precision, lower, approved)``; a null judgement counts as an error."""
    per = labels.groupBy(group).agg(F.count("*").alias("reviewed"), F.count_if(F.coalesce(good, F.lit(False))).alias("good"))
    lower = wilson_lower(F.col("good").cast("double"), F.col("reviewed").cast("double"))
    rows = per.select(group, "reviewed", F.round(F.col("good") / F.col("reviewed"), 9).alias("precision"), F.round(lower, 9).alias("lower"))
    return rows.withColumn("approved", (F.col("precision") >= min_precision) & (F.col("lower") >= min_lower))


def broken(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``(check, violations)`` of each invariant: how many rows of a table break its condition."""
    out = None
    for name, (df, condition) in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count_if(~F.coalesce(condition, F.lit(False))).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out
