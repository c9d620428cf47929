"""The domain inventory and its reports: hosts, levels, children, ancestors, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.session import materialize


def canonical_domains(domain: DataFrame) -> DataFrame:
    """One row for each domain id, that with the latest updated_at: host, registrable domain, encyclopaedia flag, parent, level, requests."""
    row = F.struct(F.coalesce("updated_at", F.lit("")).alias("at"), F.col("parent_domain_id").alias("parent_domain_id"), F.col("recursion_level").alias("recursion_level"), F.col("request_count").alias("request_count"), F.col("url").alias("url"))
    last = domain.filter("id IS NOT NULL").groupBy("id").agg(F.max(row).alias("x")).select("id", "x.parent_domain_id", "x.recursion_level", "x.request_count", tx.host(F.col("x.url")).alias("host"))
    return last.withColumn("registrable_domain", tx.registrable(F.col("host"))).withColumn("is_wiki", tx.is_wiki(F.col("host")))


def error_counts(canon: DataFrame) -> DataFrame:
    """``(error, domains)`` of missing or negative fields and of parents that were never exported."""
    ids = canon.select(F.col("id").alias("parent_domain_id"))
    orphan = canon.filter("parent_domain_id IS NOT NULL").join(ids, "parent_domain_id", "left_anti").agg(F.lit("missing_parent").alias("error"), F.count("*").alias("domains"))
    rules = {"missing_host": "host IS NULL", "missing_level": "recursion_level IS NULL", "invalid_level": "recursion_level < 0", "missing_requests": "request_count IS NULL", "without_parent": "parent_domain_id IS NULL"}
    counted = canon.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in rules.items()])
    return counted.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{k}', {k}" for k in rules) + ") AS (error, domains)").unionByName(orphan)


def levels(canon: DataFrame) -> DataFrame:
    """Domains and requests of each level with their shares; a null level is called ``missing``."""
    per = canon.groupBy("recursion_level").agg(F.count("*").alias("domains"), F.sum(F.coalesce("request_count", F.lit(0))).alias("requests"), F.round(F.avg("request_count"), 6).alias("mean_requests"))
    everything = Window.partitionBy(F.lit(0))
    share = lambda c: F.round(F.lit(100.0) * F.col(c) / F.nullif(F.sum(c).over(everything), F.lit(0)), 6)
    return per.select(F.coalesce(F.col("recursion_level").cast("string"), F.lit("missing")).alias("level"), "domains", share("domains").alias("domain_percentage"), "requests", share("requests").alias("request_percentage"), "mean_requests")


def children(canon: DataFrame, k: int | None = 15) -> DataFrame:
    """Known parents by number of direct children; ties by host, nulls last, then by id."""
    up = canon.select(F.col("id").alias("parent_id"), "host")
    per = canon.filter("parent_domain_id IS NOT NULL").groupBy(F.col("parent_domain_id").alias("parent_id")).agg(F.count("*").alias("children"), F.round(F.avg("request_count"), 6).alias("mean_requests"), F.count_if(F.col("request_count").isNull()).alias("missing_requests"))
    rows = per.join(up, "parent_id").select("parent_id", "host", "children", "mean_requests", "missing_requests")
    return rows.orderBy(F.desc("children"), F.col("host").asc_nulls_last(), "parent_id").limit(k) if k else rows


def children_reconciliation(canon: DataFrame) -> DataFrame:
    """Totals that must add up: all domains are without parent, with a missing parent, or with a known one."""
    known = canon.select(F.col("id").alias("parent_domain_id"), F.lit(True).alias("known"))
    rows = canon.join(known, "parent_domain_id", "left")
    has = F.col("parent_domain_id").isNotNull()
    out = rows.agg(F.count("*").alias("total"), F.count_if(~has).alias("without_parent"), F.count_if(has & F.col("known").isNull()).alias("missing_parent"), F.count_if(F.col("known")).alias("linked"))
    return out.withColumn("reconciled", F.col("total") == F.col("without_parent") + F.col("missing_parent") + F.col("linked"))


def ancestors(canon: DataFrame, wanted: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(id)``: the wanted domains and every ancestor of theirs, cycles included.

    Only the ids that are new in a round are joined and written; the plan of the next round reads the tables of
    those before.  Rounds go on until no new id appears; an error says that ``rounds`` were too few.
    """
    edges = canon.filter("parent_domain_id IS NOT NULL").select("id", F.col("parent_domain_id").alias("parent"))
    # parents that were exported, once: rounds need no further look at the table of domains
    edges = materialize(edges.join(canon.select(F.col("id").alias("parent")), "parent", "left_semi"), "edges")
    seen = new = materialize(wanted.select("id").distinct().join(canon.select("id"), "id", "left_semi"), "closure")
    done = 0
    while True:
        new = materialize(new.join(edges, "id").select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti"), "closure")
        if new.isEmpty():
            return seen
        if done == rounds:
            raise RuntimeError(f"ancestors did not end in {rounds} rounds")
        done += 1
        seen = seen.unionByName(new)


def running(df: DataFrame, order: str, **sums: str) -> DataFrame:
    """``df`` with running sums in the order of ``order``, which must be distinct: ``running(df, "v", upto="m")`` adds up m.

    Rows are parted by ranges of ``order``; each range begins with the sums of those before, of which there is
    one row a range, so that no task sorts all rows.
    """
    parted = materialize(df.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = parted.groupBy("range").agg(*[F.sum(c).alias(f"{n}_own") for n, c in sums.items()])
    starts = whole.select("range", *[F.coalesce(F.sum(f"{n}_own").over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parted.join(F.broadcast(starts), "range").select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"{n}_before")).alias(n) for n, c in sums.items()])


def concentration(values: DataFrame, key: str, value: str, tops: tuple[int, ...] = (1, 10, 100, 1000)) -> DataFrame:
    """``(metric, value, share)``: what the largest keys hold together, and the Gini coefficient.

    Tops come from bounded top-k plans.  The coefficient needs ranks: keys of one value share theirs, so
    that only the table of distinct values is summed in order.
    """
    v = values.filter(F.col(value) > 0).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    total = v.agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    out = None
    for top in tops:
        head = v.orderBy(F.desc("v"), "k").limit(top).agg(F.lit(f"top_{top}").alias("metric"), F.sum("v").alias("value"))
        out = head if out is None else out.unionByName(head)
    sizes = v.groupBy("v").agg(F.count("*").alias("m"))
    ranks = running(sizes, "v", upto="m")
    weighted = F.sum(F.col("v") * (F.col("m") * F.col("upto") - F.col("m") * (F.col("m") - 1) / 2))
    gini = ranks.agg(weighted.alias("s")).crossJoin(F.broadcast(total)).select(F.lit("gini").alias("metric"), (2 * F.col("s") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("value"))
    joined = out.crossJoin(F.broadcast(total)).select("metric", F.round("value", 4).alias("value"), F.round(F.col("value") / F.col("total"), 6).alias("share"))
    return joined.unionByName(gini.select("metric", F.round("value", 6).alias("value"), F.lit(None).cast("double").alias("share")))


def lorenz(values: DataFrame, value: str) -> DataFrame:
    """``(keys, share_keys, share_value)`` at each distinct value, from the smallest."""
    v = values.filter(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    v = v.withColumn("held", F.col("v") * F.col("m"))
    rows = running(v, "v", keys="m", c="held").crossJoin(F.broadcast(v.agg(F.sum("m").alias("n"), F.sum("held").alias("t"))))
    return rows.select("keys", F.round(F.col("keys") / F.col("n"), 9).alias("share_keys"), F.round(F.col("c") / F.col("t"), 9).alias("share_value"))


def fractional_words(content: DataFrame, memberships: DataFrame) -> DataFrame:
    """``(domain_id, words)``: words of each distinct text, divided evenly among the domains that hold it.

    ``content`` has ``(hash, words)`` once per hash, ``memberships`` distinct ``(hash, domain_id)``.
    """
    sizes = memberships.groupBy("hash").agg(F.count("*").alias("domains"))
    return memberships.join(sizes, "hash").join(content, "hash").groupBy("domain_id").agg(F.sum(F.col("words") / F.col("domains")).alias("words"))


def main_domains(metrics: DataFrame, k: int = 100) -> DataFrame:
    """Domains among the first ``k`` by requests, documents or words; ties by id.

    Three bounded top-k plans replace global rankings of all domains.
    """
    top = lambda c: metrics.orderBy(F.desc_nulls_last(c), "id").limit(k).select("id")
    chosen = top("requests").unionByName(top("documents")).unionByName(top("words")).distinct()
    return metrics.join(F.broadcast(chosen), "id", "left_semi")


def shares(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the share of each column in its total; null where the total is 0."""
    total = df.agg(*[F.sum(c).alias(f"{c}_total") for c in columns])
    joined = df.crossJoin(F.broadcast(total))
    return joined.select(*df.columns, *[_share(c).alias(f"{c}_share") for c in columns])


def _share(c: str) -> Column:
    return F.round(F.col(c).cast("double") / F.nullif(F.col(f"{c}_total"), F.lit(0)), 9)
