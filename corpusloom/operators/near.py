"""Near-duplicates: exact similarity join of word shingles by rare prefixes, MinHash, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.arrow import map_batches
from corpusloom.session import materialize

SHINGLE = 5
MIN_WORDS = 50
JACCARD = 0.85
#: The similarity of the whole job, over every document that has a shingle.
ALL_JACCARD = 0.8
HASHES, BANDS = 112, 14
SEED = 73129
#: Keys that the sets of one bucket are spread over.
SPREAD = 8


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(set_id, shingles)`` once for each distinct shingle set, and ``(doc_id, set_id)``.

    Copies share one set, so that pairs are formed between classes of equal texts only.  Documents of
    fewer than ``min_words`` words take no part; null ids and texts neither.
    """
    w = tx.words(F.col(text_col))
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), w.alias("w")).filter(F.size("w") >= min_words)
    each = F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: F.xxhash64(F.concat_ws("\x1f", F.slice("w", i, width))))
    rows = rows.select("doc_id", F.array_sort(F.array_distinct(each)).alias("shingles"))
    rows = materialize(rows.withColumn("key", F.sha2(F.concat_ws(",", F.transform("shingles", lambda x: x.cast("string"))), 256)), "shingles")
    heads = rows.groupBy("key").agg(F.min("doc_id").alias("set_id"))
    members = materialize(rows.select("doc_id", "key").join(heads, "key").select("doc_id", "set_id"), "shingle-members")
    sets = rows.join(members.filter("doc_id = set_id").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("set_id"), "shingles")
    return materialize(sets, "shingle-sets"), members


def similar_sets(sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``(a, b, jaccard)``, a < b: all pairs of sets with at least that similarity, none missing.

    Two sets that similar share a shingle among the first n - ceil(jaccard * n) + 1 of each in any
    common order; rare shingles come first, so that few sets meet.  Sizes must agree to the same
    factor; candidates are verified on the whole sets.
    """
    each = sets.select("set_id", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    df = each.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1")
    placed = each.join(df, "x", "left")
    w = Window.partitionBy("set_id").orderBy(F.coalesce("df", F.lit(1)), "x")
    prefix = placed.withColumn("at", F.row_number().over(w)).filter((F.col("at") <= F.col("n") - F.ceil(F.lit(jaccard) * F.col("n") - 1e-9) + 1) & F.col("df").isNotNull()).select("set_id", "n", "x")
    prefix = materialize(prefix, "prefixes")
    left, right = prefix.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "x"), prefix.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "x")
    pairs = left.join(right, "x").filter("a < b").filter((F.col("na") >= F.col("nb") * F.lit(jaccard)) & (F.col("nb") >= F.col("na") * F.lit(jaccard))).select("a", "b").distinct()
    return verified(pairs, sets, jaccard)


def verified(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Candidate pairs whose whole sets reach the similarity."""
    full = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    value = common / (F.size("sa") + F.size("sb") - common)
    return full.select("a", "b", value.alias("jaccard")).filter(F.col("jaccard") >= jaccard)


def _mixers(count: int, seed: int) -> np.ndarray:
    """Seeds of the hash functions, from one generator."""
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64)


def _mixed(x: np.ndarray, mixer: np.uint64) -> np.ndarray:
    """A permutation of 64-bit values for each mixer, by two rounds of shift and multiplication."""
    x = (x ^ mixer) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def minhash_bands(sets: DataFrame, hashes: int = HASHES, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """``(set_id, band, bucket)``: banded MinHash signatures."""
    rows = hashes // bands

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        mixers = _mixers(hashes, seed)
        ids = batch.column(0).to_pylist()
        values = batch.column(1)
        flat = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = values.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sig = np.empty((len(ids), hashes), np.uint64)
        for k in range(hashes):
            sig[:, k] = np.minimum.reduceat(_mixed(flat, mixers[k]), offsets[:-1])
        out: dict[str, list] = {"set_id": [], "band": [], "bucket": []}
        for k in range(bands):
            part = sig[:, k * rows : (k + 1) * rows]
            out["set_id"] += ids
            out["band"] += [k] * len(ids)
            out["bucket"] += [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "big", signed=True) for r in part]
        return out

    return map_batches(sets.filter(F.size("shingles") > 0).select(F.col("set_id").cast("long"), F.col("shingles").cast("array<long>")), "set_id long, band int, bucket long", step)


def minhash_pairs(sets: DataFrame, jaccard: float = JACCARD, **kw) -> DataFrame:
    """``(a, b, jaccard)`` of the pairs that share a bucket and reach the similarity; a probabilistic variant of ``similar_sets``.

    The sets of a bucket are spread over SPREAD keys on one side and copied to all on the other, so that
    a bucket that very many sets share is no single task.
    """
    bands = materialize(minhash_bands(sets, **kw), "bands")
    left = bands.select(F.col("set_id").alias("a"), "band", "bucket", F.pmod(F.xxhash64("set_id"), F.lit(SPREAD)).cast("int").alias("part"))
    many = bands.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1").select("band", "bucket")
    right = bands.join(many, ["band", "bucket"], "left_semi").select(F.col("set_id").alias("b"), "band", "bucket", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    return verified(left.join(right, ["band", "bucket", "part"]).filter("a < b").select("a", "b").distinct(), sets, jaccard)


def components(nodes: DataFrame, pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """``(id, component)``: the smallest id that is linked with each node, directly or not.

    Labels go along the links and then jump to the label of their label; each round is written, so
    that neither the plan nor the driver grows.
    """
    links = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    state = materialize(nodes.select("id", F.col("id").alias("component")), "components")
    for _ in range(rounds):
        seen = links.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = state.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("label"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialize(step.join(up, "label").select("id", F.least("label", "further").alias("component"), (F.least("label", "further") < F.col("component")).alias("moved")), "components")
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_groups(docs: DataFrame, jaccard: float = JACCARD, **kw) -> DataFrame:
    """``(doc_id, class_id, links)`` of each document of at least MIN_WORDS words.

    ``class_id`` is the smallest document of its component and ``links`` the number of other distinct
    shingle sets its own is similar to.
    """
    sets, members = shingle_sets(docs, **kw)
    pairs = materialize(similar_sets(sets, jaccard), "near-pairs")
    labels = components(sets.select(F.col("set_id").alias("id")), pairs)
    degree = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).groupBy("set_id").agg(F.count("*").alias("links"))
    return members.join(labels.select(F.col("id").alias("set_id"), F.col("component").alias("class_id")), "set_id").join(degree, "set_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def all_near_groups(docs: DataFrame, jaccard: float = ALL_JACCARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_groups``, one row for each distinct document with a text, however short.

    Every document of at least SHINGLE words takes part; shorter ones have no shingle and are classes of
    their own, with no links.
    """
    groups = near_groups(docs, jaccard, id_col=id_col, text_col=text_col, min_words=SHINGLE)
    short = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.size(tx.words(F.col(text_col))) < SHINGLE)).select(F.col(id_col).alias("doc_id")).distinct()
    return groups.unionByName(short.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def sensitivity(docs: DataFrame, jaccard: float = JACCARD, id_col: str = "page_id", text_col: str = "text", domain_col: str = "domain_id") -> DataFrame:
    """One row: what collapsing near-duplicates would remove among distinct texts.

    ``(eligible_documents, confirmed_pairs, groups, documents_removed, words_removed, affected_domains)``; the document
    of a group that stays is the one with most words, then with the smallest id.
    """
    sets, members = shingle_sets(docs, id_col, text_col)
    pairs = materialize(similar_sets(sets, jaccard), "near-pairs")
    labels = components(sets.select(F.col("set_id").alias("id")), pairs)
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(domain_col).alias("domain_id"), F.size(tx.words(F.col(text_col))).cast("long").alias("words"))
    rows = members.join(labels.select(F.col("id").alias("set_id"), F.col("component").alias("class_id")), "set_id").join(words, "doc_id")
    rows = materialize(rows.select("doc_id", "class_id", "domain_id", "words"), "near-members")
    kept = rows.groupBy("class_id").agg(F.min_by("doc_id", F.struct(-F.col("words"), F.col("doc_id"))).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(kept, "class_id").filter("doc_id <> kept").agg(F.count("*").alias("documents_removed"), F.coalesce(F.sum("words"), F.lit(0)).alias("words_removed"), F.countDistinct("domain_id").alias("affected_domains"))
    counts = rows.agg(F.count("*").alias("eligible_documents")).crossJoin(pairs.agg(F.count("*").alias("confirmed_pairs"))).crossJoin(kept.agg(F.count("*").alias("groups")))
    return counts.crossJoin(gone)
