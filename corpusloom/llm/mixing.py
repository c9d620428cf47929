"""Mixing sources to target weights: token budgets fitted exactly by a bounded knapsack over lengths."""

from __future__ import annotations

import os
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrow import map_batches
from corpusloom.session import materialize

#: Vocabulary of a public tokenizer: byte pairs with their ranks, one to a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that parts text into pieces before the pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 17
#: Tokens that the knapsack fits exactly; what is larger is filled by lengths first.
WINDOW = 8192
#: Parts of a group of documents of one source and length, by their seeded hash.
PARTS = 64
SALTS = 16


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every document of a known source, over its whole text.

    Rows with a null id, source or text take no part; an empty text has 0 tokens.
    """

    df.sparkSession.sparkContext.addFile(vocabulary)  # the workers may not have it at that path
    name = os.path.basename(vocabulary)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        enc = _encoder(SparkFiles.get(name))
        return {"doc_id": batch.column(0).to_pylist(), "source": batch.column(1).to_pylist(), "n_tokens": [len(enc.encode_ordinary(t)) for t in batch.column(2).to_pylist()]}

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    return map_batches(src, "doc_id long, source string, n_tokens long", step).dropDuplicates(["doc_id"])


def fit_budget(counts: dict[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each length to take, so that their tokens come as near to ``budget`` from below as lengths allow.

    Lengths are first taken in proportion, then longest first, until at most ``window`` tokens are
    left; that rest is fitted exactly by a bounded knapsack.
    """
    counts = {k: n for k, n in counts.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    take = {k: n * budget // total for k, n in counts.items()}
    left = budget - sum(k * n for k, n in take.items())
    for k in sorted(counts, reverse=True):
        if left <= window:
            break
        more = min(counts[k] - take[k], left // k, -(-(left - window) // k))
        take[k] += more
        left -= more * k
    for k, n in knapsack({k: counts[k] - take[k] for k in counts}, left).items():
        take[k] += n
    return {k: n for k, n in take.items() if n}


def knapsack(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Numbers of each length whose sum is the largest that is at most ``capacity``.

    Reachable sums are the bits of one integer; each length enters as powers of two of its count.
    """
    full = (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int]] = []
    reached, before = 1, []
    for k in sorted(counts):
        n = min(counts[k], capacity // k) if k > 0 else 0
        power = 1
        while n > 0:
            m = min(power, n)
            before.append(reached)
            steps.append((k, m))
            reached |= (reached << (k * m)) & full
            n -= m
            power *= 2
    at, take = reached.bit_length() - 1, defaultdict(int)
    for (k, m), old in zip(reversed(steps), reversed(before)):
        if not old >> at & 1:
            take[k] += m
            at -= k * m
    return dict(take)


def fill(wanted: float, weights: dict[str, float], most: dict[str, int]) -> dict[str, int]:
    """Tokens of each source: ``wanted`` parted by weights, where what a source cannot give goes to the others by their weights.

    So the whole size is reached while any source has tokens left, and the sources that are not used up keep the proportions
    of their weights among each other.
    """
    out, left = dict.fromkeys(weights, 0), dict(weights)
    while left:
        total = sum(left.values())
        full = [s for s, w in left.items() if wanted * w / total >= most[s]] if total > 0 else []
        if not full:
            return out | {s: int(wanted * w / total) for s, w in left.items() if total > 0}
        for s in full:
            out[s] = most[s]
            wanted -= most[s]
            del left[s]
    return out


def plan_mix(targets: list[dict], histogram: dict[str, dict[int, int]], window: int = WINDOW) -> list[tuple[str, str, int, int, int]]:
    """``(recipe, source, n_tokens, copies, extra)``: whole repeats of each length, and of how many documents one more."""
    plan = []
    for recipe in sorted({t["recipe"] for t in targets}):
        own = [t for t in targets if t["recipe"] == recipe]
        size = {t["source"]: sum(k * n for k, n in histogram.get(t["source"], {}).items()) for t in own}
        budgets = fill(max(t["size_factor"] for t in own) * sum(size.values()), {t["source"]: t["weight"] for t in own}, {t["source"]: size[t["source"]] * t["max_repeats"] for t in own})
        for t in own:
            total, tokens = size[t["source"]], budgets[t["source"]]
            if not total:
                continue
            copies, rest = divmod(tokens, total)
            extra = fit_budget(histogram[t["source"]], rest, window)
            plan += [(recipe, t["source"], k, copies, min(extra.get(k, 0), n)) for k, n in histogram[t["source"]].items() if copies or extra.get(k)]
    return plan


def mix(df: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED, **names) -> DataFrame:
    """``(recipe, source, doc_id, n_tokens, copies)``: the documents of each recipe's mix and how often each is used.

    Documents of a length are chosen by a seeded hash: a group of one source and length is parted by
    that hash, parts are taken whole as long as they fit, and only within one part is ranked.  Targets
    with a null recipe, source or weight take no part; a null max_repeats is 1.
    """
    return _mix(materialize(token_counts(df, vocabulary, **names), "token-counts"), targets, seed)


def _targets(targets: DataFrame) -> list[dict]:
    rows = targets.filter("recipe IS NOT NULL AND source IS NOT NULL AND weight > 0").groupBy("recipe", "source").agg(F.sum("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max(F.coalesce("size_factor", F.lit(1.0))).alias("size_factor"))
    return [r.asDict() for r in rows.collect()]


def _mix(tokens: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    spark = tokens.sparkSession
    histogram: dict[str, dict[int, int]] = defaultdict(dict)
    # distinct lengths of each source: their number is bounded by the longest text, not by the documents
    counts = tokens.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).toArrow()
    for source, length, n in zip(*(counts.column(c).to_pylist() for c in ("source", "n_tokens", "n"))):
        histogram[source][length] = n
    plan = spark.createDataFrame(plan_mix(_targets(targets), histogram), "recipe string, source string, n_tokens long, copies long, extra long")
    group = ["recipe", "source", "n_tokens"]
    # One source and length may hold very many documents: both sides are spread by a part of the id.
    spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = tokens.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["source", "n_tokens", "salt"]).drop("salt")
    whole = each.filter("extra = 0").select(*group, "doc_id", "copies")
    drawn = each.filter("extra > 0").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed), F.col("recipe"))).withColumn("part", F.pmod("h", F.lit(PARTS)))
    sizes = drawn.groupBy(*group, "part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = drawn.join(sizes, [*group, "part"]).withColumn("need", F.col("extra") - F.col("before"))
    easy = placed.filter("need <= 0 OR need >= n").select(*group, "doc_id", (F.col("copies") + (F.col("need") > 0).cast("long")).alias("copies"))
    rank = F.row_number().over(Window.partitionBy(*group, "part").orderBy("h", "doc_id"))
    ranked = placed.filter("need > 0 AND need < n").withColumn("rank", rank).select(*group, "doc_id", (F.col("copies") + (F.col("rank") <= F.col("need")).cast("long")).alias("copies"))
    return whole.unionByName(easy).unionByName(ranked).filter("copies > 0").select("recipe", "source", "doc_id", "n_tokens", "copies")


def report(df: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED, **names) -> DataFrame:
    """Actual shares, repeats, shortfalls and surpluses of each recipe and source, summed from the mix itself.

    A source without documents has no tokens and its whole target as shortfall; what a source lacks is the
    surplus of others, as far as their repeats allow.
    """
    tokens = materialize(token_counts(df, vocabulary, **names), "token-counts")
    own = targets.filter("recipe IS NOT NULL AND source IS NOT NULL AND weight > 0").groupBy("recipe", "source").agg(F.sum("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max(F.coalesce("size_factor", F.lit(1.0))).alias("size_factor"))
    sizes = tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_documents"))
    used = _mix(tokens, targets, seed).groupBy("recipe", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    r = own.join(sizes, "source", "left").join(used, ["recipe", "source"], "left").fillna(0, ["source_tokens", "source_documents", "actual_tokens", "documents", "most_copies"])
    w = Window.partitionBy("recipe")
    r = r.withColumn("target_share", F.col("weight") / F.sum("weight").over(w)).withColumn("wanted", F.max("size_factor").over(w) * F.sum("source_tokens").over(w))
    r = r.withColumn("target_tokens", F.floor(F.col("wanted") * F.col("target_share")).cast("long"))
    return r.select(
        "recipe", "source", "source_documents", "source_tokens", "target_share", "target_tokens", "actual_tokens", (F.col("actual_tokens") / F.greatest(F.sum("actual_tokens").over(w), F.lit(1))).alias("actual_share"),
        "documents", F.when(F.col("source_tokens") > 0, F.col("actual_tokens") / F.col("source_tokens")).otherwise(0.0).alias("repeats"), "most_copies", "max_repeats", F.greatest(F.col("target_tokens") - F.col("actual_tokens"), F.lit(0)).alias("shortfall_tokens"),
        F.greatest(F.col("actual_tokens") - F.col("target_tokens"), F.lit(0)).alias("surplus_tokens"),
    )
