"""Vocabulary, n-grams, collocations and curves over tokenised documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Words that collocations leave out, by language.
STOPWORDS = tuple(sorted(set("a o as os e de do da dos das em no na nos nas um uma que com para por se ao à é el la los las y en un una del al le les des et du au der die das und in den mit von the of and to an il lo di che".split())))
SEED = 73129


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, words)``: the words of each document in order; null texts have none."""
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), tx.words(F.col(text_col)).alias("words"))


def vocabulary(tok: DataFrame) -> DataFrame:
    """``(term, tf, df, is_stop)`` over all documents."""
    return _counted(tok.select(F.col("words").alias("items")), "term").withColumn("is_stop", F.col("term").isin(*STOPWORDS))


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """``(<name>, tf, df)`` of the ``items`` of documents, one row each.

    Every item counts as an occurrence and each distinct one of a row as a document, so that one shuffle with
    map-side combine is enough and no document id travels.
    """
    one = lambda tf, df: lambda x: F.struct(x.alias(name), F.lit(tf).cast("long").alias("tf"), F.lit(df).cast("long").alias("df"))
    both = F.concat(F.transform("items", one(1, 0)), F.transform(F.array_distinct("items"), one(0, 1)))
    return rows.select(F.explode(both).alias("x")).select("x.*").groupBy(name).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary_summary(vocab: DataFrame) -> DataFrame:
    """Types, hapax legomena, occurrences, document occurrences and the share of stop words."""
    return vocab.agg(F.count("*").alias("types"), F.count_if(F.col("tf") == 1).alias("hapax"), F.sum("tf").alias("occurrences"), F.sum("df").alias("document_occurrences"), F.count_if("is_stop").alias("stop_types"), F.sum(F.when(F.col("is_stop"), F.col("tf")).otherwise(0)).alias("stop_occurrences"))


def frequency_of_frequencies(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("tf").agg(F.count("*").alias("types"))


def top_terms(tok: DataFrame, k: int = 100, noise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The ``k`` most frequent terms, those that ``noise`` holds for left out before the cut; ties by term."""
    counts = tok.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    return (counts.filter(~noise(F.col("term"))) if noise else counts).orderBy(F.desc("tf"), "term").limit(k)


def top_ngrams(counts: DataFrame, k: int = 100, noise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The ``k`` most frequent n-grams with ``tf`` and ``df``, noise left out before the cut; ties by item."""
    return (counts.filter(~noise(F.col("item"))) if noise else counts).orderBy(F.desc("tf"), "item").limit(k).select("item", "tf", "df")


def approximate_top_terms(tok: DataFrame, k: int = 20, tracked: int = 10_000) -> DataFrame:
    """Heavy hitters by a sketch of bounded size, as an approximate variant of ``top_terms``."""
    return tok.select(F.explode("words").alias("term")).agg(F.expr(f"approx_top_k(term, {k}, {tracked})").alias("top")).select(F.explode("top").alias("x")).select(F.col("x.item").alias("term"), F.col("x.count").alias("tf"))


def zipf_bins(vocab: DataFrame) -> DataFrame:
    """``(bin, rank, frequency)``: mean rank and frequency in bins of a hundredth of the rank's decimal logarithm.

    Terms of one frequency take consecutive ranks, so that distinct frequencies with their numbers of
    terms are enough: each gives its range of ranks, which is cut at the bins' first ranks.  No term is
    ranked, and the table of distinct frequencies grows with the square root of the corpus at most.
    """
    sizes = vocab.groupBy("tf").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, 0))
    spans = sizes.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n") + 1)
    place = lambda r: F.floor(F.lit(100) * F.log10(r))
    guess = lambda b: F.ceil(F.pow(F.lit(10.0), b / 100)).cast("long")

    def first(b):
        # the rank that begins a bin, whichever way the power was rounded
        g = guess(b)
        return F.when(place(g) < b, g + 1).when((g > 1) & (place(F.greatest(g - 1, F.lit(1))) >= b), g - 1).otherwise(g)

    cut = spans.withColumn("bin", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))))
    cut = cut.withColumn("a", F.greatest("lo", first(F.col("bin")))).withColumn("b", F.least("hi", first(F.col("bin") + 1) - 1)).filter("a <= b")
    m = F.col("b") - F.col("a") + 1
    return cut.groupBy("bin").agg(F.round(F.sum((F.col("a") + F.col("b")) * m / 2) / F.sum(m), 6).alias("rank"), F.round(F.sum(F.col("tf") * m) / F.sum(m), 6).alias("frequency"))


def coverage(vocab: DataFrame, points: tuple[int, ...] = (10, 100, 1_000, 10_000, 50_000)) -> DataFrame:
    """Share of all occurrences that the most frequent ``rank`` terms cover, at given ranks and at the last."""
    sizes = vocab.groupBy("tf").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, 0)
    steps = sizes.select("tf", "n", F.sum("n").over(w).alias("upto"), F.sum(F.col("tf") * F.col("n")).over(w).alias("running"))
    total = vocab.agg(F.sum("tf").alias("total"), F.count("*").alias("types"))
    at = F.explode(F.array_distinct(F.concat(F.filter(F.array(*[F.lit(p).cast("long") for p in points]), lambda p: p < F.col("types")), F.array("types"))))
    wanted = total.select("total", at.alias("rank"))
    hit = (F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))
    covered = F.col("running") - F.col("tf") * (F.col("upto") - F.col("rank"))
    return steps.join(F.broadcast(wanted), hit).select("rank", covered.alias("running"), "total", F.round(covered / F.col("total"), 9).alias("share"))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by blanks."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, parts)``, one row per document: the words of its paragraphs, as n-grams never cross a blank line."""
    parts = F.transform(F.split(F.col(text_col), "\\n\\n"), tx.words)
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.filter(parts, lambda w: F.size(w) > 0).alias("parts"))


def ngram_counts(seq: DataFrame, n: int) -> DataFrame:
    """``(item, tf, df)`` of the n-grams of all paragraphs; exact in one pass and one shuffle."""
    return _counted(seq.select(F.flatten(F.transform("parts", lambda w: ngrams(w, n))).alias("items")), "item")


def marginals(bigrams: DataFrame) -> DataFrame:
    """``(term, left_count, right_count)``: how often a term begins and ends a bigram."""
    left = bigrams.select(F.split_part("item", F.lit(" "), F.lit(1)).alias("term"), F.col("tf").alias("l"), F.lit(0).cast("long").alias("r"))
    right = bigrams.select(F.split_part("item", F.lit(" "), F.lit(2)).alias("term"), F.lit(0).cast("long").alias("l"), F.col("tf").alias("r"))
    return left.unionByName(right).groupBy("term").agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count"))


def npmi(bigrams: DataFrame, min_tf: int = 20, min_df: int = 5, k: int = 100) -> DataFrame:
    """Bigrams without stop words by normalised pointwise mutual information."""
    m = marginals(bigrams)
    total = bigrams.agg(F.sum("tf").alias("positions"))
    first, second = F.split_part("item", F.lit(" "), F.lit(1)), F.split_part("item", F.lit(" "), F.lit(2))
    rows = bigrams.filter((F.col("tf") >= min_tf) & (F.col("df") >= min_df)).withColumn("a", first).withColumn("b", second).filter(~F.col("a").isin(*STOPWORDS) & ~F.col("b").isin(*STOPWORDS))
    rows = rows.join(m.select(F.col("term").alias("a"), "left_count"), "a").join(m.select(F.col("term").alias("b"), "right_count"), "b").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("tf") * F.col("positions") / (F.col("left_count").cast("double") * F.col("right_count")))
    rows = rows.withColumn("pmi", F.round(pmi, 9)).withColumn("npmi", F.round(pmi / -F.log(F.col("tf") / F.col("positions")), 9))
    return rows.orderBy(F.desc("npmi"), F.desc("tf"), "item").limit(k).select("item", "tf", "df", "pmi", "npmi")


def frequent_trigrams(trigrams: DataFrame, min_tf: int = 20, min_df: int = 5, k: int = 100) -> DataFrame:
    """Trigrams without a stop word at either end, most frequent first."""
    ends = ~F.split_part("item", F.lit(" "), F.lit(1)).isin(*STOPWORDS) & ~F.split_part("item", F.lit(" "), F.lit(3)).isin(*STOPWORDS)
    return trigrams.filter((F.col("tf") >= min_tf) & (F.col("df") >= min_df) & ends).orderBy(F.desc("tf"), "item").limit(k)


def vocabulary_growth(tok: DataFrame, steps: int = 100, seed: int = SEED) -> DataFrame:
    """``(documents, types)``: distinct words in the first part of the documents, in a seeded random order.

    Documents are ordered by the SHA-256 of seed and id; the order is cut into ``steps`` parts of equal
    hash range, so that each word needs the part of its first document only and nothing is ranked globally.
    """
    part = F.floor(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 6), 16, 10).cast("long") * steps / F.lit(1 << 24)).cast("int")
    placed = tok.withColumn("part", part)
    first = placed.select("part", F.explode("words").alias("term")).groupBy("term").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("new_types"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.join(first, "part", "left").select("part", F.sum("n").over(w).alias("documents"), F.sum(F.coalesce("new_types", F.lit(0))).over(w).alias("types"))
