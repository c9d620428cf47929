"""Document profiles: size, diversity, repetition, signals, and their distributions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.session import ship

WINDOW = 100
#: Sequences that mark text decoded wrongly; some begin others, so they count twice.
MARKERS = ("Ã¡", "Ã¢", "Ã£", "Ã¤", "Ã©", "Ãª", "Ã\u00ad", "Ã³", "Ã´", "Ãµ", "Ã¶", "Ãº", "Ã¼", "Ã§", "Â\u00a0", "â€“", "â€”", "â€™", "â€œ", "â€", "â€¦", "ðŸ", "\ufffd")
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def occurrences(text: Column, marker: str) -> Column:
    """How often ``marker`` stands in ``text`` without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def mattr(words: Column, window: int = WINDOW) -> Column:
    """Moving-average type-token ratio; null for fewer words than the window."""
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else moving_ratio(list(w), window))

    return run(words)


def moving_ratio(words: list[str], window: int) -> float | None:
    if len(words) < window:
        return None
    # A word adds to each window in which it is the first of its kind: from its previous occurrence
    # on, so that the sum over all windows needs one look back per word.
    last: dict[str, int] = {}
    total, n = 0, len(words)
    for i, w in enumerate(words):
        begin = max(last.get(w, -1) + 1, i - window + 1, 0)
        end = min(i, n - window)
        total += max(0, end - begin + 1)
        last[w] = i
    return total / window / (n - window + 1)


def sentence_array(text: Column) -> Column:
    """Sentences by stops and line ends, trimmed, those with a letter or digit only."""
    return F.filter(F.transform(F.split(text, "[.!?…]+(?=\\s|$)|\\n+", -1), lambda x: F.trim(x)), lambda x: x.rlike("[\\p{L}\\p{N}]"))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fragment: int = 2, long_sentence: int = 100, long_token: int = 30, min_words: int = 3, min_chars: int = 20) -> DataFrame:
    """One row per document with sizes, diversity, repetition and signals; null texts have none.

    Repeated words are those of the extra copies of sentences of ``min_words`` words and of
    paragraphs of ``min_chars`` characters.
    """
    t = F.col("text")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("w", tx.words(t)).withColumn("s", sentence_array(t)).withColumn("p", tx.paragraphs(t)).withColumn("tok", F.filter(F.split(t, "\\s+", -1), lambda x: x != ""))
    unit = lambda x: F.regexp_replace(F.lower(x), "\\s+", " ")
    count = lambda x: F.size(tx.words(x))
    long = F.filter(F.transform("s", unit), lambda x: count(x) >= min_words)
    paras = F.filter(F.transform("p", unit), lambda x: F.length(x) >= min_chars)
    size = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + count(x))
    rows = rows.withColumn("ls", long).withColumn("lp", paras)
    upper = F.size(F.filter(F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), 1), lambda x: (F.upper(x) == x) & (F.lower(x) != x)))
    n = F.size("w")
    markers = occurrences(t, MARKERS[0])
    for m in MARKERS[1:]:
        markers = markers + occurrences(t, m)
    rows = rows.select(
        "doc_id", F.length(t).cast("long").alias("characters"), n.cast("long").alias("words"), F.size("s").cast("long").alias("sentences"), F.size("p").cast("long").alias("paragraphs"), F.size(F.array_distinct("w")).cast("long").alias("unique_forms"),
        F.size(F.filter("tok", lambda x: x.rlike("^[\\d.,]*\\d$"))).cast("long").alias("numbers"), (size(F.col("ls")) - size(F.array_distinct("ls"))).cast("long").alias("repeated_sentence_words"), (size(F.col("lp")) - size(F.array_distinct("lp"))).cast("long").alias("repeated_paragraph_words"),
        F.size(F.filter("s", lambda x: count(x) <= fragment)).cast("long").alias("fragment_sentences"), F.size(F.filter("s", lambda x: count(x) >= long_sentence)).cast("long").alias("long_sentences"), F.size(F.filter("w", lambda x: F.length(x) >= long_token)).cast("long").alias("long_tokens"),
        F.size(F.filter("tok", lambda x: x.rlike("^(https?://|www\\.)"))).cast("long").alias("urls"), F.size(F.filter("tok", lambda x: x.rlike("^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+$"))).cast("long").alias("emails"),
        F.regexp_count(t, F.lit(r"([^\p{L}\p{N}_\s])\1{3,}")).cast("long").alias("punctuation_runs"), markers.alias("mojibake_markers"), upper.cast("long").alias("uppercase_words"),
    )
    part = lambda c: F.when(F.col("words") > 0, F.round(F.col(c) / F.col("words"), 6)).otherwise(0.0)
    rows = rows.withColumn("ttr", part("unique_forms")).withColumn("repeated_sentence_fraction", part("repeated_sentence_words")).withColumn("repeated_paragraph_fraction", part("repeated_paragraph_words"))
    signals = F.col("fragment_sentences") + F.col("long_sentences") + F.col("long_tokens") + F.col("urls") + F.col("emails") + F.col("punctuation_runs") + F.col("mojibake_markers")
    high = lambda c, share, of: (F.col("words") >= 20) & (F.col(c) / of >= share)
    rows = rows.withColumn("high_numeric", high("numbers", 0.30, F.col("words") + F.col("numbers"))).withColumn("high_uppercase", high("uppercase_words", 0.50, F.col("words")))
    return rows.withColumn("any_signal", (signals > 0) | F.col("high_numeric") | F.col("high_uppercase"))


SIGNALS = ("fragment_sentences", "long_sentences", "long_tokens", "urls", "emails", "punctuation_runs", "mojibake_markers")


def signal_prevalence(prof: DataFrame) -> DataFrame:
    """``(signal, documents, occurrences)`` for each signal."""
    pairs = ", ".join(f"'{s}', {s}" for s in SIGNALS)
    flags = "'high_numeric', cast(high_numeric AS bigint), 'high_uppercase', cast(high_uppercase AS bigint)"
    return prof.selectExpr(f"stack({len(SIGNALS) + 2}, {pairs}, {flags}) AS (signal, n)").groupBy("signal").agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("occurrences"))


def structure_histogram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(metric, value, count)``: sentences and paragraphs per document, words and characters per paragraph."""
    t = F.col("text")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).withColumn("s", sentence_array(t)).withColumn("p", tx.paragraphs(t))
    item = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("long").alias("value"))
    per = F.concat(
        F.array(item("sentences_per_document", F.size("s")), item("paragraphs_per_document", F.size("p"))),
        F.transform("s", lambda x: item("words_per_sentence", F.size(tx.words(x)))), F.transform("s", lambda x: item("characters_per_sentence", F.length(x))),
        F.transform("p", lambda x: item("words_per_paragraph", F.size(tx.words(x)))), F.transform("p", lambda x: item("characters_per_paragraph", F.length(x))),
    )
    return rows.select(F.explode(per).alias("x")).select("x.*").groupBy("metric", "value").agg(F.count("*").alias("count"))


def weighted_quantiles(histogram: DataFrame) -> DataFrame:
    """Units, mean and nearest-rank quantiles of each metric of a histogram."""
    w = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    base = histogram.withColumn("cumulative", F.sum("count").over(w)).withColumn("total", F.sum("count").over(Window.partitionBy("metric")))
    cuts = [F.min(F.when(F.col("cumulative") >= F.col("total") * F.lit(q), F.col("value"))).alias(f"p{round(q * 100)}") for q in QUANTILES]
    return base.groupBy("metric").agg(F.max("total").alias("units"), F.round(F.sum(F.col("value") * F.col("count")) / F.max("total"), 6).alias("mean"), *cuts)


def quantiles(df: DataFrame, *columns: str) -> DataFrame:
    """``(metric, documents, mean, p5..p99)`` of each column; nulls are left out, quantiles interpolate."""
    out = None
    for c in columns:
        cuts = F.percentile(c, F.array(*[F.lit(q) for q in QUANTILES]))
        row = df.agg(F.lit(c).alias("metric"), F.count(c).alias("documents"), F.round(F.avg(c), 6).alias("mean"), cuts.alias("q")).select("metric", "documents", "mean", *[F.round(F.col("q")[i], 6).alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)])
        out = row if out is None else out.unionByName(row)
    return out


def ttr_by_size(prof: DataFrame) -> DataFrame:
    """Type-token ratio by classes of document size."""
    size = F.when(F.col("words") < 100, "0-99").when(F.col("words") < 500, "100-499").when(F.col("words") < 2000, "500-1999").otherwise("2000+")
    return prof.groupBy(size.alias("size")).agg(F.count("*").alias("documents"), F.round(F.avg("ttr"), 6).alias("mean_ttr"), F.round(F.percentile("ttr", F.lit(0.5)), 6).alias("median_ttr"))


def rounded_distribution(prof: DataFrame) -> DataFrame:
    """``(metric, value, documents)`` of ratios at four decimals."""
    parts = [prof.filter("words > 0").select(F.lit(c).alias("metric"), F.round(c, 4).alias("value")) for c in ("ttr", "repeated_sentence_fraction", "repeated_paragraph_fraction")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("metric", "value").agg(F.count("*").alias("documents"))


def fixed_histogram(df: DataFrame, column: str, low: int = 2, high: int = 9999, bins: int = 100) -> DataFrame:
    """``(bin, left, right, documents)`` of equal bins over [low, high], the last one closed; bins -1 and ``bins`` hold what lies outside."""
    v = F.col(column)
    width = (high - low) / bins
    place = F.when(v < low, -1).when(v > high, bins).when(v == high, bins - 1).otherwise(F.floor((v - low) / F.lit(width)).cast("int"))
    rows = df.filter(v.isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("documents"))
    return rows.select("bin", F.round(F.lit(low) + F.col("bin") * F.lit(width), 6).alias("left"), F.round(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 6).alias("right"), "documents")
