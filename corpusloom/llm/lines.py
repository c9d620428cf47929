"""Lines repeated across the documents of one site, found by a likelihood-ratio test and removed."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import map_batches
from corpusloom.session import materialize

MIN_PAGES = 8
MIN_SHARE = 0.05
FALSE_DISCOVERY = 0.01
SALTS = 16
#: Levels that likelihood ratios are counted in, so that the control of false discoveries needs no global sort.
P_LEVELS = 2000
LEVELS_PER_UNIT = 16

_DIGITS = re.compile(r"\d+")
_LETTER = re.compile(r"[^\W\d_]")


def canonical_lines(text: str) -> list[tuple[int, int]]:
    """``(line_no, hash)`` of each line of ``text`` that has a letter.

    Lines end with LF and count from 1; white space at the ends is cut, runs of it are one space,
    case is folded and a run of digits reads as one digit.
    """
    out = []
    for no, line in enumerate(_DIGITS.sub("0", text.casefold()).split("\n"), 1):
        if _LETTER.search(line):
            out.append((no, xxhash.xxh3_64_intdigest(" ".join(line.split()).encode("utf-8", "surrogatepass")) - (1 << 63)))
    return out


def line_table(df: DataFrame, id_col: str = "id", site_col: str = "domain_id", text_col: str = "text") -> DataFrame:
    """``(id, site, blank, nos, hashes)`` once per document and site, for documents of a known site.

    Rows with a null id, site or text take no part.  Hashes travel instead of lines.
    """

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"id": batch.column(0).to_pylist(), "site": batch.column(1).to_pylist(), "blank": [], "nos": [], "hashes": []}
        for t in batch.column(2).to_pylist():
            lines = canonical_lines(t)
            out["blank"].append(not t or t.isspace())
            out["nos"].append([n for n, _ in lines])
            out["hashes"].append([h for _, h in lines])
        return out

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(site_col).alias("site"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("site", F.col("site").cast("string")).filter("id IS NOT NULL AND site IS NOT NULL AND text IS NOT NULL")
    return map_batches(src, "id long, site string, blank boolean, nos array<int>, hashes array<long>", step).dropDuplicates(["id", "site"])


def excess_lines(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, fdr: float = FALSE_DISCOVERY) -> DataFrame:
    """``(site, hash, pages, site_pages, outside_pages, outside, g2)``: the lines in significant excess within their site.

    ``g2`` is the signed log-likelihood ratio of the line's frequency on the pages of its site against the
    frequency of the same line outside.  The outside are the pages of all other sites but those where the
    line is itself on ``min_pages`` and ``min_share`` of the pages: a line that many sites repeat has no clean
    background there.  To it come as many pages as the site has, on which the line is as frequent as an
    ordinary one, that is on one page of all; so a line of every site, or a corpus of one site, has one too.
    Every (site, line) on at least ``min_pages`` pages is a hypothesis; Benjamini-Hochberg control at
    ``fdr`` decides which ratios are significant, and the stated bounds are checked after it.  A line that is
    about as frequent outside, below the bounds, is thereby no excess of the site.
    """
    spark = lines.sparkSession
    sizes = lines.filter(~F.col("blank")).groupBy("site").agg(F.count("*").alias("site_pages"))
    total = sizes.agg(F.sum("site_pages")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "site string, hash long, pages long, site_pages long, outside_pages double, outside double, g2 double")
    pairs = lines.select("site", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("site", "hash").agg(F.count("*").alias("pages"))
    pairs = materialize(pairs, "site-lines")
    # Sites are skewed, so that their sizes are joined by site and a part of the line's hash.
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tested = pairs.filter(F.col("pages") >= min_pages).withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(spread, ["site", "salt"]).drop("salt")
    tested = materialize(tested.withColumn("bound", F.col("pages") >= F.col("site_pages") * F.lit(min_share)), "tested-lines")
    # A line is tested on few sites but may stand on pages of all: both sums are combined on the map side.
    everywhere = pairs.join(tested.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.sum("pages").alias("all_pages"))
    repeated = tested.groupBy("hash").agg(F.sum(F.when(F.col("bound"), F.col("pages")).otherwise(0)).alias("bound_pages"), F.sum(F.when(F.col("bound"), F.col("site_pages")).otherwise(0)).alias("bound_sizes"))
    own = lambda c: F.when(F.col("bound"), F.lit(0)).otherwise(F.col(c))  # noqa: E731  (a bound pair is in the sums already)
    ordinary = F.col("site_pages") / F.lit(float(total) + 1.0)
    scored = tested.join(everywhere.join(repeated, "hash"), "hash")
    scored = scored.withColumn("outside_pages", (F.col("all_pages") - F.col("bound_pages") - own("pages")) + ordinary).withColumn("outside", F.lit(float(total)) - F.col("bound_sizes") - own("site_pages") + F.col("site_pages"))
    scored = scored.withColumn("g2", _g2(F.col("pages").cast("double"), F.col("site_pages").cast("double"), F.col("outside_pages"), F.col("outside")))
    # Ratios are counted in levels, so that the control needs no global sort; a level's p-value is that of its lower end.
    level = F.when(F.col("g2") > 0, F.least(F.floor(F.col("g2") * LEVELS_PER_UNIT), F.lit(P_LEVELS - 1))).otherwise(F.lit(0)).cast("int")
    scored = materialize(scored.withColumn("level", level), "scored-lines")
    cut = significant_level({r["level"]: r["n"] for r in scored.groupBy("level").agg(F.count("*").alias("n")).collect()}, fdr)
    return scored.filter((F.col("level") >= cut) & F.col("bound")).select("site", "hash", "pages", "site_pages", "outside_pages", "outside", "g2")


def significant_level(counts: dict[int, int], fdr: float) -> int:
    """The lowest level from which all are significant by Benjamini-Hochberg control; ``counts`` has the tests of each level."""
    tests, cut, seen = sum(counts.values()), P_LEVELS, 0
    for level in sorted((x for x in counts if x > 0), reverse=True):
        seen += counts[level]
        # one-sided tail of a chi-square with one degree of freedom
        if math.erfc(math.sqrt(level / LEVELS_PER_UNIT / 2)) / 2 <= fdr * seen / tests:
            cut = level
    return cut


def _part(k, expected):
    return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))


def _g2(a, n, b, m):
    """Signed log-likelihood ratio of a of n against b of m; positive if a / n is the larger share."""
    a, b = F.least(a, n), F.least(b, m)
    p = (a + b) / (n + m)
    g = F.lit(2.0) * (_part(a, n * p) + _part(n - a, n * (1 - p)) + _part(b, m * p) + _part(m - b, m * (1 - p)))
    return F.when(a / n >= b / m, g).otherwise(-g)


def excessive_positions(df: DataFrame, salts: int = SALTS, **kw) -> DataFrame:
    """``(id, site, line_no)`` of each line in excess within its site.

    The join on (site, line) is salted by document, as one line may stand on every page of the
    largest site.  An empty input gives no rows.
    """
    names = {k: kw.pop(k) for k in ("id_col", "site_col", "text_col") if k in kw}
    lines = materialize(line_table(df, **names), "page-lines")
    excess = excess_lines(lines, **kw).select("site", "hash", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    each = lines.select("id", "site", F.explode(F.arrays_zip("nos", "hashes")).alias("x"))
    each = each.select("id", "site", F.col("x.nos").alias("line_no"), F.col("x.hashes").alias("hash"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    return each.join(excess, ["site", "hash", "salt"]).select("id", "site", "line_no")


def found(df: DataFrame, **kw) -> DataFrame:
    """``(id, line_no)``: each line that is repeated excessively within its site."""
    return excessive_positions(df, **kw).select("id", F.col("line_no").cast("long").alias("line_no")).distinct()


def without_excess(df: DataFrame, id_col: str = "id", text_col: str = "text", **kw) -> DataFrame:
    """``(id, text, removed)``: every document once, without its excessive lines, in the order of positions.

    A document without such a line keeps its text unchanged.
    """
    drop = found(df, id_col=id_col, text_col=text_col, **kw).groupBy("id").agg(F.collect_set("line_no").alias("nos"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id"])
    joined = texts.join(drop, "id", "left")
    kept = F.expr("array_join(transform(filter(transform(split(text, '\\n', -1), (x, i) -> struct(x AS l, i AS i)), s -> NOT array_contains(nos, cast(s.i + 1 AS bigint))), s -> s.l), '\\n')")
    return joined.select("id", F.when(F.col("nos").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("nos").isNull(), 0).otherwise(F.size("nos")).cast("long").alias("removed"))
