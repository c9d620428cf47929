"""Boilerplate inside domains: text units, candidates by document frequency, cleaning in two rounds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import noise
from corpusloom.functions import text as tx
from corpusloom.session import materialize, ship

PARAGRAPH_CHARS = 80
BLOCK_LINES = 3
BLOCK_CHARS = 60


def clean_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, domain_id, text)``: the normalised text of each page once, empty ones left out."""
    rows = pages.filter("id IS NOT NULL AND text IS NOT NULL AND status = 'done'").dropDuplicates(["id"])
    return rows.select(F.col("id").alias("page_id"), "domain_id", tx.normalized(F.col("text")).alias("text")).filter("text <> ''")


def text_units(docs: DataFrame, paragraph_chars: int = PARAGRAPH_CHARS, block_lines: int = BLOCK_LINES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(page_id, domain_id, kind, unit, characters)``: the distinct paragraphs and line blocks of each document.

    Units are hashes; a document without units gives no row.
    """
    t = F.col("text")
    own = F.filter(F.split(t, "\\n\\s*\\n+", -1), lambda x: F.length(x) >= paragraph_chars)
    sliding = F.filter(tx.blocks(t, block_lines), lambda x: F.length(x) >= block_chars)
    units = F.array_distinct(F.concat(F.transform(own, lambda x: F.struct(F.lit("paragraph").alias("kind"), F.sha2(x, 256).alias("unit"), F.length(x).cast("long").alias("characters"))), F.transform(sliding, lambda x: F.struct(F.lit("block").alias("kind"), F.sha2(x, 256).alias("unit"), F.length(x).cast("long").alias("characters")))))
    return docs.select("page_id", "domain_id", F.explode(units).alias("u")).select("page_id", "domain_id", "u.*")


def candidates(units: DataFrame, docs: DataFrame, least: int = 5, most: int = 100, fraction: float = 0.001) -> DataFrame:
    """Units of a domain on at least greatest(least, least(most, ceil(fraction * documents))) of its documents."""
    sizes = docs.filter("domain_id IS NOT NULL").groupBy("domain_id").agg(F.count("*").alias("domain_documents"))
    threshold = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("domain_documents") * F.lit(fraction)))).cast("long")
    found = units.filter("domain_id IS NOT NULL").groupBy("domain_id", "kind", "unit").agg(F.max("characters").alias("characters"), F.count("*").alias("document_frequency"))
    return found.filter(F.col("document_frequency") >= least).join(sizes, "domain_id").withColumn("threshold", threshold).filter("document_frequency >= threshold")


def cross_domain(units: DataFrame, min_domains: int = 3, min_documents: int = 5) -> DataFrame:
    """Units on several domains; measured only, never removed.

    Partial counts per (unit, domain) come first, as a unit may stand on every page of the web.
    """
    per = units.filter("domain_id IS NOT NULL").groupBy("kind", "unit", "domain_id").agg(F.count("*").alias("n"), F.max("characters").alias("characters"))
    return per.groupBy("kind", "unit").agg(F.count("*").alias("domains"), F.sum("n").alias("documents"), F.max("characters").alias("characters")).filter((F.col("domains") >= min_domains) & (F.col("documents") >= min_documents))


def cover(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Union of spans; touching ones merge."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """Text without the union of ``spans``, and the number of characters it covered; not normalised again."""
    merged, out, at = cover(spans), [], 0
    for a, b in merged:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), sum(b - a for a, b in merged)


def _clean_one(text: str, found: set[str]) -> tuple[str, int]:
    import hashlib
    import re

    digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    spans, at = [], 0
    for part in re.split(r"(\n\s*\n+)", text):
        if len(part) >= PARAGRAPH_CHARS and "p" + digest(part) in found:
            spans.append((at, at + len(part)))
        at += len(part)
    rows, at = [], 0
    for line in text.split("\n"):
        if line:
            rows.append((at, at + len(line), line))
        at += len(line) + 1
    taken = list(spans)
    for i in range(len(rows) - BLOCK_LINES + 1):
        group = rows[i : i + BLOCK_LINES]
        a, b = group[0][0], group[-1][1]
        value = "\n".join(g[2] for g in group)
        if len(value) >= BLOCK_CHARS and "b" + digest(value) in found and not any(a < y and b > x for x, y in taken):
            spans.append((a, b))
    return cut(text, spans)


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(page_id, domain_id, text, characters_before, characters_after, removed)``: documents without the candidate units of their domain.

    Approved paragraphs go first, then blocks that do not overlap one; the rest is normalised again.
    Which units of a document are candidates is found by a join on (domain, unit) that is salted by
    document; the text is then cut in Arrow batches.
    """
    salts = 8
    keyed = found.select("domain_id", "unit", F.concat(F.substring("kind", 1, 1), "unit").alias("key"), "kind", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    units = text_units(docs).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    hits = units.join(keyed, ["domain_id", "kind", "unit", "salt"]).groupBy("page_id").agg(F.collect_set("key").alias("keys"))

    ship(docs.sparkSession)

    @F.pandas_udf("struct<text:string, removed:long>")
    def strip(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [_clean_one(t, set(k)) if k is not None and len(k) else (t, 0) for t, k in zip(text, keys)]
        return pd.DataFrame(rows, columns=["text", "removed"])

    cleaned = docs.join(hits, "page_id", "left").withColumn("c", strip("text", "keys"))
    after = F.when(F.col("c.removed") > 0, tx.normalized(F.col("c.text"))).otherwise(F.col("c.text"))
    rows = cleaned.select("page_id", "domain_id", after.alias("clean"), F.length("text").cast("long").alias("characters_before"), F.col("c.removed").alias("removed"))
    return rows.select("page_id", "domain_id", F.col("clean").alias("text"), "characters_before", F.length("clean").cast("long").alias("characters_after"), "removed")


def edge(lines: int, least: int = 3, fraction: float = 0.10) -> int:
    """Lines at either end of a document in which short residual lines are looked for."""
    size = max(least, math.ceil(fraction * lines))
    return min(size, max(1, (lines - 1) // 2)) if lines > 2 else size


def edge_lines(docs: DataFrame, least: int = 3, fraction: float = 0.10) -> DataFrame:
    """``(page_id, domain_id, line)``: the distinct canonical lines in the top and bottom edge of each document.

    Only lines of 3 to 79 characters and at most 12 words, two of them of letters only, are residual.
    """
    own = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size("own")
    size = F.greatest(F.lit(least), F.ceil(F.lit(fraction) * n)).cast("int")
    size = F.when(n > 2, F.least(size, F.greatest(F.lit(1), F.floor((n - 1) / 2).cast("int")))).otherwise(size)
    rows = docs.withColumn("own", own).withColumn("edge", size).withColumn("n", n)
    picked = F.filter("own", lambda x, i: (i < F.col("edge")) | (i >= F.col("n") - F.col("edge")))
    line = F.transform(picked, lambda x: F.regexp_replace(F.lower(x), "\\s+", " "))
    tokens = lambda x: F.split(x, " ")
    fit = F.filter(line, lambda x: F.length(x).between(3, 79) & (F.size(tokens(x)) <= 12) & (F.size(F.filter(tokens(x), lambda w: w.rlike("^\\p{L}+$"))) >= 2))
    return rows.select("page_id", "domain_id", F.explode(F.array_distinct(fit)).alias("line"))


def short_line_candidates(docs: DataFrame, min_documents: int = 20, fraction: float = 0.01) -> DataFrame:
    """Residual lines of a domain on at least greatest(min_documents, ceil(fraction * documents)) of its documents."""
    found = edge_lines(docs.filter("domain_id IS NOT NULL")).groupBy("domain_id", "line").agg(F.count("*").alias("document_frequency"), F.min("page_id").alias("representative"))
    sizes = docs.filter("domain_id IS NOT NULL").groupBy("domain_id").agg(F.count("*").alias("domain_documents"))
    threshold = F.greatest(F.lit(min_documents), F.ceil(F.col("domain_documents") * F.lit(fraction))).cast("long")
    return found.join(sizes, "domain_id").withColumn("threshold", threshold).filter("document_frequency >= threshold")


def interface_lines(docs: DataFrame, canon: DataFrame) -> DataFrame:
    """``(domain_id, line, rule, document_frequency)``: interface lines of encyclopaedia domains; one document is enough.

    ``canon`` has ``id`` and ``is_wiki``; lines of other domains are never looked at.
    """
    wiki = canon.filter("is_wiki").select(F.col("id").alias("domain_id"))
    own = docs.join(wiki, "domain_id", "left_semi").select("page_id", "domain_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), noise.canonical_line))).alias("line"))
    return own.withColumn("rule", noise.wiki_rule(F.col("line"))).filter("rule IS NOT NULL").groupBy("domain_id", "line", "rule").agg(F.count("*").alias("document_frequency"))


def short_pairs(docs: DataFrame, least: int = 3, fraction: float = 0.10) -> DataFrame:
    """``(page_id, domain_id, pair)``: the distinct pairs of physically adjacent lines in one edge of a document, of 6 to 159 characters."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("at"))), lambda s: s["x"] != "")
    n = F.size("own")
    size = F.greatest(F.lit(least), F.ceil(F.lit(fraction) * n)).cast("int")
    size = F.when(n > 2, F.least(size, F.greatest(F.lit(1), F.floor((n - 1) / 2).cast("int")))).otherwise(size)
    rows = docs.withColumn("own", lines).withColumn("edge", size).withColumn("n", n).filter("n >= 2")
    edge = lambda i: (i <= F.col("edge")) | (i > F.col("n") - F.col("edge"))
    picked = F.filter(F.sequence(F.lit(1), F.col("n") - 1), lambda i: edge(i) & edge(i + 1) & (F.element_at("own", i + 1)["at"] == F.element_at("own", i)["at"] + 1))
    pair = F.transform(picked, lambda i: noise.canonical_line(F.concat_ws("\n", F.element_at("own", i)["x"], F.element_at("own", i + 1)["x"])))
    return rows.select("page_id", "domain_id", F.explode(F.array_distinct(F.filter(pair, lambda p: F.length(p).between(6, 159)))).alias("pair"))


def short_pair_candidates(docs: DataFrame, min_documents: int = 20, fraction: float = 0.01) -> DataFrame:
    """Adjacent edge pairs of a domain on at least greatest(min_documents, ceil(fraction * documents)) of its documents."""
    known = docs.filter("domain_id IS NOT NULL")
    found = short_pairs(known).groupBy("domain_id", "pair").agg(F.count("*").alias("document_frequency"), F.min("page_id").alias("representative"))
    sizes = known.groupBy("domain_id").agg(F.count("*").alias("domain_documents"))
    threshold = F.greatest(F.lit(min_documents), F.ceil(F.col("domain_documents") * F.lit(fraction))).cast("long")
    return found.join(sizes, "domain_id").withColumn("threshold", threshold).filter("document_frequency >= threshold")


#: Kinds of residual units in the order in which they are cut.
RESIDUAL = ("mediawiki", "short_line", "short_pair")


def residual_units(docs: DataFrame, wiki: DataFrame) -> DataFrame:
    """``(page_id, domain_id, kind, unit, rule)``: the distinct residual units of documents of known domains.

    Interface lines are looked for in the domains of ``wiki`` (``domain_id``) only; short lines and pairs in the edges of all.
    """
    known, none = docs.filter("domain_id IS NOT NULL"), F.lit(None).cast("string")
    marked = known.join(wiki.select("domain_id").distinct(), "domain_id", "left_semi")
    lines = marked.select("page_id", "domain_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), noise.canonical_line))).alias("unit"))
    interface = lines.select("page_id", "domain_id", F.lit(RESIDUAL[0]).alias("kind"), "unit", noise.wiki_rule(F.col("unit")).alias("rule")).filter("rule IS NOT NULL")
    short = edge_lines(known).select("page_id", "domain_id", F.lit(RESIDUAL[1]).alias("kind"), F.col("line").alias("unit"), none.alias("rule"))
    pairs = short_pairs(known).select("page_id", "domain_id", F.lit(RESIDUAL[2]).alias("kind"), F.col("pair").alias("unit"), none.alias("rule"))
    return interface.unionByName(short).unionByName(pairs)


def residual_candidates(units: DataFrame, docs: DataFrame, min_documents: int = 20, fraction: float = 0.01) -> DataFrame:
    """Residual units by domain: interface lines always, the others on at least greatest(min_documents, ceil(fraction * documents)) documents."""
    sizes = docs.filter("domain_id IS NOT NULL").groupBy("domain_id").agg(F.count("*").alias("domain_documents"))
    found = units.groupBy("domain_id", "kind", "unit", "rule").agg(F.count("*").alias("document_frequency"), F.min("page_id").alias("representative"))
    frequent = F.greatest(F.lit(min_documents), F.ceil(F.col("domain_documents") * F.lit(fraction))).cast("long")
    threshold = F.when(F.col("kind") == RESIDUAL[0], F.lit(1).cast("long")).otherwise(frequent)
    return found.filter((F.col("kind") == RESIDUAL[0]) | (F.col("document_frequency") >= min_documents)).join(sizes, "domain_id").withColumn("threshold", threshold).filter("document_frequency >= threshold")


def approved_residuals(found: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates without the exceptions of a review.

    ``rejected`` holds ``(domain_id, kind, unit)`` of those judged not to be boilerplate: an interface line
    disables its rule everywhere, any other unit is left out in its domain only.
    """
    rules = found.filter(F.col("kind") == RESIDUAL[0]).join(rejected, ["domain_id", "kind", "unit"], "left_semi").select("rule").distinct()
    return found.join(rules, "rule", "left_anti").join(rejected, ["domain_id", "kind", "unit"], "left_anti")


def clean_residual(docs: DataFrame, approved: DataFrame, salts: int = 8) -> DataFrame:
    """``(page_id, domain_id, text, characters_before, <kind>_characters..., characters_after)``: documents without approved residual units.

    Kinds are cut in the order of RESIDUAL, and the characters of a kind are what it covers beyond the kinds before it.
    Interface lines are cut in the domains that still have an approved one, whatever the table of domains says.
    Which units of a document are approved is found by a join salted by document; lines are then cut by position.
    """
    wiki = approved.filter(F.col("kind") == RESIDUAL[0]).select("domain_id")
    keyed = approved.select("domain_id", "kind", "unit", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    units = residual_units(docs, wiki).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    hits = units.join(keyed, ["domain_id", "kind", "unit", "salt"]).groupBy("page_id").agg(F.collect_set(F.concat_ws(":", "kind", "unit")).alias("keys"))
    empty = F.array().cast("array<int>")
    has = lambda kind, unit: F.array_contains("keys", F.concat(F.lit(f"{kind}:"), unit))
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("at"), F.length(x).alias("n"))), lambda s: s["x"] != "")
    rows = docs.join(hits, "page_id", "left").withColumn("own", lines).withColumn("n", F.size("own")).withColumn("edge", _edge(F.size("own")))
    near = lambda i: (i < F.col("edge")) | (i >= F.col("n") - F.col("edge"))
    at = lambda found: F.when(F.col("keys").isNull(), empty).otherwise(F.transform(found, lambda s: s["at"]))
    rows = rows.withColumn("mediawiki_at", at(F.filter("own", lambda s: has(RESIDUAL[0], noise.canonical_line(s["x"])))))
    rows = rows.withColumn("short_line_at", at(F.filter("own", lambda s, i: near(i) & has(RESIDUAL[1], F.regexp_replace(F.lower(s["x"]), "\\s+", " ")))))
    after = lambda i: F.get("own", i + 1)
    pair = lambda s, i: has(RESIDUAL[2], noise.canonical_line(F.concat_ws("\n", s["x"], after(i)["x"])))
    rows = rows.withColumn("pair_at", at(F.filter("own", lambda s, i: (i + 1 < F.col("n")) & near(i) & near(i + 1) & (after(i)["at"] == s["at"] + 1) & pair(s, i))))
    rows = rows.withColumn("short_pair_at", F.array_union("pair_at", F.transform("pair_at", lambda i: i + 1)))
    covered = lambda name: F.aggregate(F.filter("own", lambda s: F.array_contains(name, s["at"])), F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    rows = rows.withColumn("short_line_at", F.array_except("short_line_at", "mediawiki_at")).withColumn("short_pair_at", F.array_except("short_pair_at", F.array_union("mediawiki_at", "short_line_at")))
    rows = rows.withColumn("cut", F.array_union(F.array_union("mediawiki_at", "short_line_at"), "short_pair_at"))
    # a cut line leaves its line break; the break inside a pair goes with it
    joined = F.transform("pair_at", lambda i: i + 1)
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.when(F.array_contains("cut", i), F.lit("")).otherwise(x).alias("x"), i.alias("at"))), lambda s: ~F.array_contains(joined, s["at"]))
    text = F.when(F.size("cut") > 0, tx.normalized(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))).otherwise(F.col("text"))
    out = rows.select(
        "page_id", "domain_id", text.alias("clean"), F.length("text").cast("long").alias("characters_before"), covered("mediawiki_at").alias("mediawiki_characters"),
        covered("short_line_at").alias("short_line_characters"), (covered("short_pair_at") + F.size("pair_at")).alias("short_pair_characters"), F.size("cut").cast("long").alias("removed_lines"),
    )
    # written here: a filter on the text would be pushed down and run all of this twice
    return materialize(out, "clean-two").withColumn("characters_after", F.length("clean").cast("long")).withColumnRenamed("clean", "text")


def _edge(n):
    """``edge`` as a column."""
    size = F.greatest(F.lit(3), F.ceil(F.lit(0.10) * n)).cast("int")
    return F.when(n > 2, F.least(size, F.greatest(F.lit(1), F.floor((n - 1) / 2).cast("int")))).otherwise(size)


def second_round(pages: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """Both cleaning rounds: ``clean_residual`` of what the first round leaves, with ``characters_raw`` before both.

    ``canon`` has ``id`` and ``is_wiki`` and says where interface lines are looked for; without it, nowhere.
    """
    first, final = round_views(pages, canon)
    return final.join(first.select("page_id", F.col("characters_before").alias("characters_raw")), "page_id")


def round_views(pages: DataFrame, canon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents after the first cleaning round, empty ones left out, and after the second."""
    docs = clean_pages(pages)
    first = materialize(clean(docs, candidates(text_units(docs), docs)).filter("text <> ''"), "clean-one")
    wiki = docs.select("domain_id").limit(0) if canon is None else canon.filter("is_wiki").select(F.col("id").alias("domain_id"))
    found = materialize(residual_candidates(residual_units(first, wiki), first), "residual")
    return first, clean_residual(first.select("page_id", "domain_id", "text"), found)


def two_rounds(pages: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """``(page_id, domain_id, characters_before, characters_clean, <kind>_characters..., characters_final, removed_lines)``: both cleaning rounds.

    The first round cuts candidate paragraphs and blocks; the second interface lines, short lines and pairs of short lines.
    """
    kinds = [f"{k}_characters" for k in RESIDUAL]
    return second_round(pages, canon).select("page_id", "domain_id", F.col("characters_raw").alias("characters_before"), F.col("characters_before").alias("characters_clean"), *kinds, F.col("characters_after").alias("characters_final"), "removed_lines")
