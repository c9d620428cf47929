"""Queries of the corpus reports, each with its SQL counterpart beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import noise
from corpusloom.functions import text as tx
from corpusloom.operators import boilerplate, content, dedup, domains, lexical, near, sampling
from corpusloom.plans import sql
from corpusloom.session import materialize, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(s, d):
    return table(s, d, "documents")


def _tok(s, d):
    return lexical.tokens(_docs(s, d))


def _features(s, d):
    return dedup.page_features(table(s, d, "pages"))


def _canon(s, d):
    return domains.canonical_domains(table(s, d, "domain"))


# --- inventory -------------------------------------------------------------------------------


@_query("status_distribution", "SELECT coalesce(status, '<null>') AS status, CAST(count(*) AS BIGINT) AS pages, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM page_inventory GROUP BY 1")
def _(s, d):
    per = table(s, d, "page_inventory").groupBy(F.coalesce("status", F.lit("<null>")).alias("status")).agg(F.count("*").alias("pages"))
    return domains.shares(per, "pages").withColumnRenamed("pages_share", "share")


@_query("explored_status", "SELECT lower(status) AS status, CAST(count(*) AS BIGINT) AS pages FROM page_inventory WHERE lower(status) IN ('done', 'failed', 'failed_timeout', 'blocked_domain', 'blocked_language') GROUP BY 1")
def _(s, d):
    explored = ("done", "failed", "failed_timeout", "blocked_domain", "blocked_language")
    return table(s, d, "page_inventory").groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("pages")).filter(F.col("status").isin(*explored))


@_query("inventory_histograms", """SELECT metric, value, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT unnest([{'metric': 'status_code', 'value': coalesce(CAST(status_code AS VARCHAR), '<null>')}, {'metric': 'recursion_level', 'value': coalesce(CAST(recursion_level AS VARCHAR), '<null>')},
  {'metric': 'retry_count', 'value': coalesce(CAST(retry_count AS VARCHAR), '<null>')}], recursive := true) FROM page_inventory) GROUP BY 1, 2""")
def _(s, d):
    label = lambda c: F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value"))
    return table(s, d, "page_inventory").select(F.explode(F.array(label("status_code"), label("recursion_level"), label("retry_count"))).alias("x")).select("x.*").groupBy("metric", "value").agg(F.count("*").alias("pages"))


@_query("level_yield", f"""WITH {sql.DOMAINS}, {sql.PAGES},
dl AS (SELECT recursion_level AS depth, count(*) AS domains, sum(request_count) AS requests FROM canon GROUP BY 1),
pl AS (SELECT recursion_level AS depth, count(*) AS pages, count(*) FILTER (WHERE status = 'done') AS done FROM page_inventory GROUP BY 1),
vl AS (SELECT recursion_level AS depth, count(*) AS valid, count(DISTINCT normalized_sha256) AS texts FROM feat GROUP BY 1)
SELECT CAST(depth AS BIGINT) AS depth, CAST(sum(domains) AS BIGINT) AS domains, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(done) AS BIGINT) AS done, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(texts) AS BIGINT) AS texts
FROM (SELECT depth, domains, coalesce(requests, 0) AS requests, 0 AS pages, 0 AS done, 0 AS valid, 0 AS texts FROM dl UNION ALL SELECT depth, 0, 0, pages, done, 0, 0 FROM pl UNION ALL SELECT depth, 0, 0, 0, 0, valid, texts FROM vl) GROUP BY depth""")
def _(s, d):
    zero, level = F.lit(0).cast("long"), F.col("recursion_level").cast("long").alias("depth")
    names = ("domains", "requests", "pages", "done", "valid", "texts")
    own = lambda df, **kw: df.select("depth", *[kw.get(n, zero).alias(n) for n in names])
    dl = _canon(s, d).groupBy(level).agg(F.count("*").alias("domains"), F.sum(F.coalesce("request_count", F.lit(0))).alias("requests"))
    pl = table(s, d, "page_inventory").groupBy(level).agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "done").alias("done"))
    vl = _features(s, d).groupBy(level).agg(F.count("*").alias("valid"), F.countDistinct("normalized_sha256").alias("texts"))
    rows = own(dl, domains=F.col("domains"), requests=F.col("requests")).unionByName(own(pl, pages=F.col("pages"), done=F.col("done"))).unionByName(own(vl, valid=F.col("valid"), texts=F.col("texts")))
    return rows.groupBy("depth").agg(*[F.sum(n).alias(n) for n in names])


@_query("funnel", f"""WITH {sql.PAGES} SELECT unnest(['rows', 'done', 'text', 'valid', 'raw_unique', 'text_unique']) AS step, unnest([(SELECT count(*) FROM pages), (SELECT count(*) FROM pages WHERE status = 'done'),
(SELECT count(*) FROM pages WHERE status = 'done' AND text IS NOT NULL), (SELECT count(*) FROM feat), (SELECT count(DISTINCT raw_sha256) FROM feat), (SELECT count(DISTINCT normalized_sha256) FROM feat)]) AS documents""")
def _(s, d):
    done = F.col("status") == "done"
    top = table(s, d, "pages").select("status", F.col("text").isNotNull().alias("has")).agg(F.count("*").alias("rows"), F.count_if(done).alias("done"), F.count_if(done & F.col("has")).alias("text"))
    low = _features(s, d).agg(F.count("*").alias("valid"), F.countDistinct("raw_sha256").alias("raw_unique"), F.countDistinct("normalized_sha256").alias("text_unique"))
    names = lambda df: df.selectExpr(f"stack({len(df.columns)}, " + ", ".join(f"'{c}', {c}" for c in df.columns) + ") AS (step, documents)")
    return names(top).unionByName(names(low))


# --- exact deduplication -----------------------------------------------------------------------

_FEATURES = "page_id, domain_id, CAST(recursion_level AS INTEGER) AS recursion_level, raw_sha256, normalized_sha256, md5_class, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(characters AS BIGINT) AS characters, CAST(lines AS BIGINT) AS lines, CAST(paragraphs AS BIGINT) AS paragraphs"
_GROUPS = "g AS (SELECT {h}, count(*) AS pages, count(DISTINCT domain_id) AS domains, min(page_id) AS representative FROM feat GROUP BY 1)"
_CLUSTERS = "SELECT '{stage}' AS stage, CAST(count(*) AS BIGINT) AS groups, CAST(count(*) FILTER (WHERE pages > 1) AS BIGINT) AS duplicate_groups, CAST(max(pages) AS BIGINT) AS largest, CAST(count(*) FILTER (WHERE pages > 1 AND domains > 1) AS BIGINT) AS cross_domain_groups FROM (SELECT {h}, count(*) AS pages, count(DISTINCT domain_id) AS domains FROM feat GROUP BY 1)"


@_query("page_features", f"WITH {sql.PAGES} SELECT {_FEATURES} FROM feat")
def _(s, d):
    return _features(s, d)


@_query("exact_dedup_groups", f"WITH {sql.PAGES}, {_GROUPS.format(h='raw_sha256')} SELECT raw_sha256, CAST(pages AS BIGINT) AS pages, CAST(domains AS BIGINT) AS domains, representative FROM g WHERE pages > 1")
def _(s, d):
    return dedup.groups(_features(s, d), "raw_sha256").filter("pages > 1")


@_query("normalized_dedup", f"WITH {sql.PAGES} SELECT page_id, domain_id, normalized_sha256, row_number() OVER (PARTITION BY normalized_sha256 ORDER BY page_id) = 1 AS is_representative FROM feat")
def _(s, d):
    return dedup.mark_representatives(materialize(_features(s, d).select("page_id", "domain_id", "normalized_sha256"), "features"), "normalized_sha256")


@_query("dedup_cluster_summary", f"WITH {sql.PAGES} {_CLUSTERS.format(stage='raw', h='raw_sha256')} UNION ALL {_CLUSTERS.format(stage='normalized', h='normalized_sha256')}")
def _(s, d):
    f = materialize(_features(s, d).select("page_id", "domain_id", "raw_sha256", "normalized_sha256"), "features")
    return dedup.cluster_summary(dedup.groups(f, "raw_sha256"), "raw").unionByName(dedup.cluster_summary(dedup.groups(f, "normalized_sha256"), "normalized"))


@_query("group_size_distribution", f"WITH {sql.PAGES} SELECT 'normalized' AS stage, CAST(pages AS BIGINT) AS group_size, CAST(count(*) AS BIGINT) AS group_count FROM (SELECT count(*) AS pages FROM feat GROUP BY normalized_sha256) GROUP BY 1, 2")
def _(s, d):
    return dedup.group_sizes(dedup.groups(_features(s, d), "normalized_sha256"), "normalized")


@_query("md5_diagnosis", f"WITH {sql.PAGES} SELECT md5_class, CAST(count(*) AS BIGINT) AS pages FROM feat GROUP BY 1")
def _(s, d):
    return _features(s, d).groupBy("md5_class").agg(F.count("*").alias("pages"))


@_query("same_as_audit", f"""WITH {sql.PAGES}, dec AS (SELECT DISTINCT id, same_as FROM pages WHERE id IS NOT NULL AND same_as IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS declared, CAST(count(t.id) AS BIGINT) AS target_present, CAST(count(*) - count(t.id) AS BIGINT) AS target_missing, CAST(count(*) FILTER (WHERE a.page_id IS NOT NULL AND b.page_id IS NOT NULL) AS BIGINT) AS both_valid,
CAST(count(*) FILTER (WHERE a.raw_sha256 = b.raw_sha256) AS BIGINT) AS d1_agreement, CAST(count(*) FILTER (WHERE a.normalized_sha256 = b.normalized_sha256) AS BIGINT) AS d2_agreement
FROM dec LEFT JOIN (SELECT DISTINCT id FROM pages WHERE id IS NOT NULL) t ON t.id = dec.same_as LEFT JOIN feat a ON a.page_id = dec.id LEFT JOIN feat b ON b.page_id = dec.same_as""")
def _(s, d):
    return dedup.same_as_audit(table(s, d, "pages"), _features(s, d))


# --- boilerplate -----------------------------------------------------------------------------


def _page_docs(s, d):
    return boilerplate.clean_pages(table(s, d, "pages"))


@_query("text_units", f"WITH {sql.PAGES}, {sql.UNITS} SELECT kind, CAST(count(*) AS BIGINT) AS units, CAST(count(DISTINCT unit) AS BIGINT) AS distinct_units, CAST(sum(characters) AS BIGINT) AS characters FROM units GROUP BY kind")
def _(s, d):
    return boilerplate.text_units(_page_docs(s, d)).groupBy("kind").agg(F.count("*").alias("units"), F.countDistinct("unit").alias("distinct_units"), F.sum("characters").alias("characters"))


_CANDIDATES = """sizes AS (SELECT domain_id, count(*) AS n FROM page_docs WHERE domain_id IS NOT NULL GROUP BY 1),
cand AS (SELECT u.domain_id, kind, unit, max(characters) AS characters, count(*) AS df, n, greatest(5, least(100, ceil(0.001 * n))) AS threshold FROM units u JOIN sizes s ON u.domain_id = s.domain_id GROUP BY u.domain_id, kind, unit, n HAVING count(*) >= greatest(5, least(100, ceil(0.001 * n))))"""


@_query("boilerplate_candidates", f"WITH {sql.PAGES}, {sql.UNITS}, {_CANDIDATES} SELECT domain_id, kind, unit, CAST(characters AS BIGINT) AS characters, CAST(df AS BIGINT) AS document_frequency, CAST(n AS BIGINT) AS domain_documents, CAST(threshold AS BIGINT) AS threshold FROM cand")
def _(s, d):
    docs = _page_docs(s, d)
    return boilerplate.candidates(boilerplate.text_units(docs), docs)


@_query("cross_domain_units", f"""WITH {sql.PAGES}, {sql.UNITS} SELECT kind, unit, CAST(count(DISTINCT domain_id) AS BIGINT) AS domains, CAST(count(*) AS BIGINT) AS documents, CAST(max(characters) AS BIGINT) AS characters
FROM units WHERE domain_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT domain_id) >= 3 AND count(*) >= 5""")
def _(s, d):
    return boilerplate.cross_domain(boilerplate.text_units(_page_docs(s, d)))


@_query("clean_documents")
def _(s, d):
    docs = _page_docs(s, d)
    return boilerplate.clean(docs, boilerplate.candidates(boilerplate.text_units(docs), docs)).drop("text")


@_query("clean_dedup")
def _(s, d):
    docs = _page_docs(s, d)
    rows = boilerplate.clean(docs, boilerplate.candidates(boilerplate.text_units(docs), docs)).filter("text <> ''")
    return dedup.mark_representatives(materialize(rows.select("page_id", "domain_id", F.sha2("text", 256).alias("clean_sha256")), "clean"), "clean_sha256")


@_query("short_line_candidates", rf"""WITH {sql.PAGES}, own AS (SELECT page_id, domain_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM page_docs WHERE domain_id IS NOT NULL),
e AS (SELECT *, CASE WHEN len(ls) > 2 THEN least(greatest(3, ceil(0.1 * len(ls))), greatest(1, (len(ls) - 1) // 2)) ELSE greatest(3, ceil(0.1 * len(ls))) END AS edge FROM own),
l AS (SELECT DISTINCT page_id, domain_id, regexp_replace(lower(ls[i]), '\s+', ' ', 'g') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM e) WHERE i <= edge OR i > len(ls) - edge),
f AS (SELECT * FROM l WHERE length(line) BETWEEN 3 AND 79 AND len(string_split(line, ' ')) <= 12 AND len(list_filter(string_split(line, ' '), lambda w: regexp_full_match(w, '\p{{L}}+'))) >= 2),
n AS (SELECT domain_id, count(*) AS n FROM own GROUP BY 1)
SELECT f.domain_id, line, CAST(count(*) AS BIGINT) AS document_frequency, min(page_id) AS representative, CAST(n AS BIGINT) AS domain_documents, CAST(greatest(20, ceil(0.01 * n)) AS BIGINT) AS threshold FROM f JOIN n ON f.domain_id = n.domain_id GROUP BY f.domain_id, line, n HAVING count(*) >= greatest(20, ceil(0.01 * n))""")
def _(s, d):
    return boilerplate.short_line_candidates(_page_docs(s, d))


@_query("short_pair_candidates", rf"""WITH {sql.PAGES}, own AS (SELECT page_id, domain_id, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'x': trim(x), 'at': i}}), lambda s: s.x <> '') AS ls FROM page_docs WHERE domain_id IS NOT NULL),
e AS (SELECT *, CASE WHEN len(ls) > 2 THEN least(greatest(3, ceil(0.1 * len(ls))), greatest(1, (len(ls) - 1) // 2)) ELSE greatest(3, ceil(0.1 * len(ls))) END AS edge FROM own),
l AS (SELECT DISTINCT page_id, domain_id, trim(regexp_replace(lower(ls[i].x || chr(10) || ls[i + 1].x), '\s+', ' ', 'g')) AS pair FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM e)
  WHERE ls[i + 1].at = ls[i].at + 1 AND (i <= edge OR i > len(ls) - edge) AND (i + 1 <= edge OR i + 1 > len(ls) - edge)),
n AS (SELECT domain_id, count(*) AS n FROM own GROUP BY 1)
SELECT l.domain_id, pair, CAST(count(*) AS BIGINT) AS document_frequency, min(page_id) AS representative, CAST(n AS BIGINT) AS domain_documents, CAST(greatest(20, ceil(0.01 * n)) AS BIGINT) AS threshold FROM l JOIN n ON l.domain_id = n.domain_id
WHERE length(pair) BETWEEN 6 AND 159 GROUP BY l.domain_id, pair, n HAVING count(*) >= greatest(20, ceil(0.01 * n))""")
def _(s, d):
    return boilerplate.short_pair_candidates(_page_docs(s, d))


_RULES = "CASE WHEN line IN (" + ", ".join(f"'{x}'" for x in noise.WIKI_LINES) + ") THEN 'literal:' || line " + " ".join(f"WHEN regexp_full_match(line, '(?i:{p})') THEN 'pattern:{i}'" for i, p in enumerate(noise.WIKI_PATTERNS)) + " END"
_WIKI = r"regexp_matches(host, '(^|\.)(" + "|".join(h.replace(".", r"\.") for h in tx.WIKI_HOSTS) + ")$')"


@_query("interface_lines", rf"""WITH {sql.PAGES}, {sql.DOMAINS}, l AS (SELECT DISTINCT page_id, domain_id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS line FROM (SELECT page_id, domain_id, unnest(string_split(text, chr(10))) AS x FROM page_docs) WHERE domain_id IN (SELECT id FROM canon WHERE {_WIKI})),
r AS (SELECT *, {_RULES} AS rule FROM l) SELECT domain_id, line, rule, CAST(count(*) AS BIGINT) AS document_frequency FROM r WHERE rule IS NOT NULL GROUP BY 1, 2, 3""")
def _(s, d):
    return boilerplate.interface_lines(_page_docs(s, d), _canon(s, d))


@_query("clean_two_rounds")
def _(s, d):
    return boilerplate.two_rounds(table(s, d, "pages"), _canon(s, d))


@_query("d4_dedup")
def _(s, d):
    final = boilerplate.second_round(table(s, d, "pages"), _canon(s, d)).filter("text <> ''")
    return dedup.mark_representatives(materialize(final.select("page_id", "domain_id", F.sha2("text", 256).alias("final_sha256")), "final"), "final_sha256")


@_query("top_terms_by_view")
def _(s, d):
    first, final = boilerplate.round_views(table(s, d, "pages"), _canon(s, d))
    top = lambda docs, view: lexical.top_terms(lexical.tokens(docs, "page_id"), noise=noise.is_noise).withColumn("view", F.lit(view))
    return top(first, "v1").unionByName(top(final, "v2"))


@_query("cleaning_rounds")
def _(s, d):
    rows = materialize(boilerplate.second_round(table(s, d, "pages"), _canon(s, d)), "rounds")
    kinds = [F.sum(f"{k}_characters").alias(f"{k}_characters") for k in boilerplate.RESIDUAL]
    v1 = rows.agg(F.lit("v1").alias("view"), F.count("*").alias("documents"), F.sum("characters_raw").alias("before"), F.sum("characters_before").alias("after"), *[F.lit(0).cast("long").alias(f"{k}_characters") for k in boilerplate.RESIDUAL], F.count_if(F.col("characters_before") == 0).alias("emptied"))
    v2 = rows.agg(F.lit("v2").alias("view"), F.count("*").alias("documents"), F.sum("characters_before").alias("before"), F.sum("characters_after").alias("after"), *kinds, F.count_if(F.col("text") == "").alias("emptied"))
    return v1.unionByName(v2)


# --- vocabulary and n-grams -------------------------------------------------------------------------

_STOP = sql.stop_list(lexical.STOPWORDS)
_VOCAB = f"WITH {sql.VOCABULARY}, vocab AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, term IN {_STOP} AS is_stop FROM occ GROUP BY term)"


def _vocab(s, d):
    return lexical.vocabulary(_tok(s, d))


@_query("vocabulary", f"{_VOCAB} SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, is_stop FROM vocab")
def _(s, d):
    return _vocab(s, d)


@_query("vocabulary_summary", f"{_VOCAB} SELECT CAST(count(*) AS BIGINT) AS types, CAST(count(*) FILTER (WHERE tf = 1) AS BIGINT) AS hapax, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(sum(df) AS BIGINT) AS document_occurrences, CAST(count(*) FILTER (WHERE is_stop) AS BIGINT) AS stop_types, CAST(sum(tf) FILTER (WHERE is_stop) AS BIGINT) AS stop_occurrences FROM vocab")
def _(s, d):
    return lexical.vocabulary_summary(_vocab(s, d))


@_query("freq_of_freq", f"{_VOCAB} SELECT CAST(tf AS BIGINT) AS tf, CAST(count(*) AS BIGINT) AS types FROM vocab GROUP BY tf")
def _(s, d):
    return lexical.frequency_of_frequencies(_vocab(s, d))


@_query("top_terms", f"WITH {sql.VOCABULARY} SELECT term, CAST(count(*) AS BIGINT) AS tf FROM occ GROUP BY term ORDER BY tf DESC, term LIMIT 100")
def _(s, d):
    return lexical.top_terms(_tok(s, d))


_NOISE = sql.stop_list(tuple(sorted({*noise.WIKI_LINES, *noise.NOISE_WORDS, *noise.NOISE_PHRASES})))


@_query("top_terms_without_noise", f"WITH {sql.PAGES}, occ AS (SELECT unnest({sql.words('text')}) AS term FROM page_docs) SELECT term, CAST(count(*) AS BIGINT) AS tf FROM occ WHERE term NOT IN {_NOISE} GROUP BY term ORDER BY tf DESC, term LIMIT 100")
def _(s, d):
    return lexical.top_terms(lexical.tokens(_page_docs(s, d), "page_id"), noise=noise.is_noise)


_PAIRS_OF_PAGES = sql.ngrams(2).replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT page_id AS doc_id, text FROM page_docs)")


@_query("top_bigrams", f"WITH {sql.PAGES}, {_PAIRS_OF_PAGES} SELECT item, tf, df FROM counts2 ORDER BY tf DESC, item LIMIT 100")
def _(s, d):
    return lexical.top_ngrams(lexical.ngram_counts(lexical.sequences(_page_docs(s, d), "page_id"), 2))


@_query("top_bigrams_without_noise", f"WITH {sql.PAGES}, {_PAIRS_OF_PAGES} SELECT item, tf, df FROM counts2 WHERE item NOT IN {_NOISE} ORDER BY tf DESC, item LIMIT 100")
def _(s, d):
    return lexical.top_ngrams(lexical.ngram_counts(lexical.sequences(_page_docs(s, d), "page_id"), 2), noise=noise.is_noise)


@_query("approximate_top_terms")
def _(s, d):
    return lexical.approximate_top_terms(_tok(s, d))


@_query("zipf_bins", f"{_VOCAB}, r AS (SELECT tf, row_number() OVER (ORDER BY tf DESC, term) AS rank FROM vocab) SELECT CAST(floor(100 * log10(rank)) AS BIGINT) AS bin, round(avg(rank), 6) AS rank, round(avg(tf), 6) AS frequency FROM r GROUP BY 1")
def _(s, d):
    return lexical.zipf_bins(_vocab(s, d))


@_query("coverage_topk", f"""{_VOCAB}, r AS (SELECT row_number() OVER (ORDER BY tf DESC, term) AS rank, sum(tf) OVER (ORDER BY tf DESC, term) AS running, sum(tf) OVER () AS total, count(*) OVER () AS types FROM vocab)
SELECT CAST(rank AS BIGINT) AS rank, CAST(running AS BIGINT) AS running, CAST(total AS BIGINT) AS total, round(running / total, 9) AS share FROM r WHERE rank IN (10, 100, 1000, 10000, 50000) OR rank = types""")
def _(s, d):
    return lexical.coverage(_vocab(s, d))


@_query("vocabulary_growth", f"""WITH {sql.TOKENS}, p AS (SELECT *, CAST(floor(CAST('0x' || substr(sha256('{lexical.SEED}:' || doc_id), 1, 6) AS BIGINT) * 100 / 16777216) AS INTEGER) AS part FROM tok),
f AS (SELECT part, count(*) AS m FROM (SELECT term, min(part) AS part FROM (SELECT part, unnest(w) AS term FROM p) GROUP BY term) GROUP BY part), n AS (SELECT part, count(*) AS n FROM p GROUP BY part)
SELECT n.part, CAST(sum(n) OVER (ORDER BY n.part) AS BIGINT) AS documents, CAST(sum(coalesce(m, 0)) OVER (ORDER BY n.part) AS BIGINT) AS types FROM n LEFT JOIN f ON n.part = f.part""")
def _(s, d):
    return lexical.vocabulary_growth(_tok(s, d))


def _counts(s, d, n):
    return lexical.ngram_counts(lexical.sequences(_docs(s, d)), n)


@_query("bigrams", f"WITH {sql.ngrams(2)} SELECT * FROM counts2 WHERE df >= 2")
def _(s, d):
    return _counts(s, d, 2).filter("df >= 2")


@_query("trigrams", f"WITH {sql.ngrams(3)} SELECT * FROM counts3 WHERE df >= 2")
def _(s, d):
    return _counts(s, d, 3).filter("df >= 2")


_MARGINALS = "l AS (SELECT split_part(item, ' ', 1) AS term, sum(tf) AS n FROM counts2 GROUP BY 1), r AS (SELECT split_part(item, ' ', 2) AS term, sum(tf) AS n FROM counts2 GROUP BY 1)"


@_query("bigram_marginals", f"WITH {sql.ngrams(2)}, {_MARGINALS} SELECT coalesce(l.term, r.term) AS term, CAST(coalesce(l.n, 0) AS BIGINT) AS left_count, CAST(coalesce(r.n, 0) AS BIGINT) AS right_count FROM l FULL JOIN r ON l.term = r.term")
def _(s, d):
    return lexical.marginals(_counts(s, d, 2))


@_query("npmi_collocations", f"""WITH {sql.ngrams(2)}, {_MARGINALS}, t AS (SELECT sum(tf) AS n FROM counts2),
x AS (SELECT item, tf, df, ln(tf * t.n / (CAST(l.n AS DOUBLE) * r.n)) AS pmi, t.n AS total FROM counts2, t JOIN l ON l.term = split_part(item, ' ', 1) JOIN r ON r.term = split_part(item, ' ', 2) WHERE tf >= 20 AND df >= 5 AND l.term NOT IN {_STOP} AND r.term NOT IN {_STOP})
SELECT item, tf, df, round(pmi, 9) AS pmi, round(pmi / -ln(tf / total), 9) AS npmi FROM x ORDER BY npmi DESC, tf DESC, item LIMIT 100""")
def _(s, d):
    return lexical.npmi(materialize(_counts(s, d, 2), "bigrams"))


@_query("frequent_trigrams", f"WITH {sql.ngrams(3)} SELECT * FROM counts3 WHERE tf >= 20 AND df >= 5 AND split_part(item, ' ', 1) NOT IN {_STOP} AND split_part(item, ' ', 3) NOT IN {_STOP} ORDER BY tf DESC, item LIMIT 100")
def _(s, d):
    return lexical.frequent_trigrams(_counts(s, d, 3))


# --- document profiles --------------------------------------------------------------------------------


def _profile(s, d):
    return content.profile(_docs(s, d))


_Q = ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS p{round(q * 100)}" for q in content.QUANTILES)


@_query("view_summary", f"""WITH {sql.TOKENS}, x AS (SELECT n_chars, len(w) AS words FROM documents JOIN tok USING (doc_id))
SELECT 'n_chars' AS metric, CAST(count(n_chars) AS BIGINT) AS documents, round(avg(n_chars), 6) AS mean, {_Q.format(c='n_chars')} FROM x UNION ALL SELECT 'words', count(words), round(avg(words), 6), {_Q.format(c='words')} FROM x""")
def _(s, d):
    rows = _docs(s, d).filter("text IS NOT NULL").select("n_chars", F.size(tx.words(F.col("text"))).alias("words"))
    return content.quantiles(rows, "n_chars", "words")


@_query("char_histogram", """SELECT CAST(bin AS BIGINT) AS bin, round(2 + bin * 99.97, 6) AS "left", round(2 + (bin + 1) * 99.97, 6) AS "right", CAST(count(*) AS BIGINT) AS documents
FROM (SELECT CASE WHEN n_chars < 2 THEN -1 WHEN n_chars > 9999 THEN 100 WHEN n_chars = 9999 THEN 99 ELSE floor((n_chars - 2) / 99.97::DOUBLE) END AS bin FROM documents WHERE n_chars IS NOT NULL) GROUP BY bin""")
def _(s, d):
    return content.fixed_histogram(_docs(s, d), "n_chars")


@_query("content_profile")
def _(s, d):
    return _profile(s, d)


@_query("ttr_by_size", f"""WITH {sql.TOKENS}, x AS (SELECT len(w) AS words, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) ELSE 0 END AS ttr FROM tok)
SELECT CASE WHEN words < 100 THEN '0-99' WHEN words < 500 THEN '100-499' WHEN words < 2000 THEN '500-1999' ELSE '2000+' END AS size, CAST(count(*) AS BIGINT) AS documents, round(avg(ttr), 6) AS mean_ttr, round(quantile_cont(ttr, 0.5), 6) AS median_ttr FROM x GROUP BY 1""")
def _(s, d):
    w = tx.words(F.col("text"))
    rows = _docs(s, d).filter("text IS NOT NULL").select(F.size(w).alias("words"), F.when(F.size(w) > 0, F.round(F.size(F.array_distinct(w)) / F.size(w), 6)).otherwise(0.0).alias("ttr"))
    return content.ttr_by_size(rows)


@_query("text_signals")
def _(s, d):
    return content.signal_prevalence(_profile(s, d))


_STRUCTURE = rf"""WITH base AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.!?…]+\s|[.!?…]+$|\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS s,
list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
each AS (SELECT 'sentences_per_document' AS metric, len(s) AS value FROM base UNION ALL SELECT 'paragraphs_per_document', len(p) FROM base
UNION ALL SELECT 'words_per_sentence', len({sql.words('x')}) FROM (SELECT unnest(s) AS x FROM base) UNION ALL SELECT 'characters_per_sentence', length(x) FROM (SELECT unnest(s) AS x FROM base)
UNION ALL SELECT 'words_per_paragraph', len({sql.words('x')}) FROM (SELECT unnest(p) AS x FROM base) UNION ALL SELECT 'characters_per_paragraph', length(x) FROM (SELECT unnest(p) AS x FROM base)),
h AS (SELECT metric, CAST(value AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS "count" FROM each GROUP BY 1, 2)"""
_UNIT = r"regexp_replace(lower(x), '\s+', ' ', 'g')"
_WORDS_OF = "coalesce(list_sum(list_transform({a}, lambda x: len(" + sql.words("x").replace("{", "{{").replace("}", "}}") + "))), 0)"
_REPEATED = rf"""{_STRUCTURE.split(",\neach AS")[0]}, {sql.TOKENS},
x AS (SELECT len(w) AS words, len(list_distinct(w)) AS forms, list_filter(list_transform(s, lambda x: {_UNIT}), lambda x: len({sql.words('x')}) >= 3) AS ls, list_filter(list_transform(p, lambda x: {_UNIT}), lambda x: length(x) >= 20) AS lp FROM base JOIN tok USING (doc_id) WHERE len(w) > 0),
y AS (SELECT words, forms, {_WORDS_OF.format(a='ls')} - {_WORDS_OF.format(a='list_distinct(ls)')} AS rs, {_WORDS_OF.format(a='lp')} - {_WORDS_OF.format(a='list_distinct(lp)')} AS rp FROM x),
z AS (SELECT 'ttr' AS metric, forms / words AS v FROM y UNION ALL SELECT 'repeated_sentence_fraction', rs / words FROM y UNION ALL SELECT 'repeated_paragraph_fraction', rp / words FROM y)
SELECT metric, round(round(v, 6), 4) AS value, CAST(count(*) AS BIGINT) AS documents FROM z GROUP BY 1, 2"""


@_query("repetition_distribution", _REPEATED)
def _(s, d):
    return content.rounded_distribution(_profile(s, d))


@_query("mattr", f"""WITH {sql.TOKENS}, x AS (SELECT doc_id, w, unnest(range(1, len(w) - 98)) AS i FROM tok WHERE len(w) >= 100)
SELECT doc_id, round(sum(len(list_distinct(w[i:i + 99]))) / 100 / count(*), 6) AS mattr FROM x GROUP BY doc_id""")
def _(s, d):
    return _tok(s, d).filter(F.size("words") >= content.WINDOW).select("doc_id", F.round(content.mattr(F.col("words")), 6).alias("mattr"))


@_query("structure_histogram", f"{_STRUCTURE} SELECT * FROM h")
def _(s, d):
    return content.structure_histogram(_docs(s, d))


@_query("weighted_quantiles", f"""{_STRUCTURE}, b AS (SELECT *, sum("count") OVER (PARTITION BY metric ORDER BY value) AS c, sum("count") OVER (PARTITION BY metric) AS t FROM h)
SELECT metric, CAST(max(t) AS BIGINT) AS units, round(sum(value * "count") / max(t), 6) AS mean, {', '.join(f"CAST(min(value) FILTER (WHERE c >= t * {q}) AS BIGINT) AS p{round(q * 100)}" for q in content.QUANTILES)} FROM b GROUP BY metric""")
def _(s, d):
    return content.weighted_quantiles(content.structure_histogram(_docs(s, d)))


_LINES = "lens AS (SELECT 'words_per_line' AS metric, len(regexp_extract_all(lower(x), '\\p{L}+')) AS value FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) WHERE x <> '')"


@_query("line_quantiles", f"""WITH {_LINES}, h AS (SELECT metric, value, count(*) AS n FROM lens GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY value) AS c, sum(n) OVER (PARTITION BY metric) AS t FROM h)
SELECT metric, CAST(max(t) AS BIGINT) AS units, round(sum(value * n) / max(t), 6) AS mean, {', '.join(f"CAST(min(value) FILTER (WHERE c >= t * {q}) AS BIGINT) AS p{round(q * 100)}" for q in content.QUANTILES)} FROM b GROUP BY metric""")
def _(s, d):
    rows = _docs(s, d).filter("text IS NOT NULL").select(F.explode(tx.lines(F.col("text"))).alias("x")).select(F.lit("words_per_line").alias("metric"), F.size(tx.words(F.col("x"))).cast("long").alias("value"))
    return content.weighted_quantiles(rows.groupBy("metric", "value").agg(F.count("*").alias("count")))


# --- domains ------------------------------------------------------------------------------------------


@_query("host_inventory", f"WITH {sql.DOMAINS} SELECT id, host, parent_domain_id, CAST(recursion_level AS INTEGER) AS recursion_level, request_count FROM canon")
def _(s, d):
    return _canon(s, d).select("id", "host", "parent_domain_id", "recursion_level", "request_count")


@_query("domain_errors", f"""WITH {sql.DOMAINS} SELECT unnest(['missing_host', 'missing_level', 'invalid_level', 'missing_requests', 'without_parent', 'missing_parent']) AS error, unnest([count(*) FILTER (WHERE host IS NULL), count(*) FILTER (WHERE recursion_level IS NULL),
count(*) FILTER (WHERE recursion_level < 0), count(*) FILTER (WHERE request_count IS NULL), count(*) FILTER (WHERE parent_domain_id IS NULL), count(*) FILTER (WHERE parent_domain_id IS NOT NULL AND parent_domain_id NOT IN (SELECT id FROM canon))]) AS domains FROM canon""")
def _(s, d):
    return domains.error_counts(_canon(s, d))


@_query("domain_levels", f"""WITH {sql.DOMAINS}, t AS (SELECT count(*) AS n, sum(request_count) AS r FROM canon) SELECT coalesce(CAST(recursion_level AS VARCHAR), 'missing') AS level, CAST(count(*) AS BIGINT) AS domains, round(100.0 * count(*) / n, 6) AS domain_percentage,
CAST(coalesce(sum(request_count), 0) AS BIGINT) AS requests, round(100.0 * coalesce(sum(request_count), 0) / nullif(r, 0), 6) AS request_percentage, round(avg(request_count), 6) AS mean_requests FROM canon, t GROUP BY recursion_level, n, r""")
def _(s, d):
    return domains.levels(_canon(s, d))


_CHILDREN = f"WITH {sql.DOMAINS}, ch AS (SELECT p.id AS parent_id, p.host, CAST(count(*) AS BIGINT) AS children, round(avg(c.request_count), 6) AS mean_requests, CAST(count(*) FILTER (WHERE c.request_count IS NULL) AS BIGINT) AS missing_requests FROM canon c JOIN canon p ON c.parent_domain_id = p.id GROUP BY p.id, p.host)"


@_query("domain_children", f"{_CHILDREN} SELECT * FROM ch ORDER BY children DESC, host ASC NULLS LAST, parent_id LIMIT 15")
def _(s, d):
    return domains.children(_canon(s, d))


@_query("domain_children_all", f"{_CHILDREN} SELECT * FROM ch")
def _(s, d):
    return domains.children(_canon(s, d), None)


@_query("domain_children_reconciliation", f"""WITH {sql.DOMAINS} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE c.parent_domain_id IS NULL) AS BIGINT) AS without_parent, CAST(count(*) FILTER (WHERE c.parent_domain_id IS NOT NULL AND p.id IS NULL) AS BIGINT) AS missing_parent,
CAST(count(p.id) AS BIGINT) AS linked, (SELECT sum(children) FROM (SELECT count(*) AS children FROM canon c JOIN canon p ON c.parent_domain_id = p.id GROUP BY p.id)) = count(p.id) AS reconciled FROM canon c LEFT JOIN canon p ON c.parent_domain_id = p.id""")
def _(s, d):
    return domains.children_reconciliation(_canon(s, d))


@_query("domain_closure", f"""WITH RECURSIVE {sql.DOMAINS}, up AS (SELECT id FROM canon WHERE id IN (SELECT domain_id FROM page_inventory WHERE status = 'failed')
UNION SELECT c.parent_domain_id FROM up JOIN canon c ON c.id = up.id WHERE c.parent_domain_id IN (SELECT id FROM canon)) SELECT id FROM up""")
def _(s, d):
    wanted = table(s, d, "page_inventory").filter("status = 'failed' AND domain_id IS NOT NULL").select(F.col("domain_id").alias("id"))
    return domains.ancestors(materialize(_canon(s, d), "canon"), wanted)


@_query("domain_references", "SELECT CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT domain_id) AS BIGINT) AS domains FROM page_inventory WHERE domain_id IS NOT NULL AND domain_id NOT IN (SELECT id FROM domain WHERE id IS NOT NULL)")
def _(s, d):
    known = table(s, d, "domain").select(F.col("id").alias("domain_id"))
    return table(s, d, "page_inventory").filter("domain_id IS NOT NULL").join(known, "domain_id", "left_anti").agg(F.count("*").alias("pages"), F.countDistinct("domain_id").alias("domains"))


_WORDS_PER_SITE = f"""WITH {sql.PAGES}, x AS (SELECT DISTINCT domain_id, sha256(text) AS h, len({sql.words('text')}) AS words FROM page_docs WHERE domain_id IS NOT NULL), y AS (SELECT *, count(*) OVER (PARTITION BY h) AS k FROM x),
site AS (SELECT domain_id, sum(words / k) AS words FROM y GROUP BY 1)"""


def _site_words(s, d):
    docs = boilerplate.clean_pages(table(s, d, "pages")).filter("domain_id IS NOT NULL")
    rows = materialize(docs.select(F.sha2("text", 256).alias("hash"), "domain_id", F.size(tx.words(F.col("text"))).alias("words")).distinct(), "site-words")
    return domains.fractional_words(rows.groupBy("hash").agg(F.max("words").alias("words")), rows.select("hash", "domain_id"))


@_query("fractional_words", f"{_WORDS_PER_SITE} SELECT domain_id, round(words, 6) AS words FROM site")
def _(s, d):
    return _site_words(s, d).withColumn("words", F.round("words", 6))


@_query("domain_concentration", f"""{_WORDS_PER_SITE}, v AS (SELECT words AS v, row_number() OVER (ORDER BY words DESC, domain_id) AS r, row_number() OVER (ORDER BY words) AS a, sum(words) OVER () AS t, count(*) OVER () AS n FROM site WHERE words > 0)
SELECT 'top_' || k AS metric, round(sum(v), 4) AS value, round(sum(v) / max(t), 6) AS share FROM v, (SELECT unnest([1, 10, 100, 1000]) AS k) WHERE r <= k GROUP BY k UNION ALL SELECT 'gini', round(2 * sum(a * v) / (max(n) * max(t)) - (max(n) + 1) / max(n), 6), NULL FROM v""")
def _(s, d):
    return domains.concentration(materialize(_site_words(s, d), "sites"), "domain_id", "words")


@_query("supplier_lorenz", """WITH v AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY l_suppkey), g AS (SELECT v, count(*) AS m FROM v WHERE v > 0 GROUP BY v)
SELECT CAST(sum(m) OVER w AS BIGINT) AS keys, round(sum(m) OVER w / sum(m) OVER (), 9) AS share_keys, round(sum(v * m) OVER w / sum(v * m) OVER (), 9) AS share_value FROM g WINDOW w AS (ORDER BY v)""")
def _(s, d):
    return domains.lorenz(table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("v")), "v")


_METRICS = f"""WITH {sql.DOMAINS}, v AS (SELECT domain_id, count(DISTINCT id) AS n FROM pages WHERE text IS NOT NULL AND status = 'done' GROUP BY 1), m AS (SELECT id, host, coalesce(request_count, 0) AS requests, coalesce(v.n, 0) AS documents FROM canon LEFT JOIN v ON canon.id = v.domain_id)"""


def _metrics(s, d):
    done = table(s, d, "pages").filter("text IS NOT NULL AND status = 'done' AND domain_id IS NOT NULL").select("domain_id", "id").distinct().groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("documents"))
    return _canon(s, d).join(done, "id", "left").select("id", "host", F.coalesce("request_count", F.lit(0)).alias("requests"), F.coalesce("documents", F.lit(0)).alias("documents"))


@_query("main_domains", f"""{_WORDS_PER_SITE}, {_METRICS.replace('WITH ', '', 1)}, w AS (SELECT m.*, round(coalesce(site.words, 0), 6) AS words FROM m LEFT JOIN site ON site.domain_id = m.id),
r AS (SELECT *, row_number() OVER (ORDER BY requests DESC, id) AS a, row_number() OVER (ORDER BY documents DESC, id) AS b, row_number() OVER (ORDER BY words DESC, id) AS c FROM w)
SELECT id, host, requests, CAST(documents AS BIGINT) AS documents, words FROM r WHERE least(a, b, c) <= 100""")
def _(s, d):
    words = _site_words(s, d).select(F.col("domain_id").alias("id"), F.round("words", 6).alias("words"))
    return domains.main_domains(materialize(_metrics(s, d).join(words, "id", "left").fillna(0.0, ["words"]), "metrics"))


@_query("domain_shares", f"{_METRICS} SELECT id, host, requests, CAST(documents AS BIGINT) AS documents, round(CAST(requests AS DOUBLE) / nullif(sum(requests) OVER (), 0), 9) AS requests_share, round(CAST(documents AS DOUBLE) / nullif(sum(documents) OVER (), 0), 9) AS documents_share FROM m ORDER BY documents DESC, id LIMIT 100")
def _(s, d):
    return domains.shares(materialize(_metrics(s, d), "metrics"), "requests", "documents").orderBy(F.desc("documents"), "id").limit(100)


@_query("domain_profile", f"""WITH {sql.PAGES}, x AS (SELECT domain_id, len({sql.words('text')}) AS words, len(string_split(text, chr(10) || chr(10))) AS paragraphs FROM page_docs WHERE domain_id IS NOT NULL)
SELECT domain_id, CAST(count(*) AS BIGINT) AS documents, CAST(sum(words) AS BIGINT) AS words, round(quantile_cont(words, 0.5), 6) AS median_words, round(quantile_cont(paragraphs, 0.5), 6) AS median_paragraphs FROM x GROUP BY 1 HAVING count(*) >= 20""")
def _(s, d):
    docs = _page_docs(s, d).filter("domain_id IS NOT NULL").select("domain_id", F.size(tx.words(F.col("text"))).cast("long").alias("words"), F.size(F.split("text", "\n\n", -1)).alias("paragraphs"))
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), 6).alias(f"median_{c}")
    return docs.groupBy("domain_id").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), median("words"), median("paragraphs")).filter("documents >= 20")


# --- near-duplicates ------------------------------------------------------------------------------------

_SHINGLES = f"""WITH {sql.PAGES}, tok AS (SELECT page_id AS doc_id, {sql.words('text')} AS w FROM page_docs), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM tok WHERE len(w) >= 50)),
sets AS (SELECT doc_id, list_sort(list(x)) AS l FROM g GROUP BY 1), heads AS (SELECT l, min(doc_id) AS set_id FROM sets GROUP BY l), member AS (SELECT doc_id, set_id FROM sets JOIN heads USING (l)),
e AS (SELECT doc_id, x FROM g WHERE doc_id IN (SELECT set_id FROM heads)), n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
pairs AS (SELECT a, b, c / (na.n + nb.n - c) AS jaccard FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.85)"""


@_query("near_pairs", f"{_SHINGLES} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs")
def _(s, d):
    sets, _members = near.shingle_sets(_page_docs(s, d), id_col="page_id")
    return near.similar_sets(sets).withColumn("jaccard", F.round("jaccard", 9))


@_query("near_groups", _SHINGLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT set_id AS id, set_id AS other FROM heads UNION SELECT r.id, p.b FROM reach r JOIN both_ways p ON r.other = p.a),
label AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id), deg AS (SELECT a AS id, count(*) AS links FROM both_ways GROUP BY a)
SELECT m.doc_id, class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM member m JOIN label ON label.id = m.set_id LEFT JOIN deg ON deg.id = m.set_id""")
def _(s, d):
    return near.near_groups(_page_docs(s, d), id_col="page_id")


_ALL_SHINGLES = _SHINGLES.replace("len(w) >= 50", "len(w) >= 5").replace(">= 0.85", ">= 0.8")


@_query("all_near_pairs", f"{_ALL_SHINGLES} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs")
def _(s, d):
    sets, _members = near.shingle_sets(_page_docs(s, d), id_col="page_id", min_words=near.SHINGLE)
    return near.similar_sets(sets, near.ALL_JACCARD).withColumn("jaccard", F.round("jaccard", 9))


@_query("all_near_groups", _ALL_SHINGLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT set_id AS id, set_id AS other FROM heads UNION SELECT r.id, p.b FROM reach r JOIN both_ways p ON r.other = p.a),
label AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id), deg AS (SELECT a AS id, count(*) AS links FROM both_ways GROUP BY a)
SELECT m.doc_id, class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM member m JOIN label ON label.id = m.set_id LEFT JOIN deg ON deg.id = m.set_id UNION ALL SELECT doc_id, doc_id, CAST(0 AS BIGINT) FROM tok WHERE len(w) < 5""")
def _(s, d):
    return near.all_near_groups(_page_docs(s, d), id_col="page_id")


@_query("minhash_pairs")
def _(s, d):
    sets, _members = near.shingle_sets(_page_docs(s, d), id_col="page_id")
    return near.minhash_pairs(sets)


@_query("near_sensitivity", f"""{_SHINGLES.replace('WITH ', 'WITH RECURSIVE ', 1).replace('page_docs)', 'one)', 1).replace(', tok AS', ', one AS (SELECT min(page_id) AS page_id, min_by(domain_id, page_id) AS domain_id, text FROM page_docs GROUP BY text), tok AS', 1)}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT set_id AS id, set_id AS other FROM heads UNION SELECT r.id, p.b FROM reach r JOIN both_ways p ON r.other = p.a), label AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
every AS (SELECT m.doc_id, class_id, len(w) AS words, domain_id, row_number() OVER (PARTITION BY class_id ORDER BY len(w) DESC, m.doc_id) AS rn, count(*) OVER (PARTITION BY class_id) AS n FROM member m JOIN label ON label.id = m.set_id JOIN tok ON tok.doc_id = m.doc_id JOIN one ON one.page_id = m.doc_id)
SELECT CAST(count(*) AS BIGINT) AS eligible_documents, CAST((SELECT count(*) FROM pairs) AS BIGINT) AS confirmed_pairs, CAST(count(DISTINCT class_id) FILTER (WHERE n > 1) AS BIGINT) AS groups, CAST(count(*) FILTER (WHERE rn > 1) AS BIGINT) AS documents_removed,
CAST(coalesce(sum(words) FILTER (WHERE rn > 1), 0) AS BIGINT) AS words_removed, CAST(count(DISTINCT domain_id) FILTER (WHERE rn > 1) AS BIGINT) AS affected_domains FROM every""")
def _(s, d):
    docs = materialize(_page_docs(s, d), "documents")
    first = dedup.mark_representatives(docs.select("page_id", F.sha2("text", 256).alias("h")), "h").filter("is_representative").select("page_id")
    return near.sensitivity(docs.join(first, "page_id", "left_semi"))


# --- samples, gates, invariants -----------------------------------------------------------------------------


@_query("stratified_sample", """SELECT doc_id, lang, CAST(sample_rank AS INTEGER) AS sample_rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('73129:' || doc_id), doc_id) AS sample_rank FROM documents) WHERE sample_rank <= 20""")
def _(s, d):
    return sampling.stratified_sample(_docs(s, d).select("doc_id", "lang"), "doc_id", ["lang"], 20).select("doc_id", "lang", "sample_rank")


@_query("balanced_sample", """WITH x AS (SELECT doc_id, source, sha256('73129:' || doc_id) AS p FROM documents), f AS (SELECT * FROM x ORDER BY p, doc_id LIMIT 100),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS r FROM x WHERE doc_id NOT IN (SELECT doc_id FROM f) QUALIFY r <= 100)
SELECT doc_id, source, 'seeded' AS drawn FROM f UNION ALL SELECT doc_id, source, 'turn' FROM (SELECT * FROM t ORDER BY r, p, doc_id LIMIT 100)""")
def _(s, d):
    return sampling.balanced_sample(_docs(s, d).select("doc_id", "source"), "doc_id", "source", 200)


_WILSON = "((g / n + {z} * {z} / (2 * n)) - {z} * sqrt(g / n * (1 - g / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)".format(z=sampling.Z)


@_query("wilson_gate", f"""WITH x AS (SELECT recursion_level, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE status = 'done') AS DOUBLE) AS g FROM page_inventory GROUP BY 1)
SELECT recursion_level, CAST(n AS BIGINT) AS reviewed, round(g / n, 9) AS precision, round({_WILSON}, 9) AS lower, round(g / n, 9) >= 0.95 AND round({_WILSON}, 9) >= 0.9 AS approved FROM x""")
def _(s, d):
    return sampling.review_gate(table(s, d, "page_inventory"), "recursion_level", F.col("status") == "done")


@_query("invariants", f"""WITH {sql.PAGES}, {sql.DOMAINS}, {sql.VOCABULARY}, {sql.ngrams(2)}, {_MARGINALS},
f AS (SELECT (SELECT count(*) FROM pages) AS a, (SELECT count(*) FROM pages WHERE status = 'done') AS b, (SELECT count(*) FROM pages WHERE status = 'done' AND text IS NOT NULL) AS c, (SELECT count(*) FROM feat) AS d, (SELECT count(DISTINCT raw_sha256) FROM feat) AS e, (SELECT count(DISTINCT normalized_sha256) FROM feat) AS g),
v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM occ GROUP BY term)
SELECT 'funnel_falls' AS "check", CAST((a < b)::INT + (b < c)::INT + (c < d)::INT + (d < e)::INT + (e < g)::INT AS BIGINT) AS violations FROM f
UNION ALL SELECT 'inventory_is_pages', CAST(count(*) AS BIGINT) FROM (SELECT status, count(*) AS n FROM pages GROUP BY 1) p FULL JOIN (SELECT status, count(*) AS n FROM page_inventory GROUP BY 1) i ON p.status IS NOT DISTINCT FROM i.status WHERE p.n IS DISTINCT FROM i.n
UNION ALL SELECT 'groups_cover_pages', CAST((sum(n) <> (SELECT count(*) FROM feat))::INT AS BIGINT) FROM (SELECT count(*) AS n FROM feat GROUP BY normalized_sha256)
UNION ALL SELECT 'df_at_most_tf', CAST(count(*) FILTER (WHERE df > tf) AS BIGINT) FROM v
UNION ALL SELECT 'terms_are_words', CAST(((SELECT sum(tf) FROM v) IS DISTINCT FROM (SELECT sum(len(w)) FROM tok))::INT AS BIGINT)
UNION ALL SELECT 'marginals_match', CAST(((SELECT sum(n) FROM l) IS DISTINCT FROM (SELECT sum(n) FROM r))::INT AS BIGINT)
UNION ALL SELECT 'levels_cover_domains', CAST(((SELECT sum(n) FROM (SELECT count(*) AS n FROM canon GROUP BY recursion_level)) <> (SELECT count(DISTINCT id) FROM domain))::INT AS BIGINT)""")
def _(s, d):
    vocab, pairs, feat, pages = materialize(_vocab(s, d), "vocabulary"), materialize(_counts(s, d, 2), "bigrams"), materialize(_features(s, d).drop("text"), "features"), table(s, d, "pages")
    sums = lexical.marginals(pairs).agg(F.sum("left_count").alias("l"), F.sum("right_count").alias("r"))
    done = F.col("status") == "done"
    steps = pages.agg(F.count("*").alias("a"), F.count_if(done).alias("b"), F.count_if(done & F.col("text").isNotNull()).alias("c")).crossJoin(feat.agg(F.count("*").alias("d"), F.countDistinct("raw_sha256").alias("e"), F.countDistinct("normalized_sha256").alias("g")))
    falls = steps.select(F.posexplode(F.array("a", "b", "c", "d", "e")).alias("i", "above"), F.array("b", "c", "d", "e", "g").alias("below")).select("above", F.get("below", F.col("i")).alias("below"))
    per = lambda name: table(s, d, name).groupBy(F.coalesce("status", F.lit("<null>")).alias("status")).agg(F.count("*").alias(name))
    statuses = per("pages").join(per("page_inventory"), "status", "full")
    one = lambda df, total, **kw: df.agg(F.sum(total).alias("x")).crossJoin(kw["of"])
    groups = one(dedup.groups(feat, "normalized_sha256"), "pages", of=feat.agg(F.count("*").alias("y")))
    words = one(vocab, "tf", of=_tok(s, d).agg(F.sum(F.size("words")).alias("y")))
    levels = one(domains.levels(_canon(s, d)), "domains", of=table(s, d, "domain").agg(F.countDistinct("id").alias("y")))
    same = F.col("x").eqNullSafe(F.col("y"))
    return sampling.broken(
        {
            "funnel_falls": (falls, F.col("above") >= F.col("below")), "inventory_is_pages": (statuses, F.col("pages").eqNullSafe(F.col("page_inventory"))), "groups_cover_pages": (groups, same), "df_at_most_tf": (vocab, F.col("df") <= F.col("tf")),
            "terms_are_words": (words, same), "marginals_match": (sums, F.col("l").eqNullSafe(F.col("r"))), "levels_cover_domains": (levels, same),
        }
    )
