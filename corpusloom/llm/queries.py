"""Queries of the training-text operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import copies, encoding, language, leakage, lines, mixing, quality, repetition
from corpusloom.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: lines.found(table(s, d, "pages")),
        "p2_cleaned": lambda s, d: lines.without_excess(table(s, d, "pages")),
        "p3_found": lambda s, d: quality.found(table(s, d, "pages")),
        "p3_statistics": lambda s, d: quality.page_kinds(table(s, d, "pages")),
        "p4_found": lambda s, d: encoding.found(table(s, d, "pages")),
        "p4_restored": lambda s, d: encoding.repaired(table(s, d, "pages")),
        "p5_found": lambda s, d: copies.found(table(s, d, "pages")),
        "p5_collapsed": lambda s, d: copies.collapsed(table(s, d, "pages")),
        "p7_found": lambda s, d: repetition.repetitive(table(s, d, "pages")).select("id"),
        "p7_shares": lambda s, d: repetition.repetition_profile(table(s, d, "pages")),
        "p8_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_leaks": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_report": lambda s, d: mixing.report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: language.found(table(s, d, "documents")),
        "p10_documents": lambda s, d: language.document_languages(table(s, d, "documents")),
        "p10_segments": lambda s, d: language.segments(table(s, d, "documents")),
    }


#: White space as lines are cut by.
_SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TEXTS = "page AS (SELECT id, any_value(domain_id) AS domain_id, any_value(text) AS text FROM pages WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)"


#: Canonical texts: DuckDB folds case by lower() only, so sharp s and the like are folded by hand.
_FOLDED = "replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ς', 'σ')"
_BARE = r"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')"
_KEYS = rf"""{_TEXTS}, folded AS (SELECT id, {_FOLDED} AS t FROM page),
            pieces AS (SELECT id, t, regexp_split_to_array(t, '[\n\r|;\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]+') AS f FROM folded),
            parted AS (SELECT id, t, flatten(list_transform(f, lambda x: CASE WHEN length(x) - length(replace(x, ':', '')) < 2 OR regexp_matches(x, '[.!?]({_SPACE[:-1]}|$)') THEN [x] ELSE string_split(regexp_replace(x, '{_SPACE}(\p{{L}}+{_SPACE[:-1]}*:)', chr(10) || '\1', 'g'), chr(10)) END)) AS f FROM pieces),
            parts AS (SELECT id, t, list_filter(f, lambda x: {_BARE.format(x='x')} <> '') AS f FROM parted),
            joined AS (SELECT id, t, list_transform(range(1, len(f) + 1), lambda i: {{'first': i = 1 OR contains(f[i], ':'), 'x': f[i]}}) AS f FROM parts),
            fields AS (SELECT id, t, regexp_split_to_array(array_to_string(list_transform(f, lambda s, i: CASE WHEN s.first AND i > 1 THEN chr(1) || s.x ELSE s.x END), ''), chr(1)) AS f FROM joined),
            keyed AS (SELECT id, CASE WHEN contains(t, ':') AND len(f) >= 2 AND len(list_filter(f, lambda x: NOT regexp_full_match(x, '{_SPACE[:-1]}*\p{{L}}[^:.!?]*:[^:]*'))) = 0
              THEN array_to_string(list_sort(list_transform(f, lambda x: {_BARE.format(x='x')})), chr(31)) ELSE {_BARE.format(x='t')} END AS key FROM fields WHERE {_BARE.format(x='t')} <> '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": rf"""WITH {_TEXTS}, ls AS (SELECT id, domain_id, string_split(text, chr(10)) AS l FROM page WHERE domain_id IS NOT NULL),
            raw AS (SELECT id, domain_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS x FROM ls),
            line AS (SELECT id, domain_id, line_no, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '{_SPACE}', ' ', 'g')) AS c FROM raw WHERE regexp_matches(x, '\p{{L}}')),
            n AS (SELECT domain_id, count(*) AS n FROM page WHERE domain_id IS NOT NULL AND regexp_replace(text, '{_SPACE}', '', 'g') <> '' GROUP BY 1),
            hot AS (SELECT domain_id, c FROM line JOIN n USING (domain_id) GROUP BY domain_id, c, n HAVING count(DISTINCT id) >= 8 AND count(DISTINCT id) >= 0.05 * n)
            SELECT id, line_no FROM line JOIN hot USING (domain_id, c)""",
        "p2_cleaned": rf"""WITH {_TEXTS}, ls AS (SELECT id, domain_id, string_split(text, chr(10)) AS l FROM page WHERE domain_id IS NOT NULL),
            raw AS (SELECT id, domain_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS x FROM ls),
            line AS (SELECT id, domain_id, line_no, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '{_SPACE}', ' ', 'g')) AS c FROM raw WHERE regexp_matches(x, '\p{{L}}')),
            n AS (SELECT domain_id, count(*) AS n FROM page WHERE domain_id IS NOT NULL AND regexp_replace(text, '{_SPACE}', '', 'g') <> '' GROUP BY 1),
            hot AS (SELECT domain_id, c FROM line JOIN n USING (domain_id) GROUP BY domain_id, c, n HAVING count(DISTINCT id) >= 8 AND count(DISTINCT id) >= 0.05 * n),
            gone AS (SELECT id, list(line_no) AS nos FROM line JOIN hot USING (domain_id, c) GROUP BY id)
            SELECT id, CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(nos, i)), chr(10)) END AS text, CAST(coalesce(len(nos), 0) AS BIGINT) AS removed FROM page LEFT JOIN gone USING (id)""",
        "p5_found": f"""WITH {_KEYS}, g AS (SELECT key, min(id) AS kept_id FROM keyed GROUP BY key) SELECT kept_id, id AS copy_id FROM keyed JOIN g USING (key) WHERE id <> kept_id""",
        "p5_collapsed": f"""WITH {_KEYS} SELECT min(id) AS id, CAST(count(*) AS BIGINT) AS copies FROM keyed GROUP BY key""",
        "p7_found": rf"""WITH {_TEXTS}, w AS (SELECT id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM page),
            g AS (SELECT id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            again AS (SELECT id, i FROM (SELECT id, i, min(i) OVER (PARTITION BY id, g) AS first FROM g) WHERE i > first),
            cover AS (SELECT id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY id)
            SELECT id FROM cover JOIN w USING (id) WHERE n >= 0.3 * len(w)""",
        "p7_shares": rf"""WITH {_TEXTS}, w AS (SELECT id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM page),
            g AS (SELECT id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            again AS (SELECT id, i FROM (SELECT id, i, min(i) OVER (PARTITION BY id, g) AS first FROM g) WHERE i > first),
            cover AS (SELECT id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY id)
            SELECT id, len(w) AS words, coalesce(n, 0) / greatest(len(w), 1) AS repeated_share FROM w LEFT JOIN cover USING (id)""",
        "p8_found": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS w FROM eval_items),
            dg AS (SELECT DISTINCT doc_id, hash(w[k:k + 11]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
            ig AS (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
