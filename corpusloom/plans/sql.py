"""Pieces of SQL that several counterparts share."""

from __future__ import annotations

H_SPACE = r"[ \t\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def normalized(text: str) -> str:
    t = rf"nfc_normalize(regexp_replace({text}, '\r\n?', chr(10), 'g'))"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g')"
    t = rf"regexp_replace({t}, '{H_SPACE}+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n ?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"
    return rf"regexp_replace({t}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\p{{L}}+')"


PAGES = f"""pages_clean AS (SELECT *, {normalized('text')} AS clean FROM pages WHERE id IS NOT NULL AND text IS NOT NULL AND status = 'done'),
feat AS (SELECT id AS page_id, min(domain_id) AS domain_id, min(recursion_level) AS recursion_level, min(sha256(text)) AS raw_sha256, min(sha256(clean)) AS normalized_sha256,
  min(CASE WHEN coalesce(text_md5, '') IN ('', 'NULL', '\\N') THEN 'missing' WHEN NOT regexp_full_match(text_md5, '[0-9a-fA-F]{{32}}') THEN 'invalid' WHEN lower(text_md5) = md5(text) THEN 'match' ELSE 'mismatch' END) AS md5_class,
  min(strlen(text)) AS raw_bytes, min(length(clean)) AS characters, min(len(string_split(clean, chr(10)))) AS lines, min(len(string_split(clean, chr(10) || chr(10)))) AS paragraphs FROM pages_clean WHERE clean <> '' GROUP BY id),
page_docs AS (SELECT id AS page_id, any_value(domain_id) AS domain_id, any_value(clean) AS text FROM pages_clean WHERE clean <> '' GROUP BY id)"""

UNITS = r"""page_lines AS (SELECT page_id, domain_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM page_docs),
raw_units AS (SELECT page_id, domain_id, 'paragraph' AS kind, unnest(regexp_split_to_array(text, '\n\s*\n+')) AS u FROM page_docs
  UNION ALL SELECT page_id, domain_id, 'block', ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS i FROM page_lines)),
units AS (SELECT DISTINCT page_id, domain_id, kind, sha256(u) AS unit, length(u) AS characters FROM raw_units WHERE length(u) >= CASE kind WHEN 'paragraph' THEN 80 ELSE 60 END)"""

HOST = r"nullif(lower(regexp_replace(regexp_extract(regexp_replace(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '')), '')"

DOMAINS = f"""canon AS (SELECT id, parent_domain_id, recursion_level, request_count, {HOST} AS host FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, '') DESC, parent_domain_id DESC NULLS LAST, recursion_level DESC NULLS LAST, request_count DESC NULLS LAST, url DESC NULLS LAST) AS rn FROM domain WHERE id IS NOT NULL) WHERE rn = 1)"""

TOKENS = f"tok AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL)"
VOCABULARY = f"{TOKENS}, occ AS (SELECT doc_id, unnest(w) AS term FROM tok)"


def stop_list(words_: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words_) + ")"


def ngrams(n: int) -> str:
    """Items of n words inside paragraphs, from ``documents``."""
    item = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"""seqs AS (SELECT doc_id, {words('part')} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM documents WHERE text IS NOT NULL)),
grams{n} AS (SELECT doc_id, {item} AS item FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i FROM seqs WHERE len(w) >= {n})),
counts{n} AS (SELECT item, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM grams{n} GROUP BY item)"""
