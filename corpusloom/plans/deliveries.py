"""Queries over deliveries and the domain forest that SQL alone does not express on whole tables."""

from __future__ import annotations

from corpusloom.operators import hierarchy
from corpusloom.session import table
from corpusloom.sources import delivery


def queries() -> dict:
    return {
        "p1_found": lambda s, d: delivery.rejected(table(s, d, "raw_pages")),
        "p1_loaded": lambda s, d: delivery.loaded(table(s, d, "raw_pages")),
        "p1_reject_report": lambda s, d: delivery.reject_report(table(s, d, "raw_pages")),
        "md5_representations": lambda s, d: delivery.md5_representations(table(s, d, "raw_pages")),
        "p6_found": lambda s, d: hierarchy.found(table(s, d, "domain")),
        "p6_cycles": lambda s, d: hierarchy.cycles(hierarchy.hierarchy(table(s, d, "domain"))),
        "p6_all_descendants": lambda s, d: hierarchy.all_descendants(hierarchy.hierarchy(table(s, d, "domain"))),
        "p6_descendants": lambda s, d: hierarchy.descendants(hierarchy.hierarchy(table(s, d, "domain"))),
    }


#: The domain row that counts for each id.
_LAST = """last AS (SELECT id, CASE WHEN parent_domain_id IN (SELECT id FROM domain WHERE id IS NOT NULL) THEN parent_domain_id END AS parent
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, '') DESC, parent_domain_id DESC NULLS LAST) AS rn FROM domain WHERE id IS NOT NULL) WHERE rn = 1)"""
#: Trees from their roots; what no root reaches is on or below a cycle, of which the smallest id is found by walking at most as many steps as there are such nodes.
_FOREST = f"""WITH RECURSIVE {_LAST},
tree AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(id AS VARCHAR) AS path FROM last WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || CAST(l.id AS VARCHAR) FROM last l JOIN tree t ON l.parent = t.id),
odd AS (SELECT * FROM last WHERE id NOT IN (SELECT id FROM tree)),
reach AS (SELECT id, parent AS up FROM odd UNION SELECT r.id, o.parent FROM reach r JOIN odd o ON r.up = o.id),
ring AS (SELECT id FROM reach WHERE id = up),
rooted AS (SELECT r.id, min(r.up) AS root_id FROM (SELECT id, up FROM reach UNION SELECT id, id FROM odd) r WHERE r.up IN (SELECT id FROM ring) GROUP BY r.id),
forest AS (SELECT id, root_id, depth, path FROM tree UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT), 'cycle' FROM rooted)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"{_FOREST} SELECT id, root_id, depth, path FROM forest",
        "p6_cycles": f"{_FOREST} SELECT root_id, CAST(count(*) AS BIGINT) AS nodes FROM forest WHERE depth = -1 GROUP BY root_id",
        "p6_descendants": f"""{_FOREST}, up AS (SELECT id, parent AS ancestor, 1 AS distance FROM last WHERE parent IS NOT NULL AND id IN (SELECT id FROM tree)
          UNION ALL SELECT u.id, l.parent, u.distance + 1 FROM up u JOIN last l ON u.ancestor = l.id WHERE l.parent IS NOT NULL)
          SELECT ancestor AS ancestor_id, id AS descendant_id, CAST(distance AS BIGINT) AS distance FROM up""",
    }
