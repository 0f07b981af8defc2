"""SQL counterparts (DuckDB) of the operators that SQL can express; the others are tested by brute force."""

from __future__ import annotations

from fourclocks.llm.secrets import BASE, MORE, Rule

_SPACE = r"[\x20\x09-\x0D]"

EXACT = rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _spans(rule: Rule, number: int) -> str:
    p = _quoted(rule.pattern)
    return f"""
SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, s AS lo, s + length(m[i]) AS hi
FROM (SELECT doc_id, m, o, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS o,
                   string_split_regex(t, '{p}') AS g, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d))
WHERE length(o[i]) >= {rule.least}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(r, i) for i, r in enumerate(BASE + MORE))}),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
             string_agg(name || ':' || CAST(lo AS BIGINT) || ':' || CAST(hi AS BIGINT), ',' ORDER BY lo, kind) FILTER (WHERE kind < 3) AS base,
             string_agg(name || ':' || CAST(lo AS BIGINT) || ':' || CAST(hi AS BIGINT), ',' ORDER BY lo, kind) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


#: crc32 of the decimal id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT))"""

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS altered FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
r AS (SELECT doc_id, leaf, altered, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
      FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
lv AS (SELECT tree, 0 AS k, pos, leaf AS h, n FROM r
       UNION ALL SELECT tree, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, k, pos // 2, n),
top AS (SELECT 0 AS k, tree AS pos, h, count(*) OVER () AS n FROM lv WHERE n = 1
        UNION ALL SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY k, pos // 2, n),
up AS (SELECT r.tree, r.pos, a.k, (r.pos >> a.k) & 1 AS side, coalesce(b.h, '') AS h
       FROM r JOIN (SELECT DISTINCT tree, k FROM lv WHERE n > 1) a ON a.tree = r.tree LEFT JOIN lv b ON b.tree = r.tree AND b.k = a.k AND b.pos = xor(r.pos >> a.k, 1)
       UNION ALL
       SELECT r.tree, r.pos, 1000 + a.k, (r.tree >> a.k) & 1, coalesce(b.h, '')
       FROM r CROSS JOIN (SELECT DISTINCT k FROM top WHERE n > 1) a LEFT JOIN top b ON b.k = a.k AND b.pos = xor(r.tree >> a.k, 1)),
way AS (SELECT tree, pos, list(CAST(side AS VARCHAR) || h ORDER BY k) AS steps, string_agg(h, '' ORDER BY k) AS siblings FROM up GROUP BY 1, 2),
f AS (SELECT r.*, coalesce(siblings, '') AS siblings, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
             list_reduce(list_prepend(coalesce(altered, leaf), coalesce(steps, [])), lambda a, u: sha256(CASE WHEN u[1] = '1' THEN u[2:] || a ELSE a || u[2:] END)) AS folded_root
      FROM r LEFT JOIN way USING (tree, pos) JOIN (SELECT tree, h FROM lv WHERE n = 1) s USING (tree))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

ORACLES = {"op2_secrets": SECRETS, "op8_exact_dedup": EXACT, "op11_merkle": MERKLE}
