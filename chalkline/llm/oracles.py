"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_LINES = """
pages AS (SELECT DISTINCT source, text FROM {docs}),
lines AS (
  SELECT source, text, place, line, trim(line, ' ') AS body
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place FROM pages)
),
totals AS (SELECT source, count(*) AS n_host FROM pages GROUP BY source),
boilerplate AS (
  SELECT l.source, l.body
  FROM (SELECT source, body, count(DISTINCT text) AS n FROM lines WHERE body <> '' GROUP BY source, body) l
  JOIN totals t ON t.source IS NOT DISTINCT FROM l.source
  WHERE l.n >= 2 AND l.n > 0.02 * t.n_host
),
cleaned AS (
  SELECT l.source, l.text,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE b.body IS NULL), '') AS kept
  FROM lines l LEFT JOIN boilerplate b ON b.source IS NOT DISTINCT FROM l.source AND b.body = l.body
  GROUP BY l.source, l.text
)"""

EXACT = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
),
grouped AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""

LINES = f"""
WITH {_LINES.format(docs="documents")}
SELECT d.doc_id, d.source, sha256(c.kept) AS text_sha256, length(c.kept) AS n_left
FROM documents d LEFT JOIN cleaned c ON c.source IS NOT DISTINCT FROM d.source AND c.text = d.text
"""


DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (g.lang_total + 2 * g.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source
),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts
QUALIFY part = 'pair' OR rank <= 10
"""


def _merkle(levels: int = 4) -> str:
    """Trees of up to 16 to the power ``levels`` rows a source, and as many sources."""

    def tree(name: str, group: str) -> str:
        """Nodes by level, a tree of one node standing still, and their runs."""
        parts = []
        for k in range(levels):
            run = f"SELECT {group}, place // 16 AS place, any_value(n) AS n, list(digest ORDER BY place) AS run FROM {name}{k} GROUP BY {group}, place // 16"
            parts.append(f"{name}_runs{k} AS ({run})")
            up = f"SELECT {group}, place, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {name}_runs{k}"
            parts.append(f"{name}{k + 1} AS ({up})")
        return ",\n".join(parts)

    def climb(name: str, start: str, by: str, group: str) -> str:
        """What is left of and right of each row's node at each level, and the node as changed."""
        parts, before = [], start
        for k in range(levels):
            at = f"((x.{by} // {16**k}) % 16)"
            left, right = (f"CASE WHEN r.n = 1 THEN '' ELSE array_to_string({part}, '') END" for part in (f"r.run[:{at}]", f"r.run[{at} + 2:]"))
            parts.append(
                f"{name}_up{k} AS (SELECT x.* REPLACE (CASE WHEN r.n = 1 THEN x.node ELSE sha256({left} || x.node || {right}) END AS node,"
                f" x.proof || {left} || {right} AS proof) FROM {before} x JOIN {name}_runs{k} r ON r.{group} = x.{group} AND r.place = x.{by} // {16 ** (k + 1)})"
            )
            before = f"{name}_up{k}"
        return ",\n".join(parts)

    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        framed = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
        return f"sha256({' || '.join(framed)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        " lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
    )
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf("text")} AS digest,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS node
  FROM documents
),
l0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
),
{tree("l", "tree")},
s0 AS (
  SELECT 0 AS world, tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM l{levels}
),
{tree("s", "world")},
started AS (SELECT doc_id, tree, digest, node, place, '' AS proof FROM l0),
{climb("l", "started", "place", "tree")},
at_source AS (
  SELECT x.doc_id, x.digest, x.node, x.proof, s.digest AS subroot, 0 AS world, s.place AS place
  FROM l_up{levels - 1} x JOIN s0 s ON s.tree = x.tree
),
{climb("s", "at_source", "place", "world")}
SELECT x.doc_id, x.digest AS leaf, x.subroot, r.digest AS root, sha256(x.proof) AS proof_sha256, x.node AS folded_root,
       x.node = r.digest AS verified
FROM s_up{levels - 1} x CROSS JOIN (SELECT digest FROM s{levels}) r
"""


def statements() -> dict[str, str]:
    return {
        "op2_exact_dedup": EXACT,
        "op4_line_dedup": LINES,
        "op11_source_divergence": DIVERGENCE,
        "op12_merkle_manifest": _merkle(),
    }
