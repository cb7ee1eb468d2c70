"""SQL for those queries that SQL can express; written for DuckDB."""

from __future__ import annotations

from vigil.llm import repeats, secrets

#: floor(1024 x) of every vector without nulls and infinities, all pairs of a query and another row.
_PRODUCTS = """
WITH numbers AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM numbers q JOIN numbers c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: Lines and sentences with their places; the first occurrence of each stays.
_REPEATS = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs),
sentences AS (
    SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?]) ', '\1' || chr(30), 'g'), chr(10), chr(30)), chr(30)) AS parts
    FROM docs),
pieces AS (
    SELECT doc_id, {repeats.LINE_WORDS} AS least, unnest(parts) AS piece, generate_subscripts(parts, 1) AS place FROM lines
    UNION ALL
    SELECT doc_id, {repeats.SENTENCE_WORDS}, unnest(parts), generate_subscripts(parts, 1) FROM sentences),
placed AS (
    SELECT doc_id, least, piece, length(piece) AS size,
           coalesce(sum(length(piece) + 1) OVER (
               PARTITION BY doc_id, least ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM pieces),
normal AS (
    SELECT doc_id, start, start + size AS stop,
           lower(trim(regexp_replace(piece, '[\x09-\x0D\x20]+', ' ', 'g'), ' ')) AS words, least
    FROM placed),
units AS (
    SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, md5(words) AS digest
    FROM normal WHERE len(string_split(words, ' ')) >= least),
firsts AS (
    SELECT doc_id, digest, arg_min(stop, start * 100000000 - stop) AS first_stop, min(start) AS first_start
    FROM units GROUP BY ALL),
owners AS (SELECT digest, min(doc_id) AS owner FROM units GROUP BY ALL),
lost AS (
    SELECT DISTINCT u.doc_id, u.start, u.stop
    FROM units u JOIN firsts f USING (doc_id, digest) JOIN owners o USING (digest)
    WHERE (u.start >= f.first_stop) OR (u.start = f.first_start AND u.stop = f.first_stop AND u.doc_id <> o.owner)),
begun AS (
    SELECT *, CASE WHEN start < max(stop) OVER (
        PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
    FROM lost),
numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS span FROM begun),
spans AS (SELECT doc_id, span, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY ALL),
kept AS (
    SELECT d.doc_id, string_agg(substr(d.text, CAST(k.a + 1 AS BIGINT), CAST(k.b - k.a AS BIGINT)), '' ORDER BY k.a) AS text
    FROM docs d JOIN (
        SELECT doc_id, coalesce(lag(stop) OVER w, 0) AS a, start AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY start)
        UNION ALL
        SELECT doc_id, max(stop), 1000000000 FROM spans GROUP BY ALL) k USING (doc_id)
    GROUP BY ALL),
told AS (
    SELECT doc_id, count(*) AS n_removed, CAST(sum(stop - start) AS BIGINT) AS removed_chars,
           string_agg(start || ':' || stop, ',' ORDER BY start) AS spans
    FROM spans GROUP BY ALL)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
       coalesce(spans, '') AS spans, md5(coalesce(k.text, d.text)) AS kept_md5
FROM docs d LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


#: The tree of each language level by level, the tree over the languages, paths and folds of every leaf.
_MANIFEST = """
WITH RECURSIVE
written AS (
    SELECT doc_id, lang, n_chars, concat(
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
               coalesce(strlen(source) || ':' || source, '-'),
               coalesce(strlen(lang) || ':' || lang, '-')) AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM documents),
leaves AS (
    SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf
    FROM written),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS size
    FROM leaves),
tree AS (
    SELECT lang, 0 AS level, pos, leaf AS node, size FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (size + 1) // 2
    FROM tree WHERE size > 1 GROUP BY lang, level, pos // 2, size),
subroots AS (
    SELECT lang, level AS height, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
    FROM tree WHERE size = 1),
summit AS (
    SELECT 0 AS level, pos, node, size FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (size + 1) // 2
    FROM summit WHERE size > 1 GROUP BY level, pos // 2, size),
steps AS (
    SELECT p.lang, p.pos AS leaf_pos, t.level, p.pos >> t.level AS pos, s.node AS other
    FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos >> t.level AND t.size > 1
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = t.level AND s.pos = xor(t.pos, 1)
    UNION ALL
    SELECT p.lang, p.pos, r.height + t.level, r.pos >> t.level, s.node
    FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
    JOIN summit t ON t.pos = r.pos >> t.level AND t.size > 1
    LEFT JOIN summit s ON s.level = t.level AND s.pos = xor(t.pos, 1)),
paths AS (
    SELECT lang, leaf_pos, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256
    FROM steps GROUP BY lang, leaf_pos),
crc_bits AS (
    SELECT i, 0 AS round, CAST(i AS BIGINT) AS v FROM range(256) r(i)
    UNION ALL
    SELECT i, round + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE round < 8),
crc_table AS (SELECT list(v ORDER BY i) AS crc FROM crc_bits WHERE round = 8),
claims AS (
    SELECT p.lang, p.pos, p.leaf, p.head, p.tail, p.n_chars,
           coalesce(xor(list_reduce(
               [4294967295] || list_transform(string_split(CAST(p.doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda v, byte: xor(crc[xor(v & 255, byte) + 1], v >> 8)), 4294967295) % 7 = 0, false) AS claimed
    FROM placed p, crc_table),
folds AS (
    SELECT lang, pos AS leaf_pos, 0 AS level,
           CASE WHEN claimed THEN sha256(head || coalesce(
               strlen(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR), '-') || tail)
                ELSE leaf END AS node
    FROM claims
    UNION ALL
    SELECT f.lang, f.leaf_pos, f.level + 1,
           sha256(CASE WHEN s.pos % 2 = 1 THEN coalesce(s.other, '') || f.node ELSE f.node || coalesce(s.other, '') END)
    FROM folds f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_pos = f.leaf_pos AND s.level = f.level),
ends AS (SELECT lang, leaf_pos, max_by(node, level) AS folded_root FROM folds GROUP BY lang, leaf_pos),
whole AS (SELECT node AS root FROM summit WHERE size = 1)
SELECT p.doc_id, p.leaf, r.node AS subroot, whole.root, coalesce(t.proof_sha256, sha256('')) AS proof_sha256,
       e.folded_root, e.folded_root = whole.root AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.leaf_pos = p.pos
LEFT JOIN paths t ON t.lang IS NOT DISTINCT FROM p.lang AND t.leaf_pos = p.pos, whole
"""


def _matches(name: str, pattern: str, condition: str, kind: int) -> str:
    """A table of matches of a pattern with their places."""
    pattern = pattern.replace("'", "''")
    return f"""
{name}_parts AS (
    SELECT doc_id, string_split_regex(text, '{pattern}') AS before, regexp_extract_all(text, '{pattern}') AS found FROM docs),
{name}_rows AS (
    SELECT doc_id, unnest(found) AS found, generate_subscripts(found, 1) AS n, before, found AS every FROM {name}_parts),
{name} AS (
    SELECT doc_id, {kind} AS kind, found, start, start + length(found) AS stop
    FROM (SELECT *, CAST(list_sum(list_transform(before[1:n], lambda x: length(x)))
                       + coalesce(list_sum(list_transform(every[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS start
          FROM {name}_rows)
    WHERE {condition})"""


def _explained(run: str, span: str) -> str:
    def pieces(pattern: str) -> str:
        return f"len(list_filter(string_split_regex({span}, '{pattern}'), lambda p: length(p) >= {secrets.WINDOW})) = 0"

    return f"""(regexp_matches({run}, '{secrets.UUID}') OR regexp_matches({span}, '{secrets.NUMBERS}')
      OR (regexp_matches({span}, '{secrets.LETTERS}') AND NOT regexp_matches({span}, '{secrets.SHUFFLED}'))
      OR {pieces(secrets.WORDS)} OR (regexp_matches({run}, '{secrets.ADDRESS}') AND {pieces(secrets.WORDS + secrets.PATH)}))"""


def _windows(number: int) -> str:
    """Joined windows of one character class over the candidates, less spans that the allow-list explains."""
    kind = secrets.CLASSES[number]
    name, size = f"windows{number}", secrets.WINDOW
    alphabet = kind.alphabet.replace("-", "") + ("-" if "-" in kind.alphabet else "")
    return f"""
{name} AS (
    SELECT doc_id, start + i AS start, start + i + {size} AS stop, start AS run, found, substr(found, CAST(i + 1 AS BIGINT), {size}) AS part
    FROM (SELECT *, unnest(generate_series(0, length(found) - {size})) AS i FROM candidates)),
{name}_hot AS (
    SELECT doc_id, run, found, start, stop FROM {name}
    WHERE regexp_full_match(part, '[{alphabet}]+')
      AND list_sum(list_transform(map_values(list_aggregate(string_split(part, ''), 'histogram')),
                                  lambda c: ({secrets.WEIGHTS!r})[CAST(c + 1 AS BIGINT)])) <= {secrets.most(kind.least)}),
{name}_begun AS (
    SELECT *, CASE WHEN start <= lag(stop) OVER (PARTITION BY doc_id, run ORDER BY start) THEN 0 ELSE 1 END AS new
    FROM {name}_hot),
{name}_numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY doc_id, run ORDER BY start ROWS UNBOUNDED PRECEDING) AS span FROM {name}_begun),
{name}_spans AS (
    SELECT doc_id, {len(secrets.BASE) + number} AS kind, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop
    FROM {name}_numbered GROUP BY doc_id, run, span
    HAVING NOT {_explained("any_value(found)", "substr(any_value(found), CAST(min(start) - run + 1 AS BIGINT), CAST(max(stop) - min(start) AS BIGINT))")})"""


def _secrets() -> str:
    (_, assign, value, least), (_, access, _, long), (_, hexes, _, _) = secrets.BASE
    value = value.replace("'", "''")
    kinds = ", ".join(f"'{k}'" for k in secrets.KINDS)
    tables = [
        "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        _matches("assign", assign, f"length(regexp_extract(found, '{value}', 1)) >= {least}", 0),
        _matches("access", access, f"length(found) >= {long}", 1),
        _matches("hexes", hexes, "true", 2),
        _matches("candidates", secrets.CANDIDATE, "true", 9),
        "base AS (SELECT * EXCLUDE (found) FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexes))",
        *[_windows(i) for i in range(len(secrets.CLASSES))],
        "added AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM windows{i}_spans" for i in range(len(secrets.CLASSES)))
        + ") a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.stop >= a.stop))",
        f"""written AS (
    SELECT doc_id, kind, start, stop, ([{kinds}])[kind + 1] || ':' || start || ':' || stop AS span
    FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
told AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
           count(*) FILTER (WHERE kind = 2) AS n_hex,
           string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind <= 2) AS base,
           string_agg(span, ',' ORDER BY start, kind, stop) AS spans
    FROM written GROUP BY ALL)""",
    ]
    return f"""WITH {", ".join(tables)}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (doc_id)"""


ORACLE: dict[str, str] = {
    "op3_secrets": _secrets(),
    "op9_pivot_search": _PRODUCTS,
    "op10_repeats": _REPEATS,
    "op12_merkle_manifest": _MANIFEST,
}
