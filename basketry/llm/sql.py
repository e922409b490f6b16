"""DuckDB SQL that checks the text queries, where SQL can say what they do.

Hashes of the Spark side stand for texts, lines and windows; the SQL compares those themselves.
"""

WORD = r"[^\x20\x09-\x0D]+"

WINDOWS = rf"""
WITH lines AS (
  SELECT doc_id, text, l.i, l.line FROM (
    SELECT doc_id, coalesce(text, '') AS text,
           unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
                                 lambda x, i: {{'i': i, 'line': x}})) AS l
    FROM documents)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS place
  FROM (SELECT DISTINCT * FROM lines) WHERE regexp_matches(line, '{WORD}')
), windows AS (
  SELECT a.doc_id, a.text, a.place, [a.line, b.line, c.line] AS w
  FROM worded a
  JOIN worded b ON a.doc_id = b.doc_id AND a.text = b.text AND b.place = a.place + 1
  JOIN worded c ON a.doc_id = c.doc_id AND a.text = c.text AND c.place = a.place + 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, place) AS nth,
         count(*) OVER (PARTITION BY w) AS times
  FROM windows
), covered AS (
  SELECT doc_id, place + k AS place, nth = 1 AS is_first
  FROM ranked, range(3) r(k) WHERE times > 1
), gone AS (
  SELECT doc_id, place FROM covered GROUP BY 1, 2 HAVING NOT bool_or(is_first)
), spans AS (
  SELECT g.doc_id, min(w.i) AS a, max(w.i) AS b
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run
        FROM gone) g
  JOIN worded w USING (doc_id, place) GROUP BY g.doc_id, g.run
), stays AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines l
  WHERE NOT EXISTS (FROM spans s WHERE s.doc_id = l.doc_id AND l.i BETWEEN s.a AND s.b)
  GROUP BY 1
)
SELECT d.doc_id, coalesce(s.text, '') AS text,
       (SELECT count(*) FROM worded w WHERE w.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN stays s USING (doc_id)
"""

LINE_RULES = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), counted AS (
  SELECT *, len(words) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '{WORD}')) AS worded
  FROM base
), places AS (
  SELECT doc_id, i, words[i : i + 4] AS w
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 3)) AS i FROM counted)
), twice AS (
  SELECT doc_id, i FROM places
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, range(5) r(k) GROUP BY 1
), plain AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '{WORD}')) AS n,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
              'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS p
  FROM (SELECT doc_id, source, text, unnest(worded) AS line FROM counted)
), often AS (
  SELECT source, p FROM plain GROUP BY 1, 2
  HAVING count(DISTINCT text) > 10
     AND count(DISTINCT text) > 0.001 * (SELECT count(DISTINCT q.text) FROM plain q
                                         WHERE q.source IS NOT DISTINCT FROM plain.source)
), lost AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_frequent_words
  FROM plain JOIN often ON plain.p = often.p AND plain.source IS NOT DISTINCT FROM often.source
  GROUP BY 1
), judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols,
         CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
         coalesce(n_frequent_words, 0) AS n_frequent_words
  FROM counted LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, NOT base_failed AND n_words - n_frequent_words >= 10
          AND n_words - n_frequent_words >= 0.2 * n_words AS kept
FROM judged
"""

LEVELS = 5  # runs of 16: a million documents of a source, and as many sources


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256({' || '.join(map(_field, fields))})"


# CRC-32 of the decimal digits: eight steps of one bit for every byte.
CRC = """list_reduce(
    list_concat([CAST(4294967295 AS UBIGINT)],
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
    lambda a, c: list_reduce(
      list_concat([xor(a, c)], list_transform(range(8), lambda k: CAST(k AS UBIGINT))),
      lambda x, k: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1))))"""


def _levels(name: str) -> str:
    """Levels above ``name_0 (tree, i, n, d)``: parents ``name_k``, and each node's siblings."""
    parts = []
    for k in range(LEVELS):
        before = "ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        after = "ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
        run = "PARTITION BY tree, i // 16"
        parts.append(f"""{name}_siblings_{k} AS (
  SELECT tree, i, n, coalesce(string_agg(d, '') OVER ({run} {before}), '') AS l,
         coalesce(string_agg(d, '') OVER ({run} {after}), '') AS r
  FROM {name}_{k}
), {name}_{k + 1} AS (
  SELECT tree, i // 16 AS i, (n + 15) // 16 AS n,
         CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM {name}_{k} GROUP BY tree, i // 16, n
)""")
    return ", ".join(parts)


def _folds(name: str, rows: str, out: str) -> str:
    """``rows (tree, i, node, proof, ...)`` with the siblings of every level folded in."""
    parts = []
    for k in range(LEVELS):
        target = out if k == LEVELS - 1 else f"{out}_{k}"
        parts.append(f"""{target} AS (
  SELECT w.* REPLACE (
    CASE WHEN s.n > 1 THEN sha256(s.l || w.node || s.r) ELSE w.node END AS node,
    CASE WHEN s.n > 1 THEN w.proof || s.l || s.r ELSE w.proof END AS proof)
  FROM {rows} w JOIN {name}_siblings_{k} s ON s.tree = w.tree AND s.i = w.i // {16**k}
)""")
        rows = target
    return ", ".join(parts)


MANIFEST = f"""
WITH hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         {_leaf(f"CASE WHEN xor({CRC}, CAST(4294967295 AS UBIGINT)) % 5 = 0 "
                "THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "
                "ELSE text END")} AS claimed
  FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), leaf_0 AS (SELECT tree, i, n, leaf AS d FROM placed),
{_levels("leaf")},
top_0 AS (SELECT 0 AS tree, tree - 1 AS i, count(*) OVER () AS n, d FROM leaf_{LEVELS}),
{_levels("top")},
started AS (SELECT *, claimed AS node, '' AS proof FROM placed),
{_folds("leaf", "started", "inner_rows")},
renamed AS (SELECT * REPLACE (0 AS tree, tree - 1 AS i), tree AS of FROM inner_rows),
{_folds("top", "renamed", "outer_rows")}
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = t.d AS verified
FROM outer_rows w JOIN leaf_{LEVELS} s ON s.tree = w.of CROSS JOIN top_{LEVELS} t
"""

STATEMENTS = {
    "op5_line_windows": WINDOWS,
    "op8_line_rules": LINE_RULES,
    "op12_merkle_manifest": MANIFEST,
}
