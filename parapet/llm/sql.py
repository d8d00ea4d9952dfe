"""DuckDB SQL for the queries that SQL can express, written from their rules."""

from __future__ import annotations

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s
        FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM win), starts AS (
  SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lengths WHERE len(w) >= n
), hit AS (
  SELECT k, s, win.n, item_id
  FROM starts JOIN win ON win.n = starts.n AND win.g = array_to_string(w[s:s + starts.n - 1], ' ')
), places AS (
  SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT k, s, n FROM hit))
  GROUP BY k
), named AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (k) LEFT JOIN named USING (k)
"""


def license_scan(templates: list[tuple[str, list[str]]], threshold: float) -> str:
    """SQL of the licence scan for (name, bigrams) templates."""
    rows = ", ".join(
        "('{}', ['{}'])".format(name, "', '".join(grams)) for name, grams in templates
    )
    return f"""
WITH t(name, g) AS (VALUES {rows}), d AS (
  SELECT row_number() OVER () AS k, doc_id, text FROM documents
), u AS (
  SELECT DISTINCT k, unnest(list_concat(string_split(text, chr(10)),
         regexp_split_to_array(text, '\\n\\s*\\n'), [text])) AS u FROM d WHERE text IS NOT NULL
), w AS (
  SELECT k, u, list_filter(regexp_split_to_array(lower(u), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\xBF\\x{{2000}}-\\x{{206F}}]+'), lambda x: x <> '') AS w
  FROM u
), g AS (
  SELECT k, u, list_distinct(list_transform(generate_series(1, len(w) - 1),
         lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1
), m AS (
  SELECT k, u, name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice
  FROM g JOIN t ON 2 * least(len(g.g), len(t.g)) >= {threshold} * (len(g.g) + len(t.g))
), best AS (
  SELECT k, u, min(struct_pack(less := -dice, name := name)) AS b
  FROM m WHERE dice >= {threshold} GROUP BY k, u
), per AS (
  SELECT k, count(*) AS n_matches, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS licenses,
         min(b).name AS best_license, -min(b).less AS best_dice FROM best GROUP BY k
)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses,
       best_license, best_dice
FROM d LEFT JOIN per USING (k)
"""


def _rendered(turns: str) -> str:
    return (
        f"array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, 'unknown') || "
        "'|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"
    )


def _mask(turns: str) -> str:
    return (
        f"array_to_string(list_transform({turns}, lambda t: "
        "(5 + length(coalesce(t.role, 'unknown'))) || ':0,' || (8 + length(coalesce(t.text, ''))) "
        "|| CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), ',')"
    )


PREFERENCES = f"""
WITH c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) WHERE conv_id IS NOT NULL
  GROUP BY conv_id
), pairs AS (
  SELECT 'sibling' AS kind, a.conv_id AS chosen_id, b.conv_id AS rejected_id,
         a.turns AS a, b.turns AS b
  FROM c b JOIN (SELECT turns[1] AS first, min(conv_id) AS head FROM c GROUP BY 1) h
    ON b.turns[1] = h.first AND b.conv_id <> h.head JOIN c a ON a.conv_id = h.head
  UNION ALL
  SELECT 'echo', conv_id, conv_id, turns[:p], list_append(turns[:p - 1], {{'role': 'assistant',
         'text': CASE WHEN p > 1 THEN coalesce(turns[p - 1].text, '') ELSE '' END}})
  FROM (SELECT *, list_max(list_transform(turns, lambda t, i: CASE WHEN t.role = 'assistant' THEN i END)) AS p FROM c)
  WHERE p IS NOT NULL
), cut AS (
  SELECT *, coalesce(list_min(list_transform(generate_series(1, greatest(len(a), len(b))),
         lambda i: CASE WHEN a[i] IS DISTINCT FROM b[i] THEN i END)) - 1, len(a)) AS n FROM pairs
)
SELECT kind, chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns,
       {_rendered("a[:n]")} AS prompt,
       {_rendered("a[n + 1:]")} AS chosen, {_mask("a[n + 1:]")} AS chosen_mask,
       {_rendered("b[n + 1:]")} AS rejected, {_mask("b[n + 1:]")} AS rejected_mask
FROM cut
"""

PHRASES = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM piece
), spans AS (
  SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i
  FROM words, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM spans GROUP BY ALL
), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
    FROM cand WHERE k = 3) GROUP BY lang, part
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN longer o ON o.lang = c.lang AND o.part = c.phrase
  WHERE o.a IS NULL OR 100 * o.a < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, w, unnest(generate_series(1, k - 1)) AS cut FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:len(c.w)], ' ')
), worst AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
