"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from khamkit.llm.urls import RULES, listed_rows

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    e AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
    x AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM e),
    m AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
    late AS (SELECT doc_id, p FROM x JOIN m USING (g) WHERE first < doc_id),
    gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 13)) AS i FROM late)),
    o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM o WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = o.doc_id AND g.i = o.i) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES)
LISTED_ROWS = ", ".join(f"('{h}', '{p}', '{v}', false)" for h, p, v in listed_rows())

URLS = rf"""
    WITH u AS (SELECT page_id,
                      translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r(h, p, v, ranked) AS (VALUES {RULE_ROWS}, {LISTED_ROWS}),
    f AS (SELECT DISTINCT u.host, u.path, h || p AS rule, v, ranked FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)),
    b AS (SELECT host, path, arg_max(struct_pack(rule := rule, v := v, ranked := ranked), (CASE WHEN ranked THEN 1000000 ELSE 0 END) + length(rule)) AS best FROM f GROUP BY host, path)
    SELECT page_id, u.host, u.path, CASE WHEN best.ranked THEN best.rule END AS rule, coalesce(best.v, 'allow') AS verdict
    FROM u LEFT JOIN b ON u.host = b.host AND u.path = b.path"""

QUALITY = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
    x AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS gram FROM g),
    t AS (SELECT doc_id, gram FROM x GROUP BY doc_id, gram HAVING count(*) > 1),
    c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT x.doc_id, unnest(range(p, p + 3)) AS i FROM x JOIN t ON x.doc_id = t.doc_id AND x.gram = t.gram) GROUP BY doc_id),
    q AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS n_letters, len(list_distinct(w)) AS n_different,
                 len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[\x{{2022}}\x{{2023}}\x{{25E6}}*+-][ \t]'))) AS n_bulleted, len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|\x{{2026}})[ \t\r]*$'))) AS n_broken,
                 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > 3 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) OR 10 * word_chars < 20 * greatest(n_words, 1)
                OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
                OR 100 * n_letters < 40 * word_chars OR (n_words >= 200 AND 50 * n_different < n_words)
                OR (n_lines >= 5 AND 10 * n_bulleted > 9 * n_lines) OR (n_lines >= 5 AND 10 * n_broken > 5 * n_lines)) AS kept FROM b"""

ORACLE = {"op1_substring": SUBSTRING, "op7_urls": URLS, "op10_quality": QUALITY}
