"""DuckDB SQL of the training-data queries that SQL can say, over the raw tables."""

from __future__ import annotations

from . import interaction, quality

_WORD = r"[^\x20\x09-\x0D]"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
p AS (SELECT id, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5),
v AS (SELECT p.id, i, w[i:i + 4] AS v FROM p JOIN s USING (id)),
twice AS (SELECT id, i FROM v QUALIFY count(*) OVER (PARTITION BY id, v) > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(lines) AS BIGINT) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_open_lines,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM s LEFT JOIN covered USING (id)),
f AS (SELECT *, {" + ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in quality.RULES)} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {quality.Policy("base", 1, quality.BASE).mask}) <> 0 AS base_failed,
  (failed & {quality.PRODUCTION.mask}) = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f
"""

FILTER_AUDIT = rf"""
WITH k AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first < doc_id THEN 16 ELSE 0 END) AS failed FROM t LEFT JOIN k USING (doc_id)),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, failed),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INTEGER) AS upto FROM o, range(1, {interaction.STEPS + 1}) AS r(step)),
x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN failed & upto = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & upto = bit THEN n ELSE 0 END) AS removed, sum(CASE WHEN failed & bit <> 0 AND failed & upto <> bit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failed & upto = bit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & upto = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""

COLLOCATIONS = r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM
    (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce(text, ''), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inner_ AS (SELECT lang, array_to_string(w[b:b + j - 1], ' ') AS phrase, max(a) AS over FROM c, range(2, 5) AS r(j), range(1, 5) AS q(b)
  WHERE j < k AND b + j - 1 <= k GROUP BY 1, 2),
free AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE over IS NULL OR 100 * over < 100 * a),
cut AS (SELECT free.*, j, x.f AS l, y.f AS r FROM free, range(1, 5) AS r(j), f x, f y WHERE j < free.k AND x.lang = free.lang AND y.lang = free.lang
  AND x.phrase = array_to_string(free.w[1:j], ' ') AND y.phrase = array_to_string(free.w[j + 1:free.k], ' ')),
scored AS (SELECT cut.*, n, (1000 * a * n) // (l * r) AS score FROM cut JOIN total USING (lang)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""
