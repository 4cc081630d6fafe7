"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from feedpanel.llm.licenses import Template
from feedpanel.llm.quality import RULES

_SPACES = r"[\x20\x09-\x0D]+"
_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quality(risk: float = 0.02, error: float = 0.05) -> str:
    each = risk / len(RULES)
    cells = " UNION ALL ".join(
        f"SELECT stratum, '{rule}' AS rule, CAST({c} AS DOUBLE) AS cutoff, count(*) AS n, sum(CASE WHEN {stat} > {c} THEN 1 ELSE 0 END) AS k FROM held GROUP BY stratum"
        for rule, (stat, tried) in RULES.items()
        for c in tried
    )
    limits = ", ".join(f"min(CASE WHEN rule = '{r}' THEN cutoff END) AS max_{r}" for r in RULES)
    passed = " AND ".join(f"coalesce({stat} <= max_{r}, TRUE)" for r, (stat, _) in RULES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: trim(x, {_CHARS}) <> '') AS l FROM docs),
runs AS (SELECT row, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS run FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, run) AS times FROM runs),
covered AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS j FROM twice WHERE times > 1) GROUP BY row),
measured AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (row)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT j.* FROM judged j JOIN good USING (doc_id) WHERE NOT base_failed),
cells AS ({cells}),
safe AS (SELECT *, ln(list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i:
  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each}) + (n - i) * ln(1 - {each}))))) AS p FROM cells WHERE k < n * {each}),
limits AS (SELECT stratum, {limits} FROM safe WHERE p <= ln({error} / (SELECT count(*) FROM cells)) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept
FROM judged j LEFT JOIN limits m ON j.stratum IS NOT DISTINCT FROM m.stratum"""


MIXING = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS nth FROM docs),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM docs GROUP BY source),
weighed AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS filled FROM sources),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(filled) OVER (ORDER BY filled / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY filled / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT level FROM levels WHERE level * weight <= filled ORDER BY filled / weight, number LIMIT 1),
goal AS (SELECT source, source_size, least((SELECT level FROM level) * weight, CAST(filled AS DOUBLE)) AS target FROM weighed),
queued AS (SELECT r.*, pass, source_size, target, md5(concat_ws('/', 0, pass, coalesce(CAST(doc_id AS VARCHAR), '-'), size)) AS key
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source, range(3) p(pass) WHERE size > 0),
placed AS (SELECT *, CAST(pass * source_size + sum(size) OVER (PARTITION BY source, pass ORDER BY key, size, doc_id, nth) AS DOUBLE) / target AS finish FROM queued),
taken AS (SELECT doc_id, source, size, nth, CAST(sum(size) AS BIGINT) AS taken FROM (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, key, nth) AS upto FROM placed)
  WHERE upto <= (SELECT sum(source_size) FROM sources) GROUP BY ALL)
SELECT r.doc_id, r.size, g.source_size, g.target, coalesce(t.taken, 0) AS taken
FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
LEFT JOIN taken t ON r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.source IS NOT DISTINCT FROM t.source AND r.size = t.size AND r.nth = t.nth"""


LINES = r"""
WITH lines AS (SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(l[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT *, array_to_string(w, ' ') AS s, doc_id * 1000000000 + line AS place FROM lines WHERE len(w) > 0),
firsts AS (SELECT s, min(place) AS first, any_value(w) AS w FROM worded GROUP BY s),
variants AS (SELECT s, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 8)),
near AS (
  SELECT s FROM (SELECT s, first, min(first) OVER (PARTITION BY v, i) AS other FROM variants) WHERE other < first
  UNION SELECT v.s FROM variants v JOIN firsts f ON v.v = f.s WHERE len(f.w) >= 8 AND f.first < v.first
  UNION SELECT f.s FROM variants v JOIN firsts f ON v.v = f.s WHERE len(f.w) >= 8 AND v.first < f.first),
judged AS (SELECT o.doc_id, o.line, n.s IS NOT NULL AS near, n.s IS NULL AND o.place > f.first AS exact
  FROM worded o JOIN firsts f USING (s) LEFT JOIN near n ON o.s = n.s)
SELECT d.doc_id, CAST(count(j.line) AS BIGINT) AS n_lines, CAST(coalesce(sum(CASE WHEN exact THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_exact,
  CAST(coalesce(sum(CASE WHEN near THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_near,
  coalesce(string_agg(CASE WHEN near OR exact THEN CAST(line AS VARCHAR) END, ',' ORDER BY line), '') AS dropped
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id"""


def licenses(known: list[Template]) -> str:
    """Every word of every text meets every equal word of a template; places where enough of them agree are matches."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = ", ".join(f"({n}, {i}, '{w}', {int(i in t.keys)})" for n, t in enumerate(known) for i, w in enumerate(t.words))
    heads = ", ".join(f"({n}, '{t.label}', {len(t.words)}, {len(t.keys)}, {t.least}, {t.base})" for n, t in enumerate(known))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
placed AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS spot FROM docs),
templates(n, place, word, key) AS (VALUES {rows}),
heads(n, label, size, keys, least, base) AS (VALUES {heads}),
agreeing AS (SELECT row, n, spot - place AS begin, count(*) AS same, sum(key) AS same_keys FROM placed JOIN templates USING (word) GROUP BY ALL),
found AS (SELECT * FROM agreeing JOIN heads USING (n) WHERE same >= least AND same_keys = keys),
told AS (SELECT row, count(*) FILTER (WHERE base) AS n_base, min(begin) FILTER (WHERE base) AS first_word, max(begin) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(CAST(same AS DOUBLE) / size) AS score FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN told USING (row)"""


BRANCHES = """
WITH RECURSIVE m AS (SELECT conv_id AS tree, turn AS node, CASE WHEN turn > 0 THEN turn // 2 END AS parent, CAST(length(text) % 7 AS DOUBLE) AS score FROM conversations),
inner_nodes AS (SELECT DISTINCT tree, parent AS node FROM m WHERE parent IS NOT NULL),
up AS (SELECT tree, node AS leaf, node, 0 AS step FROM m ANTI JOIN inner_nodes USING (tree, node)
  UNION ALL SELECT u.tree, u.leaf, m.parent, step + 1 FROM up u JOIN m ON m.tree = u.tree AND m.node = u.node JOIN m p ON p.tree = m.tree AND p.node = m.parent),
scored AS (SELECT up.tree, leaf, count(*) AS length, avg(score) AS mean, string_agg(CAST(up.node AS VARCHAR), ',' ORDER BY step DESC) AS nodes FROM up JOIN m ON m.tree = up.tree AND m.node = up.node GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY mean DESC, length DESC, leaf) AS rank FROM scored)
SELECT tree, CAST(rank AS INTEGER) AS rank, leaf, length, round(mean, 9) AS mean, nodes FROM ranked WHERE rank <= 2"""
