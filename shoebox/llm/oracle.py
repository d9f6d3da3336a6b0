"""SQL twins of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM texts WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS body FROM starts),
firsts AS (SELECT body, min(doc_id) AS owner FROM windows GROUP BY body),
gone AS (SELECT DISTINCT w.doc_id, unnest(generate_series(i, i + 12)) AS at FROM windows w JOIN firsts f ON w.body = f.body AND f.owner < w.doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM texts),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY w.at) FILTER (WHERE g.at IS NULL) AS body
         FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.at = w.at GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

OP12 = rf"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(text, {_AZ}) AS body FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
          FROM lists, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
split AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS cut FROM split),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, l.f AS l, r.f AS r, c.cut, (1000000 * c.a::HUGEINT * c.a) // (l.f::HUGEINT * r.f) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ')
           JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM split WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.part = b.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL: dict[str, str] = {"op11_automaton_dedup": OP11, "op12_collocations": OP12, "op13_lexical_search": OP13}
