"""DuckDB SQL for the queries that SQL can express."""

ESCAPED = r"replace(replace(replace({}, '\', '\s'), '[', '\b'), '<', '\a')"

CHAT = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, {ESCAPED.format('text')}) AS said,
           coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                               ORDER BY turn NULLS FIRST, role, {ESCAPED.format('text')}), '') AS loss,
           3 + sum(6 + length({ESCAPED.format('role')}) + 7 + length({ESCAPED.format('text')}) + 4) AS formatted_chars
    FROM rows GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

NEIGHBOURS = """
WITH usable AS (
    SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id, len(embedding)),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

URLS = r"""
WITH split AS (
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
fitting AS (
    SELECT n, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
    FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)
"""

#: Words of pieces, one row each: document, piece and place of a word.
WORDS = r"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT doc, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS said
           FROM (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM texts)),
split AS (SELECT doc, lang, piece, regexp_extract_all(said, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT doc, lang, piece, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM split)
"""

COLLOCATIONS = WORDS + """,
one AS (SELECT lang, word AS phrase, count(*) AS f FROM words GROUP BY ALL),
grams AS (
    SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4
    FROM words WINDOW p AS (PARTITION BY doc, piece ORDER BY place)),
phrases AS (
    SELECT lang, [w1, w2] AS words, count(*) AS a FROM grams WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL
    SELECT lang, [w1, w2, w3], count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL
    SELECT lang, [w1, w2, w3, w4], count(*) FROM grams WHERE w4 IS NOT NULL GROUP BY ALL),
parts AS (SELECT lang, [phrase] AS words, f FROM one UNION ALL SELECT lang, words, a FROM phrases WHERE len(words) < 4),
candidates AS (SELECT lang, words, a FROM phrases WHERE a >= 30),
cuts AS (SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.words, a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
    FROM cuts c JOIN parts x ON x.lang = c.lang AND x.words = c.words[1:k]
    JOIN parts y ON y.lang = c.lang AND y.words = c.words[k + 1:]),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM scored),
taken AS (
    SELECT lang, part, max(a) AS longer
    FROM (SELECT lang, a, unnest(list_filter([words[1:2], words[2:3], words[3:4], words[1:3], words[2:4]],
                                             lambda p: len(p) > 1 AND len(p) < len(words))) AS part FROM candidates) GROUP BY ALL),
left_over AS (
    SELECT s.lang, array_to_string(s.words, ' ') AS phrase, s.a, l, r, score FROM lowest s
    LEFT JOIN taken t ON t.lang = s.lang AND t.part = s.words WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op3_chat_formatting": CHAT, "op4_nearest_neighbours": NEIGHBOURS, "op5_url_filter": URLS,
          "op12_phrase_collocations": COLLOCATIONS}
