"""DuckDB SQL of the training-data queries that SQL can express."""

OP10 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS window_text, least(len(w), 10) AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(s) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS window_text
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(s)),
hits AS (SELECT DISTINCT doc_id, s, k, item_id FROM dw JOIN bw USING (window_text, k)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, k FROM hits), unnest(range(s, s + k)) AS r(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM words, (VALUES (1), (2), (3), (4), (5)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS r(s)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS first_part,
         array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS rest FROM counted, unnest(range(1, k)) AS r(c)),
scores AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, x.f AS l, y.f AS r, n, c,
         (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = first_part
  JOIN counted y ON y.lang = cuts.lang AND y.phrase = rest JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM best longer WHERE longer.lang = best.lang AND longer.k > best.k AND longer.a >= best.a
    AND contains(' ' || longer.phrase || ' ', ' ' || best.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def op5() -> str:
    """The sentence and rule tables spelled out as SQL values; the steps are SQL's own."""
    from netsift.llm.licenses import CUES, RULES, SENTENCES
    number = {name: i for i, name in enumerate(SENTENCES)}
    known = ", ".join(f"('{t}', {number[name]})" for name, texts in SENTENCES.items() for t in texts)
    cued = " OR ".join(f"contains(t, '{c}')" for c in CUES)
    steps, last = [], "sequences"
    for i, (_, _, names) in enumerate(RULES):
        pattern = "(?:,[0-9]+;)*?".join(f",{number[n]};" for n in names)
        steps.append(f"r{i} AS (SELECT doc_id, cut, n, CASE WHEN regexp_matches(ids, '{pattern}') THEN list_append(hit, {i}) ELSE hit END AS hit, "
                     f"regexp_replace(ids, '{pattern}', '', 'g') AS ids FROM {last})")
        last = f"r{i}"
    rules = ", ".join(f"({i}, '{name}', '{kind}')" for i, (name, kind, _) in enumerate(RULES))
    return rf"""
WITH known(sentence, number) AS (VALUES {known}),
rules(i, license, kind) AS (VALUES {rules}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
c AS (SELECT * FROM d WHERE {cued}),
cuts AS (
  SELECT doc_id, 'lines' AS cut, regexp_replace(t, '[.!?;:]*\s*(?:\n\s*|$)|[.!?;:]+\s+', '|', 'g') AS t FROM c
  UNION ALL SELECT doc_id, 'joined', regexp_replace(t, '[.!?;:]+(?:\s+|$)', '|', 'g') FROM c),
parts AS (
  SELECT doc_id, cut, unnest(string_split(regexp_replace(t, '[^a-z0-9|]+', ' ', 'g'), '|')) AS s,
         generate_subscripts(string_split(regexp_replace(t, '[^a-z0-9|]+', ' ', 'g'), '|'), 1) AS pos FROM cuts),
sequences AS (
  SELECT doc_id, cut, count(*) AS n, CAST([] AS INTEGER[]) AS hit, string_agg(',' || number || ';', '' ORDER BY pos) AS ids
  FROM parts JOIN known ON trim(s) = sentence GROUP BY doc_id, cut),
{", ".join(steps)},
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
         count(DISTINCT license) AS n FROM (SELECT doc_id, unnest(hit) AS i FROM {last}) JOIN rules USING (i) GROUP BY doc_id),
counted AS (SELECT doc_id, max(n) AS n FROM sequences GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_sentences, coalesce(licenses, '') AS licenses, coalesce(kinds, '') AS kinds,
  CAST(coalesce(found.n, 0) AS BIGINT) AS n_licenses
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN found USING (doc_id)
"""
