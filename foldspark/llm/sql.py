"""SQL of the corpus queries, where SQL can say them."""

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents),
line AS (SELECT doc_id, unnest(held) AS line, generate_subscripts(held, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
owner AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT keyed.*, coalesce(owner.first <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN owner USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_WORD, _GAPS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

QUALITY = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
             [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, {WS}) <> ''] AS held FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM doc),
triple AS (SELECT doc_id, pos, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM triple WHERE w3 IS NOT NULL),
inside AS (SELECT doc_id, count(DISTINCT pos + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
base AS (SELECT doc.doc_id, text, words, held, len(words) AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(held) - len(list_distinct(held)) AS n_dup_lines,
         coalesce(inside.n, 0) AS n_repeat_words FROM doc LEFT JOIN inside USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines * 2 > len(held)
            OR 5 * len([x FOR x IN words IF NOT regexp_matches(x, '\p{{L}}')]) > n_words
            OR 10 * len(regexp_extract_all(text, '\p{{Lu}}')) > 3 * word_chars
            OR 10 * len([x FOR x IN held IF regexp_matches(x, '^[\x20\x09]*[-*•][\x20\x09]')]) > 9 * len(held)) AS kept
FROM failed"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS far FROM embeddings UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.far = link.a)
SELECT node AS vec_id, (SELECT count(*) FROM link WHERE link.a = node) AS n_links, min(far) AS component_id, node = min(far) AS kept
FROM reach GROUP BY node"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text of code points below U+0100: a byte's table entry is the xor of its bits' entries."""
    entries = []
    for k in range(8):
        entry = 1 << k
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        entries.append(entry)
    table = "0::BIGINT"
    for k, entry in enumerate(entries):
        table = f"xor({table}, ((xor(a, b) >> {k}) & 1) * {entry})"
    byte = "if(unicode(c) < 128, [unicode(c)::BIGINT], [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64])"
    data = f"list_concat([4294967295::BIGINT], flatten([{byte} FOR c IN string_split({text}, '')]))"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, {table})), 4294967295::BIGINT)"


SPELLING = rf"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS raw FROM documents),
lowered AS (SELECT doc_id, {_LOWER.format('raw')} AS run, count(*) AS times FROM run WHERE length(raw) >= 6 GROUP BY ALL),
hashed AS (SELECT run, times, {_crc32("concat(doc_id, ':', run)")} AS h FROM lowered),
edited AS (SELECT times, if(h % 199 = 0, run[:CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2:], run) AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
place AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cut AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM place),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word),
form AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, if(other_n >= 5 * words.n, other, NULL) AS form,
  if(other_n >= 5 * words.n, other_n, NULL) AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM form UNION SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NOT NULL)
SELECT form.word, form.n, form.n_near, form.form, form.form_n, walk.root FROM form JOIN walk USING (word)
JOIN form last ON walk.root = last.word WHERE last.form IS NULL"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = rf"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TERMS}')) AS raw FROM documents),
tf AS MATERIALIZED (SELECT doc_id, {_LOWER.format('raw')} AS term, count(*) AS tf FROM found GROUP BY ALL),
doc AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc),
asked AS (SELECT item_id, unnest(regexp_extract_all(text, '{_TERMS}')) AS raw FROM benchmark),
item AS MATERIALIZED (SELECT item_id, {_LOWER.format('raw')} AS term, count(*) AS times FROM asked GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, n_docs),
part AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS gain
  FROM tf JOIN weight USING (term) JOIN doc USING (doc_id), corpus WHERE tf.term IN (SELECT term FROM item)),
scored AS (SELECT item_id, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM part JOIN item USING (term) GROUP BY ALL HAVING sum(times * gain) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY rank <= 10"""
