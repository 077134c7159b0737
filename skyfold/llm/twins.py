"""SQL twins of the numbered operators, for DuckDB over the same tables."""

from skyfold.llm.chat import BEGIN, END, ESCAPES
from skyfold.llm.chat import SEPARATOR as TURN_SEPARATOR
from skyfold.llm.quality import BOILERPLATE, NAVIGATION, SENTENCE, SEPARATOR, SYMBOLS
from skyfold.llm.secret_scan import BASE, RULES
from skyfold.llm.sharding import SLOTS
from skyfold.llm.spelling import LETTERS, LOWER, MISPRINT, UPPER

W = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = "regexp_extract_all(" + ASCII_LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LINES = f"""
SELECT doc_id, n, line,
  regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS filled,
  length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
  len({W.format('line')}) AS n_line_words,
  len(regexp_split_to_array(line, '{SEPARATOR}')) AS segments
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)"""



def _spans(order, rule) -> str:
    regex = rule.regex.replace("'", "''")
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""
SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, ({size.format('s[1:k]')} + {size.format('m[1:k - 1]')})::BIGINT AS a,
  ({size.format('s[1:k]')} + {size.format('m[1:k]')})::BIGINT AS b, length(g[k]) AS n
FROM (SELECT doc_id, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {rule.group}) AS g,
        regexp_split_to_array(t, '{regex}') AS s, unnest(range(1, len(regexp_extract_all(t, '{regex}', 0)) + 1)) AS k
      FROM d WHERE regexp_matches(t, '{regex}'))
WHERE length(g[k]) >= {rule.least}"""


def _escape(column: str) -> str:
    for old, new in ESCAPES:
        column = f"replace({column}, '{old}', '{new}')"
    return column


def _nibble_steps() -> list[int]:
    """What four zero bits make of each value of four bits in the CRC of Ethernet and zip."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return steps


def with_crc32(text: str, source: str, columns: str) -> str:
    """A select of ``columns`` and ``crc``, the unsigned CRC-32 of an expression's UTF-8 bytes, four bits at a time."""
    digits = f"list_transform(string_split(hex(encode({text})), ''), lambda c: (strpos('0123456789ABCDEF', c) - 1)::BIGINT)"
    turned = "list_transform(range(len(digits)), lambda i: digits[xor(i, 1) + 1])"
    steps = "[" + ", ".join(f"{s}::BIGINT" for s in _nibble_steps()) + "]"
    return f"""SELECT {columns}, CASE WHEN {text} = '' THEN 0 ELSE
  xor(list_reduce({turned}, lambda c, x: xor(({steps})[(xor(c, x) & 15) + 1], c >> 4), 4294967295::BIGINT), 4294967295) END AS crc
  FROM (SELECT *, {digits} AS digits FROM {source})"""


LISTED = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord)"

TWINS = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {W.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT doc_id, i FROM win JOIN least USING (g) WHERE doc_id > m),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
runs AS (SELECT doc_id, count(*) AS n_intervals FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM cov) GROUP BY doc_id, r),
turns AS (SELECT doc_id, count(*) AS n_intervals FROM runs GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT flat.doc_id, count(*) AS n_words, count(cov.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY flat.p) FILTER (cov.p IS NULL), '') AS rest
  FROM flat LEFT JOIN cov ON flat.doc_id = cov.doc_id AND flat.p = cov.p GROUP BY flat.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256, coalesce(n_intervals, 0) AS n_intervals
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN turns USING (doc_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)""",
    "op7_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  {LISTED} FILTER (ord < {len(BASE)}) AS base, {LISTED} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""",
    "op9_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM t),
n AS (SELECT *, length({_escape('text')}) + CASE WHEN prev = role THEN {len(TURN_SEPARATOR)} ELSE {len(BEGIN) + len(END) + 1} + length({_escape('role')}) END AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {W.format(ASCII_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT sides.b, reach.root FROM reach JOIN sides ON reach.node = sides.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(root) FROM reach WHERE node = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op4_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d WHERE len(lines) >= 3)),
f AS (SELECT * FROM w WHERE regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')),
later AS (SELECT doc_id, i FROM f QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
flat AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
SELECT flat.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY flat.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.i = gone.i GROUP BY flat.doc_id""",
    "op5_decontaminate": f"""
WITH b AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, dw.i, dw.k, item_id FROM dw JOIN bw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {W.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS ({LINES}),
judged AS (SELECT *, filled AND (3 * symbols > n_line_words OR (n_line_words >= 20 AND NOT regexp_matches(line, '{SENTENCE}'))
    OR regexp_matches(line, '{NAVIGATION}') OR (segments >= 3 AND n_line_words <= 3 * segments) OR regexp_matches(line, '{BOILERPLATE}')) AS fails
  FROM lines),
byline AS (SELECT doc_id, count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
    coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (NOT fails), 0) AS rest
  FROM judged GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines_removed, rest
  FROM d JOIN byline USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND CASE WHEN word_chars > 0 THEN 1 - rest::DOUBLE / word_chars ELSE 0 END <= 0.5 AS kept
FROM m""",
    "op11_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS c
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[{LETTERS}]{{6,}}')) AS run FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
hashed AS ({with_crc32("id || ':' || run", "runs", "run, c")}),
printed AS (SELECT CASE WHEN crc % {MISPRINT} = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM printed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM one GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM words UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
    "op12_virtual_slots": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, text, ''))[1:8])::BIGINT % {SLOTS} AS virtual_slot FROM documents),
r AS ({with_crc32("t", "d", "doc_id, size, virtual_slot")}),
b AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes FROM r GROUP BY virtual_slot),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k FROM b),
dealt AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads, -1::BIGINT AS virtual_slot, -1 AS shard
  UNION ALL SELECT o.k, list_transform(loads, lambda x, i: x + CASE WHEN i = p THEN bytes ELSE 0 END), o.virtual_slot, p - 1
  FROM (SELECT k, loads, list_position(loads, list_min(loads)) AS p FROM dealt) x JOIN o ON o.k = x.k + 1)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, size, crc) - 1 AS slot, NULL::INTEGER AS grown_shard, virtual_slot::INTEGER AS virtual_slot
FROM r JOIN (SELECT virtual_slot, shard FROM dealt) USING (virtual_slot)""",
}
