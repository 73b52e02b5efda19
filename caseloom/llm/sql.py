"""DuckDB SQL that gives the rows of the registered queries, where SQL can say the same."""

from __future__ import annotations

from caseloom.llm.urls import RULES, SOFT, SOFT_HITS, STRICT

SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, [x for x in regexp_split_to_array(t, '{SPACE}+') if x <> ''] AS w FROM d)"


def removed(pattern: str) -> str:
    """Characters of the text that match."""
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


QUALITY = f"""WITH {WORDS},
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM spots),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
full_lines AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM w),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}+', '', 'g'))::BIGINT AS word_chars,
    {removed('[#*$%&|<>]')}::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    {removed('!')} AS cries, {removed('[A-Z]')} AS capitals, len(l) AS n_lines
  FROM w JOIN full_lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed, greatest(n_words, 1) AS c FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > c * 20 OR cries * 100 > c * 30 OR capitals * 100 > greatest(word_chars, 1) * 60
    OR greatest(word_chars, 1) > c * 30 OR n_dup_lines * 100 > n_lines * 60) AS kept
FROM b"""

_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31) + 1, 1)"
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, h, unnest(range(8)) AS k, ('0x' || substr(h, 5 * unnest(range(8)) + 1, 5))::INT AS v FROM p),
d AS (SELECT page_id, string_agg({' || '.join(_LETTER.format(s) for s in (15, 10, 5, 0))}, '' ORDER BY k) AS payload_digest FROM g GROUP BY page_id),
r AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM r JOIN d USING (page_id)"""

SUBSTRINGS = f"""WITH {WORDS},
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM spots),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, (SELECT unnest(range(35)) AS j)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def _bench(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


BENCHMARK = f"""WITH d AS (SELECT doc_id, {_bench('text')} AS w FROM documents), b AS (SELECT item_id, {_bench('text')} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
places AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM places),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
hits AS (SELECT s.doc_id, x.item_id, s.i, s.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM spots) s JOIN item_windows x USING (n, s)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def _hits(terms) -> str:
    edge = r"[^\p{L}\p{N}]"
    return " + ".join(f"regexp_matches(low, '(^|{edge})\\Q{t}\\E($|{edge})')::BIGINT" for t in terms)


def _rule(value: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule[1].partition("/")
        cases.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{path}') THEN '{rule[value]}'")
    return "CASE " + " ".join(cases) + " END"


URLS = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS head FROM p),
x AS (SELECT page_id, translate(split_part(head, '/', 1), '{UPPER}', '{LOWER}') AS host, substr(head, length(split_part(head, '/', 1)) + 1) AS path,
  translate(url, '{UPPER}', '{LOWER}') AS low FROM h),
n AS (SELECT page_id, host, path, {_rule(1)} AS rule, {_rule(0)} AS ruled, {_hits(STRICT)} AS n_strict, {_hits(SOFT)} AS n_soft FROM x)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict::BIGINT AS n_strict, n_soft::BIGINT AS n_soft FROM n"""

# CRC-32 of an ASCII string: the table by its rule, then a step for each byte.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    step = "lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295] || [ascii(x)::BIGINT for x in string_split({text}, '')], {step}), 4294967295)"


PREFIXES = f"""WITH {CRC_TABLE},
c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM c), crc_table),
parts AS (SELECT i.conv_id, 0 AS part, s.pos, s.role, s.text FROM ids i JOIN c s ON s.conv_id = i.conv_id - i.conv_id % 5 AND s.pos < i.h
  UNION ALL SELECT i.conv_id, 1, c.pos, c.role, c.text FROM ids i JOIN c USING (conv_id) WHERE c.pos >= i.h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, role, text FROM parts),
paths AS (SELECT conv_id, d, text, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM seq
  UNION ALL SELECT conv_id, 0, '', '' FROM ids),
steps AS (SELECT *, lag(p) OVER w AS up, lead(d) OVER w IS NULL AS is_end FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nodes AS (SELECT p, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(strlen(text)) AS size,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends FROM steps GROUP BY p, d),
kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
own AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up = n.p),
below AS (SELECT a.p, sum((o.n_children = 0)::INT) AS n_leaves, sum((o.n_convs - 1) * o.size) AS saved
  FROM own o JOIN paths a ON a.conv_id = o.conv_id AND a.d <= o.d GROUP BY a.p)
SELECT o.conv_id, o.d::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN below b USING (p) LEFT JOIN nodes u ON u.p = o.up"""


def _add(value: str, cost: str, letter: str) -> str:
    """A state's cost in six digits and its audit after a dearer letter; z is out of reach."""
    return f"CASE WHEN {value} = 'z' THEN 'z' ELSE printf('%06d', substr({value}, 1, 6)::INT + {cost}) || substr({value}, 7) || '{letter}' END"


# States of (s?(ua)+)?: start v0, after s vs, after u vu, after a pair va; iu and ia are vu and va after any inserts.
_INSERTED = f"""SELECT *, least(va, {_add('iu', '2', 'I')}) AS ia FROM (
    SELECT *, least(vu, {_add('least(v0, vs, va)', '2', 'I')}) AS iu FROM ({{}}))"""
_ROW = f"""SELECT conv_id, k + 1, {_add('v0', '3', 'D')},
    least({_add('vs', '3', 'D')}, CASE WHEN letter = 's' THEN {_add('v0', 'cut', 'K')} ELSE 'z' END),
    least({_add('iu', '3', 'D')}, CASE WHEN letter = '-' THEN 'z' WHEN letter = 'u' THEN {_add('least(v0, vs, ia)', 'cut', 'K')} ELSE {_add('least(v0, vs, ia)', '2 + cut', 'R')} END),
    least({_add('ia', '3', 'D')}, CASE WHEN letter = '-' THEN 'z' WHEN letter = 'a' THEN {_add('iu', 'cut', 'K')} ELSE {_add('iu', '2 + cut', 'R')} END)
  FROM ({_INSERTED.format('SELECT dp.*, j.letter, j.cut FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.pos = dp.k + 1')})"""
REPAIR = f"""WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS pos FROM damaged),
faults AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM placed),
judged AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN '-' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS letter, (fault = 't')::INT AS cut FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
  count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp(conv_id, k, v0, vs, vu, va) AS (
  SELECT conv_id, 0::BIGINT, '000000', 'z', 'z', 'z' FROM ids UNION ALL {_ROW}),
ends AS (SELECT dp.* FROM dp LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.k = coalesce(c.n, 0)),
best AS (SELECT conv_id, least(v0, ia) AS v FROM ({_INSERTED.format('SELECT * FROM ends')})),
audits AS (SELECT conv_id, substr(v, 1, 6)::BIGINT AS cost, substr(v, 7) AS audit FROM best),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS i FROM audits WHERE audit <> ''),
rows_ AS (SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM edits),
named AS (SELECT r.conv_id, r.i, r.e, j.role, j.text, r.e = 'K' AND j.initial = 's' AS is_system
  FROM rows_ r LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.pos = r.pos AND r.e <> 'I'),
lines AS (SELECT *, CASE WHEN coalesce(sum((e <> 'D' AND NOT is_system)::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0
  THEN 'user' ELSE 'assistant' END AS name FROM named),
texts AS (SELECT conv_id, string_agg(CASE e WHEN 'I' THEN name || ':' WHEN 'R' THEN name || ':' || text ELSE role || ':' || text END, chr(10) ORDER BY i) AS t
  FROM lines WHERE e <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, a.cost, a.audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM audits a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES = {
    "op3_quality_rules": QUALITY,
    "op4_warc": WARC,
    "op6_substring_dedup": SUBSTRINGS,
    "op7_benchmark_decontamination": BENCHMARK,
    "op8_url_filters": URLS,
    "op12_prefix_trie": PREFIXES,
    "op13_conversation_repair": REPAIR,
}
