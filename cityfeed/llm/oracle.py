"""DuckDB SQL that states the result of the queries SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
), dup AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY 1
), f AS (
  SELECT d.doc_id, d.text, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)
), g AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 5 * n_symbols > n_words
    OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars
    OR 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars
    OR (10 * (length(text) - length(replace(text, '...', '..'))) > 3 * n_lines AND n_lines >= 3)
    OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words) AS kept
FROM g
"""

OP7 = r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT url, unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical[\s/>])[^>]*>?'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS raw,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS base, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS here
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), said_tags AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '&#(?:38|x26);', '&amp;', 'gi'), '&(?:quot|#34|#x22);', '"', 'gi'), '&(?:apos|#39|#x27);', '''', 'gi'), '&amp;', '&', 'gi') AS tag FROM tags
), joined AS (
  SELECT *, CASE WHEN tag = '' THEN NULL WHEN regexp_matches(tag, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN tag WHEN base = '' THEN NULL
    WHEN tag LIKE '//%' THEN regexp_extract(base, '(?s)^(.*?):', 1) || ':' || tag WHEN tag LIKE '#%' OR regexp_matches(tag, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN tag LIKE '?%' THEN base || here || tag END AS whole,
    CASE WHEN tag LIKE '/%' THEN '' ELSE '/' || regexp_extract(here, '(?s)^/(.*/)', 1) END || regexp_extract(tag, '^[^?#]*') AS merged, regexp_extract(tag, '[?#].*$') AS rest
  FROM said_tags
), dotted AS (
  SELECT *, list_reduce(list_concat([''], string_split(regexp_replace(merged, '/(\.\.?)$', '/\1/'), '/')[2:]), lambda done, x: CASE x WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) AS resolved FROM joined
), links AS (
  SELECT url AS src, CASE WHEN whole IS NOT NULL THEN whole WHEN tag = '' OR base = '' OR tag LIKE '#%' OR regexp_matches(tag, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE base || CASE WHEN resolved = '' THEN '/' ELSE resolved END || rest END AS dst FROM dotted
), urls AS (
  SELECT url FROM pages UNION SELECT dst FROM links WHERE dst IS NOT NULL
), parts AS (
  SELECT url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query FROM urls
), fit AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || path || query END AS node,
    (SELECT arg_max({'rule': h || p, 'verdict': verdict}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS f
  FROM parts
), pairs AS (
  SELECT a.node AS a, b.node AS b FROM links JOIN fit a ON a.url = src JOIN fit b ON b.url = dst WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node
), twoway AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach(a, b) AS (
  SELECT a, a FROM twoway UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON r.b = e.a
), said AS (
  SELECT r.a AS node, min(f.f.verdict) AS alias_verdict FROM reach r JOIN fit f ON f.node = r.b GROUP BY 1
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, f.rule AS rule,
  coalesce(f.verdict, alias_verdict, 'allow') AS verdict, (f IS NULL AND alias_verdict IS NOT NULL) AS by_alias
FROM pages p LEFT JOIN fit ON p.url IS NOT DISTINCT FROM fit.url LEFT JOIN said USING (node)
"""

_SPECIAL = r"\\|<\|text\|>|<\|role\|>|<\|end\|>|<</SYS>>|<s>\[INST\]|<<SYS>>|\[/INST\]|</s>|<a>"
_PARTS = [c[:k] for c in ["<|text|>", "<|role|>", "<|end|>", "<</SYS>>", "<s>[INST]", "<<SYS>>", "[/INST]", "</s>", "<a>"] for k in range(1, len(c))]
_TAIL = "|".join("".join("\\" + x if x in "[]|" else x for x in p) for p in sorted(set(_PARTS), key=len, reverse=True))
OP3 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), o AS (
  SELECT *, row_number() OVER w AS k, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
    last_value(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    len(regexp_extract_all(text, '{_SPECIAL}|(?:{_TAIL})\z')) AS escapes,
    len(regexp_extract_all(role, '{_SPECIAL}|(?:{_TAIL})\z')) AS role_escapes
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(length(said))::BIGINT AS loss_chars, sha256(string_agg(said, '' ORDER BY k)) AS loss_sha256,
  sum(length(text) + escapes + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 ELSE 23 + length(role) + role_escapes END)::BIGINT AS formatted_chars,
  count(*) FILTER (NOT coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS DISTINCT FROM 'user' WHEN 'assistant' THEN before = 'user' END, false)) AS n_out_of_order
FROM o GROUP BY conv_id
"""

OP8 = r"""
WITH d AS (SELECT doc_id, text, coalesce(source, chr(10)) AS site, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, site, p, lines[p] AS line, text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS p FROM d WHERE text IS NOT NULL)
), bad AS (
  SELECT line FROM l WHERE length(line) >= 20 AND regexp_matches(line, '[^ \t\r]+[ \t]+[^ \t\r]+[ \t]+[^ \t\r]')
  GROUP BY line HAVING count(DISTINCT site) >= 8 AND count(DISTINCT md5(text)) >= 8
), k AS (
  SELECT doc_id, count(*) AS n, count(bad.line) AS gone, coalesce(string_agg(l.line, chr(10) ORDER BY p) FILTER (bad.line IS NULL), '') AS rest
  FROM l LEFT JOIN bad USING (line) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), met AS (
  SELECT part, array_to_string(o, '') AS filter_order, good, toxic, list_transform(o, lambda x: fails[ascii(x) - 64]) AS r FROM f, orders
), step AS (
  SELECT part, filter_order, unnest(range(1, 6)) AS step, good, toxic, r, list_position(r, true) AS gone, len(list_filter(r, lambda x: x)) AS n_fails FROM met
), counted AS (
  SELECT part, filter_order, step::INTEGER AS step, count(*) FILTER (gone IS NULL OR gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (r[step] AND gone < step) AS redundant, count(*) FILTER (r[step] AND n_fails = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
  FROM step GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""


def _past(name: str, key: str) -> str:
    """Lines and returned ones of strictly earlier times with the same value, the own fold left out."""
    earlier = "ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    over = lambda x, k: f"coalesce(sum({x}) OVER (PARTITION BY {k} {earlier}), 0)"
    return ", ".join(f"({over(x, key)} - {over(x, key + ', fold')})::BIGINT AS {name}_{c}" for c, x in (("n", "1"), ("s", "back")))


def _rate(name: str, prior: str) -> str:
    return f"CASE WHEN {name}_n < 1 THEN {prior} ELSE (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) END"


_KEYS = {"every": "1", "item": "item_id", "kind": "kind", "vendor": "vendor_id", "nation": "nation_id", "client": "client_id", "segment": "segment"}
OP13 = f"""
WITH l AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at, coalesce(flag = 'returned', false)::INTEGER AS back
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id WHERE s.sold_at IS NOT NULL
), a AS (
  SELECT l.*, kind, v.nation_id, segment FROM l LEFT JOIN items USING (item_id) LEFT JOIN vendors v USING (vendor_id) LEFT JOIN clients USING (client_id)
), bits AS (
  SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM (SELECT unnest(range(256)) AS n)
), crc_table AS (SELECT list(crc ORDER BY n) AS t FROM bits
), folds AS (
  SELECT sale_id, xor(list_reduce([4294967295] || list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 AS fold
  FROM (SELECT DISTINCT sale_id FROM a), crc_table
), h AS (SELECT a.*, fold FROM a JOIN folds USING (sale_id)
), p AS (
  SELECT *, {", ".join(_past(n, k) for n, k in _KEYS.items())} FROM h
), q AS (SELECT *, {_rate("every", "500000")} AS whole FROM p
), r AS (SELECT *, {_rate("kind", "whole")} AS of_kind, {_rate("nation", "whole")} AS of_nation, {_rate("segment", "whole")} AS of_segment FROM q)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, sum(back)::BIGINT AS n_returned,
  any_value(item_n) AS item_n, any_value({_rate("item", "of_kind")}) AS item_rate, any_value(vendor_n) AS vendor_n, any_value({_rate("vendor", "of_nation")}) AS vendor_rate,
  any_value(client_n) AS client_n, any_value({_rate("client", "of_segment")}) AS client_rate
FROM r GROUP BY sale_id, item_id, vendor_id
"""

ORACLE_SQL = {
    "op1_quality_rules": OP1,
    "op3_chat_formatting": OP3,
    "op7_url_filters": OP7,
    "op8_line_dedup": OP8,
    "op10_decontamination": OP10,
    "op12_filter_audit": OP12,
    "op13_time_encoding": OP13,
}
