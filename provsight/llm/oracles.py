"""DuckDB SQL for the queries that SQL can express: op2, op4, op5, op12 and op13. The others are tested against brute force."""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
e AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT r, p, word, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c, lead(word, 3) OVER x AS d, lead(word, 4) OVER x AS f
      FROM e WINDOW x AS (PARTITION BY r ORDER BY p)),
h AS (SELECT r, p, CASE WHEN f IS NOT NULL AND count(*) OVER (PARTITION BY r, word, b, c, d, f) > 1 THEN 1 ELSE 0 END AS rep FROM g),
k AS (SELECT r, max(rep) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM h),
rw AS (SELECT r, sum(c) AS n_repeat_words FROM k GROUP BY r),
s AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dl USING (r) LEFT JOIN rw USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
ho AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS bad FROM b WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT count(*) AS k, sum(bad / n) / count(*) AS m, sum(1 / n) / count(*) AS i FROM ho),
pr AS (SELECT m, (avg((bad / n - m) * (bad / n - m)) - m * (1 - m) * i) / nullif(1 - i, 0) AS v FROM ho, mo GROUP BY m, i),
po AS (SELECT source, m, v, bad + m * greatest(m * (1 - m) / v - 1, 0) AS a, n - bad + (1 - m) * greatest(m * (1 - m) / v - 1, 0) AS z FROM ho, pr WHERE v > 1e-9),
re AS (SELECT source FROM po WHERE a / (a + z) - 1.645 * sqrt(a * z / ((a + z) * (a + z) * (a + z + 1))) > greatest(m + sqrt(v), 0.5))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  re.source IS NOT NULL AS host_rejected, NOT base_failed AND re.source IS NULL AS kept FROM b LEFT JOIN re USING (source)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, p, line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

OP4 = r"""
WITH c AS (SELECT page_id, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
             regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') AS bare FROM pages),
q AS (SELECT *, list_sort([x for x in string_split(regexp_extract(bare, '\?(.*)$', 1), '&')
               if x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]*|fbclid|gclid)(=|$)')]) AS args FROM c),
p AS (SELECT page_id, digest, size, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
        || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key FROM q),
resp AS (SELECT url_key, page_id * 10 AS ts, min_by(page_id, 'resp-' || page_id) AS page_id, min_by(digest, 'resp-' || page_id) AS digest,
           min_by(size, 'resp-' || page_id) AS size FROM p GROUP BY ALL),
rev AS (SELECT page_id, url_key, CASE WHEN page_id % 9 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 1000000005 END AS ts,
          CASE WHEN page_id % 5 = 0 THEN 'new-' || digest ELSE digest END AS digest FROM p),
j AS (SELECT rev.*, resp.page_id AS rp, resp.digest AS rd, resp.size AS rs FROM rev ASOF LEFT JOIN resp ON rev.url_key = resp.url_key AND rev.ts > resp.ts),
s AS (SELECT *, CASE WHEN rp IS NULL THEN 'no_earlier_response' WHEN digest = rd THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j)
SELECT 'revi-' || page_id AS record_id, url_key, ts, status, CASE WHEN status = 'resolved' THEN 'resp-' || rp END AS response_id, 'resp-' || rp AS candidate_id,
  CASE WHEN status = 'resolved' THEN 'content-length=' || rs || ';'
    || CASE WHEN page_id % 7 = 0 AND rp % 7 <> 0 THEN 'etag=' || rd || ';last-modified=' || digest
            WHEN page_id % 7 = 0 THEN 'last-modified=' || digest
            WHEN rp % 7 = 0 THEN 'etag=' || digest || ';last-modified=' || rd ELSE 'etag=' || digest END || ';server=two' END AS headers FROM s
"""

OP12 = r"""
WITH te AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT false AS target, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT true, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT target, r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda s: s <> '') AS ws FROM x),
n AS (SELECT unnest([1, 2, 3]) AS width),
f AS (SELECT target, r, unnest(list_transform(range(1, greatest(len(ws) - width + 2, 1)), lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS feature FROM w, n),
h AS (SELECT feature, hex(encode(feature)) AS hx FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hx), 2), lambda i: (strpos('0123456789ABCDEF', hx[i]) - 1) * 16 + strpos('0123456789ABCDEF', hx[i + 1]) - 1)),
         lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM h, te),
k AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN b USING (feature) GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM k),
g AS (SELECT bucket, floor(1000 * ln((k.t + 1)::DOUBLE * (z.s + 10000) / ((k.s + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM k, z),
a AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY r),
d AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM x JOIN w USING (target, r) LEFT JOIN a USING (r) WHERE NOT target),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words < 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM o
"""

OP13 = r"""
WITH m AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lb AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT m.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(m.doc_id > min(m.doc_id) OVER (PARTITION BY t), false) AS e
      FROM m LEFT JOIN lb USING (doc_id)),
g AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [l1.x, l2.x, l3.x, l4.x, l5.x] AS ord FROM l l1, l l2, l l3, l l4, l l5 WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
s AS (SELECT ord, array_to_string([chr(64 + x) for x in ord], '') AS filter_order, l.x AS step FROM o, l),
r AS (SELECT part, filter_order, step, fails[ord[step]] AS own, len([1 for x in ord[1:step - 1] if fails[x]]) AS before, len([1 for x in fails if x]) AS n_fails, ord[step] AS flt, n, good, toxic FROM g, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (before = 0 AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (before = 0 AND own), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (before > 0 AND own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (before = 0 AND own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (before = 0 AND own), 0)::BIGINT AS toxic_lost,
  sum(coalesce(sum(n) FILTER (before = 0 AND own), 0)) OVER (PARTITION BY part, flt)::BIGINT AS shapley FROM r GROUP BY part, filter_order, step, flt
"""

ORACLES = {"op2_quality_rules": OP2, "op4_revisits": OP4, "op5_line_dedup": OP5, "op12_importance_resampling": OP12, "op13_filter_audit": OP13}
