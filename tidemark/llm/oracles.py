"""DuckDB SQL for the operator queries that SQL can express."""

from __future__ import annotations

from .quality import METRICS, PRIOR, UNIT

WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

OP8 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND m > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND m > page_id THEN m END AS refers_to FROM g"""

_TERMS = "list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
OP10 = f"""WITH d AS (SELECT doc_id, {_TERMS.format(t="text")} AS w FROM documents), b AS (SELECT item_id, {_TERMS.format(t="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw), dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


OP12 = """WITH RECURSIVE bits AS (SELECT i AS v, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS tab FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda c, b: xor(c // 256, tab[CAST(xor(c, b) % 256 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM src, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, regexp_extract(text, '([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*$', 1) AS tail FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS no, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad FROM num),
flt AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN no > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen),
sums AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
ins(f, g, c, a, o) AS (VALUES ('', '', 0, '', []::VARCHAR[]), ('', 'u', 3, 'I', ['user:']), ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 's', 0, '', []), ('s', 'u', 3, 'I', ['user:']), ('s', 'a', 6, 'II', ['user:', 'assistant:']), ('u', 'u', 0, '', []), ('u', 'a', 3, 'I', ['assistant:']), ('a', 'a', 0, '', []), ('a', 'u', 3, 'I', ['user:'])),
nxt(g, h) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '' AS st, struct_pack(c := 0, a := '', o := []::VARCHAR[]) AS b FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
  SELECT conv_id, pos, st, min(x) FROM (
    SELECT w.conv_id, r.pos, e.st, struct_pack(c := w.b.c + i.c + e.c, a := w.b.a || i.a || e.a, o := w.b.o || i.o || e.o) AS x FROM walk w JOIN flt r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1 JOIN ins i ON i.f = w.st,
    LATERAL (SELECT i.g AS st, 4 AS c, 'D' AS a, []::VARCHAR[] AS o UNION ALL
      SELECT h, CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, 'K', [r.role || ':' || r.text] FROM nxt WHERE nxt.g = i.g AND h = left(r.role, 1) AND coalesce(r.fault, '') NOT IN ('blank', 'duplicate') UNION ALL
      SELECT h, CASE WHEN r.fault = 'truncated' THEN 6 ELSE 3 END, 'R', [CASE h WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] FROM nxt WHERE nxt.g = i.g AND h <> 's' AND coalesce(r.fault, '') NOT IN ('blank', 'duplicate')) e) GROUP BY conv_id, pos, st),
fin AS (SELECT w.conv_id, min(struct_pack(c := b.c + i.c, a := b.a || i.a, o := b.o || i.o)) AS b FROM walk w LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ins i ON i.f = w.st WHERE w.pos = coalesce(s.n, 0) AND i.g IN ('', 'a') GROUP BY w.conv_id)
SELECT fin.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(array_to_string(b.o, chr(10))) AS repaired_sha256 FROM fin LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM fin.conv_id"""


#: CRC-32 byte by byte over a table; the middle byte of a row decides its shard.
OP9 = """WITH RECURSIVE bits AS (SELECT i AS v, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
x AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, y: xor(c // 256, tab[CAST(xor(c, y) % 256 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, crc),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32) AS n FROM x),
p AS (SELECT *, CAST(least(23, (24 * (2 * start + size)) // (2 * total)) AS INT) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""


def _op11() -> str:
    """Plain nearest entries by comparing all: two rounds of averages, then the codes."""
    def assign(k: int) -> str:
        return f"a{k} AS (SELECT x.vid, x.p, any_value(x.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS m FROM x JOIN b{k} b ON b.p = x.p GROUP BY x.vid, x.p)"

    def means(k: int) -> str:
        return f"""n{k} AS (SELECT p, e, j, floor(CAST(sum(c) AS DOUBLE) / count(*))::BIGINT AS c FROM (SELECT p, m.e AS e, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS c FROM a{k}) GROUP BY p, e, j),
        g{k} AS (SELECT p, e, list(c ORDER BY j) AS v FROM n{k} GROUP BY p, e), b{k + 1} AS (SELECT b.p, b.e, coalesce(g.v, b.v) AS v FROM b{k} b LEFT JOIN g{k} g ON g.p = b.p AND g.e = b.e)"""

    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS vid, vec_id, label, q FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))::BIGINT) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
      x AS (SELECT vid, p, list_slice(q, p * w + 1, (p + 1) * w) AS v FROM (SELECT vid, q, len(q) // 16 AS w, unnest(range(16)) AS p FROM k)), b0 AS (SELECT p, vid - 1 AS e, v FROM x WHERE vid <= 64),
      {assign(0)}, {means(0)}, {assign(1)}, {means(1)}, {assign(2)},
      h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM b2),
      c AS (SELECT vid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vid)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM k JOIN c USING (vid), h"""


def _op5() -> str:
    w = WORDS.format(t="text")
    ws = "[ \\t\\n\\x0B\\f\\r]"
    metric = {"symbols_per_mille": ("n_symbols", 1000, "word_chars"), "dup_lines_per_mille": ("n_dup_lines", 1000, "n_lines"), "repeats_per_mille": ("n_repeat_words", 1000, "n_words"), "word_chars_per_hundred": ("word_chars", 100, "n_words")}
    columns = ", ".join(f"CASE WHEN {c} > 0 THEN ({k} * {a}) // {c} ELSE 0 END AS {m}" for m, (a, k, c) in metric.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE NOT base_failed" for m in METRICS)
    level = lambda i: "CASE metric " + " ".join(f"WHEN '{m}' THEN {str(v[i]).lower()}" for m, v in METRICS.items()) + " END"
    value = "CASE metric " + " ".join(f"WHEN '{m}' THEN m.{m}" for m in METRICS) + " END"
    share = f"CAST(floor(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY {{by}}metric) AS DOUBLE) * {float(PRIOR * UNIT)}) AS BIGINT)"
    at = lambda q: f"min(low) FILTER (upto * 1000 >= {q} * total) OVER (PARTITION BY lang, source, metric)"
    return f"""WITH t AS (SELECT doc_id, lang, source, {w} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{ws}', '', 'g') <> '') AS ln FROM documents),
      c AS (SELECT doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines FROM t),
      win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)), rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
      r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
      b AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)), m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {columns} FROM b),
      lo AS ({long}), s1 AS (SELECT *, CASE WHEN v < 64 THEN 0 ELSE length(bin(v)) - 6 END AS sh FROM lo), sk AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE sh * 32 + (v >> sh) END AS bucket, CASE WHEN v < 64 THEN v ELSE (v >> sh) << sh END AS low FROM s1),
      fine AS (SELECT lang, source, metric, bucket, any_value(low) AS low, CAST({UNIT} * count(*) AS BIGINT) AS w FROM sk GROUP BY ALL), every AS (SELECT metric, bucket, any_value(low) AS low, CAST(sum(w) AS BIGINT) AS w FROM fine GROUP BY ALL),
      l0 AS (SELECT lang, metric, bucket, any_value(low) AS low, CAST(sum(w) AS BIGINT) AS w FROM fine GROUP BY ALL), ln2 AS (SELECT DISTINCT lang, metric FROM l0), pa AS (SELECT metric, bucket, low, {share.format(by="")} AS w FROM every),
      l1 AS (SELECT lang, metric, bucket, any_value(low) AS low, CAST(sum(w) AS BIGINT) AS w FROM (SELECT lang, metric, bucket, low, w FROM l0 UNION ALL SELECT lang, metric, bucket, low, w FROM ln2 JOIN pa USING (metric)) GROUP BY ALL),
      gn AS (SELECT DISTINCT lang, source, metric FROM fine), pl AS (SELECT lang, metric, bucket, low, {share.format(by="lang, ")} AS w FROM l1),
      g1 AS (SELECT lang, source, metric, bucket, any_value(low) AS low, CAST(sum(w) AS BIGINT) AS w FROM (SELECT lang, source, metric, bucket, low, w FROM fine UNION ALL SELECT gn.lang, gn.source, gn.metric, pl.bucket, pl.low, pl.w FROM gn JOIN pl ON gn.metric = pl.metric AND gn.lang IS NOT DISTINCT FROM pl.lang) GROUP BY ALL),
      g2 AS (SELECT *, CAST(sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(w) OVER (PARTITION BY lang, source, metric) AS BIGINT) AS total FROM g1),
      g3 AS (SELECT *, {at("500")} AS mid, {at(f"({level(1)})")} AS tail, {at(f"(1000 - ({level(1)}))")} AS head FROM g2),
      g4 AS (SELECT lang, source, metric, max(tail) AS tail, max(head) AS head, CAST(sum(w * abs(low - mid)) AS BIGINT) // max(total) * ({level(2)}) AS reach FROM g3 GROUP BY lang, source, metric),
      ok AS (SELECT m.doc_id, bool_and(coalesce({value} <= tail + reach AND (({level(0)}) OR {value} >= head - reach), true)) AS within FROM m LEFT JOIN g4 ON g4.lang IS NOT DISTINCT FROM m.lang AND g4.source IS NOT DISTINCT FROM m.source GROUP BY 1)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM m JOIN ok USING (doc_id)"""


SQL = {"op5_quality_rules": _op5(), "op8_warc": OP8, "op9_byte_shards": OP9, "op10_contamination": OP10, "op11_vector_codes": _op11(), "op12_conversation_repair": OP12}
