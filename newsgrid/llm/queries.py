"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsgrid.llm.ann import op6_ann
from newsgrid.llm.chat import op2_chat
from newsgrid.llm.license_scan import TEMPLATES, THRESHOLD, op3_license
from newsgrid.llm.mixing import op1_mixing
from newsgrid.llm.packing import op4_packing
from newsgrid.llm.quality import COVERED, STOP_WORDS, UNSPACED, op9_quality
from newsgrid.llm.repair import op13_repair, symbol_matrix
from newsgrid.llm.sharding import op8_sharding
from newsgrid.llm.simhash import op7_simhash
from newsgrid.llm.suffix_dedup import op12_suffix_dedup
from newsgrid.llm.tokens import op5_token_count
from newsgrid.llm.variants import LOWER, UPPER, op11_variants
from newsgrid.llm.warc import op10_warc


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": _over("documents", op1_mixing),
    "op2_chat": _over("conversations", op2_chat),
    "op3_license": _over("documents", op3_license),
    "op4_packing": _over("documents", op4_packing),
    "op5_token_count": _over("documents", op5_token_count),
    "op6_ann": _over("embeddings", op6_ann),
    "op7_simhash": _over("documents", op7_simhash),
    "op8_sharding": _over("documents", op8_sharding),
    "op9_quality": _over("documents", op9_quality),
    "op10_warc": _over("pages", op10_warc),
    "op11_variants": _over("documents", op11_variants),
    "op12_suffix_dedup": _over("documents", op12_suffix_dedup),
    "op13_repair": _over("conversations", op13_repair),
}

_TEMPLATES = ", ".join("({}, {!r}, '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
#: CRC-32 in SQL: its table, and the checksum of a list of bytes.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_prepend(4294967295, {}), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"
_WAYS = ", ".join(f"('{c}', {i}, {j}, {x[0]}, '{x[1]}')" for c in "dsuaoSUAO" for i, row in enumerate(symbol_matrix(c)) for j, x in enumerate(row) if x)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op9_quality": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words, lower(regexp_extract(coalesce(lang, ''), '^\s*([A-Za-z]+)', 1)) IN ({", ".join(repr(s) for s in COVERED)}) AS known FROM documents),
g AS (SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '{UNSPACED}', '', 'g')) AS n_unspaced,
  len(list_filter(words, lambda x: lower(x) IN ({", ".join(repr(s) for s in STOP_WORDS)}))) AS n_stop_words FROM w),
p AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS place FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT g.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words, n_stop_words, known, n_unspaced
  FROM g LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 2 * n_unspaced > word_chars AS unspaced FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (unspaced OR word_chars BETWEEN 2.5 * n_words AND 12 * n_words) AND 10 * n_symbols <= CASE WHEN unspaced THEN greatest(n_words, n_unspaced) ELSE n_words END
  AND (NOT known OR 100 * n_stop_words >= 6 * n_words) AND 2 * n_dup_lines <= n_lines AS kept, n_stop_words
FROM b""",
    "op3_license": f"""
WITH t(i, name, text) AS (VALUES {_TEMPLATES}), tw AS (SELECT i, name, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM t), tm AS (SELECT i, name, len(w) - 1 AS m FROM tw),
tg AS (SELECT i, gram, count(*) AS c FROM (SELECT i, w[k] || ' ' || w[k + 1] AS gram FROM (SELECT i, w, unnest(range(1, len(w))) AS k FROM tw)) GROUP BY ALL),
split AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)) AS x FROM documents),
raw AS (SELECT doc_id, r, list_transform(regexp_extract_all(line, '[A-Za-z0-9]+'), lambda y: lower(y)) AS w FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS r FROM split)),
l AS (SELECT doc_id, r, w, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY r) AS stop FROM raw WHERE len(w) > 0), ends AS (SELECT doc_id, max(stop) AS total FROM l GROUP BY doc_id),
words AS (SELECT doc_id, r, stop - len(w) + generate_subscripts(w, 1) AS k, unnest(w) AS w FROM l),
grams AS (SELECT doc_id, k, r, lead(r) OVER o AS r2, w || ' ' || lead(w) OVER o AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
hits AS (SELECT doc_id, i, k, r, r2, gram, c FROM grams JOIN tg USING (gram)),
near AS (SELECT doc_id, i, m, name FROM (SELECT doc_id, i, gram, least(count(*), any_value(c)) AS n FROM hits GROUP BY ALL) JOIN tm USING (i) GROUP BY doc_id, i, m, name HAVING sum(n) >= {THRESHOLD} / (2 - {THRESHOLD}) * m - 1e-9),
runs AS (SELECT a.doc_id, i, m, a.r AS r1, b.r AS r2, b.stop - a.stop + len(a.w) - 1 AS n FROM near JOIN l a USING (doc_id) JOIN l b ON a.doc_id = b.doc_id AND a.r <= b.r AND b.stop - a.stop + len(a.w) - 1 BETWEEN 1 AND m * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
in_runs AS (SELECT s.doc_id, s.i, s.m, s.r1, s.r2, n, gram, least(count(*), any_value(c)) AS shared FROM runs s JOIN hits h ON h.doc_id = s.doc_id AND h.i = s.i AND h.r >= s.r1 AND h.r2 <= s.r2 GROUP BY ALL),
starts AS (SELECT DISTINCT h.doc_id, h.i, m, least(k, total - m) AS s FROM hits h JOIN near USING (doc_id, i) JOIN ends USING (doc_id) WHERE total > m),
in_windows AS (SELECT s.doc_id, s.i, s.m, s, gram, least(count(*), any_value(c)) AS shared FROM starts s JOIN hits h ON h.doc_id = s.doc_id AND h.i = s.i AND h.k BETWEEN s AND s + m - 1 GROUP BY s.doc_id, s.i, s.m, s, gram),
scores AS (SELECT doc_id, i, 2 * sum(shared) / (n + m)::DOUBLE AS dice FROM in_runs GROUP BY doc_id, i, m, r1, r2, n UNION ALL SELECT doc_id, i, sum(shared) / m::DOUBLE FROM in_windows GROUP BY doc_id, i, m, s),
b AS (SELECT doc_id, arg_max(name, (dice, -i)) AS license, round(max(dice), 9)::DOUBLE AS dice, list_sort(list(DISTINCT name)) AS licenses FROM scores JOIN tm USING (i) WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(licenses, []) AS licenses FROM documents LEFT JOIN b USING (doc_id)""",
    "op11_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM documents),
h AS (SELECT run, {_CRC.format("flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64] END))")} AS h FROM runs, crc),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
holes AS (SELECT word, n, length(word) AS l, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT DISTINCT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.l = y.l AND x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN w y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM holes x JOIN w y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, encode(near))) AS near FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN near END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS i FROM f UNION ALL SELECT k.word, f.form, i + 1 FROM walk k JOIN f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(root, i) AS root, n, n_near, form_n FROM walk JOIN f USING (word) GROUP BY word, form, n, n_near, form_n""",
    "op13_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
ways(sym, st, st2, c, way) AS (VALUES {_WAYS}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)")} % 20 AS k FROM conversations, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM raw, range(CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM rows_),
seen AS (SELECT *, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM placed),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS r FROM seen),
syms AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(r) ELSE r END AS sym FROM f),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS st, 0::BIGINT AS cost, '' AS audit FROM conversations
  UNION ALL SELECT d.conv_id, d.pos + 1, w.st2, min(d.cost + w.c)::BIGINT, arg_min(d.audit || w.way, (d.cost + w.c, d.audit || w.way)) FROM dp d JOIN syms s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.pos = d.pos + 1 JOIN ways w ON w.sym = s.sym AND w.st = d.st GROUP BY d.conv_id, d.pos + 1, w.st2),
done AS (SELECT conv_id, cost + 3 * length(tail) AS cost, audit || tail AS audit FROM (SELECT *, CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS tail FROM dp) d
  WHERE pos = (SELECT count(*) FROM placed WHERE placed.conv_id IS NOT DISTINCT FROM d.conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + 3 * length(tail), audit || tail) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (prev IS NOT NULL AND prev[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
letters AS (SELECT *, count(*) FILTER (l <> 'I') OVER o AS pos, count(*) FILTER (l <> 'D') OVER o AS k FROM (SELECT conv_id, unnest(string_split(audit, '')) AS l, generate_subscripts(string_split(audit, ''), 1) AS i FROM done WHERE audit <> '') WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
outs AS (SELECT l.conv_id, i, k, l, s.role, coalesce(s.text, '') AS text, max(CASE WHEN l = 'K' AND k = 1 AND s.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS shift FROM letters l LEFT JOIN syms s ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.pos = l.pos AND l <> 'I' WHERE l <> 'D'),
text_ AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (k + shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body FROM outs GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM done LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN text_ ON text_.conv_id IS NOT DISTINCT FROM done.conv_id""",
    "op10_warc": """
WITH s AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT d, max(page_id) AS top FROM s WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM s LEFT JOIN t USING (d)""",
}
