"""DuckDB SQL for the operators that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document against every window of every item.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
item_windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[p + 1 : p + size], ' ') AS g FROM i, unnest(range(len(ws) - size + 1)) AS u(p)),
doc_windows AS (SELECT doc_id, size, unnest(ps) AS p, unnest(list_transform(ps, lambda p: array_to_string(ws[p + 1 : p + size], ' '))) AS g FROM (SELECT doc_id, ws, size, range(greatest(0, len(ws) - size + 1)) AS ps FROM d, (SELECT DISTINCT size FROM i))),
hits AS (SELECT doc_id, p, w.size AS size, item_id FROM doc_windows w JOIN item_windows x ON w.g = x.g AND w.size = x.size),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + size)) AS u(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _price(pair: str, after: str, n: str) -> str:
    scaled = f"({after} * (total / greatest(1.0, cast({n} AS double))))"
    return f"cast(round_even((log2({scaled} + 50.0) - log2({pair} * (total / greatest(1.0, cast({n} AS double))) + 50.0 * ({scaled} + 1.0) / (total + words + 2))) * 4194304, 0) AS bigint)"


#: Exact counts of all words and pairs, and each step's price in whole numbers of 2^-22 bits.
LM_SCORE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
wanted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL),
steps AS (SELECT r, doc_id IN (SELECT doc_id FROM wanted) AS y, unnest(list_concat([''], ws)) AS x, unnest(list_concat(ws, [''])) AS z FROM d WHERE len(ws) > 0),
pairs AS (SELECT x, z, count(*) AS b, count(*) FILTER (WHERE y) AS t FROM steps GROUP BY x, z),
singles AS (SELECT z, sum(b) AS b, sum(t) AS t FROM pairs GROUP BY z),
totals AS (SELECT sum(b) AS nb, sum(t) AS nt, count(*) FILTER (WHERE z <> '') AS words, greatest(1.0, cast(sum(t) AS double)) AS total FROM singles),
priced AS (SELECT p.x, p.z, {_price('cast(p.b AS double)', 'cast(s.b AS double)', 'nb')} AS b, {_price('cast(p.t AS double)', 'cast(s.t AS double)', 'nt')} AS t FROM pairs p JOIN singles s ON s.z = p.z, totals),
sums AS (SELECT r, cast(sum(b) AS bigint) AS b, cast(sum(t) AS bigint) AS t FROM steps JOIN priced USING (x, z) GROUP BY r),
loss AS (SELECT doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(t, 0) / 4194304 / (len(ws) + 1) AS target_loss, coalesce(b, 0) / 4194304 / (len(ws) + 1) AS background_loss FROM d LEFT JOIN sums USING (r))
SELECT *, background_loss - target_loss AS score FROM loss
"""

#: Every string of 400 bytes, as hexadecimal digits, by its digest; every run of 51 words that two documents have.
REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(ps) AS p, unnest(list_transform(ps, lambda p: md5_number(substr(x, 2 * p + 1, 800)))) AS m FROM (SELECT doc_id, x, range(greatest(0, length(x) // 2 - 399)) AS ps FROM d)),
starts AS (SELECT doc_id, p FROM s JOIN (SELECT m FROM s GROUP BY m HAVING count(*) > 1) USING (m)),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS opens FROM starts),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g),
kept AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front, max(z) AS last
         FROM (SELECT doc_id, x, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans JOIN d USING (doc_id)) GROUP BY doc_id),
runs AS MATERIALIZED (SELECT doc_id, unnest(ps) AS p, unnest(list_transform(ps, lambda p: md5_number(array_to_string(ws[p + 1 : p + 51], ' ')))) AS m FROM (SELECT doc_id, ws, range(greatest(0, len(ws) - 50)) AS ps FROM d)),
common AS (SELECT doc_id, p FROM runs JOIN (SELECT m FROM runs GROUP BY m HAVING min(doc_id) <> max(doc_id)) USING (m)),
passages AS (SELECT doc_id, count(DISTINCT q) AS n_repeated_words FROM common, unnest(range(p, p + 51)) AS u(q) GROUP BY doc_id)
SELECT doc_id, cast(length(x) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(concat(front, substr(x, 2 * coalesce(last, 0) + 1)))) AS kept_sha256, coalesce(n_repeated_words, 0) AS n_repeated_words
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN passages USING (doc_id)
"""

ORACLES = {"op2_decontamination": DECONTAMINATION, "op3_exact_dedup": EXACT_DEDUP, "op4_lm_score": LM_SCORE, "op8_repeats": REPEATS}
