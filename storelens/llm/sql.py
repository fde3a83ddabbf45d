"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from storelens.llm.quality import STOP_WORDS

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {}

SQL["op2_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: trim(lower(x), '.,;:!?()') IN (__STOP__))) AS n_stop,
             len(regexp_extract_all(t, '\p{Lu}')) AS upper_letters,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_runs
      FROM w LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR word_chars / n_words < 1.5 OR word_chars / n_words > 25 OR n_symbols / n_words > 0.3
            OR (n_lines > 0 AND n_dup_lines / n_lines > 0.5) OR n_stop / n_words < 0.02 OR n_runs / n_words > 0.5 OR upper_letters / word_chars > 0.5) AS kept
FROM m
"""

SQL["op9_chat_format"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS l FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, l FROM c ANTI JOIN proper USING (l) GROUP BY l),
turns AS (SELECT conv_id, len(l) AS n_turns, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM kept),
parts AS (SELECT conv_id, (pos - 1) // 256 AS part, n_turns,
                 string_agg('<|' || x.r || '|>' || chr(10) || replace(x.t, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
          FROM turns GROUP BY ALL)
SELECT conv_id, part, n_turns, length(text) AS n_chars, text FROM parts
"""

_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
SQL["op7_quality_rules"] = SQL["op7_quality_rules"].replace("__STOP__", _STOP)

#: crc32 of a feature: its bytes folded through the table of the reflected polynomial, built from its rule.
_CRC = """
crc_table AS (SELECT list(list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
                          lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0 END)) ORDER BY b) AS tab
              FROM range(256) r(b)),
"""
_FEATURES = """
{name}_w AS (SELECT rid, doc_id, regexp_extract_all(translate(t, '{up}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
             FROM (SELECT row_number() OVER () AS rid, {id} AS doc_id, coalesce(text, '') AS t FROM {table})),
{name}_f AS (SELECT rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM {name}_w),
"""
SQL["op12_resample"] = (
    "WITH "
    + _CRC
    + _FEATURES.format(name="d", id="doc_id", table="documents", up=UP, low=LOW)
    + _FEATURES.format(name="b", id="0", table="benchmark", up=UP, low=LOW)
    + """
words AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d_f UNION SELECT f FROM b_f)),
buckets AS (SELECT f, CAST(xor(list_reduce(
                list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
                lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS BIGINT) AS bucket
            FROM words, crc_table),
s AS (SELECT bucket, count(*) AS s FROM d_f JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b_f JOIN buckets USING (f) GROUP BY bucket),
gain AS (SELECT r.bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d_f) + 10000)::DOUBLE)
                                           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b_f) + 10000)::DOUBLE))) AS BIGINT) AS g
         FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT rid, count(*) AS n, floor(sum(g) / count(*)) AS w FROM d_f JOIN buckets USING (f) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(w, 0) AS BIGINT) AS weight,
                  len(ws) >= 20 AS eligible,
                  CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
           FROM d_w LEFT JOIN weighed USING (rid)),
placed AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY eligible ORDER BY weight + noise DESC, doc_id) AS nth,
                  count(*) FILTER (WHERE eligible) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND nth <= 25 * total // 100 THEN nth END AS rank FROM placed
"""
)


def _rounds(k: int, rounds: int) -> str:
    """Lloyd rounds as a chain of tables: c<i> centroids (c, v), a<i> assignments (rid, c, d)."""
    out = ""
    for i in range(rounds + 1):
        out += f"""
a{i} AS (SELECT rid, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
           SELECT rid, c, CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
           FROM x, c{i} y) GROUP BY rid),"""
        if i < rounds:
            out += f"""
m{i} AS (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS v FROM (
           SELECT c, i, CAST(sum(e) AS BIGINT) AS t, count(*) AS n
           FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS i FROM a{i} JOIN x USING (rid)) GROUP BY c, i) GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c)),"""
    return out


SQL["op13_centroids"] = f"""
WITH x AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * e::DOUBLE) AS BIGINT)) AS v
           FROM embeddings WHERE len(embedding) = 64
             AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(e::DOUBLE) < 2097152)) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM x ORDER BY c LIMIT 16),
{_rounds(16, 3)}
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia, CAST(sum(sum(d)) OVER () AS BIGINT) AS inertia FROM a3 GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, cluster_inertia, inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN x USING (rid) JOIN c3 USING (c) JOIN i USING (c)
"""
