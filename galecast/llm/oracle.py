"""DuckDB statements for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""
WITH marks AS (SELECT doc_id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT t.doc_id, t.source,
         coalesce(len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('7|' || coalesce(t.doc_id::VARCHAR, '') || '|' || coalesce(t.text, '')), 1, 12))::BIGINT::DOUBLE + 1)
             / 281474976710656.0) / coalesce(0.5 + 1.5 * m.q, 1.0) AS k
  FROM documents t LEFT JOIN marks m ON t.doc_id = m.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap / weight > level
             THEN weight * (SELECT max(level) FROM l WHERE cap / weight > level) ELSE cap END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (epochs + CASE WHEN target > epochs * source_size
                               AND 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


OP3 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
occ AS (
  SELECT x.rid, x.i, x.m, win.item_id
  FROM (SELECT rid, m, i, list_slice(w, i, i + m - 1) AS g
        FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)) x
  JOIN win ON win.m = x.m AND win.g = x.g),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM occ) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
      FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p
                                      FROM x JOIN f USING (g) WHERE f.least < x.doc_id OR (x.doc_id IS NULL AND f.least IS NOT NULL))),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
kept AS (SELECT rid, string_agg(t, ' ' ORDER BY p) AS t
         FROM (SELECT rid, p, w[p] AS t FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0)
               ANTI JOIN gone USING (rid, p)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
t AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
q AS (SELECT * FROM t WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, t.vec_id, sum(q.x * t.x)::BIGINT AS score
      FROM q JOIN t ON q.d = t.d AND q.vec_id <> t.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# Bytes as pairs of hexadecimal digits: byte p is characters 2p - 1 and 2p.
OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, doc_id, h, len(h) // 2 AS n FROM d),
piece AS (SELECT rid, doc_id, n, j, substr(h, 1000 * j + 1, 1100) AS h  -- of 500 bytes, with the 50 that follow
          FROM (SELECT rid, doc_id, n, h, unnest(range(0, (n + 499) // 500)) AS j FROM b)),
x AS (SELECT rid, doc_id, 500 * j + i AS i, md5_number(substr(h, 2 * i - 1, 100)) AS g
      FROM (SELECT rid, doc_id, j, h, unnest(range(1, least(500, n - 49 - 500 * j) + 1)) AS i FROM piece WHERE n - 49 > 500 * j)),
f AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g HAVING count(*) > 1),
w AS (SELECT rid, i FROM x JOIN f USING (g) WHERE f.least < x.doc_id OR (x.doc_id IS NULL AND f.least IS NOT NULL)),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM w)),
s AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM gone),
n AS (SELECT rid, count(*) AS removed, count(*) FILTER (before IS NULL OR before < p - 1) AS spans FROM s GROUP BY rid),
k AS (SELECT rid, string_agg(c, '' ORDER BY p) AS h
      FROM (SELECT rid, 500 * j + i AS p, substr(h, 2 * i - 1, 2) AS c
            FROM (SELECT rid, j, h, unnest(range(1, least(500, n - 500 * j) + 1)) AS i FROM piece SEMI JOIN n USING (rid)))
           ANTI JOIN gone USING (rid, p)
      GROUP BY rid)
SELECT doc_id, b.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n.rid IS NULL THEN b.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM b LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (SELECT DISTINCT rid, md5_number(array_to_string(list_slice(w, i, i + 3), ' ')) AS g
       FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
shared AS (SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
link AS (SELECT u, v FROM shared JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(u, v) AS (SELECT rid, rid FROM d UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
c AS (SELECT u AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.v GROUP BY u)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def _located(source: str, text: str, pattern: str, columns: str) -> str:
    """``columns, i, v, s, e``: every match of ``pattern`` in ``text`` with its place, from what lies between matches."""
    return f"""(
  SELECT {columns}, i, hits[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: len(x)))
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS s, s + len(hits[i]) AS e
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS hits, string_split_regex({text}, '{pattern}') AS gaps
              FROM {source})))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda j:
    CASE WHEN j % 2 = 1 THEN substr(reverse({_DIGITS}), j, 1)::INTEGER
         ELSE 2 * substr(reverse({_DIGITS}), j, 1)::INTEGER
              - CASE WHEN substr(reverse({_DIGITS}), j, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT rid, 1 AS o, 'email' AS kind, v, s, e
  FROM {_located("d", "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "rid")}
  UNION ALL
  SELECT rid, 2, 'ip', v, s, e FROM {_located("d", "t", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "rid")}
  WHERE len(list_filter(string_split(v, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER) > 255, true))) = 0
  UNION ALL
  SELECT rid, 3, 'card', v, s, e FROM {_located("d", "t", r"[0-9]([\x20-]?[0-9])+", "rid")}
  WHERE len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}
  UNION ALL
  SELECT rid, 4, 'phone', v, s, e FROM {_located("d", "t", r"\+[0-9][\x20().0-9-]+[0-9]", "rid")}
  WHERE len({_DIGITS}) BETWEEN 8 AND 15),
c AS (
  SELECT rid, kind || ':' || lower(v) AS entity, s, e, len(t) AS n,
         string_split(substr(t, (greatest(s - 64, 0) + 1)::BIGINT, least(s, 64)::BIGINT), chr(10))[-1] AS before,
         string_split(substr(t, (e + 1)::BIGINT, 64), chr(10))[1] AS after
  FROM base JOIN d USING (rid)),
near AS (
  SELECT rid, entity, before || chr(0) || after AS context, lower(v) AS term, edge - len(before) + s AS s, edge - len(before) + e AS e
  FROM {_located("(SELECT rid, entity, before, after, s AS edge FROM c)", "before", r"\p{L}{4,}", "rid, entity, before, after, edge")}
  WHERE s > 0 OR len(before) < 64
  UNION ALL
  SELECT rid, entity, before || chr(0) || after, lower(v), edge + s, edge + e
  FROM {_located("(SELECT rid, entity, before, after, e AS edge, n FROM c)", "after", r"\p{L}{4,}", "rid, entity, before, after, edge, n")}
  WHERE e < len(after) OR len(after) < 64 OR edge + len(after) = n),
words AS (SELECT lower(v) AS term, count(*) AS c FROM (SELECT unnest(regexp_extract_all(t, '\p{{L}}{{4,}}')) AS v FROM d) GROUP BY 1),
total AS (SELECT sum(c)::DOUBLE AS n FROM words),
around AS (SELECT entity, count(*) AS m FROM near GROUP BY entity),
pairs AS (SELECT entity, term, count(*) AS c, count(DISTINCT context) AS contexts FROM near GROUP BY entity, term),
known AS (SELECT entity, term FROM pairs p JOIN around USING (entity) JOIN words w USING (term), total
          WHERE contexts >= 2 AND m < n AND log2(p.c * n / (w.c * m)) / log2(n / m) >= 0.9),
spans AS (SELECT DISTINCT rid, s, e FROM near JOIN known USING (entity, term)),
terms AS (SELECT rid, string_agg('term:' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, e) AS x FROM spans GROUP BY rid),
found AS (SELECT rid, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o = 3) AS n3,
                 count(*) FILTER (o = 4) AS n4,
                 string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY o, s) AS x FROM base GROUP BY rid)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_email, coalesce(n2, 0)::BIGINT AS n_ip, coalesce(n3, 0)::BIGINT AS n_card,
       coalesce(n4, 0)::BIGINT AS n_phone, sha256(coalesce(found.x, '')) AS base_sha256,
       concat_ws(',', found.x, terms.x) AS spans
FROM d LEFT JOIN found USING (rid) LEFT JOIN terms USING (rid)
"""


OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30),
used AS (SELECT lang, source, t, count(*) AS c FROM (SELECT lang, source, unnest(w) AS t FROM d) SEMI JOIN kept USING (lang, t)
         GROUP BY lang, source, t),
langs AS (SELECT lang, count(t) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT lang, source, v, coalesce(n, 0) AS n
           FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang)
           LEFT JOIN (SELECT lang, source, sum(c) AS n FROM used GROUP BY lang, source) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.t, coalesce(u.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 5)) // (g.n + 5 * g.v)::HUGEINT AS p
      FROM groups g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v))::HUGEINT AS q
      FROM used JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, t),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT p.lang, p.source, r.source AS item, sum(abs(p.p - r.p)) AS value
                     FROM p JOIN p r ON p.lang = r.lang AND p.t = r.t AND p.source <> r.source GROUP BY ALL) x
            ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
more AS (SELECT lang, source, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
                 SELECT lang, source, 'term' AS part, item, value FROM more))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""


def llm_oracle() -> dict[str, str]:
    return {"op1_mix": OP1, "op3_decontaminate": OP3, "op6_pii": OP6, "op7_suffix_dedup": OP7, "op8_topk": OP8,
            "op9_substring_dedup": OP9, "op10_near_dedup": OP10, "op12_divergence": OP12, "op13_infill": OP13}
