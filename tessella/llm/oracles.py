"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import hashlib

import regex

from tessella.llm.licence_texts import EQUIVALENT, FORMS, NOTICES, TEXTS
from tessella.llm import licences
from tessella.llm.licences import BREAKS, NEITHER
from tessella.llm.mixing import CYCLE, MAX_REPEATS
from tessella.llm.quality import FENCES, PRIOR, RATES, SCALE, SPREAD

#: Only Java wants to be told that lines end with \n alone.
COPYRIGHT_LINE = licences.COPYRIGHT_LINE.replace("(?md)", "(?m)")

OP1 = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '(?s)^[^/?#]*') AS h, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM q
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {MAX_REPEATS} * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {CYCLE} + 1)::BIGINT AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER before, 0)::BIGINT AS lw,
  (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS lk FROM w
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT lw, lk FROM l WHERE cap * lk > lw * weight ORDER BY cap / weight LIMIT 1),
t AS (SELECT l.source, source_size, CASE WHEN one.lw IS NULL OR cap <= one.lw * weight::DOUBLE / one.lk THEN cap::DOUBLE ELSE one.lw * weight::DOUBLE / one.lk END AS target
  FROM l LEFT JOIN one ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
  sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
  (size * least({MAX_REPEATS}, whole + CASE WHEN upto - own + upto < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

OP4 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, doc_id, hash(array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid),
e AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM (SELECT x.rid AS r, y.rid AS q, any_value(x.doc_id) AS xa, any_value(y.doc_id) AS ya, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY 1, 2) p
  JOIN d x ON x.rid = r JOIN d y ON y.rid = q JOIN n nx ON nx.rid = r JOIN n ny ON ny.rid = q
  WHERE 100 * k >= 85 * (nx.n + ny.n - k) AND x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id),
low AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN low ON d.doc_id = low.doc_id
"""



def _digest(text: str) -> str:
    """What the operator's ``digest`` gives for a known text."""
    c = regex.sub(NEITHER, " ", regex.sub(COPYRIGHT_LINE, "", text.lower()))
    for spelling, one in EQUIVALENT:
        c = c.replace(spelling, one)
    return hashlib.md5(regex.sub(BREAKS, " ", c).strip(" ").encode()).hexdigest()


def _licences() -> str:
    def lines(text: str) -> str:
        c = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g'), '{NEITHER}', ' ', 'g')"
        for spelling, one in EQUIVALENT:
            c = f"replace({c}, '{spelling}', '{one}')"
        return c

    rows = lambda known: ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known)
    digest = lambda c: f"md5(nullif(trim(regexp_replace({c}, '{BREAKS}', ' ', 'g')), ''))"
    known = lambda r: f"SELECT {digest(lines('t'))} AS known, min(i) AS licence FROM (VALUES {rows(r)}) k(i, t) GROUP BY 1"
    whole: dict[str, str] = {}
    for i, text in TEXTS + FORMS:
        whole[_digest(text)] = min(i, whole.get(_digest(text), i))
    whole_rows = ", ".join(f"('{k}', '{i}')" for k, i in whole.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {lines('text')} AS c FROM documents),
l AS (SELECT rid, unnest(list_transform(string_split(c, chr(10)), lambda x: md5(trim(x)))) AS known FROM d),
h AS (SELECT rid, array_to_string(list_sort(list(DISTINCT licence)), ' ') AS notices, count(*)::BIGINT AS n FROM l JOIN ({known(NOTICES)}) USING (known) GROUP BY rid)
SELECT doc_id, {digest('c')} AS digest, w.licence, coalesce(h.notices, '') AS notices, coalesce(h.n, 0)::BIGINT AS n_notice_lines
FROM d LEFT JOIN h USING (rid) LEFT JOIN (VALUES {whole_rows}) w(known, licence) ON w.known = {digest('c')}
"""


OP5 = _licences()

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
hit AS (SELECT rid, i FROM g QUALIFY coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY g)),
gone AS (SELECT rid, list(DISTINCT i + k) AS gone FROM hit, (SELECT unnest(range(13)) AS k) GROUP BY rid),
k AS (SELECT doc_id, w, list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])) AS kept FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(list_transform(kept, lambda x: x[1]), ' ')) AS kept_sha256 FROM k
"""

OP9 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _quality(docs: str) -> str:
    q = lambda c, p: f"quantile_disc({c}, {p})::DOUBLE"
    own = [f"{q(c, 0.75)} + {SPREAD} * greatest({q(c, 0.75)} - {q(c, 0.5)}, {SCALE}::DOUBLE / {q(base, 0.5)}) AS {c}_hi" for c, (_, base) in RATES.items()]
    low, mid, high = (q("word_len", p) for p in (0.25, 0.5, 0.75))
    error = f"{mid} / (2 * sqrt({q('n_words', 0.5)}))"
    own += [f"{high} + {SPREAD} * greatest({high} - {mid}, {error}) AS word_len_hi", f"{low} - {SPREAD} * greatest({mid} - {low}, {error}) AS word_len_lo"]
    raw = lambda keys: f"SELECT {keys} count(*) AS n, {', '.join(own)} FROM sig WHERE NOT base_failed " + (f"GROUP BY {keys[:-1]}" if keys else "")
    blend = ", ".join(f"(o.n * o.{c} + {PRIOR} * w.{c}) / (o.n + {PRIOR}) AS {c}" for c in FENCES)
    rates = ",\n  ".join(f"CASE WHEN m.{base} > 0 THEN {SCALE} * m.{count} // m.{base} ELSE 0 END AS {c}" for c, (count, base) in RATES.items())
    ok = " AND ".join(f"{c} <= f.{c}_hi" for c in RATES) + " AND word_len BETWEEN f.word_len_lo AND f.word_len_hi"
    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {docs}),
grams AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS r FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
m AS (SELECT rid, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2]))::BIGINT AS n_echoes FROM base),
sig AS (SELECT b.* EXCLUDE (w, lines), m.* EXCLUDE (rid, n_echoes), coalesce(r, 0)::BIGINT AS n_repeat_words,
  (m.n_words < 10 OR 100 * coalesce(r, 0) > 20 * m.n_words) AS base_failed,
  {rates},
  CASE WHEN m.n_words > 0 THEN 100 * m.word_chars // m.n_words ELSE 0 END AS word_len
  FROM base b JOIN m USING (rid) LEFT JOIN rep USING (rid)),
by_lang AS (SELECT o.lang, {blend} FROM ({raw('lang,')}) o, ({raw('')}) w),
f AS (SELECT o.lang, o.source, {blend} FROM ({raw('lang, source,')}) o JOIN by_lang w ON o.lang IS NOT DISTINCT FROM w.lang)
SELECT sig.*, (NOT base_failed AND coalesce({ok}, false)) AS kept FROM sig
  LEFT JOIN f ON sig.lang IS NOT DISTINCT FROM f.lang AND sig.source IS NOT DISTINCT FROM f.source
"""


OP10 = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({_quality('documents')})"

#: The same rules once more, row by row with whole audit strings.
OP12 = r"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ')||':'||coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(substr(key, i::BIGINT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 20 AS way FROM (SELECT DISTINCT key FROM base)),
conv AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
hurt AS (SELECT c, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base JOIN crc USING (key) JOIN conv ON base.conv_id IS NOT DISTINCT FROM conv.conv_id, (VALUES (1), (2)) t(time) WHERE way <> 0 AND (time = 1 OR way = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM hurt),
r AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault FROM n),
runs(state, spot, run, price, made) AS (VALUES ('e', 'e', '', 0, []::VARCHAR[]), ('e', 'u', 'I', 3, ['user:']), ('e', 'a', 'II', 6, ['user:', 'assistant:']), ('s', 's', '', 0, []), ('s', 'u', 'I', 3, ['user:']), ('s', 'a', 'II', 6, ['user:', 'assistant:']),
  ('u', 'u', '', 0, []), ('u', 'a', 'I', 3, ['assistant:']), ('u', 'u', 'II', 6, ['assistant:', 'user:']), ('a', 'a', '', 0, []), ('a', 'u', 'I', 3, ['user:']), ('a', 'a', 'II', 6, ['user:', 'assistant:'])),
follows(spot, i, after) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
edits AS (SELECT spot, NULL AS i, 'D' AS edit, spot AS after, 4 AS price FROM (SELECT DISTINCT spot FROM runs) UNION ALL SELECT spot, i, 'K', after, 0 FROM follows UNION ALL SELECT spot, NULL, 'R', after, 3 FROM follows WHERE i <> 's'),
moves AS (SELECT u.state, e.i, e.edit, e.after, u.run || e.edit AS macro, u.price + e.price AS price, made FROM runs u JOIN edits e USING (spot)),
dp AS (SELECT c, 0::BIGINT AS k, 'e' AS state, {'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]} AS best FROM conv
  UNION ALL SELECT dp.c, r.k, m.after, min({'cost': best.cost + m.price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'audit': best.audit || macro,
    'made': list_concat(best.made, m.made, CASE edit WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE m.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END)})
  FROM dp JOIN r ON r.c = dp.c AND r.k = dp.k + 1 JOIN moves m ON m.state = dp.state AND (m.i IS NULL OR m.i = r.i) AND (edit = 'D' OR fault IN ('ok', 'truncated')) GROUP BY dp.c, r.k, m.after),
ends(state, run, price, made) AS (VALUES ('e', '', 0, []::VARCHAR[]), ('s', 'II', 6, ['user:', 'assistant:']), ('u', 'I', 3, ['assistant:']), ('a', '', 0, [])),
done AS (SELECT c, min({'cost': best.cost + price, 'audit': best.audit || run, 'made': list_concat(best.made, ends.made)}) AS best FROM (SELECT * FROM dp QUALIFY k = max(k) OVER (PARTITION BY c)) JOIN ends USING (state) GROUP BY c),
facts AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY c ORDER BY k) || i AS pair FROM r) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.made, chr(10))) AS repaired_sha256 FROM conv JOIN done USING (c) LEFT JOIN facts USING (c)
"""

#: Every kept term in every group, without a split.
OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM o GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0)::HUGEINT AS total FROM g LEFT JOIN (SELECT o.* FROM o JOIN k USING (lang, term)) o USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 5) // (t.total + 5 * v.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 5) // (v.total + 5 * v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN t USING (lang, source) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op1_url_filter": OP1, "op2_mix_sources": OP2, "op4_near_dedup": OP4, "op5_licence_scan": OP5, "op6_substring_dedup": OP6, "op9_top_k": OP9, "op10_quality_rules": OP10, "op12_conversation_repair": OP12, "op13_source_divergence": OP13}
