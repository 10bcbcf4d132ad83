"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from batchtrace.llm.quality import (
    CLASSES, COMMON, MAX_CHAR_JS, MAX_WORD_JS, MIN_CHARS, MIN_WORDS, WORD_LIST, WORD_NOISE)
from batchtrace.llm.secret_scan import BASE, MORE
from batchtrace.llm.spans import MIN_WORDS as MIN_RUN_WORDS, RUN, WINDOW

SQL: dict[str, str] = {}


def _quality() -> str:
    """Counts by lists and unnested windows; histograms as columns c0.. and w0.., summed per language."""
    blank = r"[ \t\n\x0B\f\r]"
    classes = []
    for pattern in CLASSES.values():
        inverse = pattern.replace("[^", "[", 1) if pattern.startswith("[^") else pattern.replace("[", "[^", 1)
        classes.append("CAST(length(regexp_replace(t, '" + inverse.replace("'", "''") + "', '', 'g')) AS DOUBLE)")
    nc, nw = len(CLASSES) + 2, len(WORD_LIST) + 1
    c = [f"c{i}" for i in range(nc)]
    w = [f"w{i}" for i in range(nw)]
    sums = ", ".join(f"sum({x}) AS q{x}" for x in c + w)

    def js(cols: list[str]) -> str:
        p, q = " + ".join(cols), " + ".join(f"q{x}" for x in cols)
        part = lambda a, b, x: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        terms = " + ".join(part(f"({x} / ({p}))", f"(q{x} / ({q}))", x) + " + " + part(f"(q{x} / ({q}))", f"({x} / ({p}))", x) for x in cols)
        return f"CASE WHEN {p} > 0 AND {q} > 0 THEN round(sqrt(greatest(0, ({terms}) / 2)), 6) END"

    langs = ", ".join(f"'{x}'" for x in COMMON)
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '*' END AS lang, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1)
      GROUP BY doc_id),
b AS (SELECT d.doc_id, d.lang, length(t) AS chars, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))
                - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))) AS BIGINT)
               AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, list_transform(w, lambda x: lower(x)) AS low,
             {", ".join(f"{e} AS c{i}" for i, e in enumerate(classes))}
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
h AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             CAST(chars - word_chars AS DOUBLE) AS c{nc - 2},
             word_chars - ({" + ".join(c[:nc - 2])}) AS c{nc - 1},
             {", ".join(f"CAST(len(list_filter(low, lambda x: x = '{x}')) AS DOUBLE) AS w{i}" for i, x in enumerate(WORD_LIST))} FROM b),
f AS (SELECT *, n_words - ({" + ".join(w[:-1])}) AS w{nw - 1} FROM h),
refs AS (SELECT lang, {sums} FROM f WHERE NOT base_failed AND lang <> '*' GROUP BY lang
         UNION ALL SELECT '*', {sums} FROM f WHERE NOT base_failed),
j AS (SELECT f.*, {js(c)} AS char_js, {js(w)} AS word_js FROM f LEFT JOIN refs ON refs.lang = f.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_js, word_js,
       NOT base_failed AND NOT ((chars >= {MIN_CHARS} AND coalesce(char_js, 0) > {MAX_CHAR_JS})
                                OR (n_words >= {MIN_WORDS} AND coalesce(word_js, 0) > {MAX_WORD_JS} + {WORD_NOISE} / sqrt(n_words))) AS kept FROM j"""


SQL["op2_quality_rules"] = _quality()

# formatted_chars: texts, one backslash for each escaped control string, and the markers of each block of one role
SQL["op9_chat"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE)\]|SEP\])')) AS n,
             length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE)\]|SEP\])')) AS nr,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 WHEN role = 'user' THEN 13 WHEN role = 'system' THEN 11
                         WHEN role = 'assistant' THEN 7 ELSE 18 + nr END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

SQL["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_WS = r"[ \t\n\x0B\f\r]"
SQL["op4_sentence_spans"] = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?s).+?(?:[.!?]{_WS}+|\n{_WS}*|\z)') AS p FROM documents),
s AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS sentence FROM d),
c AS (SELECT *, regexp_extract_all(sentence, '{_WS}*[^ \t\n\x0B\f\r]+{_WS}*') AS t FROM s),
-- long sentences: word by word, and of every {WINDOW} words the one with the smallest hash, ties the last
w AS (SELECT doc_id, i, sentence, t, unnest(range(len(t))) AS k, unnest(t) AS chunk FROM c WHERE len(t) >= {WINDOW}),
m AS (SELECT doc_id, i, k, len(t) AS n, min(struct_pack(h := substr(md5(lower(regexp_replace(chunk, '{_WS}', '', 'g'))), 1, 10), o := -k))
             OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS least FROM w),
e AS (SELECT DISTINCT doc_id, i, -least.o AS k FROM m WHERE k <= n - {WINDOW} UNION SELECT DISTINCT doc_id, i, n - 1 FROM m),
b AS (SELECT doc_id, i, k, coalesce(lag(k) OVER (PARTITION BY doc_id, i ORDER BY k), -1) AS before FROM e),
x AS (SELECT doc_id, i, -1 AS k, sentence AS piece FROM c WHERE len(t) < {WINDOW}
      UNION ALL SELECT b.doc_id, b.i, b.k, array_to_string(c.t[b.before + 2:b.k + 1], '') FROM b JOIN c ON c.doc_id = b.doc_id AND c.i = b.i),
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS i, piece,
             array_to_string(list_filter(string_split_regex(lower(piece), '{_WS}+'), lambda v: v <> ''), ' ') AS norm,
             len(list_filter(string_split_regex(piece, '{_WS}+'), lambda v: v <> '')) AS n FROM x),
z AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM q),
l AS (SELECT doc_id, list(norm ORDER BY i) AS norms FROM q GROUP BY doc_id),
r AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM z a JOIN z b ON b.doc_id = a.doc_id AND b.i >= a.i + {RUN - 1}
             AND b.upto - a.upto + a.n >= {MIN_RUN_WORDS} GROUP BY a.doc_id, a.i
      UNION SELECT b.doc_id, max(a.i), b.i FROM z a JOIN z b ON b.doc_id = a.doc_id AND b.i >= a.i + {RUN - 1}
             AND b.upto - a.upto + a.n >= {MIN_RUN_WORDS} GROUP BY b.doc_id, b.i),
k AS (SELECT r.doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(norms[a:b], chr(10)) ORDER BY r.doc_id, a) AS rk
      FROM r JOIN l ON l.doc_id = r.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM k WHERE rk > 1),
f AS (SELECT q.doc_id, string_agg(piece, '' ORDER BY q.i) FILTER (gone.i IS NULL) AS kept, count(*) AS n_pieces, count(gone.i) AS n_removed
      FROM q LEFT JOIN gone ON gone.doc_id = q.doc_id AND gone.i = q.i GROUP BY q.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(f.n_removed, 0) = 0 THEN d.text ELSE coalesce(f.kept, '') END AS text,
       coalesce(f.n_pieces, 0) AS n_pieces, coalesce(f.n_removed, 0) AS n_removed
FROM d LEFT JOIN f ON f.doc_id = d.doc_id"""


def _secrets() -> str:
    """Spans from the texts between matches; no index, every rule over every text."""
    parts = []
    for o, rule in enumerate((*BASE, *MORE)):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, '{rule.kind}' AS kind, {o} AS ord, pos - length(hit) AS start, pos AS stop, length(value) AS size, {max(1, rule.min_length)} AS least
FROM (SELECT doc_id, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS pos
      FROM (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[:len(hits)]) AS gap
            FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits,
                         regexp_extract_all(text, '{pattern}', {rule.group}) AS vals, string_split_regex(text, '{pattern}') AS gaps
                  FROM documents WHERE text IS NOT NULL)))""")
    line = "string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, ord)"
    return f"""
WITH s AS ({" UNION ALL ".join(parts)}),
m AS (SELECT * FROM s WHERE size >= least)
SELECT d.doc_id, {", ".join(f"count(m.kind) FILTER (m.kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
       sha256(coalesce({line} FILTER (m.ord < {len(BASE)}), '')) AS base_sha256, coalesce({line}, '') AS spans
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""


SQL["op7_secrets"] = _secrets()


def _urls() -> str:
    """Reputation by level, each with the strength that its own spread gives."""
    from batchtrace.llm.queries import URL_RULES
    from batchtrace.llm.urls import DEVIATIONS, MAX_BAD, MAX_STRENGTH, MIN_STRENGTH, SUFFIXES
    two = " ".join(f"WHEN ends_with(name, '.{s}') THEN '{s}'" for s in SUFFIXES)
    least, most = 1 / (MAX_STRENGTH + 1), 1 / (MIN_STRENGTH + 1)

    def level(name: str, rows: str) -> str:
        return f"""
{name}_in AS ({rows}),
{name}_s AS (SELECT 1 / least(greatest(coalesce(CASE WHEN room > 0 THEN over / room END, {least}), {least}), {most}) - 1 AS s
    FROM (SELECT sum(pow(bad - seen * prior, 2) / seen - prior * (1 - prior)) FILTER (seen > 0) AS over,
                 sum(prior * (1 - prior) * (seen - 1)) FILTER (seen > 0) AS room FROM {name}_in)),
{name} AS (SELECT *, prior * s + bad AS alpha, (prior * s + bad) / (s + seen) AS mean, s + seen AS size FROM {name}_in, {name}_s)"""

    rules = sorted(URL_RULES, key=lambda r: -len("".join(r[1])))
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, (h, p) in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for _, r, f in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for v, _, f in fits) + " END"
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name, count(l.bad) AS seen,
             coalesce(sum(l.bad), 0) AS bad FROM p LEFT JOIN l ON l.doc_id = p.page_id GROUP BY host),
u AS (SELECT *, CASE {two} ELSE string_split(name, '.')[-1] END AS suffix FROM h),
hosts AS (SELECT *, CASE WHEN length(name) <= length(suffix) + 1 OR regexp_matches(name, '^[0-9.]+$|^\[') THEN name
                         ELSE string_split(left(name, length(name) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS domain FROM u),
domains AS (SELECT domain, suffix, sum(seen) AS seen, sum(bad) AS bad FROM hosts GROUP BY ALL),
tops AS (SELECT suffix, sum(seen) AS seen, sum(bad) AS bad FROM domains GROUP BY ALL),
{level("t", "SELECT *, ((SELECT sum(bad) FROM tops) - bad + 0.5) / ((SELECT sum(seen) FROM tops) - seen + 1) AS prior FROM tops")},
{level("d", "SELECT domains.*, (t.alpha - domains.bad) / (t.size - domains.seen) AS prior FROM domains JOIN t USING (suffix)")},
{level("r", "SELECT hosts.host, hosts.seen, hosts.bad, (d.alpha - hosts.bad) / (d.size - hosts.seen) AS prior FROM hosts JOIN d USING (domain)")}
SELECT p.page_id, p.host, p.path, {rule.replace("host ", "p.host ").replace("(host,", "(p.host,").replace("(path,", "(p.path,")} AS rule,
       coalesce({says.replace("host ", "p.host ").replace("(host,", "(p.host,").replace("(path,", "(p.path,")},
                CASE WHEN r.mean - {DEVIATIONS} * sqrt(r.mean * (1 - r.mean) / (r.size + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN r ON r.host = p.host"""


SQL["op11_url_filter"] = _urls()

SQL["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
             CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
            AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5"""
