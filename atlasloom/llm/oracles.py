"""SQL for DuckDB that computes what some of the corpus queries return, each by its plain definition."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS
from .url_filter import ANY, DEPTH, IMPURE, PRIOR, SPREAD, SUPPORT, Z
from .url_filter import RULES as URL_RULES

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COMPACTION = "SELECT doc_id, CAST(doc_id % 12 AS INTEGER) AS arrival, md5(text) AS text_md5, lang, source, n_chars FROM documents"

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON a = n.doc_id GROUP BY n.doc_id, n.n"""


def _rule(name: str, value: str, low: float | None, high: float | None) -> str:
    outside = [f"{value} < {low}"] * (low is not None) + [f"{value} > {high}::DOUBLE"] * (high is not None)
    return f"CASE WHEN {' OR '.join(outside)} THEN '{name}' END"


def quality() -> str:
    per = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END"
    values = {
        "words": "n_words",
        "repeated words": per("n_repeat_words", "n_words"),
        "mean word length": per("word_chars", "n_words"),
        "symbols to words": per("n_symbols", "n_words"),
        "repeated lines": per("n_dup_lines", "n_lines"),
        "stop words": per("n_stop_words", "n_words"),
    }
    broken = ", ".join(_rule(r.name, values[r.name], r.low, r.high) for r in RULES)
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM d JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(', ', {broken}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules FROM j"""


def urls() -> str:
    """The template tree level by level, down and up."""
    number = "TRY_CAST(regexp_extract(url, '/([0-9]{1,18})(?:[.]html)?/?(?:[?#].*)?$', 1) AS BIGINT)"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
    ending = r"regexp_extract(s, '(\.[A-Za-z][A-Za-z0-9]{0,4})$', 1)"
    stem = r"regexp_replace(s, '\.[A-Za-z][A-Za-z0-9]{0,4}$', '')"
    # RE2 has no lookahead: a long mixed id is one with a digit in it.
    typed = rf"CASE WHEN regexp_matches({stem}, '^[0-9][0-9_\-]*$|^[0-9a-fA-F\-]{{12,}}$') OR (regexp_matches({stem}, '^[A-Za-z0-9_\-]{{16,}}$') AND regexp_matches({stem}, '[0-9]')) THEN '{ANY}' || {ending} ELSE s END"
    ctes = [
        f"marks AS (SELECT page_id, max(bad) AS bad FROM (SELECT page_id, CAST(quality = 0 AS INTEGER) AS bad FROM pages JOIN labels ON doc_id = {number}) WHERE bad IS NOT NULL GROUP BY page_id)",
        f"parsed AS (SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT page_id, {rest} AS r FROM pages))",
        f"t0 AS (SELECT host, path, count(*) AS n, count(bad) AS seen, coalesce(sum(bad), 0) AS bad, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {typed})[1:{DEPTH}] AS t FROM parsed LEFT JOIN marks USING (page_id) GROUP BY host, path)",
    ]
    for k in range(DEPTH):
        ctes += [
            f"node{k} AS (SELECT host, t[1:{k}] AS head, t[{k + 1}] AS seg, sum(n) AS n FROM t{k} WHERE len(t) > {k} GROUP BY ALL)",
            f"rare{k} AS (SELECT host, head, seg, true AS rare FROM node{k} JOIN (SELECT host, head, sum(n)::DOUBLE / count(*) AS spread FROM node{k} GROUP BY ALL) USING (host, head) WHERE (n < {SUPPORT} OR spread < {SPREAD}) AND NOT starts_with(seg, '{ANY}'))",
            f"t{k + 1} AS (SELECT a.* EXCLUDE (t), CASE WHEN rare THEN a.t[1:{k}] || ['{ANY}'] || a.t[{k + 2}:] ELSE a.t END AS t FROM t{k} a LEFT JOIN rare{k} r ON a.host = r.host AND a.t[1:{k}] = r.head AND a.t[{k + 1}] = r.seg)",
        ]
    ctes.append(f"m{DEPTH} AS (SELECT host, t, t AS u, sum(seen) AS seen, sum(bad) AS bad FROM t{DEPTH} GROUP BY host, t)")
    for k in reversed(range(DEPTH)):
        ctes += [
            f"b{k} AS (SELECT host, u, sum(seen) AS s, sum(bad) AS b, CASE WHEN len(u) > {k} THEN u[1:{k}] || ['{ANY}'] || u[{k + 2}:] ELSE u END AS key FROM m{k + 1} GROUP BY host, u)",
            f"p{k} AS (SELECT *, sum(s) OVER (PARTITION BY host, key) AS ps, sum(b) OVER (PARTITION BY host, key) AS pb FROM b{k})",
            f"z{k} AS (SELECT *, (pb + 0.5::DOUBLE) / (ps + 1.0::DOUBLE) AS p FROM p{k})",
            f"mv{k} AS (SELECT host, u, CASE WHEN s > 0 AND ps - s > 0 AND abs((b::DOUBLE / s - (pb - b)::DOUBLE / (ps - s)) / sqrt(p * (1 - p) * (1::DOUBLE / s + 1::DOUBLE / (ps - s)))) >= {Z} THEN u ELSE key END AS moved FROM z{k})",
            f"m{k} AS (SELECT m.host, m.t, moved AS u, seen, bad FROM m{k + 1} m JOIN mv{k} v ON m.host = v.host AND m.u = v.u)",
        ]
    ctes.append(f"judged AS (SELECT host, u, (sum(bad) + {PRIOR} * (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(seen), 0), 0) FROM m0)) / (sum(seen) + {PRIOR}) AS impurity FROM m0 GROUP BY host, u)")
    fits = []
    for said, text in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        own, start = text.split("/", 1)
        fits.append((f"(p.host = '{own}' OR ends_with(p.host, '.{own}')) AND starts_with(p.path, '/{start}')", text, said))
    case = lambda k, other: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + f" ELSE {other} END"
    verdict = case(2, f"CASE WHEN impurity >= {IMPURE} THEN 'block' ELSE 'allow' END")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, p.host, p.path, {case(1, 'NULL')} AS rule, {verdict} AS verdict, '/' || array_to_string(m.u, '/') AS template, impurity "
        f"FROM parsed p JOIN t{DEPTH} l ON p.host = l.host AND p.path = l.path JOIN m0 m ON m.host = l.host AND m.t = l.t JOIN judged j ON j.host = m.host AND j.u = m.u"
    )


ORACLES = {
    "op3_embedding_dedup": EMBEDDINGS,
    "op4_quality_rules": quality(),
    "op5_compaction": COMPACTION,
    "op6_url_filter": urls(),
    "op10_ngram_jaccard": JACCARD,
}
