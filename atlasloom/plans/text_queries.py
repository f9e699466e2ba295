"""Queries over label text and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import scores as sc
from ..functions import text as t
from ..functions.lexicon import ALIASES, CONTEXT, PHRASES
from ..operators import dictionary as d
from ..operators import repair as rp
from ..operators.overlap import joined_tokens, shared_tokens
from .registry import query
from .text_sql import all_sql, collapse_sql, fold_sql, has, q, slug_sql, strip_admin_sql, strip_sql, upper_sql
from .views import AREAS, LINES, NAMES, WORDS, areas, by_id, lines, names, names_of, table, words, words_of


def _any(parts) -> str:
    return "(?:" + "|".join(parts) + ")"


def _in(c: str, values) -> str:
    return f"{c} IN (" + ", ".join(map(q, values)) + ")"


KNOWN = lambda c: "(" + f"{c} <> '' AND " + _in(fold_sql(c), sorted({*p.COMMON_WORDS, *p.CONTEXT_WORDS})) + ")"
MARKED = lambda c: has(c, t.MARK)
LISTED = lambda c: has(f"lower({c})", f"[{t.MARKED}]")
DIGIT = lambda c: has(c, r"\p{Nd}")


@query(f"SELECT doc_id, line_no, {fold_sql('line')} AS folded FROM lines", LINES)
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", t.fold(F.col("line")).alias("folded"))


@query(f"SELECT doc_id, line_no, CAST(len({all_sql('line', t.TOKEN)}) AS INTEGER) AS n, array_to_string(list_transform({all_sql('line', t.TOKEN)}, lambda w: {fold_sql('w')}), ' ') AS tokens, CAST(len({all_sql(fold_sql('line'), '[a-z0-9]+')}) AS INTEGER) AS n_ascii FROM lines", LINES)
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "line_no", F.size(t.tokens(line)).alias("n"), F.array_join(t.folded_tokens(line), " ").alias("tokens"), F.size(t.ascii_tokens(line)).alias("n_ascii"))


@query(f"SELECT doc_id, \"at\", {slug_sql('word')} AS slug FROM words", WORDS)
def text_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "at", t.slugify(F.col("word")).alias("slug"))


@query(f"SELECT area_no, {slug_sql('province')} || '/' || {slug_sql('district')} AS key, {strip_admin_sql('district')} AS bare FROM areas", AREAS)
def area_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).select("area_no", t.centre_key(F.col("province"), F.col("district")).alias("key"), t.strip_admin_prefix(F.col("district")).alias("bare"))


@query(f"SELECT doc_id, name_no, regexp_replace({fold_sql('label')}, '[^a-z0-9]+', '', 'g') AS name_key, regexp_replace({fold_sql('label')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS clean_name FROM names", NAMES)
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", t.name_key(F.col("label")).alias("name_key"), t.clean_name(F.col("label")).alias("clean_name"))


@query(f"SELECT doc_id, \"at\", CASE WHEN {upper_sql('word')} THEN upper('Chợ bến') WHEN regexp_matches(word, '^\\p{{Ll}}') THEN 'chợ bến' ELSE 'Chợ bến' END AS cased FROM words", WORDS)
def match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "at", t.match_case(F.col("word"), F.lit("Chợ bến")).alias("cased"))


_PAIRS = "pairs AS (SELECT a.doc_id, a.\"at\", a.word AS l, b.word AS r FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.\"at\" = a.\"at\" + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return w.select("doc_id", "at", F.col("word").alias("l")).join(w.select("doc_id", (F.col("at") - 1).alias("at"), F.col("word").alias("r")), ["doc_id", "at"])


@query(
    f"SELECT doc_id, \"at\", CASE WHEN l = r THEN l WHEN m > 0 THEN r WHEN m < 0 THEN l WHEN regexp_matches(r, '^\\p{{Lu}}') AND NOT regexp_matches(l, '^\\p{{Lu}}') THEN r ELSE l END AS better FROM (SELECT *, len({all_sql('r', t.MARK)}) - len({all_sql('l', t.MARK)}) AS m FROM pairs)",
    WORDS,
    _PAIRS,
)
def better_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all neighbouring words the better spelling."""
    return _pairs(spark, sf_dir).select("doc_id", "at", t.better_duplicate(F.col("l"), F.col("r")).alias("better"))


@query()
def latin_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of all neighbouring words in letters, folded. DuckDB's counts bytes, so a test has a plain one."""
    return _pairs(spark, sf_dir).select("doc_id", "at", t.latin_distance(t.fold(F.col("l")), t.fold(F.col("r"))).alias("distance"))


@query(
    f"SELECT doc_id, line_no, {collapse_sql('regexp_replace(line, ' + q(r'[^A-Za-zÀ-ỹĐđ0-9\s/&.,%+' + chr(39) + r'()\-–—]') + ', chr(32), chr(103))')} AS latin FROM lines",
    LINES,
)
def keep_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", t.keep_latin(F.col("line")).alias("latin"))


_RATING = r"^.*?\([0-9]+(?:[.,][0-9]+)?\s*[KkM]?[+-]?\)\s*(?:[-·•*]\s*)?"


@query(f"SELECT doc_id, name_no, regexp_replace(label, {q(_RATING)}, '') AS name FROM names", NAMES)
def rating_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", t.strip_rating_prefix(F.col("label")).alias("name"))


def _tail(c: str) -> str:
    one = strip_sql(f"regexp_replace({c}, " + q(r"\s+[0-9]+(?:[.,][0-9]+)?\s*\(\s*[0-9]+\s*\)\s*$") + ", '')")
    return strip_sql(f"regexp_replace({one}, " + q(r"(?i)\s+(?:open|closed)\s+[0-9]{1,2}(?::|\s)[0-9]{2}\s*(?:am|pm)?\s*$") + ", '')")


_NOTED = "CASE doc_id % 4 WHEN 0 THEN label || ' 4,5 ( 12 ) ' WHEN 1 THEN label || ' Open 10:30 PM' WHEN 2 THEN label || ' closed 9 00 4.5 (3)' ELSE label END"


@query(f"SELECT doc_id, name_no, {_tail('noted')} AS name FROM (SELECT doc_id, name_no, {_NOTED} AS noted FROM names)", NAMES)
def tail_notes_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    note = F.when(k == 0, " 4,5 ( 12 ) ").when(k == 1, " Open 10:30 PM").when(k == 2, " closed 9 00 4.5 (3)").otherwise("")
    return names(spark, sf_dir).select("doc_id", "name_no", t.strip_tail_notes(F.concat("label", note)).alias("name"))


@query(f"SELECT doc_id, name_no, {collapse_sql('string_split(label, ' + q(' / ') + ')[1]')} AS main, {collapse_sql('array_to_string(string_split(label, ' + q(' / ') + ')[2:], ' + q(' / ') + ')')} AS sub FROM names", NAMES)
def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, sub = t.split_name(F.col("label"))
    return names(spark, sf_dir).select("doc_id", "name_no", main.alias("main"), sub.alias("sub"))


@query(f"SELECT doc_id, line_no, CASE WHEN x = '' THEN 'Unknown' ELSE x END AS file FROM (SELECT doc_id, line_no, {strip_sql('replace(regexp_replace(line, ' + q(chr(91) + chr(92) * 2 + '/*?:' + chr(34) + '<>|' + chr(93)) + ', chr(39)[0:0], chr(103)), chr(32), chr(95))')} AS x FROM lines)", LINES)
def safe_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", t.safe_file_name(F.col("line")).alias("file"))


def _junk_line(s: str = "s", plain: str = "plain") -> str:
    digits = f"len({all_sql(plain, '[0-9]')})"
    tests = [
        has(s, r"^\p{Nd}+(\.\p{Nd}+)?\s*\(\p{Nd}+\)$|^\(\p{Nd}+\)$|^\p{Nd}+(\.\p{Nd}+)?$|^\p{Nd}+(\.\p{Nd}+)?%\s*\(\p{Nd}+\)|^\p{Nd}+(\.\p{Nd}+)?\s*\(\p{Nd}+\)\s*-\s*"),
        has(s, r"\p{Nd}{5,}|^0{3,}"),
        f"{plain} = ''",
        f"({digits} >= 4 AND {digits}::DOUBLE / length({plain}) > 0.65 AND (length({plain}) - {digits})::DOUBLE / length({plain}) < 0.2)",
        has(plain, f"(?i)^{_any(p.JUNK_HEADS)}{_any(p.JUNK_TAILS)}?$"),
        has(f"lower({plain})", "^dis[a-z]{3,}(?:ness|tess|cess|erian|minery)$"),
        "(" + has(f"lower({plain})", "^[a-z]{5,}(?:ness|tess|cess)$") + " AND NOT " + _in(f"lower({plain})", p.NOT_JUNK) + ")",
        _in(f"lower({plain})", p.JUNK_WORDS),
        "(" + has(f"lower({plain})", "[a-z][0-9]{2,}[a-z]") + f" AND length({plain}) >= 5)",
    ]
    return "(" + " OR ".join(tests) + ")"


@query(f"SELECT doc_id, line_no, {_junk_line()} AS junk FROM (SELECT doc_id, line_no, {strip_sql('line')} AS s, regexp_replace({strip_sql('line')}, '[^a-zA-Z0-9]', '', 'g') AS plain FROM lines)", LINES)
def junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", p.junk_line(F.col("line")).alias("junk"))


def _junk_word(w: str) -> str:
    plain = f"regexp_replace({w}, '[^a-zA-Z0-9]', '', 'g')"
    tests = [
        has(plain, "[0-9]{4,}|^0{3,}"),
        has(plain, f"(?i)^{_any([*p.JUNK_HEADS, *p.MORE_HEADS])}{_any([*p.JUNK_TAILS, *p.MORE_TAILS])}+$"),
        _in(f"lower({plain})", p.JUNK_WORDS),
        "(" + has(f"lower({plain})", "[a-z][0-9]{2,}[a-z]") + f" AND length({plain}) >= 5)",
    ]
    return "(" + " OR ".join(tests) + ")"


_KEPT = f"array_to_string(list_filter({all_sql('line', chr(92) + 'S+')}, lambda w: NOT {_junk_word('w')}), ' ')"


@query(f"SELECT doc_id, line_no, {strip_sql('regexp_replace(' + _KEPT + ', ' + q(r'^[\s,\-/]+|[\s,\-/]+$') + ', chr(39)[0:0], chr(103))')} AS cleaned FROM lines", LINES)
def junk_words_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", p.clean_junk_words(F.col("line")).alias("cleaned"))


def _junk_token(w: str, edge: str) -> str:
    key = fold_sql(w)
    sound = f"{KNOWN(w)} OR {_in(key, p.ADMIN_KEYS)} OR {DIGIT(w)} OR {MARKED(w)} OR ({upper_sql(w)} AND length({w}) BETWEEN 2 AND 6)"
    vowels = f"len({all_sql(key, '[aeiouy]')})::DOUBLE / greatest(1, len({all_sql(key, chr(92) + 'p{L}')}))"
    noise = (
        f"({edge} AND length({w}) <= 1 AND NOT {has(w, '^' + chr(92) + 'p{Lu}')}) OR (length({key}) >= 7 AND {has(key, _any(p.TOKEN_TAILS) + '$')}) OR {_in(key, p.TOKEN_JUNK)} "
        f"OR (length({key}) >= 8 AND NOT {has(w, '^' + chr(92) + 'p{Lu}')} AND {has(key, chr(92) + 'p{L}')} AND {vowels} < 0.25)"
    )
    return f"({w} = '' OR (NOT ({sound}) AND ({noise})))"


@query(f"SELECT doc_id, \"at\", {_junk_token('word', chr(34) + 'at' + chr(34) + ' % 2 = 0')} AS junk FROM words", WORDS)
def junk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "at", p.junk_token(F.col("word"), F.col("at") % 2 == 0).alias("junk"))


_CAPITAL = lambda w: f"({has(w, '^' + chr(92) + 'p{Lu}')} OR {upper_sql(w)})"
_SEGS = "segs AS (SELECT doc_id, \"at\", CASE WHEN \"at\" % 3 = 0 THEN word ELSE word || ' shop' END AS seg FROM words)"


def _segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "at", F.when(F.col("at") % 3 == 0, F.col("word")).otherwise(F.concat("word", F.lit(" shop"))).alias("seg"))


_W = all_sql("seg", t.TOKEN_AMP)


@query(
    f"SELECT doc_id, \"at\", len({_W}) <= 5 AND len(list_filter({_W}, lambda w: {DIGIT('w')} OR {MARKED('w')})) = 0 AND len(list_filter({_W}, lambda w: {_in(fold_sql('w'), p.CATEGORY_HEADS)})) > 0 AND len(list_filter({_W}, lambda w: {_CAPITAL('w')})) <= 1 AS category FROM segs",
    WORDS,
    _SEGS,
)
def category_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segs(spark, sf_dir).select("doc_id", "at", p.category_segment(F.col("seg")).alias("category"))


def _bad(c: str) -> str:
    low, w = fold_sql(c), all_sql(c, t.TOKEN_PLAIN)
    first = f"coalesce({w}[1], '')"
    key = fold_sql(first)
    one = f"(len({w}) = 1 AND NOT {KNOWN(first)} AND NOT {MARKED(first)} AND NOT {DIGIT(first)} AND length({key}) >= 6 AND ({has(first, '[a-z][A-Z]')} OR ({has(key, '^' + _any(p.ARTIFACT_HEADS))} AND {has(key, _any(p.ARTIFACT_TAILS) + '$')})))"
    few = f"(len({w}) BETWEEN 1 AND 2 AND NOT {DIGIT(c)} AND len({all_sql(low, chr(92) + 'p{L}')}) > 0 AND len({all_sql(low, '[' + p.VOWELS + ']')})::DOUBLE / greatest(1, len({all_sql(low, chr(92) + 'p{L}')})) < 0.28)"
    return f"(length(regexp_replace({c}, '[^A-Za-zÀ-ỹ0-9]', '', 'g')) <= 4 OR {has(low, '|'.join(p.BAD_PARTS))} OR {one} OR {few})"


@query(f"SELECT doc_id, \"at\", {_bad('seg')} AS bad FROM segs", WORDS, _SEGS)
def bad_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segs(spark, sf_dir).select("doc_id", "at", p.bad_ocr(F.col("seg")).alias("bad"))


_FIRST = f"coalesce({_W}[1], '')"


@query(
    f"SELECT doc_id, \"at\", len({_W}) = 0 OR (len({_W}) = 1 AND (({has(_FIRST, chr(92) + 'p{L}')} AND {DIGIT(_FIRST)} AND NOT {MARKED(_FIRST)} AND NOT {upper_sql(_FIRST)}) OR ({_bad(_FIRST)} AND NOT {KNOWN(_FIRST)}))) AS dropped FROM segs",
    WORDS,
    _SEGS,
)
def dropped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segs(spark, sf_dir).select("doc_id", "at", p.drop_name(F.col("seg")).alias("dropped"))


_BRAND = lambda w: f"({w} = '' OR {DIGIT(w)} OR ({upper_sql(w)} AND length({w}) >= 2 AND {w} <> 'TP') OR (NOT {LISTED(w)} AND {has(w, '^[A-Z][A-Za-z]{6,}$')}))"


@query(
    f"SELECT doc_id, \"at\", {_BRAND('word')} AS brand, {LISTED('word')} AS listed_mark, {MARKED('word')} AS marked, {has('lower(word)', '[ăằắẳẵặâầấẩẫậêềếểễệôồốổỗộơờớởỡợưừứửữự]')} AS shaped, "
    f"NOT {_BRAND('word')} AND {has('word', '^[A-Za-zÀ-ỹĐđ]{3,}$')} AND NOT {upper_sql('word')} AND ({LISTED('word')} OR {has('word', '^' + chr(92) + 'p{Ll}')}) AS correctable FROM words",
    WORDS,
)
def brand_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return words(spark, sf_dir).select("doc_id", "at", p.brand_token(w).alias("brand"), t.has_listed_mark(w).alias("listed_mark"), t.has_mark(w).alias("marked"), t.has_shaped_vowel(w).alias("shaped"), p.correctable(w).alias("correctable"))


_L = all_sql("label", t.TOKEN)


@query(
    f"SELECT doc_id, name_no, len(list_filter({_L}, lambda w: {upper_sql('w')} AND length(w) >= 2)) > 0 OR len(list_filter({_L}, lambda w: {has('w', '^' + chr(92) + 'p{Lu}')} AND NOT {MARKED('w')} AND length(w) >= 5)) >= 2 AS sensitive, "
    f"len({_L}) = 0 OR len(list_filter({_L}, lambda w: {DIGIT('w')})) > 0 OR (len(list_filter({_L}, lambda w: {upper_sql('w')} AND length(w) > 1)) > 0 AND len(list_filter({_L}, lambda w: w <> 'TP')) > 0) AS brand FROM names",
    NAMES,
)
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", p.brand_sensitive(F.col("label")).alias("sensitive"), p.brand_tokens(t.tokens(F.col("label"))).alias("brand"))


@query(
    f"SELECT doc_id, \"at\", length({fold_sql('word')}) BETWEEN 4 AND 7 AND NOT {MARKED('word')} AND NOT {DIGIT('word')} AND NOT {upper_sql('word')} AND (len({all_sql(fold_sql('word'), '[aeiouy]')})::DOUBLE / length({fold_sql('word')}) < 0.45 OR {has(fold_sql('word'), '[qxz]$|rx$')}) AS suspicious FROM words",
    WORDS,
)
def suspicious_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "at", p.suspicious_short(F.col("word")).alias("suspicious"))


_P = all_sql("seg", t.TOKEN_PLAIN)
_PF = f"coalesce({_P}[1], '')"


@query(
    f"SELECT doc_id, \"at\", len({_P}) >= 2 OR (len({_P}) = 1 AND ({has(_PF, '[À-ỹ]')} OR {DIGIT(_PF)} OR ({upper_sql(_PF)} AND length({_PF}) BETWEEN 2 AND 6))) AS strong, "
    f"len({_P}) = 1 AND (length({fold_sql(_PF)}) <= 3 OR (NOT {has(_PF, '[À-ỹ]|' + chr(92) + 'p{Nd}')} AND (({has(_PF, '^' + chr(92) + 'p{Ll}')} AND length({fold_sql(_PF)}) >= 5) OR ({has(_PF, '^' + chr(92) + 'p{Lu}')} AND lower({_PF}[2:]) = {_PF}[2:] AND length({fold_sql(_PF)}) >= 8 AND ends_with({fold_sql(_PF)}, 'iness')) OR ({upper_sql(_PF)} AND length({fold_sql(_PF)}) > 6)))) AS weak FROM segs",
    WORDS,
    _SEGS,
)
def edge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segs(spark, sf_dir).select("doc_id", "at", p.strong_segment(F.col("seg")).alias("strong"), p.weak_edge_segment(F.col("seg")).alias("weak"))


@query()
def edge_segments_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", p.clean_edge_segments(F.col("label")).alias("cleaned"), p.junk_token_count(F.col("label")).alias("n_junk"))


_TONE = " + ".join(f"{score} * len({all_sql('lower(word)', '[' + chars + ']')})" for chars, score in sc.TONES)


@query(f"SELECT doc_id, \"at\", CAST({_TONE} AS INTEGER) AS tone FROM words", WORDS)
def tone_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "at", sc.tone_preference(F.col("word")).alias("tone"))


def _artifacts(s: str) -> str:
    n = lambda w, pattern: f"{w} * len({all_sql(s, pattern)})"
    dashes = f"2 * len(list_filter(range(2, length({s})), lambda i: regexp_matches({s}[i], '[-–—]') AND regexp_matches({s}[i - 1], '[\\p{{L}}\\p{{N}}_]') AND regexp_matches({s}[i + 1], '[\\p{{L}}\\p{{N}}_]')))"
    w = all_sql("g", t.TOKEN_PLAIN)
    heavy = f"list_sum(list_transform({w}, lambda v: CASE WHEN {DIGIT('v')} THEN 0 ELSE CASE WHEN length(v) >= 6 AND len({all_sql('v', t.MARK)}) >= 2 AND {has('v', '^' + chr(92) + 'p{Ll}')} THEN 4 ELSE 0 END + CASE WHEN length(v) >= 7 AND len({all_sql('v', t.MARK)}) >= 3 THEN 5 ELSE 0 END END))"
    of = f"CASE WHEN len({w}) > 1 AND length({w}[1]) = 1 THEN 2 ELSE 0 END + CASE WHEN len({w}) > 1 AND length({w}[-1]) = 1 THEN 1 ELSE 0 END + coalesce({heavy}, 0)"
    parts = f"list_sum(list_transform(regexp_split_to_array({s}, '\\s*/\\s*'), lambda g: {of}))"
    letters = "2 * len(" + all_sql(s, "[0-9][A-Za-zÀ-ỹ]|[A-Za-zÀ-ỹ][0-9]") + ")"
    return " + ".join([n(3, '[?#*"“”]'), n(2, r"[():;]"), dashes, letters, n(1, r"[^\p{L}\p{N}_\sÀ-ỹ/&.,%+'\-–—]"), f"coalesce({parts}, 0)"])


@query(f"SELECT doc_id, name_no, CAST({_artifacts('label')} AS INTEGER) AS score FROM names", NAMES)
def artifact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", sc.artifact_score(F.col("label")).alias("score"))


def _bag(name: str, keys: str, c: str, source: str) -> str:
    folded = f"list_transform({all_sql(c, t.TOKEN)}, lambda w: {fold_sql('w')})"
    return f"{name} AS (SELECT {keys}, size, token, count(*) AS n FROM (SELECT {keys}, len(w) AS size, unnest(w) AS token FROM (SELECT {keys}, {folded} AS w FROM {source})) GROUP BY ALL)"


@query(
    "SELECT doc_id, name_no, item_id, round(2.0::DOUBLE * sum(least(a.n, b.n)) / (a.size + b.size), 6) AS f1 FROM a JOIN b ON a.token = b.token GROUP BY doc_id, name_no, item_id, a.size, b.size",
    NAMES,
    _bag("a", "doc_id, name_no", "label", "names"),
    _bag("b", "item_id", "text", "benchmark"),
)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with every benchmark text that shares a token with it, both whole; all other pairs have 0."""
    once, again = by_id(table(spark, sf_dir, "documents"))
    w = lambda df, c: df.withColumn("w", t.folded_tokens(F.col(c), t.TOKEN))
    b = w(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    both = shared_tokens(w(names_of(once), "label"), ["doc_id", "name_no"], b, "item_id")
    if again is not None:
        both = both.unionByName(joined_tokens(w(names_of(again), "label"), ["doc_id", "name_no"], b, "item_id"))
    return both.select("doc_id", "name_no", "item_id", F.round(2.0 * F.col("shared") / (F.col("size") + F.col("other_size")), 6).alias("f1"))


@query("SELECT c_custkey, CASE WHEN m IS NULL THEN 0.0::DOUBLE WHEN m <= 15 THEN 0.05::DOUBLE WHEN m <= 40 THEN 0.03::DOUBLE WHEN m <= 80 THEN 0.01::DOUBLE ELSE -0.04::DOUBLE END AS score FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 120 END AS m FROM customer)")
def distance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", sc.distance_score(F.when(key % 5 != 0, key % 120)).alias("score"))


_TURNS = (
    "counted AS (SELECT doc_id, count(*) AS n FROM names GROUP BY 1), "
    "turns AS (SELECT doc_id, n, m, unnest(range(greatest(n, m))) AS turn FROM (SELECT c.doc_id, c.n, o.n AS m FROM counted c JOIN counted o ON o.doc_id = c.doc_id + 1)), "
    f"keys AS (SELECT doc_id, name_no, {fold_sql('label')} AS folded, {all_sql(fold_sql('label'), '[a-z0-9]+')} AS w FROM names)"
)


@query(
    "SELECT t.doc_id, turn, a.folded <> '' AND contains(' ' || array_to_string(a.w, ' ') || ' ', ' ' || array_to_string(b.w[1:2], ' ') || ' ') AS contains, len(list_intersect(a.w, b.w)) = 0 AS unrelated "
    "FROM turns t JOIN keys a ON a.doc_id = t.doc_id AND a.name_no = turn % n JOIN keys b ON b.doc_id = t.doc_id + 1 AND b.name_no = turn % m WHERE len(a.w) > 0 AND len(b.w) > 0",
    NAMES,
    _TURNS,
)
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of neighbouring documents, side by side; the shorter list starts again until the longer one ends."""
    n = names(spark, sf_dir)
    counts = n.groupBy("doc_id").agg(F.count("*").alias("n"))
    turns = counts.join(counts.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m")), "doc_id")
    turns = turns.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("n", "m") - 1)))
    turns = turns.select("doc_id", "turn", (F.col("turn") % F.col("n")).alias("name_no"), (F.col("turn") % F.col("m")).alias("other_no"))
    b = n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name_no").alias("other_no"), F.col("label").alias("other"))
    both = turns.join(n, ["doc_id", "name_no"]).join(b, ["doc_id", "other_no"]).where((F.size(t.ascii_tokens(F.col("label"))) > 0) & (F.size(t.ascii_tokens(F.col("other"))) > 0))
    return both.select("doc_id", "turn", t.contains_run(t.ascii_tokens(F.col("label")), F.slice(t.ascii_tokens(F.col("other")), 1, 2)).alias("contains"), t.unrelated(F.col("label"), F.col("other")).alias("unrelated"))


@query(f"SELECT doc_id, \"at\", word, {fold_sql('word')} IN (SELECT unnest(list_transform({all_sql('text', t.TOKEN_AMP)}, lambda w: {fold_sql('w')})) FROM benchmark) AS is_known FROM words", WORDS)
def known_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = d.known_tokens(table(spark, sf_dir, "benchmark"), "text")
    return d.with_known(words(spark, sf_dir), known)


_LEADS = lambda k: "[" + ", ".join(["word", *(f'lead(word, {i}) OVER (PARTITION BY doc_id ORDER BY \"at\")' for i in range(1, k))]) + "]"
_MARKS = f"len(list_filter(g, lambda w: {LISTED('w')}))"


@query(
    f"SELECT key, arg_max(spelling, (marks, -o, -n, -i)) AS spelling, CAST(max(marks) AS INTEGER) AS marks FROM (SELECT o, n, i, array_to_string(g, ' ') AS spelling, {_MARKS} AS marks, array_to_string(list_transform(g, lambda w: {fold_sql('w')}), ' ') AS key FROM "
    f"(SELECT o, n, i, g[1:n] AS g FROM (SELECT doc_id AS o, \"at\" AS i, {_LEADS(5)} AS g, unnest(range(2, 6)) AS n FROM words) WHERE g[n] IS NOT NULL) WHERE len(list_filter(g, lambda w: {DIGIT('w')})) = 0) WHERE marks > 0 GROUP BY key",
    WORDS,
)
def phrase_ngram_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts: phrases also run from one label into the next."""
    return d.phrase_ngrams(table(spark, sf_dir, "documents"), "text", "doc_id")


#: Words of the test tables renamed to those of the built-in rules, every 5th in capitals.
_RULE_WORDS = ("xe", "sua", "Tho", "hello", "vat", "an", "nuoc", "mia", "Cung", "do", "hanoi", "nha", "hang", "Lam", "ca", "phe", "TP", "Highlands")


def _rename(at, word):
    pick = F.element_at(F.array(*map(F.lit, _RULE_WORDS)), ((F.col("doc_id") * 7 + at * 5 + F.length(word)) % len(_RULE_WORDS) + 1).cast("int"))
    return F.when(at % 2 == 0, F.when((F.col("doc_id") + at) % 5 == 0, F.upper(pick)).otherwise(pick)).otherwise(word)


def _renamed_words(w: DataFrame) -> DataFrame:
    return w.select("doc_id", "at", _rename(F.col("at"), F.col("word")).alias("word"))


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed_words(words(spark, sf_dir))


_LIST = "[" + ", ".join(map(q, _RULE_WORDS)) + "]"
_RENAMED = f"renamed AS (SELECT doc_id, \"at\", CASE WHEN \"at\" % 2 <> 0 THEN word WHEN (doc_id + \"at\") % 5 = 0 THEN upper(x) ELSE x END AS word FROM (SELECT *, {_LIST}[CAST((doc_id * 7 + \"at\" * 5 + length(word)) % {len(_RULE_WORDS)} + 1 AS INTEGER)] AS x FROM words))"
_CASED = lambda w, c: f"CASE WHEN {upper_sql(w)} THEN upper({c}) WHEN {has(w, '^' + chr(92) + 'p{Ll}')} THEN lower({c}[1]) || {c}[2:] ELSE {c} END"
_RULES = "rules(base, spelled, near) AS (VALUES " + ", ".join(f"({q(b)}, {q(s)}, {q(n)})" for b, s, near in CONTEXT for n in near) + ")"


@query(
    f"SELECT DISTINCT w.doc_id, w.\"at\", w.word, CASE WHEN {has('w.word', '^' + chr(92) + 'p{Ll}')} AND {has('coalesce(v.word, chr(32))', '^' + chr(92) + 'p{Lu}')} THEN spelled ELSE {_CASED('w.word', 'spelled')} END AS spelled FROM renamed w JOIN rules ON {fold_sql('w.word')} = base "
    f"JOIN renamed o ON o.doc_id = w.doc_id AND o.\"at\" <> w.\"at\" AND abs(o.\"at\" - w.\"at\") <= 3 AND {fold_sql('o.word')} = near LEFT JOIN renamed v ON v.doc_id = w.doc_id AND v.\"at\" = w.\"at\" - 1 WHERE NOT {_BRAND('w.word')}",
    WORDS,
    _RENAMED,
    _RULES,
)
def contextual_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    once, again = by_id(table(spark, sf_dir, "documents"))
    found = once.select("doc_id", t.tokens(F.col("text")).alias("words"))
    out = d.context_rewrites_within(found.select("doc_id", F.transform("words", lambda w, i: _rename(i, w)).alias("words")))
    return out if again is None else out.unionByName(d.context_rewrites(_renamed_words(words_of(again))))


_ALIAS = "aliases(key, spelled) AS (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in ALIASES.items()) + ")"


@query(
    f"SELECT doc_id, \"at\", word, spelled FROM renamed JOIN aliases ON {fold_sql('word')} = key WHERE NOT {_BRAND('word')} AND doc_id IN (SELECT doc_id FROM renamed GROUP BY doc_id HAVING bool_or({LISTED('word')}) OR count(*) <= 3)",
    WORDS,
    _RENAMED,
    _ALIAS,
)
def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.alias_rewrites(_renamed(spark, sf_dir))


_PHRASES = "phrases(phrase, spelled, n) AS (VALUES " + ", ".join(f"({q(' '.join(s))}, {q(' '.join(x))}, {len(s)})" for s, x in PHRASES) + ")"


@query(
    f"SELECT doc_id, CAST(i AS INTEGER) AS \"at\", phrase, spelled FROM (SELECT doc_id, i, w[1:n] AS g, phrase, spelled FROM (SELECT doc_id, \"at\" AS i, {_LEADS(max(len(x) for x, _ in PHRASES))} AS w FROM even) JOIN phrases ON {fold_sql('w[1]')} = split_part(phrase, ' ', 1) WHERE w[n] IS NOT NULL) "
    f"WHERE array_to_string(list_transform(g, lambda x: {fold_sql('x')}), ' ') = phrase AND len(list_filter(g, lambda x: {_BRAND('x')})) = 0",
    WORDS,
    _RENAMED,
    "even AS (SELECT doc_id, \"at\" // 2 AS \"at\", word FROM renamed WHERE \"at\" % 2 = 0)",
    _PHRASES,
)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = _renamed(spark, sf_dir).where("at % 2 = 0").select("doc_id", F.expr("cast(at div 2 as int)").alias("at"), "word")
    return d.phrase_hits(even)


_COUNTS = f"counts AS (SELECT {fold_sql('word')} AS key, sum(1 + doc_id % 3) AS weight, arg_max(word, ({LISTED('word')}, -(doc_id::HUGEINT * 4294967296 + \"at\"))) AS word FROM words WHERE {has('word', '^[A-Za-zÀ-ỹĐđ]{2,}$')} AND NOT {_BRAND('word')} GROUP BY 1)"


@query(f"SELECT key, CAST(weight AS BIGINT) AS weight, word FROM counts", WORDS, _COUNTS)
def spelling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the words of all documents."""
    weighted = words(spark, sf_dir).select((F.col("doc_id").cast("decimal(20,0)") * (1 << 32) + F.col("at")).alias("ordinal"), "word", (1 + F.col("doc_id") % 3).alias("weight"))
    return d.spelling_counts(weighted)


@query()
def edit_distance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents in the dictionary of all benchmark texts; one made of the same words would leave none unknown."""
    found = F.regexp_extract_all("text", F.lit(t.TOKEN), F.lit(0))
    listed = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(found).alias("at", "word"))
    listed = listed.select((F.col("item_id").cast("decimal(20,0)") * (1 << 32) + F.col("at")).alias("ordinal"), "word", F.lit(1).alias("weight"))
    return d.closest_spellings(words(spark, sf_dir), d.spelling_counts(listed))


@query()
def clean_final_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", rp.clean_final(rp.ship(spark))(F.col("label")).alias("name"))


@query()
def clean_spelling_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("doc_id", "name_no", rp.clean_spelling(rp.ship(spark))(F.col("label")).alias("name"))


@query()
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are dealt out first, since a file may hold them all in one row group, which is one task."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    judged = rp.judged(rp.ship(spark))(F.col("label"))
    return names_of(documents).select("doc_id", "name_no", judged.alias("j")).select("doc_id", "name_no", "j.quality", "j.needs_rescue")


@query()
def two_tier_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, key = F.col("label"), F.struct("doc_id", "name_no").alias("key")
    n = names(spark, sf_dir)
    first = n.select(key, label.alias("text"), F.lit(2).alias("lines"))
    more = n.select(key, label.alias("masked"), F.concat(F.lit("Quán "), label).alias("unmasked"), F.upper(label).alias("normalized"))
    return rp.read_labels(first, more, rp.ship(spark), "key").select("key.*", "name", "way")
