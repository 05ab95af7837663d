"""Queries of the text functions, chunkers and tokenisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import CHROME_LINES, PARTICLES, STOPWORDS, SUFFIXES
from ..operators import chunking, index
from ..sources import readers
from .base import digest, hangul, sql_digest, sql_grams, sql_hangul, sql_no_space, sql_one_line, sql_stem, sql_trim, sql_unescape, sql_words, table

_DOCS = "documents"


def _scalar(spark: SparkSession, sf: str, c: object) -> DataFrame:
    return table(spark, sf, _DOCS).select("doc_id", F.char_length(c).alias("n"), F.md5(c.cast("binary")).alias("digest"))


def _tokens(spark: SparkSession, sf: str, toks: object) -> DataFrame:
    rows = table(spark, sf, _DOCS).select("doc_id", toks.alias("toks"))
    return rows.select("doc_id", F.size("toks").alias("n"), F.size(F.array_distinct("toks")).alias("n_distinct"), digest(F.col("toks")).alias("digest"))


def _sql_scalar(x: str) -> str:
    return f"WITH s AS (SELECT doc_id, {x} AS x FROM documents) SELECT doc_id, CAST(length(x) AS INT) AS n, md5(x) AS digest FROM s"


def _sql_tokens(x: str, source: str = "SELECT doc_id, text AS t FROM documents") -> str:
    return f"WITH b AS ({source}), s AS (SELECT doc_id, {x} AS x FROM b) SELECT doc_id, CAST(len(x) AS INT) AS n, CAST(len(list_distinct(x)) AS INT) AS n_distinct, {sql_digest('x')} AS digest FROM s"


QUERIES, ORACLES = {}, {}


def _add(name: str, query: object, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_add("b1_nfc", lambda s, d: _scalar(s, d, T.unicode_form("text")), _sql_scalar("nfc_normalize(text)"))
_add("b2_no_space", lambda s, d: _scalar(s, d, T.no_space("text")), _sql_scalar(sql_no_space("text")))
_add("b3_normalize_line", lambda s, d: _scalar(s, d, T.one_line("text")), _sql_scalar(sql_one_line("text")))
_add("b11_compact_question", lambda s, d: table(s, d, "benchmark").select("item_id", T.no_space("text").alias("compact")), f"SELECT item_id, {sql_no_space('text')} AS compact FROM benchmark")


def b4_clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents up to the first one that begins with a capital O, without those that read KOR."""
    text = F.regexp_replace("text", "(?m)^The.*$", "KOR")
    return table(spark, sf, _DOCS).select("doc_id", T.clean_lines(text, stop="^O.*$").alias("t")).select("doc_id", F.char_length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


_CHROME = ", ".join(f"'{x}'" for x in CHROME_LINES)
_add(
    "b4_clean_lines",
    b4_clean_lines,
    f"""WITH l AS (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^The.*$', 'KOR', 'g'), chr(10)), lambda x: {sql_one_line('x')}), lambda x: x <> '') AS ls FROM documents
    ), c AS (
      SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '^O.*$')), true) AS cut FROM l
    ), k AS (
      SELECT doc_id, array_to_string(list_filter(CASE WHEN cut > 0 THEN ls[1:cut - 1] ELSE ls END, lambda x: x NOT IN ({_CHROME})), chr(10)) AS t FROM c
    ) SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM k""",
)

_SQL_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<!--.*?-->', '', 'gs'), '<script\\b[^>]*>.*?</script\\s*>', '', 'gsi'), '<style\\b[^>]*>.*?</style\\s*>', '', 'gsi'), '</?(?:br|p|li|ul|ol|div|h[1-6]|section|article|tr|td)\\b[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')"


def b5_strip_html(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", T.strip_html("html").alias("t"))
    return rows.select("page_id", F.char_length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


_add("b5_strip_html", b5_strip_html, f"WITH s AS (SELECT page_id, {sql_unescape(_SQL_STRIP.format(x='html'))} AS t FROM pages) SELECT page_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM s")

#: Lines that are headings in parentheses or bare, of either width, with blanks and references, and lines that only look like one.
_LINE = """CASE (doc_id + length(text)) % 12 WHEN 0 THEN '제 ' || doc_id || ' 조 (' || lang || ')' WHEN 1 THEN ' 제' || doc_id || '조  ' || source WHEN 2 THEN '제1조에 따라' WHEN 3 THEN '제' || doc_id || '조（ ' || source || ' ）' WHEN 4 THEN '제 ' || doc_id || '조의2 (' || lang || ')'
  WHEN 5 THEN '제' || doc_id || '조(' || lang || ') ' || source WHEN 6 THEN '제 ' || doc_id || ' 조()' WHEN 7 THEN '제' || doc_id || '조' WHEN 8 THEN substr(text, 1, 30) WHEN 9 THEN '  제  ' || doc_id || '  조  ' || substr(text, 1, 9) || ' ' WHEN 10 THEN '제' || doc_id || '조 (a&amp;b' || lang || ')' ELSE '제 일 조 (' || lang || ')' END"""


def b6_parse_heading(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, _DOCS).select("doc_id", T.heading(F.expr(_LINE)).alias("h"))
    return rows.select("doc_id", F.col("h.article_no").alias("article_no"), F.col("h.title").alias("title"))


_add(
    "b6_parse_heading",
    b6_parse_heading,
    f"""WITH l AS (SELECT doc_id, {sql_one_line(_LINE)} AS x FROM documents), b AS (SELECT *, '^제 ?([0-9]+) ?조 ?[（(] ?([^）)]*?) ?[）)]$' AS p, '^제 ?([0-9]+) ?조 (.+)$' AS q FROM l)
    SELECT doc_id, CASE WHEN regexp_matches(x, p) THEN CAST(regexp_extract(x, '^제 ?([0-9]+) ?조 ?[（(] ?([^）)]*?) ?[）)]$', 1) AS INT) WHEN regexp_matches(x, q) THEN CAST(regexp_extract(x, '^제 ?([0-9]+) ?조 (.+)$', 1) AS INT) END AS article_no,
      CASE WHEN regexp_matches(x, p) THEN regexp_extract(x, '^제 ?([0-9]+) ?조 ?[（(] ?([^）)]*?) ?[）)]$', 2) WHEN regexp_matches(x, q) THEN regexp_extract(x, '^제 ?([0-9]+) ?조 (.+)$', 2) END AS title FROM b""",
)
_add(
    "b7_article_no",
    lambda s, d: table(s, d, _DOCS).select("doc_id", T.first_number(F.concat(F.lit("제"), F.col("source"), F.lit("조 2"))).alias("no")),
    "SELECT doc_id, CAST(regexp_extract('제' || source || '조 2', '([0-9]+)', 1) AS INT) AS no FROM documents",
)
_add(
    "b8_safe_article",
    lambda s, d: table(s, d, _DOCS).select("doc_id", T.safe_number(F.expr("CASE WHEN doc_id % 2 = 0 THEN cast(doc_id AS string) ELSE '제' || doc_id || '조' END")).alias("x")).select("doc_id", "x.number", "x.label"),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS INT) END AS number, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '제' || doc_id || '조' END AS label FROM documents",
)
_add(
    "b9_vocabulary",
    lambda s, d: chunking.vocabulary(table(s, d, _DOCS).where("lang <> 'en'"), "source", "text"),
    "SELECT DISTINCT unnest(regexp_extract_all(source || ' ' || text, '[0-9A-Za-z가-힣]+')) AS word FROM documents WHERE lang <> 'en'",
)


def b10_repair_wraps(spark: SparkSession, sf: str) -> DataFrame:
    """Lines broken after every twelfth character, joined again by the vocabulary of all documents."""
    docs = table(spark, sf, _DOCS)
    rows = docs.select("doc_id", F.transform(F.split(F.regexp_replace("text", "(?s)(.{12})", "$1\x03"), "[\x03\n]"), lambda x: F.trim(x)).alias("lines"))
    out = chunking.repaired(rows, "lines", chunking.vocabulary(docs, "text"))
    return out.select("doc_id", F.char_length("repaired").alias("n"), F.md5(F.col("repaired").cast("binary")).alias("digest"))


_add(
    "b10_repair_wraps",
    b10_repair_wraps,
    """WITH v AS (SELECT map_from_entries(list(DISTINCT {'k': w, 'v': true})) AS m FROM (SELECT unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣]+')) AS w FROM documents)),
    l AS (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(.{12})', '\\1' || chr(3), 'gs'), '[\\x03\\n]'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents
    ), r AS (
      SELECT doc_id, list_reduce(ls, lambda a, x: CASE
        WHEN regexp_matches(a, '[0-9A-Za-z가-힣]$') AND regexp_matches(x, '^[0-9A-Za-z가-힣]')
          AND map_contains(v.m, regexp_extract(a, '([0-9A-Za-z가-힣]+)$', 1) || regexp_extract(x, '^([0-9A-Za-z가-힣]+)', 1)) THEN a || x
        ELSE a || ' ' || x END) AS t FROM l, v WHERE len(ls) > 0
      UNION ALL SELECT doc_id, '' FROM l WHERE len(ls) = 0
    ) SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM r""",
)
_TEAM = """CASE (doc_id + length(text)) % 9 WHEN 0 THEN cast(doc_id AS varchar(20)) WHEN 1 THEN source WHEN 2 THEN ' ' WHEN 3 THEN ' ' || (doc_id + 1) || '  ' WHEN 4 THEN '0' || doc_id WHEN 5 THEN '1' || repeat('7', 25 + cast(doc_id % 12 AS int))
  WHEN 6 THEN '12 ' || doc_id WHEN 7 THEN substr(text, 1, 3) ELSE '-' || doc_id END"""
_add(
    "b12_team_id",
    lambda s, d: table(s, d, _DOCS).select("doc_id", readers.team_problem(F.expr(_TEAM)).alias("problem"), readers.team_problem(F.expr(_TEAM), numeric=False).alias("named")),
    f"""WITH t AS (SELECT doc_id, trim({_TEAM}) AS t FROM documents), r AS (SELECT doc_id, t, CASE WHEN length(t) > 32 THEN 'too long' WHEN NOT regexp_full_match(t, '[0-9A-Za-z_가-힣-]+') THEN 'character' END AS rest FROM t)
    SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN NOT regexp_full_match(t, '[1-9][0-9]*') THEN 'not a number' ELSE rest END AS problem, CASE WHEN t = '' THEN 'empty' ELSE rest END AS named FROM r""",
)
_FILE = "CASE doc_id % 3 WHEN 0 THEN 'file:/x/answers_BLIND' || doc_id || '.json' WHEN 1 THEN '/x/blind 0' || doc_id || '.json' ELSE '/x/' || source || '.json' END"
_BODY = "CASE WHEN doc_id % 5 = 0 THEN '{\"meta\":{\"blind_id\":\" b' || doc_id || '\"}}' ELSE '{}' END"
_add(
    "b13_blind_id",
    lambda s, d: table(s, d, _DOCS).select("doc_id", readers.blind_id(F.expr(_FILE), F.expr(_BODY)).alias("blind_id")),
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'B' || doc_id WHEN doc_id % 3 < 2 THEN 'BLIND' || CASE WHEN doc_id < 10 THEN '0' || doc_id ELSE CAST(doc_id AS VARCHAR) END ELSE source END AS blind_id FROM documents""",
)
_NAME = """CASE (doc_id + length(text)) % 6 WHEN 0 THEN 'answers_BLIND' || doc_id WHEN 1 THEN 'blind0' || doc_id || 'x' WHEN 2 THEN 'blind ' || doc_id WHEN 3 THEN source || '.v2' WHEN 4 THEN 'BLIND' ELSE 'xBlInD' || doc_id || '_BLIND1' END"""
_FIELDS = """CASE length(text) % 5 WHEN 0 THEN '{"team":"t' || doc_id || '"}' WHEN 1 THEN '{"blindId":" b' || doc_id || ' ","team":"t"}' WHEN 2 THEN '{"id":"i' || doc_id || '","blind_id":" "}' WHEN 3 THEN '{"blind_id":"c' || doc_id || '","id":"x"}' ELSE '{}' END"""
_add(
    "b14_blind_id_dev",
    lambda s, d: table(s, d, _DOCS).select("doc_id", readers.blind_id(F.expr(f"concat('/x/', {_NAME}, '.json')"), F.expr(_FIELDS), "dev").alias("blind_id")),
    f"""WITH r AS (SELECT doc_id, {_NAME} AS name, {_FIELDS} AS raw FROM documents), f AS (SELECT doc_id, name, upper(regexp_extract(name, '(?i)(BLIND[0-9]+)', 1)) AS b,
      [nullif(trim(json_extract_string(raw, k)), '') FOR k IN ['$.blind_id', '$.blindId', '$.id', '$.team']] AS given FROM r)
    SELECT doc_id, coalesce(nullif(b, ''), given[1], given[2], given[3], given[4], name) AS blind_id FROM f""",
)

# ---------------------------------------------------------------- chunking

_HEADED = "concat('# 제 1 조 (a)\n', replace(text, '\n', '\n## 제2조 b\n'))"


def c1_split_articles(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with a heading before every line, split at the headings."""
    rows = chunking.articles(table(spark, sf, _DOCS).withColumn("t", F.expr(_HEADED)), "doc_id", "t")
    return rows.select("doc", "article_no", "heading", "ord", F.md5(F.col("content").cast("binary")).alias("digest"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents"
_add(
    "c1_split_articles",
    c1_split_articles,
    f"""WITH l AS ({_LINES}), b AS (SELECT doc_id, k, {sql_trim('line')} AS body FROM l WHERE {sql_trim('line')} <> ''),
    h AS (SELECT *, CASE WHEN k = 0 THEN '제 1 조 (a)' ELSE '제2조 b' END AS heading FROM b)
    SELECT doc_id AS doc, CAST(CASE WHEN k = 0 THEN 1 ELSE 2 END AS INT) AS article_no, heading, CAST(k AS INT) AS ord, md5('[' || doc_id || ' ' || heading || ']' || chr(10) || body) AS digest FROM h""",
)


def c2_html_articles(spark: SparkSession, sf: str) -> DataFrame:
    """All pages inside a terms container with one heading, and a button block that goes."""
    head, tail = '<p>x</p><div class="a wrap_terms b"><h3 class="tit_subject">제 7 조 (<b>t</b>)</h3><div class="wrap_btn">KOR</div>', "<div>y</div></div><div>z</div>"
    body = F.concat(F.lit(head), F.regexp_replace("html", "(?i)</?div[^>]*>", " "), F.lit(tail))
    rows = chunking.html_articles(table(spark, sf, "pages").select("page_id", body.alias("h")), "page_id", "h")
    return rows.select("doc", "article_no", "title", F.char_length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


_add(
    "c2_html_articles",
    c2_html_articles,
    f"""WITH s AS (SELECT page_id, {sql_unescape(_SQL_STRIP.format(x="regexp_replace(html, '</?div[^>]*>', ' ', 'gi') || '<div>y</div>'"))} AS t FROM pages),
    l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql_one_line('x')}), lambda x: x <> ''), chr(10)) AS t FROM s)
    SELECT page_id AS doc, 7 AS article_no, 't' AS title, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM l""",
)


def c3_docx_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, _DOCS).select("doc_id", F.expr("concat('front\n제 1 조 (a)\n', replace(text, '\n', '\n제2조 b\n'))").alias("t"))
    return chunking.docx_articles(rows, "doc_id", "t").select("doc", "article_no", "title", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


_add(
    "c3_docx_articles",
    c3_docx_articles,
    f"""WITH l AS ({_LINES}) SELECT doc_id AS doc, CAST(CASE WHEN k = 0 THEN 1 ELSE 2 END AS INT) AS article_no, CASE WHEN k = 0 THEN 'a' ELSE 'b' END AS title, CAST(k AS INT) AS ord,
    md5({sql_one_line(sql_one_line('line'))}) AS digest FROM l""",
)


def c4_plain_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, _DOCS).select("doc_id", F.expr("concat('제1조 a\n', replace(text, '\n', '\n제 3 장 c\n제 2 조 b\n'))").alias("t"))
    return chunking.plain_articles(rows, "doc_id", "t").select("doc", "article_no", "title", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


_add(
    "c4_plain_articles",
    c4_plain_articles,
    f"""WITH l AS ({_LINES}) SELECT doc_id AS doc, CAST(CASE WHEN k = 0 THEN 1 ELSE 2 END AS INT) AS article_no, CASE WHEN k = 0 THEN 'a' ELSE 'b' END AS title, CAST(k AS INT) AS ord,
    md5(trim(line)) AS digest FROM l WHERE trim(line) <> ''""",
)

_CLAUSES = "replace(replace(text, '. ', '. ① '), ', ', ' ② ')"


def c5_clause_units(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with circled digits after stops and commas, as clauses."""
    rows = table(spark, sf, _DOCS).select("doc_id", "source", F.expr(_CLAUSES).alias("t"))
    out = chunking.units(rows, "clause", "source", "t")
    return out.select("doc_id", "unit_no", F.char_length("unit_text").alias("n"), F.md5(F.col("unit_text").cast("binary")).alias("digest"))


SQL_CLAUSES = f"""p AS (
      SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace({_CLAUSES}, '([①-⑩])', chr(1) || '\\1', 'g'), '(?m)^([\\t-\\r\\x20]*[0-9]+[\\t-\\r\\x20]*\\.)', chr(1) || '\\1', 'g'), chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS ps FROM documents
    ), e AS (
      SELECT doc_id, source, unnest(CASE WHEN len(ps) = 0 THEN [''] ELSE ps END) AS part, unnest(range(0, greatest(len(ps), 1))) AS k FROM p
    ), g AS (
      SELECT *, sum(CASE WHEN length(part) >= 40 OR k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS unit_no FROM e
    ), u AS (
      SELECT doc_id, CAST(unit_no AS INT) AS unit_no, source || chr(10) || string_agg(part, chr(10) ORDER BY k) AS unit_text FROM g GROUP BY doc_id, source, unit_no
    )"""
_add("c5_clause_units", c5_clause_units, f"WITH {SQL_CLAUSES} SELECT doc_id, unit_no, CAST(length(unit_text) AS INT) AS n, md5(unit_text) AS digest FROM u")

_SENT = "replace(text, '. ', '다. ')"


def _sql_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '(다\\.){T.WS}+', '\\1' || chr(2), 'g'), chr(2)), lambda x: {sql_trim('x')}), lambda x: x <> '')"


_add(
    "c6_source_spans",
    lambda s, d: table(s, d, _DOCS).select("doc_id", chunking.source_spans(F.expr(f"replace({_SENT}, ', ', ' ② ')")).alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|").cast("binary")).alias("digest")),
    f"""WITH m AS (SELECT doc_id, regexp_replace(replace({_SENT}, ', ', ' ② '), '(^|{T.WS})([0-9]{{1,2}}\\.{T.WS}|[①-⑳])', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS ps FROM m),
    s AS (SELECT doc_id, list_transform(flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 260 THEN [p] ELSE {_sql_sentences('p')} END)), lambda y: {sql_trim(f"regexp_replace(y, '^[①-⑳]{T.WS}*', '')")}) AS x FROM p)
    SELECT doc_id, CAST(len(x) AS INT) AS n, md5(coalesce(array_to_string(x, '|'), '')) AS digest FROM s""",
)
_add(
    "c7_sentences",
    lambda s, d: table(s, d, _DOCS).select("doc_id", chunking.sentences(F.expr(_SENT)).alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|").cast("binary")).alias("digest")),
    f"WITH s AS (SELECT doc_id, {_sql_sentences(_SENT)} AS x FROM documents) SELECT doc_id, CAST(len(x) AS INT) AS n, md5(coalesce(array_to_string(x, '|'), '')) AS digest FROM s",
)

# ---------------------------------------------------------------- tokenisers

_HWORDS = "regexp_extract_all(t, '[0-9A-Za-z가-힣]+')"
_H = f"SELECT doc_id, {sql_hangul('text')} AS t FROM documents"


def _sql_particles(particles: bool) -> str:
    stem = sql_stem("w", PARTICLES)
    extra = f"CASE WHEN regexp_full_match(w, '[가-힣]+') AND length(w) > 2 AND {stem} <> w THEN [{stem}] ELSE [] END" if particles else "[]"
    return f"flatten(list_transform({_HWORDS}, lambda w: list_concat([w], {extra}, CASE WHEN regexp_full_match(w, '[가-힣]+') THEN {sql_grams('w', 2)} ELSE [] END)))"


_add("d1_particle_tokens", lambda s, d: _tokens(s, d, T.particle_tokens(hangul("text"))), _sql_tokens(_sql_particles(True), _H))
_add("d2_plain_tokens", lambda s, d: _tokens(s, d, T.particle_tokens(hangul("text"), particles=False)), _sql_tokens(_sql_particles(False), _H))
_add("d3_word_tokens", lambda s, d: _tokens(s, d, T.word_tokens("text")), _sql_tokens(sql_words("t")))
_BARE = f"SELECT doc_id, {sql_no_space('lower(text)')} AS t FROM documents"
_add("d4_char_ngrams", lambda s, d: _tokens(s, d, T.ngram_tokens("text")), _sql_tokens(f"list_concat({sql_grams('t', 2)}, {sql_grams('t', 3)})", _BARE))
_add(
    "d5_hybrid_tokens",
    lambda s, d: _tokens(s, d, T.hybrid_tokens("text")),
    _sql_tokens(f"list_concat(list_concat(w, {sql_grams('t', 2)}), {sql_grams('t', 3)})", f"SELECT doc_id, {sql_words('text')} AS w, {sql_no_space('lower(text)')} AS t FROM documents"),
)


def _set(spark: SparkSession, sf: str, digits: bool) -> DataFrame:
    """Token sets, sorted for the comparison."""
    return _tokens(spark, sf, F.sort_array(T.set_tokens("text", digits)))


_SET = "list_sort(list_distinct(regexp_extract_all(t, '[0-9A-Za-z가-힣]+')))"
_add("d6_set_tokens", lambda s, d: _set(s, d, False), _sql_tokens(f"list_filter({_SET}, lambda w: NOT regexp_full_match(w, '[0-9]+'))"))
_add("d7_set_tokens_digits", lambda s, d: _set(s, d, True), _sql_tokens(_SET))
_STOPS = ", ".join(f"'{x}'" for x in STOPWORDS)
_add(
    "d8_content_tokens",
    lambda s, d: _tokens(s, d, T.content_tokens(hangul("text"))),
    _sql_tokens(f"list_filter(list_transform(regexp_extract_all(t, '[0-9]+|[A-Za-z]+|[가-힣]+'), lambda w: lower({sql_stem('w', SUFFIXES)})), lambda w: length(w) >= 2 AND w NOT IN ({_STOPS}))", _H),
)
_BARE_CASE = f"SELECT doc_id, {sql_no_space('text')} AS t FROM documents"
_add("d9_char_bigrams", lambda s, d: _tokens(s, d, T.char_bigrams("text")), _sql_tokens(sql_grams("t", 2), _BARE_CASE))
for _name, _n in (("d10_trigram_set", 3), ("d11_fivegram_set", 5)):
    _add(_name, lambda s, d, n=_n: _tokens(s, d, F.sort_array(T.gram_set("text", n))), _sql_tokens(f"list_sort(list_distinct({sql_grams('t', _n)}))", _BARE_CASE))

# ---------------------------------------------------------------- sources and sinks that are relational


_add(
    "a13_blob_round_trip",
    lambda s, d: table(s, d, "benchmark").select("item_id", readers.blob_text(readers.blob("text")).alias("text"), F.md5(F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "").cast("binary")).alias("plain")),
    "SELECT item_id, text, md5(base64(encode(text))) AS plain FROM benchmark",
)
_add(
    "a10_page_numbers",
    lambda s, d: table(s, d, _DOCS).select("doc_id", readers.page_text(F.regexp_replace("text", "\n", "\n 12 \n")).alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest")),
    "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\\t-\\r ]*[0-9]+[\\t-\\r ]*')), chr(10))) AS digest FROM documents",
)

# ---------------------------------------------------------------- index

_POST = f"t AS (SELECT doc_id, unnest({sql_words('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)"
_add(
    "e1_term_frequency",
    lambda s, d: index.postings(index.tokenised(table(s, d, _DOCS), "doc_id", "text")).select("term", F.col("unit").alias("doc_id"), "tf"),
    f"WITH {_POST} SELECT term, doc_id, tf FROM p",
)
_add(
    "e2_document_length",
    lambda s, d: index.tokenised(table(s, d, _DOCS), "doc_id", "text").select(F.col("unit").alias("doc_id"), "dl"),
    f"SELECT doc_id, CAST(len({sql_words('text')}) AS INT) AS dl FROM documents",
)
_add(
    "e3_average_length",
    lambda s, d: index.corpus_stats(index.tokenised(table(s, d, _DOCS), "doc_id", "text")).select("n", F.round("avgdl", 6).alias("avgdl")),
    f"SELECT count(*) AS n, round(avg(len({sql_words('text')})), 6) AS avgdl FROM documents",
)
_add(
    "e5_term_stats",
    lambda s, d: index.term_stats(table(s, d, _DOCS), "doc_id", "text").withColumn("idf", F.round("idf", 6)),
    f"WITH {_POST}, n AS (SELECT count(*) AS n FROM documents) SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, round(ln(1 + (max(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM p, n GROUP BY term",
)
_add(
    "e6_unit_vectors",
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(index.unit_vector("embedding")).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")),
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS r FROM e) SELECT vec_id, unnest(range(0, len(v)))::INT AS i, round(unnest(v) / r, 6) AS x FROM n",
)
_add(
    "e7_index_text",
    lambda s, d: table(s, d, _DOCS).select("doc_id", *[F.md5(index.index_text(k, "source", "doc_id", "lang", "text").cast("binary")).alias(k) for k in ("joined", "title", "bracket", "cited")]),
    """SELECT doc_id, md5(source || ' ' || lang || ' ' || text) AS joined, md5(lang || chr(10) || text) AS title, md5('[' || source || ' ' || lang || ']' || chr(10) || text) AS bracket,
    md5(source || ' 제' || doc_id || '조(' || lang || ')' || chr(10) || text) AS cited FROM documents""",
)
_add(
    "f8_model_prefix",
    lambda s, d: table(s, d, "benchmark").select("item_id", index.model_text("text", F.expr("CASE WHEN item_id % 2 = 0 THEN 'x/multilingual-e5-base' ELSE 'other' END"), "query").alias("t")),
    "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'query: ' || text ELSE text END AS t FROM benchmark",
)
