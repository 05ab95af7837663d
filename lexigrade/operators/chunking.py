"""Chunking: documents to articles, clauses and spans.

Splitting needs no shuffle: a row's lines are marked where a part begins, joined
again and split at the marks, so the work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T

#: A markdown heading of an article; the number is group 1.
MARKDOWN_ARTICLE = r"^#{1,6}[\t-\r\x20]*(제[\t-\r\x20]*([0-9]+)[\t-\r\x20]*조[^\n]*)$"
PLAIN_ARTICLE = r"^제[\t-\r\x20]*([0-9]+)[\t-\r\x20]*조[\t-\r\x20]*(.{0,40})$"
CHAPTER = r"^제[\t-\r\x20]*[0-9]+[\t-\r\x20]*장(?![0-9A-Za-z_가-힣])"

#: Begins a part. A text that holds this or another mark has SPARE in its place until it is split.
PART_MARK, SPARE = "\ufdd0", "\ufdef"


def _free(text: Column, mark: str) -> Column:
    return T.bound(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.translate(t, mark, SPARE)).otherwise(t))


def _back(parts: Column, text: Column, mark: str) -> Column:
    """Parts of a text in which SPARE stands for a mark, as they were. Texts without the mark keep a SPARE of their own."""
    known = F.struct(parts.alias("p"), F.contains(text, F.lit(mark)).alias("held"))
    return F.transform(F.array(known), lambda x: F.when(x["held"], F.transform(x["p"], lambda y: F.translate(y, SPARE, mark))).otherwise(x["p"]))[0]


def _parts(lines: Column, is_head: object) -> Column:
    """The text from each heading to the next one, heading first; lines before the first heading go."""
    free = lambda x: _free(x, PART_MARK)

    def parts(known: Column) -> Column:
        marked = F.array_join(F.transform(known, lambda x: F.when(is_head(x), F.concat(F.lit(PART_MARK), free(x))).otherwise(free(x))), "\n")
        return _from_marks(marked, F.array_join(known, ""))

    return T.bound(lines, parts)


def _from_marks(marked: Column, text: Column) -> Column:
    """The parts of a marked text, without what precedes the first mark."""
    parts = F.filter(_back(F.split(marked, PART_MARK, -1), text, PART_MARK), lambda x, i: i > 0)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\n$", ""))


def _rows(docs: DataFrame, doc_col: str, parts: Column) -> DataFrame:
    """(doc, ord, p): a row per part. Spark evaluates what it explodes a second time, to filter, unless empty arrays stay at first."""
    return docs.select(F.col(doc_col).alias("doc"), F.posexplode_outer(parts).alias("ord", "p")).where("p IS NOT NULL")


def _head(part: str = "p") -> Column:
    return F.substring_index(part, "\n", 1)


def _body(part: str = "p") -> Column:
    """What follows the heading's line; null if nothing does."""
    return F.when(F.contains(F.col(part), F.lit("\n")), F.regexp_replace(part, "^[^\n]*\n", ""))


def articles(docs: DataFrame, doc_col: str, text_col: str, head: str = MARKDOWN_ARTICLE, number_group: int = 2, title_group: int = 1, required: bool = True) -> DataFrame:
    """(doc, article_no, heading, body, content, ord): the articles between headings.

    A body runs to the next article's heading, so chapter headings stay at its
    end; articles without a body go. content carries document and heading. A
    document without any heading is an error, unless ``required`` is False.
    """
    parts = _parts(F.split(F.col(text_col), "\n"), lambda x: x.rlike(head))
    rows = docs.select(F.col(doc_col).alias("doc"), parts.alias("parts"))
    if required:
        problem = F.raise_error(F.concat(F.col("doc").cast("string"), F.lit(": no article heading"))).cast("array<string>")
        rows = rows.withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(problem))
    rows = rows.select("doc", F.posexplode("parts").alias("ord", "p"))
    body = F.regexp_replace(F.coalesce(_body(), F.lit("")), rf"^{T.WS}+|{T.WS}+$", "")
    number, title = F.regexp_extract(_head(), head, number_group).try_cast("int"), F.trim(F.regexp_extract(_head(), head, title_group))
    rows = rows.select("doc", number.alias("article_no"), title.alias("heading"), body.alias("body"), "ord").where("body <> ''")
    content = F.concat(F.lit("["), F.col("doc").cast("string"), F.lit(" "), F.col("heading"), F.lit("]\n"), F.col("body"))
    return rows.select("doc", "article_no", "heading", "body", content.alias("content"), "ord")


def plain_articles(docs: DataFrame, doc_col: str, text_col: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc, article_no, title, text, ord) of texts whose headings own a whole line; chapter lines go, wrapped words are repaired.

    ``vocabulary`` (word) is small: the words of the clean documents.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(CHAPTER))
    rows = _rows(docs, doc_col, _parts(lines, lambda x: x.rlike(PLAIN_ARTICLE)))
    rows = rows.withColumn("body", _body()).where("body IS NOT NULL")
    number, title = F.regexp_extract(_head(), PLAIN_ARTICLE, 1).cast("int"), F.trim(F.regexp_extract(_head(), PLAIN_ARTICLE, 2))
    rows = rows.select("doc", number.alias("article_no"), title.alias("title"), F.split("body", "\n").alias("lines"), "ord")
    return repaired(rows, "lines", vocabulary).withColumnRenamed("repaired", "text").drop("lines")


#: Words' characters, of which a word at a line's start or end consists.
_WORDS = re.compile("[0-9A-Za-z가-힣]+")


def vocabulary(docs: DataFrame, *text_cols: str) -> DataFrame:
    """(word): the distinct words of some columns."""
    return docs.select(F.explode(T.words(F.concat_ws(" ", *text_cols), "[0-9A-Za-z가-힣]+")).alias("word")).distinct()


def repaired(rows: DataFrame, lines_col: str, words: DataFrame | None) -> DataFrame:
    """Adds ``repaired``: lines joined by a space, or by nothing where the words at the break are one word of the vocabulary.

    Which joined words are known is settled by a join on the candidates of all
    breaks, so the vocabulary may be large; then each text is built in one pass
    over its lines. The tail is that of what has been built, as one line may be
    a single word that has already been joined to its predecessor.
    """
    lines = F.filter(F.transform(F.col(lines_col), lambda x: F.trim(x)), lambda x: x != "")
    tagged = rows.withColumn("__lines", lines).withColumn("__row", F.monotonically_increasing_id())
    if words is None:
        return tagged.withColumn("repaired", F.array_join("__lines", " ")).drop("__lines", "__row")
    asked = tagged.select("__row", F.explode(_joined_words("__lines")).alias("word"))
    known = asked.join(words.select("word").distinct(), "word").groupBy("__row").agg(F.collect_set("word").alias("__known"))
    both = tagged.join(known, "__row", "left")
    return both.withColumn("repaired", _built("__lines", F.coalesce("__known", F.array().cast("array<string>")))).drop("__lines", "__row", "__known")


#: Rows whose lines are Python's objects at a time.
_ROWS = 256


def _each(columns: tuple[pa.Array, ...], make: Callable, kind: pa.DataType) -> pa.Array:
    """What ``make`` gives for each row's lists, none where there are no lines."""
    out: list[pa.Array] = [pa.array([], kind)]
    for a in range(0, len(columns[0]), _ROWS):
        rows = zip(*(c.slice(a, _ROWS).to_pylist() for c in columns), strict=True)
        out.append(pa.array([None if row[0] is None else make(*row) for row in rows], kind))
    return pa.concat_arrays(out)


def _ends(line: str) -> tuple[str, str]:
    """The word at a line's start and that at its end, either may be empty."""
    found = _WORDS.findall(line)
    if not found:
        return "", ""
    return found[0] if line.startswith(found[0]) else "", found[-1] if line.endswith(found[-1]) else ""


@F.arrow_udf(ArrayType(StringType()))
def _joined_words(lines: pa.Array) -> pa.Array:
    """Every word that may arise at a break: a tail may be the last word of the line before, or that line whole with what precedes it."""

    def words(lines: list[str]) -> list[str]:
        before, out = [], set()
        for line in lines:
            head, tail = _ends(line)
            if head and before:
                out.update([t + head for t in before])
            before = [*(t + line for t in before), line] if head == line else [tail] if tail else []
        return list(out)

    return _each((lines,), words, pa.list_(pa.string()))


@F.arrow_udf(StringType())
def _built(lines: pa.Array, known: pa.Array) -> pa.Array:
    """Lines joined by nothing where tail and head are a known word, else by a space."""

    def text(lines: list[str], known: list[str]) -> str:
        words, before, out = set(known), "", []
        for line in lines:
            head, tail = _ends(line)
            joins = before != "" and head != "" and before + head in words
            before = ((before if joins else "") + line) if head == line else tail
            out += [line] if joins or not out else [" ", line]
        return "".join(out)

    return _each((lines, known), text, pa.string())


CLAUSE_MARK = "\x01"


def clause_parts(c: T.Text) -> Column:
    """Pieces of a text that begin with a circled digit 1 to 10, or with ``N.`` at a line's start; shorter than 40 characters join the piece before."""
    marked = F.regexp_replace(F.regexp_replace(_free(T.col(c), CLAUSE_MARK), "([①-⑩])", CLAUSE_MARK + "$1"), r"(?m)^([\t-\r\x20]*[0-9]+[\t-\r\x20]*\.)", CLAUSE_MARK + "$1")
    parts = F.filter(F.transform(F.split(marked, CLAUSE_MARK), lambda x: F.regexp_replace(x, rf"^{T.WS}+|{T.WS}+$", "")), lambda x: x != "")
    # A mark goes where fewer than 40 characters follow it up to the next one.
    found = F.split(F.regexp_replace(F.array_join(parts, CLAUSE_MARK), f"{CLAUSE_MARK}(?=[^{CLAUSE_MARK}]{{0,39}}(?:{CLAUSE_MARK}|\\z))", "\n"), CLAUSE_MARK, -1)
    return _back(found, T.col(c), CLAUSE_MARK)


def units(rows: DataFrame, granularity: str = "article", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """rows with ``unit_text`` (title, newline, text) and ``unit_no``: one per article, or one per clause."""
    title = F.coalesce(F.col(title_col), F.lit(""))
    if granularity == "article":
        return rows.withColumns({"unit_no": F.lit(1), "unit_text": F.concat(title, F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))})
    if granularity != "clause":
        raise ValueError("granularity must be article or clause")
    parts = rows.select("*", F.posexplode(clause_parts(F.coalesce(F.col(text_col), F.lit("")))).alias("unit_no", "__part"))
    return parts.withColumns({"unit_no": F.col("unit_no") + 1, "unit_text": F.concat(title, F.lit("\n"), F.col("__part"))}).drop("__part")


SENTENCE_MARK = "\x02"


def sentences(c: T.Text, lines: bool = False) -> Column:
    """Sentences that end in the plain declarative form and a space, and lines if asked for; stripped, none empty."""
    marked = F.regexp_replace(_free(T.col(c), SENTENCE_MARK), rf"(다\.){T.WS}+", "$1" + SENTENCE_MARK)
    parts = _back(F.split(marked, f"[{SENTENCE_MARK}\n]" if lines else SENTENCE_MARK), T.col(c), SENTENCE_MARK)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, rf"^{T.WS}+|{T.WS}+$", "")), lambda x: x != "")


def source_spans(c: T.Text, most: int = 260) -> Column:
    """Numbered or circled items of a text, long ones by sentence, without their circled digit."""
    marked = F.regexp_replace(_free(T.col(c), CLAUSE_MARK), rf"(^|{T.WS})(?=[0-9]{{1,2}}\.{T.WS}|[①-⑳])", "$1" + CLAUSE_MARK)
    trimmed = lambda x: F.regexp_replace(x, rf"^{T.WS}+|{T.WS}+$", "")
    parts = F.filter(F.transform(_back(F.split(marked, CLAUSE_MARK), T.col(c), CLAUSE_MARK), trimmed), lambda x: x != "")
    spans = F.flatten(F.transform(parts, lambda x: F.when(F.char_length(x) <= most, F.array(x)).otherwise(sentences(x))))
    return F.transform(spans, lambda x: trimmed(F.regexp_replace(x, rf"^[①-⑳]{T.WS}*", "")))


def html_section(c: T.Text, name: str = "wrap_terms", drop: str = "wrap_btn") -> Column:
    """The inside of the first div of a class, up to the tag that balances it, without the divs of another class; null if there is none."""
    bare = F.regexp_replace(T.col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    start = rf"(?is)^.*?<div\b[^>]*class\s*=\s*['\"][^'\"]*\b{name}\b[^'\"]*['\"][^>]*>"
    inside = F.regexp_replace(bare, start, "")
    # Pieces up to each div tag; the section is what precedes the piece whose tag closes the depth.
    tag = r"(?i)</?\s*div(?:\s+[^>]*)?>"
    pieces, tags = F.split(inside, tag, -1), F.regexp_extract_all(inside, F.lit(tag), F.lit(0))
    zero = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        text = F.concat(acc["out"], x["p"])
        depth = acc["depth"] + F.when(x["t"].startswith("</"), -1).otherwise(1)
        ends = depth == 0
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), F.when(ends, text).otherwise(F.concat(text, x["t"])).alias("out"), ends.alias("done")))

    folded = F.aggregate(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(tags)).alias("p"), tags.alias("t")), zero, step)
    gone = rf"(?is)<div\b[^>]*class\s*=\s*['\"][^'\"]*\b{drop}\b[^'\"]*['\"][^>]*>.*?</div\s*>"
    return F.when(bare.rlike(start) & folded["done"], F.regexp_replace(folded["out"], gone, ""))


HTML_HEADING = r"(?is)<(strong|h[1-6])\b(?=[^>]*\bclass\s*=\s*['\"][^'\"]*\btit_subject\b[^'\"]*['\"])[^>]*>.*?</\1\s*>"


def html_articles(docs: DataFrame, doc_col: str, html_col: str) -> DataFrame:
    """(doc, article_no, title, text, ord) of HTML pages: the text between the headings of the terms section."""
    section = html_section(html_col)
    heads, pieces = F.regexp_extract_all(F.col("__s"), F.lit(HTML_HEADING), F.lit(0)), F.split(F.col("__s"), HTML_HEADING, -1)
    rows = docs.select(F.col(doc_col).alias("doc"), section.alias("__s")).where("__s IS NOT NULL")
    rows = rows.select("doc", F.posexplode(F.arrays_zip(heads.alias("h"), F.slice(pieces, F.lit(2), F.size(heads)).alias("b"))).alias("ord", "p"))
    rows = rows.select("doc", "ord", T.heading(T.strip_html("p.h")).alias("h"), F.col("p.b").alias("b"))
    # A heading that names no article belongs to the body of the one before.

    order = Window.partitionBy("doc").orderBy("ord")
    rows = rows.withColumn("__no", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(order)).where("__no > 0")
    own = rows.groupBy("doc", "__no").agg(F.min("ord").alias("ord"), F.first("h", ignorenulls=True).alias("h"), F.array_sort(F.collect_list(F.struct("ord", "b"))).alias("bs"))
    text = T.clean_lines(T.strip_html(F.array_join(F.transform("bs", lambda x: x["b"]), "\n")))
    return own.select("doc", F.col("h.article_no").alias("article_no"), F.col("h.title").alias("title"), text.alias("text"), F.col("ord"))


def docx_articles(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc, article_no, title, text, ord) of plain lines, from heading to heading."""
    known = docs.select(F.col(doc_col).alias("doc"), T.line_forms(text_col).alias("t"))
    rows = _rows(known, "doc", T.bound(F.col("t"), lambda t: _from_marks(F.regexp_replace(_free(t, PART_MARK), T.HEADINGS, PART_MARK), t)))
    rows = rows.select("doc", "ord", T.heading(_head(), True).alias("h"), T.clean_lines(F.coalesce(_body(), F.lit(""))).alias("text"))
    return rows.select("doc", F.col("h.article_no").alias("article_no"), F.col("h.title").alias("title"), "text", "ord")
