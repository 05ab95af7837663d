"""Text functions, Column to Column. All but ``unescape`` and ``line_forms`` stay in the JVM.

Patterns spell out character classes that mean the same in Java, Python and
RE2: Java's ``\\s`` is ASCII unless told otherwise.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CHROME_LINES, PARTICLES, STOPWORDS, SUFFIXES

#: White space as Python's str knows it.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
HANGUL = "[가-힣]+"
NONE = "array<string>"

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, then: object) -> Column:
    """What a function makes of a column, which is computed once however often the function names it."""
    return F.transform(F.array(c), then)[0]


#: A character that may change under a normal form, alone or after another one.
_UNSTABLE = {"NFC": r"[^\x{0}-\x{2FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]", "NFKC": r"[^\x{0}-\x{7F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"}


def unicode_form(c: Text, form: str = "NFC") -> Column:
    """Unicode normalisation by the ICU library that Spark brings along, for texts that may need it."""

    def composed(text: Column) -> Column:
        compose = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(form == "NFKC"))
        return F.when(text.rlike(_UNSTABLE[form]), compose).otherwise(text)

    return composed(col(c)) if isinstance(c, str) else bound(c, composed)


def no_space(c: Text, form: str = "NFC") -> Column:
    """The normalised text without any white space: the key by which document names and questions are compared."""
    return F.regexp_replace(unicode_form(c, form), WS + "+", "")


def one_space(c: Text) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), WS + "+", " "))


_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_LINE_ENDS = dict.fromkeys(map(ord, "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"), " ")


def unescape(c: Text, within_lines: bool = False) -> Column:
    """Character references resolved, all that HTML knows by name or number; texts without an ampersand do not reach Python.

    within_lines: one that stands for a line's end is a space, so lines stay as they are.
    """
    text = col(c)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        one = (lambda m: html.unescape(m[0]).translate(_LINE_ENDS)) if within_lines else (lambda m: html.unescape(m[0]))
        return s.map(lambda x: None if x is None else _REFERENCE.sub(one, x))

    return F.coalesce(run(bound(text, lambda t: F.when(F.contains(t, F.lit("&")), t))), text)


def line_forms(c: Text, ends: bool = False) -> Column:
    """A text whose lines, between line feeds, are as ``one_line`` makes them: one pass in Python, where the references go anyway.

    ends: lines end where ``str.splitlines`` ends them, and blank ones go.
    """

    def form(x: str) -> str:
        x = unicodedata.normalize("NFC", x)
        if "&" in x:
            x = unicodedata.normalize("NFC", _REFERENCE.sub(lambda m: html.unescape(m[0]).translate(_LINE_ENDS), x))
        lines = [" ".join(y.split()) for y in (x.replace("\u200b", "").splitlines() if ends else x.replace("\u200b", "").split("\n"))]
        return unicodedata.normalize("NFC", "\n".join(filter(None, lines) if ends else lines))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else form(x))

    return run(col(c))


def one_line(c: Text, resolved: bool = False) -> Column:
    """Normalised, references resolved (unless they are), zero-width spaces gone, white space collapsed."""
    text = unicode_form(c)
    return one_space(F.regexp_replace(text if resolved else unescape(text), "\u200b", ""))


def first_number(c: Text) -> Column:
    """The first run of digits as an integer, or null."""
    return F.regexp_extract(col(c).cast("string"), "([0-9]+)", 1).try_cast("int")


def safe_number(c: Text) -> Column:
    """A value as an integer if it is one, else its text unchanged: (number, label)."""
    return F.struct(col(c).try_cast("int").alias("number"), col(c).cast("string").alias("label"))




def heading(c: Text, resolved: bool = False) -> Column:
    """(article_no, title) of a line that is an article's heading, in parentheses or bare; null otherwise."""
    bracket = r"^제 ?([0-9]+) ?조 ?[（(] ?([^）)]*?) ?[）)]$"
    bare = r"^제 ?([0-9]+) ?조 (.+)$"

    def found(line: Column) -> Column:
        by = lambda p: F.struct(F.regexp_extract(line, p, 1).cast("int").alias("article_no"), F.regexp_extract(line, p, 2).alias("title"))
        return F.when(line.rlike(bracket), by(bracket)).when(line.rlike(bare), by(bare))

    return bound(one_line(c, resolved), found)


#: Where a line that is such a heading begins, in a text of ``line_forms``.
HEADINGS = r"(?m)^(?=제 ?[0-9]+ ?조(?: ?[（(] ?[^）)\n]*? ?[）)]$| .+$))"


def strip_html(c: Text) -> Column:
    """Comments, scripts and styles go with their bodies, block tags end a line, other tags go, entities are resolved."""
    out = F.regexp_replace(col(c), "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)</?(?:br|p|li|ul|ol|div|h[1-6]|section|article|tr|td)\b[^>]*>", "\n")
    return unescape(F.regexp_replace(out, "<[^>]+>", ""))


STOP_LINE = "^(?:공고일자|시행일자) ?:.*$"


def clean_lines(c: Text, stop: str = STOP_LINE, chrome: tuple[str, ...] = CHROME_LINES) -> Column:
    """The lines of a text, normalised, up to the first stop line, without blank and chrome lines.

    Lines are taken apart only where the text has one that may be a stop or chrome line.
    """
    known = "(?m)^(?:" + "|".join(map(re.escape, chrome)) + ")$"

    def cut(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        at = F.array_position(F.transform(lines, lambda x: x.rlike(stop)), True)
        kept = F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
        return F.array_join(F.filter(kept, lambda x: ~F.array_contains(F.array(*map(F.lit, chrome)), x)), "\n")

    may = lambda t: t.rlike("(?m)" + stop) | (t.rlike(known) if chrome else F.lit(False))
    return bound(line_forms(c, ends=True), lambda t: F.when(may(t), cut(t)).otherwise(t))


# ---------------------------------------------------------------- tokenisers


def words(c: Text, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def grams(c: Text, n: int) -> Column:
    """All runs of n characters, in order, in linear time.

    An empty match that looks ahead yields the run at every place. Places are
    UTF-16 units, so texts with characters beyond the first plane go by zipping
    shifted copies of their characters.
    """
    text = col(c)
    fast = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    chars, some = F.split(text, ""), F.greatest(F.char_length(text) - n + 1, F.lit(0))
    slow = F.slice(chars, F.lit(1), some)
    for k in range(1, n):
        slow = F.zip_with(slow, F.slice(chars, F.lit(k + 1), some), lambda x, y: F.concat(x, y))
    slow = F.when(F.char_length(text) >= n, slow).otherwise(F.array().cast(NONE))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), slow).otherwise(fast)


def word_tokens(c: Text) -> Column:
    """Lower-cased runs of letters and digits."""
    return words(F.lower(col(c)), r"[\p{L}\p{N}]+")


def ngram_tokens(c: Text) -> Column:
    """All 2-grams, then all 3-grams of the lower-cased text without white space."""
    bare = no_space(F.lower(col(c)))
    return F.concat(grams(bare, 2), grams(bare, 3))


def hybrid_tokens(c: Text) -> Column:
    return F.concat(word_tokens(c), ngram_tokens(c))


def without_ending(w: Column, endings: Sequence[str]) -> Column:
    """A word without the longest ending that leaves two characters, or null if it has none. Endings are looked up by length, not tried one by one."""
    n, out = F.char_length(w), None
    for size in sorted({len(e) for e in endings}, reverse=True):
        found = (n >= size + 2) & F.substring(w, -size, size).isin([e for e in endings if len(e) == size])
        cut = F.substring(w, F.lit(1), n - size)
        out = F.when(found, cut) if out is None else out.when(found, cut)
    return out


def particle_tokens(c: Text, particles: bool = True, bigrams: bool = True) -> Column:
    """Words, and of Hangul words also the form without its particle and all syllable pairs. Words are taken once."""
    none = F.array().cast(NONE)

    def forms(w: Column) -> Column:
        stem = without_ending(w, PARTICLES)
        own = F.when(stem.isNotNull(), F.array(w, stem)).otherwise(F.array(w)) if particles else F.array(w)
        pairs = F.regexp_extract_all(w, F.lit("(?=([가-힣]{2}))"), F.lit(1)) if bigrams else none
        return F.when(w.rlike("^[가-힣]{2,}$"), F.concat(own, pairs)).otherwise(F.array(w))

    return F.flatten(F.transform(words(unicode_form(c), "[0-9A-Za-z가-힣]+"), forms))


def set_tokens(c: Text, digits: bool = False) -> Column:
    """Distinct words of the text in NFC; with those of digits alone, in NFKC."""
    found = F.array_distinct(words(unicode_form(c, "NFKC" if digits else "NFC"), "[0-9A-Za-z가-힣]+"))
    return found if digits else F.filter(found, lambda w: ~w.rlike("^[0-9]+$"))


def content_tokens(c: Text) -> Column:
    """Runs of digits, of Latin letters or of Hangul without their endings; short words and stop words go."""
    text = F.translate(unicode_form(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stems = F.transform(words(text, "[0-9]{2,}|[a-z]{2,}|[가-힣]{2,}"), lambda w: F.coalesce(without_ending(w, SUFFIXES), w))
    return F.filter(stems, lambda w: ~w.isin(list(STOPWORDS)))


def char_bigrams(c: Text) -> Column:
    return grams(no_space(c), 2)


def gram_set(c: Text, n: int) -> Column:
    """The distinct n-grams of the text without white space."""
    return F.array_distinct(grams(no_space(c), n))


TOKENISERS = {
    "word": word_tokens,
    "ngram": ngram_tokens,
    "hybrid": hybrid_tokens,
    "particle": particle_tokens,
    "plain": lambda c: particle_tokens(c, particles=False),
    "content": content_tokens,
    "bigram": char_bigrams,
}


def tokenise(c: Text, name: str = "word") -> Column:
    if name not in TOKENISERS:
        raise ValueError(f"tokeniser must be one of: {', '.join(TOKENISERS)}")
    return TOKENISERS[name](c)


def window_inside(fact: Text, text: Text, n: int) -> Column:
    """Whether any n characters in a row of the fact occur in the text; not if the fact is shorter. One pass over each: their n-grams meet by hash."""
    return F.arrays_overlap(grams(fact, n), grams(text, n))
