"""What the queries share: stand-ins on the test tables, and SQL for the oracle.

The tables hold no Hangul, so the Korean branches run on texts whose Latin
letters are mapped to syllables; particles are among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LATIN, SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사은는이을를의에로와과도만자차카타파하서"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hangul(c: T.Text) -> Column:
    return F.translate(F.lower(T.col(c)), LATIN, SYLLABLES)


def digest(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, " ").cast("binary"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- SQL of the oracle

WS = T.WS


def sql_hangul(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{SYLLABLES}')"


def sql_no_space(x: str) -> str:
    return f"regexp_replace(nfc_normalize({x}), '{WS}+', '', 'g')"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


#: The references that the test tables hold, with and without a semicolon; the ampersand last.
_REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("middot", "·"), ("copy", "©"), ("amp", "&"))


def sql_unescape(x: str) -> str:
    for name, char in _REFERENCES:
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def sql_one_line(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_unescape(f'nfc_normalize({x})')}, '\u200b', '', 'g'), '{WS}+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def sql_grams(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) >= {n} THEN list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})) ELSE [] END)"


def sql_stem(w: str, suffixes: tuple[str, ...]) -> str:
    return f"regexp_replace({w}, '^([가-힣]{{2,}}?)(?:{'|'.join(suffixes)})$', '\\1')"


def sql_digest(tokens: str) -> str:
    return f"md5(coalesce(array_to_string({tokens}, ' '), ''))"
