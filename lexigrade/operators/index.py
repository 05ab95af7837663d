"""Index statistics: postings, lengths, document frequencies, idf, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tokenised(rows: DataFrame, id_col: str, text_col: str, tokeniser: str = "word") -> DataFrame:
    """(unit, toks, dl): the tokens of each unit and their number, repeats included."""
    return rows.select(F.col(id_col).alias("unit"), T.tokenise(text_col, tokeniser).alias("toks")).withColumn("dl", F.size("toks"))


def term_counts(toks: T.Text) -> Column:
    """(term, tf) of an array of tokens, within the row: sorted, a run of equal ones is a term and its length the count."""
    s, n = F.sort_array(T.col(toks)), F.size(T.col(toks))
    begins = F.transform(F.array(s), lambda a: F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1))))[0]
    ends = lambda b: F.concat(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    pairs = F.transform(F.array(F.struct(s.alias("s"), begins.alias("b"))), lambda x: F.zip_with(x["b"], ends(x["b"]), lambda i, j: F.struct(F.get(x["s"], i).alias("term"), (j - i).alias("tf"))))[0]
    return pairs


def postings(units: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, unit, tf, dl). With ``terms`` (term), tokens that no question asks for are left out before anything is shuffled."""
    rows = units.select("unit", "dl", F.explode("toks").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "unit", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(units: DataFrame) -> DataFrame:
    """One row: the number of units and their mean length; 0 for no units."""
    return units.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """Positive for every document frequency."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_stats(rows: DataFrame, id_col: str, text_col: str, tokeniser: str = "word") -> DataFrame:
    """(term, cf, df, idf) of all terms."""
    units = tokenised(rows, id_col, text_col, tokeniser)
    by_term = postings(units).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    return by_term.crossJoin(F.broadcast(corpus_stats(units))).select("term", "cf", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def unit_vector(c: T.Text) -> Column:
    """A vector of doubles scaled to length 1; zeros stay."""
    v = T.col(c).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def index_text(style: str, doc: T.Text, no: T.Text, title: T.Text, body: T.Text) -> Column:
    """The text of an article that is indexed, in one of the four styles."""
    d, n, t, b = (F.coalesce(T.col(x).cast("string"), F.lit("")) for x in (doc, no, title, body))
    if style == "joined":
        return F.concat_ws(" ", d, t, b)
    if style == "title":
        return F.concat(t, F.lit("\n"), b)
    if style == "bracket":
        return F.concat(F.lit("["), d, F.lit(" "), t, F.lit("]\n"), b)
    if style == "cited":
        return F.concat(d, F.lit(" 제"), n, F.lit("조("), t, F.lit(")\n"), b)
    raise ValueError("style must be one of: joined, title, bracket, cited")


def model_text(c: T.Text, model: T.Text, kind: str) -> Column:
    """Adds the prefix that E5 models expect of queries and passages."""
    needs = T.col(model).rlike("(?i)(^|/)(multilingual-)?e5-")
    return F.when(needs, F.concat(F.lit(f"{kind}: "), T.col(c))).otherwise(T.col(c))
