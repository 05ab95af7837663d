"""Constraints and data quality: contracts, duplicates, coverage, leaks, outputs.

Each check returns rows that say what is wrong, so an empty result is a pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import CUTOFF
from .metrics import fact_found


def problems(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of the checks whose condition holds."""
    said = [F.when(cond, F.lit(what) if isinstance(what, str) else what) for cond, what in checks]
    return F.array_compact(F.array(*said))


def contract_problems(answer: T.Text, refs: Column, allowed: Sequence[str] | None = None) -> Column:
    """What an answer with references (doc, article as text; null: no pair) breaks.

    allowed is the short list of document names.
    """
    blank = F.coalesce(F.trim(T.col(answer)) == "", F.lit(True))
    count = F.coalesce(F.size(refs), F.lit(-1))
    bad_pair = F.exists(refs, lambda r: r.isNull())
    bad_no = F.exists(refs, lambda r: r.isNotNull() & ~F.coalesce(F.trim(r["article"].cast("string")).rlike("^[0-9]+$"), F.lit(False)))
    checks = [(blank, "answer is blank"), (~count.between(1, CUTOFF), "1 to 4 references"), (F.coalesce(bad_pair, F.lit(False)), "reference is no pair"), (F.coalesce(bad_no, F.lit(False)), "article is no number")]
    if allowed is not None:
        names = F.array(*map(F.lit, allowed))
        unknown = F.exists(refs, lambda r: r.isNotNull() & ~F.array_contains(names, r["doc"]))
        checks.append((F.coalesce(unknown, F.lit(False)), "unknown document"))
    return problems(*checks)


def unknown_documents(refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows (qid, doc) whose document, white space aside, is on no allow-list (doc)."""
    keys = allowed.select(T.no_space("doc").alias("k")).distinct()
    return refs.withColumn("k", T.no_space("doc")).join(keys, "k", "left_anti").drop("k")


def key_differences(gold: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that are missing, unknown, or given more than once."""
    have = given.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    want = gold.select(key).distinct()
    say = lambda df, what: df.select(key, F.lit(what).alias("problem"))
    return say(have.where("n > 1"), "duplicate").unionByName(say(want.join(have, key, "left_anti"), "missing")).unionByName(say(have.join(want, key, "left_anti"), "unknown"))


def first_or_last(rows: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """One row per key: that of the least order, or of the greatest. A partial aggregate, no window."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    pick = F.min_by if keep == "first" else F.max_by
    others = [c for c in rows.columns if c != key]
    got = rows.groupBy(key).agg(pick(F.struct(*others), F.col(order)).alias("r"))
    return got.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def require_count(rows: DataFrame, expected: int | None) -> DataFrame:
    """rows, or an error as they are read if their number is not the expected one; None or 0 expect nothing."""
    if not expected:
        return rows
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    ok = F.assert_true(F.col("__n") == expected, F.concat(F.lit(f"expected {expected} rows, found "), F.col("__n").cast("string")))
    return rows.crossJoin(F.broadcast(n)).where(F.coalesce(ok.cast("string"), F.lit("")) == "").drop("__n")


def output_problems(results: DataFrame) -> DataFrame:
    """(blind_id, problem) of results (blind_id, total, status)."""
    failed = F.col("status") == "failed"
    checks = problems(
        (~F.col("status").isin("completed", "partial", "failed") | F.col("status").isNull(), "status"),
        (failed & F.col("total").isNotNull(), "failed with a total"),
        (~F.coalesce(failed, F.lit(False)) & ~F.coalesce(F.col("total").between(0, 100), F.lit(False)), "total out of range"),
        (~F.coalesce(F.col("status") == "completed", F.lit(False)), "not completed"),
    )
    own = results.select("blind_id", F.explode(checks).alias("problem"))
    twice = results.groupBy("blind_id").count().where("count > 1").select("blind_id", F.lit("duplicate").alias("problem"))
    return own.unionByName(twice)


def corpus_checks(articles: DataFrame, doc: str = "doc", no: str = "article_no", text: str = "text") -> DataFrame:
    """(doc, n, distinct, lo, hi, blank, contiguous) per document: numbers run from 1 without gaps or repeats, texts are not empty."""
    out = articles.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(no).alias("n_distinct"), F.min(no).alias("lo"), F.max(no).alias("hi"),
        F.sum((F.coalesce(F.trim(F.col(text)), F.lit("")) == "").cast("long")).alias("blank"),
    )
    return out.withColumn("contiguous", (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("n") == F.col("n_distinct")))


def repeated_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, n, first_id): texts that repeat, white space aside. Keys are digests, so long texts are not shuffled."""
    key = F.sha2(T.no_space(text_col), 256)
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def leaks(questions: DataFrame, gold: DataFrame, n: int = 10) -> DataFrame:
    """(qid, leaked): whether any n characters in a row of a question occur in its gold texts.

    questions (qid, question), gold (qid, text). Texts of a question are
    compared one by one, and pairs meet by qid.
    """
    pairs = questions.select("qid", T.no_space("question").alias("q")).join(gold.select("qid", T.no_space("text").alias("t")), "qid")
    return pairs.groupBy("qid").agg(F.bool_or(T.window_inside("q", "t", n)).alias("leaked"))


def grounded(facts: DataFrame, gold: DataFrame, n: int = 12) -> DataFrame:
    """(qid, fact_no, problem): short, or with no n characters in a row in any gold text; null if in order."""
    pairs = facts.select("qid", "fact_no", T.no_space("fact").alias("f")).join(gold.select("qid", T.no_space("text").alias("t")), "qid", "left")
    ok = pairs.groupBy("qid", "fact_no").agg(F.max(F.char_length("f")).alias("size"), F.bool_or(F.coalesce(T.window_inside("f", "t", n), F.lit(False))).alias("found"))
    return ok.select("qid", "fact_no", F.when(F.col("size") < n, "short").when(~F.col("found"), "not grounded").alias("problem"))


def coverage(articles: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """(key, refs, primary, ok) of all articles against references (key, pos): two at least, of which two are first."""
    n = refs.groupBy(key).agg(F.count(F.lit(1)).alias("refs"), F.sum((F.col("pos") == 0).cast("long")).alias("primary"))
    out = articles.select(key).join(n, key, "left").na.fill(0, ["refs", "primary"])
    return out.withColumn("ok", (F.col("refs") >= 2) & (F.col("primary") == 2))


def bench_problems(c_id: T.Text, position: Column, ptype: T.Text, difficulty: T.Text, question: T.Text, refs: Column, facts: Column) -> Column:
    """What a benchmark question breaks: its id, domains, number of references and facts."""
    n = F.coalesce(F.size(refs), F.lit(0))
    return problems(
        (T.col(c_id) != F.format_string("S%03d", position), "id"),
        (~T.col(ptype).isin("basic", "exact", "trap", "cross"), "ptype"),
        (~T.col(difficulty).isin("easy", "medium", "hard"), "difficulty"),
        (F.trim(T.col(question)) == "", "question"),
        (~n.between(1, 3), "references"),
        ((T.col(ptype) == "cross") & (n < 2), "cross"),
        (F.coalesce(F.size(facts), F.lit(0)) == 0, "facts"),
    )


def bench_statistics(rows: DataFrame, *dims: str) -> DataFrame:
    """(dim, value, n): counts by several columns and the total, in one pass over the rows."""
    named = [F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("value")) for d in dims]
    total = F.struct(F.lit("total").alias("dim"), F.lit("").alias("value"))
    return rows.select(F.explode(F.array(*named, total)).alias("x")).groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n"))


def numbered(specs: DataFrame, order: str, articles: DataFrame) -> DataFrame:
    """Benchmark questions of specs (order, owner, question, ptype, difficulty, gold, key_facts).

    gold defaults to the owner and a cross question's begins with it; references get their title and citation from articles (doc, article_no, title).
    """
    gold = F.when(F.col("ptype") == "cross", F.concat(F.array("owner"), F.coalesce("gold", F.array().cast(dict(specs.dtypes)["gold"])))).otherwise(F.coalesce("gold", F.array("owner")))
    rows = specs.withColumns({"gold": gold, "id": F.format_string("S%03d", F.col(order))})
    refs = rows.select("id", F.posexplode("gold").alias("pos", "g")).join(articles, (F.col("g.doc") == articles["doc"]) & (F.col("g.article") == articles["article_no"]))
    cited = F.format_string("%s 제%s조(%s)", F.col("g.doc"), F.col("g.article").cast("string"), F.col("title"))
    full = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("g.doc").alias("doc"), F.col("g.article").alias("article"), cited.alias("citation")))).alias("r"))
    out = rows.join(full, "id").withColumn("gold_articles", F.transform("r", lambda x: F.struct(x["doc"].alias("doc"), x["article"].alias("article"), x["citation"].alias("citation"))))
    return out.select("id", "question", "ptype", "difficulty", "gold_articles", "key_facts")


def audit(refs: DataFrame, articles: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, n_refs, missing, n_facts, found, share) of references (qid, doc, article_no) and facts (qid, fact): which exist and which facts their texts hold."""

    texts = refs.join(articles.select("doc", "article_no", "text"), ["doc", "article_no"], "left")
    by_q = texts.groupBy("qid").agg(F.count(F.lit(1)).alias("n_refs"), F.sum(F.col("text").isNull().cast("long")).alias("missing"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "article_no", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    checked = by_q.join(facts, "qid", "left").withColumn("f", F.when(F.col("fact").isNotNull(), fact_found("fact", "text").cast("long")))
    out = checked.groupBy("qid").agg(F.max("n_refs").alias("n_refs"), F.max("missing").alias("missing"), F.count("fact").alias("n_facts"), F.coalesce(F.sum("f"), F.lit(0)).alias("found"))
    return out.withColumn("share", F.when(F.col("n_facts") > 0, F.col("found") / F.col("n_facts")).otherwise(F.lit(1.0)))
