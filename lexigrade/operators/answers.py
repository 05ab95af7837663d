"""Answers: question forms, contexts, extraction, cleaning, selection, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import CUTOFF, ENUMERATION, FILLER, FOREIGN, PREAMBLE, REFUSAL, TOKEN_BUDGET, WH_WORDS, YES_NO
from .chunking import sentences, source_spans

_STRINGS = "array<string>"


def pattern(text: str) -> str:
    """A pattern whose white space is Python's."""
    return text.replace(r"\s", T.WS)


def question_form(c: T.Text, enumeration: str = ENUMERATION, yes_no: str = YES_NO, wh: str = WH_WORDS) -> Column:
    """enum, multi (two different question words), yesno (no question word) or single."""
    text = F.trim(T.col(c))
    n = F.size(F.array_distinct(T.words(text, wh)))
    return F.when(text.rlike(pattern(enumeration)), "enum").when(n >= 2, "multi").when(text.rlike(pattern(yes_no)) & (n == 0), "yesno").otherwise("single")


def token_budget(form: Column, budgets: dict[str, int] | None = None) -> Column:
    budgets = budgets or TOKEN_BUDGET
    return F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))])[form]


def kept_bodies(lengths: Column, full_ranks: int = 2, budget: int = 7000) -> Column:
    """Of hits in rank order, whose bodies go in: the first ranks' always, then those that still fit. A body left out costs nothing."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc: Column, n: Column) -> Column:
        early = acc["i"] < full_ranks
        fits = early | (acc["used"] + n <= budget)
        return F.struct((acc["i"] + 1).alias("i"), (acc["used"] + F.when(fits & ~early, n).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(acc["keep"], F.array(fits)).alias("keep"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["keep"])


def capped_bodies(lengths: Column, most: int = 3600, total: int = 7200, mark: int = 8) -> Column:
    """The other budget: bodies are cut to ``most`` (plus a mark's length) and, but for the first, left out when the total is passed."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc: Column, n: Column) -> Column:
        size = F.when(n > most, F.lit(most + mark)).otherwise(n)
        fits = (F.size(acc["keep"]) == 0) | (acc["used"] + size <= total)
        return F.struct((acc["used"] + F.when(fits, size).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(acc["keep"], F.array(fits)).alias("keep"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["keep"])


def context(hits: Column, full_ranks: int = 2, budget: int = 7000) -> Column:
    """The context block of hits (doc, article_no, title, text) in rank order."""
    keep = kept_bodies(F.transform(hits, lambda h: F.char_length(h["text"]).cast("long")), full_ranks, budget)

    def block(h: Column, i: Column) -> Column:
        head = F.format_string("<조항 %d> [%s 제%s조(%s)]", i + 1, h["doc"].cast("string"), h["article_no"].cast("string"), h["title"])
        return F.when(F.get(keep, i), F.concat(head, F.lit("\n"), h["text"])).otherwise(head)

    return F.array_join(F.transform(hits, block), "\n\n")


def messages(system: str, shots: list[tuple[str, str]], user: Column) -> Column:
    """A chat: the system text, question and answer shots, and the user's text."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = [one("system", F.lit(system))]
    for q, a in shots:
        rows += [one("user", F.lit(q)), one("assistant", F.lit(a))]
    return F.array(*rows, one("user", user))


def best_spans(hits: DataFrame, questions: DataFrame, tokeniser: str = "plain") -> DataFrame:
    """(qid, answer): the extracted answer of questions (qid, question, form) from hits (qid, rank, text).

    An enumeration takes all spans of the first hit; another question the span
    that shares most distinct tokens with it, earlier ones first.
    """
    rows = hits.join(questions.select("qid", "question", "form"), "qid").select("qid", "question", "form", "rank", "text", source_spans("text").alias("spans"))
    whole = rows.where((F.col("form") == "enum") & (F.col("rank") == 1)).select("qid", F.array_join("spans", " ").alias("answer"))
    spans = rows.where("form <> 'enum'").select("qid", F.array_distinct(T.tokenise("question", tokeniser)).alias("q"), "rank", F.posexplode_outer("spans").alias("pos", "span"), "text")
    span = F.coalesce("span", F.when(F.col("rank") == 1, F.col("text")))
    scored = spans.withColumn("span", span).where("span IS NOT NULL").withColumn("hits", F.size(F.array_intersect("q", F.array_distinct(T.tokenise("span", tokeniser)))))
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), "rank", "pos")
    picked = scored.withColumn("i", F.row_number().over(order)).where("i = 1").select("qid", F.col("span").alias("answer"))
    return whole.unionByName(picked)


def postprocessed(c: T.Text) -> Column:
    """An answer without label, filler and foreign script, each sentence once, blanks collapsed."""
    out = F.regexp_replace(F.trim(T.col(c)), pattern(PREAMBLE), "")
    out = F.regexp_replace(F.regexp_replace(out, pattern(FILLER), ""), FOREIGN, "")
    parts = sentences(out, lines=True)
    # Of sentences alike the first stays: sorted, those alike lie together, the first one in front.
    keyed = F.sort_array(F.transform(parts, lambda x, i: F.struct(T.no_space(x).alias("key"), i.alias("i"), x.alias("x"))))
    first = lambda s: F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (F.get(s, i - 1)["key"] != e["key"]), F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e.isNotNull())
    kept = F.transform(F.sort_array(F.transform(F.array(keyed), first)[0]), lambda e: e["x"])
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), "[ \t]+", " "))


def cleaned(c: T.Text) -> Column:
    """The other cleaning: label and bullets go, full-width stops become plain, lines become one."""
    out = F.regexp_replace(T.col(c), rf"(?i)^{T.WS}*(?:답변|Answer){T.WS}*[:：]{T.WS}*", "")
    out = F.regexp_replace(out, r"(?m)^[\t-\r\x20]*(?:[-*•]|#+)[\t-\r\x20]*", "")
    out = F.replace(F.replace(out, F.lit("。"), F.lit(". ")), F.lit("，"), F.lit(", "))
    out = F.regexp_replace(out, rf"{T.WS}+([.,])", "$1")
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def evades(c: T.Text) -> Column:
    """Whether an answer is empty or says that it does not know."""
    text = F.coalesce(T.col(c), F.lit(""))
    return (F.trim(text) == "") | text.rlike(pattern(REFUSAL))


def copy_rate(answer: T.Text, contexts: Column, n: int = 5) -> Column:
    """Share of the answer's distinct n-grams that some context (an array of texts) has."""
    a = T.gram_set(answer, n)
    source = F.array_distinct(F.flatten(F.transform(contexts, lambda c: T.gram_set(c, n))))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, source)) / F.size(a)).otherwise(F.lit(0.0))


def copy_rates(pairs: DataFrame, key: str, answer: T.Text, context: T.Text, n: int = 5) -> DataFrame:
    """(key, copy): the share of an answer's distinct n-grams that any of its contexts has, for a row per answer and context.

    Only n-grams that both have leave their row, so contexts may be as many as they are.
    """
    a = T.gram_set(answer, n)
    rows = pairs.select(F.col(key), a.alias("a"), F.array_intersect(a, T.gram_set(context, n)).alias("both"))
    found = rows.select(key, F.size("a").alias("n"), F.explode_outer("both").alias("gram")).groupBy(key).agg(F.max("n").alias("n"), F.countDistinct("gram").alias("k"))
    return found.select(key, F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0)).alias("copy"))


def grounding(answer: T.Text, text: T.Text) -> Column:
    return copy_rate(answer, F.array(T.col(text)), 3)


def ending_rate(c: T.Text) -> Column:
    """One less the share of sentences of ten characters or more that end in a nominal form; 0 if there are none."""
    long = F.filter(sentences(c, lines=True), lambda s: F.char_length(s) >= 10)
    bare = F.transform(long, lambda s: F.regexp_replace(s, rf"[.\t-\r\x20\p{{Z}}]+$", ""))
    bad = F.filter(bare, lambda s: s.rlike("(음|함|임|됨|짐|옴|기)$") & ~s.endswith("니다"))
    return F.when(F.size(long) > 0, 1.0 - F.size(bad) / F.size(long)).otherwise(F.lit(0.0))


def unusable(c: T.Text) -> Column:
    """Whether an answer is too short, holds foreign script, breaks off, or repeats a sentence."""
    text = F.coalesce(T.col(c), F.lit(""))
    last = F.trim(F.element_at(F.split(F.regexp_replace(text, rf"{T.WS}+$", ""), "\n"), -1))
    listed = last.rlike(rf"^{T.WS}*(?:[0-9]+[.)]|[-*·]){T.WS}*[^\t-\r\x20\p{{Z}}]")
    ended = last.rlike(r"(다\.|\.|요\.|!|\?|다|요|:)$")
    marked = F.regexp_replace(text, rf"(다\.){T.WS}*", "$1\x02")
    parts = F.filter(F.transform(F.split(marked, "[\x02\n]"), lambda x: F.trim(x)), lambda s: F.char_length(s) >= 15)
    return (F.char_length(text) < 15) | text.rlike("[一-鿿぀-ヿ]") | (~listed & ~ended) | (F.size(parts) != F.size(F.array_distinct(parts)))


def best_of(candidates: Column, margin: float = 0.01, exit_copy: float = 0.95) -> Column:
    """The place of the candidate that stays, of an array of (copy, ending, fail) with the greedy one first.

    A candidate replaces the best so far if it copies more by a margin and ends
    no worse, or copies as much and ends better; a good greedy one ends the search.
    """
    first = F.element_at(candidates, 1)
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("best"), F.when(first["fail"], F.lit(-1.0)).otherwise(first["copy"]).alias("copy"),
        F.when(first["fail"], F.lit(-1.0)).otherwise(first["ending"]).alias("ending"),
    )

    def step(acc: Column, c: Column) -> Column:
        i = acc["i"] + 1
        more = (c["copy"] > acc["copy"] + margin) & (c["ending"] >= acc["ending"])
        same = (F.abs(c["copy"] - acc["copy"]) <= margin) & (c["ending"] > acc["ending"])
        wins = ~c["fail"] & (more | same)
        return F.struct(i.alias("i"), F.when(wins, i).otherwise(acc["best"]).alias("best"), F.when(wins, c["copy"]).otherwise(acc["copy"]).alias("copy"), F.when(wins, c["ending"]).otherwise(acc["ending"]).alias("ending"))

    rest = F.slice(candidates, F.lit(2), F.greatest(F.size(candidates) - 1, F.lit(0)))
    done = ~first["fail"] & (first["copy"] >= exit_copy) & (first["ending"] >= 1.0)
    return F.when(done, F.lit(0)).otherwise(F.aggregate(rest, start, step)["best"])


def question_seed(c: T.Text) -> Column:
    return F.lit(42) + F.crc32(F.encode(T.col(c), "UTF-8")) % 100000


def repaired_answer(answer: T.Text, other: T.Text, text: T.Text, least: float = 0.5) -> Column:
    """The other answer, if this one is hardly grounded in the text and the other is more so."""
    return better_grounded(answer, other, grounding(answer, text), grounding(other, text), least)


def better_grounded(answer: T.Text, other: T.Text, here: Column, there: Column, least: float = 0.5) -> Column:
    """repaired_answer for known shares of both answers that the text has."""
    return F.when((here < least) & T.col(other).isNotNull() & (there > here), T.col(other)).otherwise(T.col(answer))


def _or_none(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("(없음)"))


def judge_prompt(question: T.Text, gold: Column, facts: Column, answer: T.Text, refs: Column, blank: Column | None = None) -> Column:
    """The prompt of the final judge. gold: (doc, article, citation); refs: (doc, article), null items are skipped.

    blank: what stands for an answer that is empty or missing.
    """
    cited = F.transform(gold, lambda g: F.coalesce(F.nullif(g["citation"], F.lit("")), F.concat(F.coalesce(g["doc"], F.lit("")), F.lit(" 제"), F.coalesce(g["article"].cast("string"), F.lit("")), F.lit("조"))))
    cites = F.array_join(F.transform(cited, lambda x: F.concat(F.lit("- "), x)), "\n")
    listed = F.array_join(F.transform(facts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    picked = F.array_join(F.transform(F.array_compact(F.slice(refs, 1, CUTOFF)), lambda r: F.concat(r["doc"], F.lit(" 제"), r["article"].cast("string"), F.lit("조"))), ", ")
    empty = F.coalesce(F.nullif(T.col(answer), F.lit("")), F.lit("(빈 답변)") if blank is None else blank)
    return F.concat(
        F.lit("[질문]\n"), T.col(question), F.lit("\n\n[정답 근거 조항]\n"), _or_none(cites), F.lit("\n\n[정답 키팩트]\n"), _or_none(listed),
        F.lit("\n\n[참가자가 검색한 근거]\n"), _or_none(picked), F.lit("\n\n[참가자 답변]\n"), empty, F.lit("\n\n위 기준에 따라 네 축을 채점하십시오."),
    )


def judge_prompt_with_sources(question: T.Text, citations: Column, facts: Column, answer: T.Text, bodies: Column, body_chars: int = 700, answer_chars: int = 4000) -> Column:
    """The prompt that also shows the start of each gold article; an answer is fenced and cut."""
    shown = F.array_join(F.transform(bodies, lambda b: F.substring(b, 1, body_chars)), "\n")
    parts = F.array_compact(
        F.array(
            F.lit("[질문]"), T.col(question), F.lit("\n[정답 근거 조항]"), _or_none(F.array_join(citations, "; ")), F.lit("\n[정답 핵심내용]"),
            _or_none(F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")), F.when(F.size(bodies) > 0, F.concat(F.lit("\n[근거 조항 원문]\n"), shown)),
            F.lit("\n[답변] <<<"), F.substring(F.coalesce(T.col(answer), F.lit("")), 1, answer_chars), F.lit(">>>"),
        )
    )
    return F.array_join(parts, "\n")
