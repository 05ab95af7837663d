"""Metrics: retrieval ranks, key-fact overlap, judge scores, totals, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import AXIS_WEIGHTS, COST, CUTOFF, TOTAL_WEIGHTS
from . import index

# ---------------------------------------------------------------- retrieval


def reciprocal_rank(hits: DataFrame, gold: DataFrame, cutoff: int | None = CUTOFF) -> DataFrame:
    """(qid, rr) of questions with hits (qid, unit, rank) against gold (qid, unit): one over the first gold rank, else 0."""
    within = hits if cutoff is None else hits.where(F.col("rank") <= cutoff)
    marked = within.join(gold.select("qid", "unit").distinct().withColumn("g", F.lit(1)), ["qid", "unit"], "left")
    return marked.groupBy("qid").agg(F.coalesce(1.0 / F.min(F.when(F.col("g") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))


def parsed_refs(c: T.Text) -> Column:
    """References of any of the accepted JSON shapes as an array of (doc, article), null where one cannot be read.

    An item is a pair or an object with doc, document or doc_name and article or article_no.
    """
    items = F.from_json(T.col(c), "array<string>")

    def one(x: Column) -> Column:
        pair = F.from_json(x, "array<string>")
        doc = F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("doc", "document", "doc_name")])
        art = F.coalesce(F.get_json_object(x, "$.article"), F.get_json_object(x, "$.article_no"))
        is_pair = x.startswith("[")
        d, a = F.when(is_pair, F.get(pair, F.lit(0))).otherwise(doc), F.when(is_pair, F.get(pair, F.lit(1))).otherwise(art)
        return F.when(d.isNotNull() & a.isNotNull(), F.struct(T.no_space(d).alias("doc"), T.first_number(a).alias("article")))

    return F.transform(items, one)


def rr_of_refs(refs: Column, gold: Column, cutoff: int | None = CUTOFF) -> Column:
    """Reciprocal rank of an array of references (null items keep their rank) against an array of gold ones."""
    part = refs if cutoff is None else F.slice(refs, 1, cutoff)
    at = F.array_position(F.transform(part, lambda x: F.coalesce(F.array_contains(gold, x), F.lit(False))), True)
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def retrieval_scores(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, recall, full, rr, hit1) of every gold question; questions without hits score 0."""
    g = gold.select("qid", "unit").distinct()
    found = g.join(hits.select("qid", "unit", "rank"), ["qid", "unit"], "left")
    out = found.groupBy("qid").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), (F.count("rank") == F.count(F.lit(1))).cast("double").alias("full"), F.min("rank").alias("r"))
    return out.select("qid", "recall", "full", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr"), F.coalesce((F.col("r") == 1).cast("double"), F.lit(0.0)).alias("hit1"))


def retrieval_means(scores: DataFrame, *by: str) -> DataFrame:
    """Means of retrieval_scores, by some columns; a null group is ``?``."""
    keys = [F.coalesce(F.col(k), F.lit("?")).alias(k) for k in by]
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in ("recall", "full", "rr", "hit1")])


# ---------------------------------------------------------------- overlap


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct tokens."""
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def multiset_prf(rows: DataFrame, key: str, answer: str, facts: str) -> DataFrame:
    """(key, overlap, precision, recall, f1) of two columns of token arrays, repeats counted. Tokens are counted within their row: nothing moves."""
    counted = F.map_from_entries(index.term_counts(answer))
    wanted = index.term_counts(facts)
    both = F.transform(F.array(F.struct(counted.alias("a"), wanted.alias("f"))), lambda x: F.aggregate(x["f"], F.lit(0).cast("long"), lambda s, e: s + F.least(e["tf"], F.coalesce(F.try_element_at(x["a"], e["term"]), F.lit(0)))))[0]
    out = rows.select(F.col(key), both.alias("overlap"), F.size(answer).alias("na"), F.size(facts).alias("nf"))
    p = F.when((F.col("na") > 0) & (F.col("nf") > 0), F.col("overlap") / F.col("na")).otherwise(F.lit(0.0))
    r = F.when((F.col("na") > 0) & (F.col("nf") > 0), F.col("overlap") / F.col("nf")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("overlap") > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))
    return out.select(key, "overlap", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def covered(answer: Column, fact: Column, threshold: float) -> Column:
    """Whether a fact's distinct tokens are in the answer's to a threshold; not if it has none."""
    return F.coalesce((F.size(fact) > 0) & (F.size(F.array_intersect(fact, answer)) / F.nullif(F.size(fact), F.lit(0)) >= threshold), F.lit(False))


def fact_recall(answer: Column, facts: Column, threshold: float = 0.7) -> Column:
    """Share of an array of facts (token arrays) that are covered."""
    return F.size(F.filter(facts, lambda f: covered(answer, f, threshold))) / F.size(facts)


def soft_recall(answer: T.Text, fact: T.Text) -> Column:
    """Share of a fact's distinct 3-grams that the answer has; 0 if it has none."""
    f, a = T.gram_set(fact, 3), T.gram_set(answer, 3)
    return F.when(F.size(f) > 0, F.size(F.array_intersect(f, a)) / F.size(f)).otherwise(F.lit(0.0))


def hard_covered(answer: T.Text, fact: T.Text, n: int = 8) -> Column:
    """Whether any n characters in a row of the fact, white space aside, are in the answer."""
    return T.window_inside(T.no_space(fact), T.no_space(answer), n)


def fact_found(fact: T.Text, text: T.Text, n: int = 12) -> Column:
    """The same with white space collapsed."""
    return T.window_inside(T.one_space(fact), T.one_space(text), n)


#: N-grams of an item that are looked for one by one; more of them meet the answer's by hash.
FEW_GRAMS = 1 << 10


def fact_marks(docs: DataFrame, items: DataFrame, item: str, answer: str, facts: str, soft: int | None = None, hard: int | None = None, form: object = T.no_space) -> DataFrame:
    """docs with a mark per fact of their item in arrays ``soft`` (soft_recall by n-grams) and ``hard`` (whether any n-gram is in the answer), and ``bare``, the answer's form.

    An item's n-grams are made once per item and looked for in an answer once, however
    many facts there are; those that are found meet each fact.
    """
    sizes = {n for n in (soft, hard) if n}
    own = items.select(item, F.transform(facts, lambda f: T.bound(form(f), lambda x: F.struct(*[F.array_distinct(T.grams(x, n)).alias(f"g{n}") for n in sizes]))).alias("__facts"))
    own = own.select("*", *[F.array_distinct(F.flatten(F.col(f"__facts.g{n}"))).alias(f"__g{n}") for n in sizes])
    both = docs.withColumn("bare", form(answer)).join(own, item)
    met = lambda n, mark: T.bound(F.when((F.size(f"__g{n}") <= FEW_GRAMS) & F.col("bare").isNotNull(), F.filter(f"__g{n}", lambda g: F.contains(F.col("bare"), g))).otherwise(F.array_intersect(f"__g{n}", T.grams("bare", n))), lambda hit: F.transform("__facts", lambda f: mark(f[f"g{n}"], hit)))
    if soft:
        both = both.withColumn("soft", met(soft, lambda g, hit: F.when(F.size(g) > 0, F.size(F.array_intersect(g, hit)) / F.size(g)).otherwise(F.lit(0.0))))
    if hard:
        both = both.withColumn("hard", met(hard, F.arrays_overlap))
    return both.drop("__facts", *[f"__g{n}" for n in sizes])


def array_mean(c: T.Text) -> Column:
    """The mean of an array of numbers without nulls."""
    return T.bound(T.col(c), lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double")) / F.size(x))


# ---------------------------------------------------------------- judge and totals


def judge_score(axes: dict[str, T.Text]) -> Column:
    """Weighted axes of 0 to 10 as 0 to 100; what is no number counts 0."""
    total = F.lit(0.0)
    for name, weight in AXIS_WEIGHTS.items():
        value = F.coalesce(T.col(axes[name]).try_cast("double"), F.lit(0.0))
        total = total + weight * F.greatest(F.lit(0.0), F.least(F.lit(10.0), value))
    return total * 10.0


def parsed_axes(c: T.Text, strict: bool = True) -> Column:
    """Axes from a judge's reply, null if it is not in order.

    Strict: code fences go, and a value out of range spoils the reply. Otherwise
    the first braces count, values may be objects with a score, and are rounded half to even and clamped.
    """
    text = T.col(c)
    if strict:
        body = F.trim(F.regexp_replace(text, r"(?i)^```(?:json)?[\t-\r ]*|[\t-\r ]*```$", ""))
        get = lambda k: F.get_json_object(body, f"$.{k}").try_cast("double")
        ok = lambda k: get(k).between(0, 10)
        value = get
    else:
        body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
        raw = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}.score"), F.get_json_object(body, f"$.{k}")).try_cast("double")
        ok = lambda k: raw(k).isNotNull()
        value = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.bround(raw(k), 0)))
    good = F.lit(True)
    for k in AXIS_WEIGHTS:
        good = good & F.coalesce(ok(k), F.lit(False))
    return F.when(good, F.struct(*[value(k).alias(k) for k in AXIS_WEIGHTS]))


def candidate_totals(rows: DataFrame, key: str = "blind_id", style: str = "final") -> DataFrame:
    """(key, n, mrr, keyfact, judge, total, status) of per-question rows (key, rr, f1, judge; judge null where it failed).

    final: only the judge's mean leaves failed rows out. renormalised: all means
    do, and if a candidate retrieved nothing at all (column ``has_refs``), the
    weight of the ranks is dropped for everyone.
    """
    w = TOTAL_WEIGHTS
    ok = F.col("judge").isNotNull()
    judged, n = F.count("judge"), F.count(F.lit(1))
    if style == "final":
        out = rows.groupBy(key).agg(n.alias("n"), judged.alias("j"), F.avg("rr").alias("mrr"), F.avg("f1").alias("keyfact"), F.avg("judge").alias("judge"))
        total = w["mrr"] * F.col("mrr") + w["keyfact"] * F.col("keyfact") + w["judge"] * F.col("judge") / 100.0
        total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
    elif style == "renormalised":
        out = rows.groupBy(key).agg(
            n.alias("n"), judged.alias("j"), F.avg(F.when(ok, F.col("rr"))).alias("mrr"), F.avg(F.when(ok, F.col("f1"))).alias("keyfact"), F.avg("judge").alias("judge"), F.bool_or("has_refs").alias("refs")
        )
        all_have = out.agg(F.coalesce(F.bool_and("refs"), F.lit(True)).alias("all_refs"))
        out = out.crossJoin(F.broadcast(all_have))  # one row
        whole = w["mrr"] * F.col("mrr") + w["keyfact"] * F.col("keyfact") + w["judge"] * F.col("judge") / 100.0
        rest = (w["keyfact"] * 100.0 * F.col("keyfact") + w["judge"] * F.col("judge")) / (w["keyfact"] + w["judge"])
        total = F.when(F.col("all_refs"), whole).otherwise(rest)
    else:
        raise ValueError("style must be final or renormalised")
    status = F.when(F.col("j") == 0, "failed").when(F.col("j") < F.col("n"), "partial").otherwise("completed")
    return out.select(key, "n", "mrr", "keyfact", "judge", F.when(F.col("j") > 0, total).alias("total"), status.alias("status"))


def leaderboard(rows: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Means of f1, precision, recall, rr and length per variant, and the 50-point score."""
    out = rows.groupBy(key).agg(*[F.avg(c).alias(c) for c in ("f1", "precision", "recall", "rr", "chars", *extra)])
    return out.withColumn("score", TOTAL_WEIGHTS["mrr"] * F.col("rr") + TOTAL_WEIGHTS["keyfact"] * F.col("f1"))


#: Ranges of scores that are ranked apart.
RANGES = 64


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mae, max_err, spearman) of two scores; ranks are 1 + the number of greater scores.

    Equal scores are counted first, so the ranks need the distinct scores only.
    """

    def ranks(c: str) -> DataFrame:
        # Distinct scores in ranges between quantiles: a running sum within each, and the sums of the ranges above it.
        cuts = sorted(set(pairs.approxQuantile(c, [i / RANGES for i in range(1, RANGES)], 0.001)))
        place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x <= F.col(c).cast("double")))
        counts = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("k")).withColumn("range", place)
        own = Window.partitionBy("range")
        within = F.sum("k").over(own.orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
        ranges = counts.groupBy("range").agg(F.sum("k").alias("all"))  # a row per range
        above = ranges.alias("x").join(F.broadcast(ranges.alias("y")), F.col("y.range") > F.col("x.range"), "left").groupBy(F.col("x.range").alias("range")).agg(F.coalesce(F.sum("y.all"), F.lit(0)).alias("above"))
        return counts.withColumn("w", within).join(F.broadcast(above), "range").select(c, (1 + F.col("w") + F.col("above")).alias(f"r_{c}"))

    r = pairs.select(a, b).join(ranks(a), a).join(ranks(b), b).select(a, b, F.col(f"r_{a}").alias("ra"), F.col(f"r_{b}").alias("rb"))
    d2 = F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb")))
    n = F.count(F.lit(1))
    return r.agg(n.alias("n"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_err"), (1.0 - 6.0 * d2 / (n * (n * n - 1))).alias("spearman"))


# ---------------------------------------------------------------- latencies and cost


def floor_percentile(values: Column, ratio: float) -> Column:
    """The value at index floor((n - 1) * ratio) of a sorted array, rounded half to even to 4 places; null if empty."""
    at = F.floor((F.size(values) - 1) * F.lit(ratio)).cast("int") + 1
    return F.when(F.size(values) > 0, F.bround(F.element_at(values, F.greatest(at, F.lit(1))), 4))


#: How far from a percentile its bracket reaches, as a part of the rows, and the sketch's accuracy.
BRACKET, ACCURACY = 0.002, 10_000


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """floor_percentile of groups of any size, exactly, without sorting a group.

    A mergeable sketch gives each percentile a bracket of two values. Then the rows
    below a bracket are counted, and of the values within it, each with its number of
    rows, the one that holds the rank is taken. Should a rank be outside its bracket,
    its group is taken whole.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.struct(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]).alias("key"), F.col(value).alias("x"))  # a struct of nulls equals another
    own = ["key"]
    at = [p for r in ratios.values() for p in (max(0.0, r - BRACKET), min(1.0, r + BRACKET))]
    sketch = known.groupBy(*own).agg(F.percentile_approx("x", F.array(*map(F.lit, at)), F.lit(ACCURACY)).alias("marks"), F.count(F.lit(1)).alias("n"))
    rank = lambda r: F.floor((F.col("n") - 1) * F.lit(r)).cast("long")
    one = [F.struct(F.lit(name).alias("name"), rank(r).alias("rank"), F.col("marks")[2 * i].alias("low"), F.col("marks")[2 * i + 1].alias("high")) for i, (name, r) in enumerate(ratios.items())]
    brackets = sketch.select(*own, F.explode(F.array(*one)).alias("b")).select(*own, "b.*")  # a row per group and percentile
    found = _in_brackets(known, brackets, own)
    missed = brackets.join(found, [*own, "name"], "left_anti")
    if not missed.isEmpty():
        ends = known.groupBy(*own).agg(F.min("x").alias("low"), F.max("x").alias("high"))
        found = found.unionByName(_in_brackets(known, missed.drop("low", "high").join(ends, own), own))
    wide = found.groupBy(*own).agg(*[F.max(F.when(F.col("name") == name, F.bround("x", 4))).alias(name) for name in ratios])
    return wide.select(*[F.col(f"key.key{i}").alias(k) for i, k in enumerate(keys)], *ratios)


def _in_brackets(known: DataFrame, brackets: DataFrame, own: list[str]) -> DataFrame:
    """(keys, name, x): the values of the ranks that are within their brackets."""
    met = known.join(brackets, own)
    place = [*own, "name", "rank"]
    below = met.where("x < low").groupBy(*place).agg(F.count(F.lit(1)).alias("below"))
    inside = met.where("x BETWEEN low AND high").groupBy(*place, "x").agg(F.count(F.lit(1)).alias("k"))
    inside = inside.withColumn("upto", F.sum("k").over(Window.partitionBy(*place).orderBy("x")))  # the distinct values of a bracket
    both = inside.join(below, place, "left").withColumn("upto", F.col("upto") + F.coalesce("below", F.lit(0)))
    return both.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k"))).select(*own, "name", "x")


def latency_rounds(requests: DataFrame, key: str = "repetition") -> DataFrame:
    """Requests (key, ok, latency_s, wall_s) by round: counts, rates, and floor-index percentiles of the successes."""
    out = requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("ok").cast("long")).alias("success"), F.max("wall_s").alias("wall")
    )
    p = exact_percentiles(requests.where("ok"), [key], "latency_s", {"p50": 0.50, "p95": 0.95})
    rate = F.bround(F.col("success") / F.col("requests"), 4)
    rps = F.when(F.col("wall") > 0, F.bround(F.col("success") / F.col("wall"), 4)).otherwise(F.lit(0.0))
    out = out.join(p, key, "left")
    return out.select(key, "requests", "success", (F.col("requests") - F.col("success")).alias("fail"), rate.alias("success_rate"), rps.alias("throughput_rps"), F.bround("wall", 4).alias("wall_s"), "p50", "p95")


def latency_summary(rounds: DataFrame) -> DataFrame:
    """One row: the medians over rounds."""
    names = ("success_rate", "throughput_rps", "wall_s", "p50", "p95")
    whole = [F.median(c).cast("long").alias(c) for c in ("success", "fail")]
    return rounds.agg(*whole, *[F.bround(F.median(c), 4).alias(c) for c in names])


def cost(calls: Column, chars_in: Column) -> Column:
    """Estimated US dollars of judge calls whose prompts have so many characters before the answer."""
    tokens = chars_in / COST["chars_per_token"] + COST["answer_tokens"]
    return calls * (tokens * COST["usd_in"] + COST["output_tokens"] * COST["usd_out"]) / 1e6
