"""Secret scans over a trigram inverted index, in DataFrame functions alone.

1. From every rule's regular expression a Boolean query over trigrams is
   derived: an OR of ANDs that any matching text satisfies. A rule without
   mandatory trigrams has none and scans every text.
2. One pass over a text, in lower case, finds the rules' trigrams that it holds;
   these are its postings (trigram, id) of the index.
3. The postings are looked up by trigram for each clause and intersected: an id
   that has as many of a clause's trigrams as it has is a candidate of its rule.
   The candidates are written, so that they are broadcast only if found small.
4. Candidates meet their texts again, which the rule's expression verifies.
   Matches are the leftmost non-overlapping ones; their places are running sums
   of the lengths of the matches and of the pieces between them, in code points,
   in n log n steps for n matches.

Rules and clauses are part of the job and do not grow with the data. The index
holds, per text, at most as many postings as the rules have trigrams.

Defined cases: a null or empty text has no spans; a null id is a key like any
other; rows that repeat an id are verified each by its own text; an empty table
gives no rows; other columns play no part, whatever their names are.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written


@dataclass(frozen=True)
class Rule:
    """``regex`` finds the matches; of these, those that ``keep`` finds in full stay."""

    kind: str
    regex: str
    keep: str
    base: bool = False


_ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?"""

#: Base rules first, in the order of the contract; then the method's own.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", "^" + _ASSIGN + "[A-Za-z0-9+/_.=-]{6}", True),
    Rule("access", "AKIA[A-Z0-9]+", "^.{20}", True),
    Rule("hex", "[0-9a-f]{24,}", "", True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", ""),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", ""),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", ""),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", ""),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ""),
    Rule("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", ""),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]{20,}", ""),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", ""),
    Rule("npm", "npm_[A-Za-z0-9]{36}", ""),
)

_KEY = r"(?:[A-Z0-9]+\x20){0,3}PRIVATE\x20KEY(?:\x20BLOCK)?-----"
_RUN = "[A-Za-z0-9+/]"
#: From BEGIN to END, or without one as far as header lines and base64 go; line ends may be escaped. One character a step, as Java's loops of longer ones use the stack.
_KEY_BLOCK = (
    "-----BEGIN " + _KEY + r"(?:(?:(?!-----)[\s\S])*+-----END\x20" + _KEY + r"|(?:\s{0,9}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):\x20[^\r\n]*+){0,9}"
    + rf"(?:(?={_RUN}|=|[\s\\nr]{{1,40}}(?:{_RUN}{{16}}|{_RUN}*+=))[A-Za-z0-9+/=\s\\])*+)"
)

#: What ``redacted`` masks: whole private keys, of any label.
MASK_RULES = tuple(Rule(r.kind, _KEY_BLOCK, r.keep, r.base) if r.kind == "private_key" else r for r in RULES)

# ---------------------------------------------------------------- trigram queries

#: Longest set of exact strings that is followed through an expression.
_MOST = 64


def _literals(parsed: Sequence) -> tuple[set[str] | None, list[set[frozenset[str]]]]:
    """The exact lower-cased strings that an expression can match (None: too many), and queries it implies.

    A query is a set of clauses, each a set of trigrams; it holds if any clause does.
    """
    exact: set[str] | None = {""}
    found: list[set[frozenset[str]]] = []

    def ended(strings: set[str] | None) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            found.append({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})

    for op, value in parsed:
        if op is sre.LITERAL:
            more: set[str] | None = {chr(value).lower()}
        elif op is sre.IN and value[0][0] is not sre.NEGATE and all(x is sre.LITERAL for x, _ in value):
            more = {chr(v).lower() for _, v in value}
        elif op is sre.SUBPATTERN:
            more, inner = _literals(value[3])
            found += inner
        elif op is sre.BRANCH:
            sides = [_literals(x) for x in value[1]]
            more = set().union(*(s for s, _ in sides)) if all(s is not None for s, _ in sides) else None
            if more is None and all(q for _, q in sides):
                found.append(set().union(*(min(q, key=len) for _, q in sides)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[:2] == (0, 1) and (inner := _literals(value[2])[0]) is not None:
            more = inner | {""}
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            inner, queries = _literals(value[2])
            found += queries
            more = None
            if inner is not None and value[0] == value[1] == 1:
                more = inner
            elif inner is not None and exact is not None:  # once at least
                ended({a + b for a in exact for b in inner})
                exact = None
        else:
            more = None
        joined = {a + b for a in exact for b in more} if exact is not None and more is not None else None
        if joined is None or len(joined) > _MOST:
            ended(exact)
            exact = more if more is not None and exact is None else ({""} if more is None else more)
            if more is None:
                exact = {""}
        else:
            exact = joined
    whole = exact if not found and exact is not None else None
    ended(exact)
    return whole, found


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of which any matching text holds one in full; none if the rule must scan everything."""
    _, queries = _literals(sre_parser.parse(regex))
    if not queries:
        return []
    best = min(queries, key=lambda q: (len(q), -min(map(len, q))))
    return sorted((c for c in best if not any(d < c for d in best)), key=sorted)  # a clause within another says it all


# ---------------------------------------------------------------- index and candidates


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _trie(words: Sequence[str]) -> str:
    """An expression for any of some words of one length, by their first characters."""
    if not words[0]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index: (trigram, id) for every trigram asked for and every text that holds it, by one pass over the texts."""
    low = _lower(F.coalesce("text", F.lit("")))
    heads = "".join(re.escape(c) for c in sorted({t[0] for t in trigrams}))
    found = F.regexp_extract_all(low, F.lit(f"(?=[{heads}])(?=({_trie(trigrams)}))"), F.lit(1))
    return docs.select("id", F.explode(F.array_distinct(found)).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(cand_id, kinds) of the ids whose texts satisfy a clause of a rule: the index is looked up by each clause's trigrams."""
    clauses = [(r.kind, c) for r in rules for c in trigram_query(r.regex)]
    trigrams = sorted({t for _, c in clauses for t in c})
    if not trigrams:
        return docs.select(F.col("id").alias("cand_id"), F.array().cast("array<string>").alias("kinds")).where("false")
    asked = [(t, n, kind, len(c)) for n, (kind, c) in enumerate(clauses) for t in sorted(c)]
    lookup = docs.sparkSession.createDataFrame(asked, "trigram string, clause int, kind string, size int")  # as many rows as the rules have trigrams
    met = postings(docs, trigrams).join(F.broadcast(lookup), "trigram")
    whole = met.groupBy("id", "clause", "kind", "size").agg(F.countDistinct("trigram").alias("n")).where("n = size")
    return whole.groupBy(F.col("id").alias("cand_id")).agg(F.collect_set("kind").alias("kinds"))


# ---------------------------------------------------------------- verification


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array's running sums, or what else ``join`` makes of two values, in n log n steps: after step k each place holds 2**k values' join."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i < back, x).otherwise(join(x, F.get(acc, i - back))))

    return F.aggregate(steps, values, step)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    pieces = F.split(text, rule.regex, -1)
    both = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, g: F.struct(F.char_length(m).alias("n"), (F.char_length(g) + F.char_length(m)).alias("step"), (m.rlike(rule.keep) if rule.keep else F.lit(True)).alias("keep")))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda e: e["step"]), lambda p, q: p + q)
        spans = F.zip_with(x, ends, lambda e, end: F.struct((end - e["n"]).alias("start"), F.lit(order).alias("kind"), end.alias("end"), e["keep"].alias("keep")))
        return F.transform(F.filter(spans, lambda e: e["keep"]), lambda e: F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end")))

    return bound(both, placed)


def with_found(docs: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule], text: str, found: str) -> DataFrame:
    """docs with ``text``, its text or an empty one, and ``found``: an array of (start, kind, end), by start and then by the rules' order.

    Names of the columns added on the way are such as docs has not.
    """
    key, cand, kinds, *parts = fresh([*docs.columns, text, found], "key", "cand", "kinds", *(f"part{k}" for k in range(len(rules))))
    rows = docs.withColumns({key: F.col(id_col), text: F.coalesce(F.col(text_col), F.lit(""))})
    keys = written(candidates(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), rules), "candidates")
    keys = keys.select(F.col("cand_id").alias(cand), F.col("kinds").alias(kinds))
    joined = rows.join(keys, F.col(key).eqNullSafe(F.col(cand)), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for k, rule in enumerate(rules):
        if trigram_query(rule.regex):
            gate = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
        else:
            gate = F.col(text).rlike(rule.regex)
        spans.append(F.when(gate, _spans(F.col(text), rule, k)).otherwise(none).alias(parts[k]))
    every = joined.select(*docs.columns, text, *spans)
    return every.select(*docs.columns, text, F.sort_array(F.concat(*map(F.col, parts))).alias(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """id, text and the spans found in every row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return with_found(narrow, "id", "t", rules, "text", "found").select("id", "text", "found")


def _joined(found: Column, rules: Sequence[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


#: Characters of the chunks in which a text is cut up.
CHUNK = 1024


def masked(text: Column, found: Column, mask: str) -> Column:
    """The text with every span (start, kind, end) replaced by the mask, overlapping ones by one.

    The text is cut into chunks once; a piece between spans is made of the ends of
    two chunks and the whole ones between them, so the work does not grow with the
    product of text and spans.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    reach = running(F.transform(found, lambda s: s["end"]), lambda p, q: F.greatest(p, q))
    known = F.struct(chunks.alias("chunks"), found.alias("found"), reach.alias("reach"), F.char_length(text).alias("n"))

    def whole(x: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            head = F.substring(F.get(x["chunks"], first), a % CHUNK + 1, F.when(first == last, b - a).otherwise(F.lit(CHUNK)))
            inner = F.array_join(F.slice(x["chunks"], first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.substring(F.get(x["chunks"], last), F.lit(1), (b - 1) % CHUNK + 1)
            return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(F.concat(head, inner, tail))

        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["reach"], i - 1))
        apart = F.filter(F.transform(x["found"], lambda s, i: F.when(s["start"] >= before(i), i)), lambda i: i.isNotNull())
        parts = F.transform(apart, lambda i: F.concat(piece(before(i), F.get(x["found"], i)["start"]), F.lit(mask)))
        return F.concat(F.array_join(parts, ""), piece(F.element_at(x["reach"], -1), x["n"]))

    return bound(known, whole)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = MASK_RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret of a text replaced by a mask, overlapping ones by one; rows without any are unchanged."""
    own, found = fresh(docs.columns, "own_text", "found")
    rows = with_found(docs, id_col, text_col, rules, own, found)
    new = F.when(F.size(found) > 0, masked(F.col(own), F.col(found), mask)).otherwise(F.col(text_col))
    return rows.withColumn(text_col, new).select(*docs.columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under all rules."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"),
        _joined(F.col("found"), RULES).alias("spans"),
    )


def oracle_sql() -> str:
    """The same by plain SQL: every rule over every text."""
    parts = []
    for k, r in enumerate(RULES):
        regex, keep = r.regex.replace("'", "''"), (r.keep or ".").replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(coalesce(text, ''), '{regex}') AS ms, "
            f"string_split_regex(coalesce(text, ''), '{regex}') AS gs, '{keep}' AS keep FROM documents"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH f AS ({union}),
e AS (SELECT doc_id, k, kind, keep, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
s AS (
  SELECT doc_id, k, kind, keep, ms[i] AS m,
    CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS st
  FROM e
), v AS (
  SELECT *, st + length(m) AS en, kind || ':' || st || ':' || (st + length(m)) AS span FROM s WHERE regexp_matches(m, keep)
), a AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg(span, ',' ORDER BY st, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY st, k) AS spans
  FROM v GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""
