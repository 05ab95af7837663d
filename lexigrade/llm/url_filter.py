"""URL filters: pattern rules found by their rarest literal token.

Every rule is compiled to a regular expression and to the literal tokens that
any URL it fits must contain. How often these tokens occur is counted over all
URLs; a rule is filed under its rarest one. A URL is split into tokens, these
fetch the candidate rules, and only those run their expressions. Rules without
a literal token are candidates for every URL.

Host rules come first: of those that fit, the longest wins (host and path
together, then the longer host, then by code point). Without one, the pattern
rules decide: any fitting block rule without a fitting exception blocks,
everything else is allowed.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is allowed; repeated rows are judged each; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)

#: The rules of the contract: verdict, host, path.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: What the pattern rules block, in a small pattern language: ``*`` is any run of
#: characters, ``^`` one separator or the end, ``||`` the start of a host or of
#: one of its labels. ``@@`` marks an exception. Each topic is blocked as a
#: label of a host, as the first or last word of one, and as a part of a path.
TOPICS = (
    "casino", "poker", "bets", "betting", "slots", "jackpot", "roulette", "blackjack", "lottery", "gambling", "pills", "pharma", "viagra", "cialis", "tramadol", "payday", "loans", "porn",
    "xxx", "adult", "sex", "escort", "escorts", "webcams", "hentai", "nude", "warez", "torrent", "torrents", "keygen", "cracks", "spam", "malware", "phishing", "clickbait", "replica", "replicas",
    "adserver", "adservers", "doubleclick", "popunder", "popads", "adclick", "adtrack", "doorway", "linkfarm", "botnet", "proxies",
)
TOPIC_FORMS = ("||{}-", "-{}.", "||{}.", "^{}^")
#: Words of a label that mean nothing in a path.
LABELS = ("ads", "ad", "banner", "banners", "track", "tracker", "tracking", "click", "clicks", "pixel", "affiliate", "cheap", "free", "farm")
LABEL_FORMS = ("||{0}-track", "||{0}-server", "||{0}-network", "||cheap-{0}", "||spam-{0}")
#: Parts of paths of machinery, logins and traps, and of sessions and shops.
PATHS = (
    "wp-login.php", "wp-admin", "wp-json", "xmlrpc.php", "cgi-bin", "phpmyadmin", "administrator^index", "server-status", "ads^banner", "banner^ad", "affiliate^click", "click^track", "out^redirect",
    "account^login", "user^login", "user^register", "password^reset", "checkout^payment", "cart^add", "add-to-cart", "search^results^page", "calendar^day", "print^page", "payday^loan", "adult^video",
)
PARAMETERS = ("sessionid", "jsessionid", "phpsessid", "aspsessionid", "replytocom", "clickid", "gclid", "fbclid", "msclkid", "add-to-cart", "affid", "affiliate_id", "redirect_url")
PORTS = (1080, 3128, 6667, 6881, 8118, 9050)
EXCEPTIONS = ("@@^docs^", "@@^wiki^", "@@||docs.", "@@||wiki.", "@@||help.")


def pattern_rules() -> tuple[str, ...]:
    """All pattern rules, in order."""
    rules = [form.format(t) for t in TOPICS for form in TOPIC_FORMS] + [form.format(t) for t in LABELS for form in LABEL_FORMS]
    rules += [f"^{p}^" for p in PATHS] + [f"^{p}=" for p in PARAMETERS] + [f":{p}^" for p in PORTS]
    return tuple(dict.fromkeys([*rules, *EXCEPTIONS]))


PATTERN_RULES = pattern_rules()


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    #: Host rules rank by length; pattern rules have None.
    rank: tuple | None = None


def ascii_lower(text: str) -> str:
    return text.translate(_UPPER)


def url_parts(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path of a URL; both empty without ``://``."""
    found = _PARTS.search(url or "")
    return (ascii_lower(found[1]), found[2]) if found else ("", "")


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix; it is matched against host + path."""
    host = ascii_lower(host)
    whole = re.split(r"[^a-z0-9]", ascii_lower(path))
    tokens = TOKEN.findall(host) + [x for x in whole[:-1] if x]  # the last may go on in the URL
    if re.search(r"[^\x00-\x7f]", host + path):
        tokens = [x for x in tokens if x.isascii()]
    return Rule(host + path, verdict, r"(?:[^/]*\.)?" + re.escape(host + path), tuple(dict.fromkeys(tokens)), (len(host + path), len(host), host + path))


def pattern_rule(text: str) -> Rule:
    """A rule in the pattern language; it is searched in the lower-cased URL."""
    verdict = "allow" if text.startswith("@@") else "block"
    body = ascii_lower(text.removeprefix("@@"))
    start = r"://(?:[^/?#]*\.)?" if body.startswith("||") else ""
    body = body.removeprefix("||")
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%\x80-\U0010ffff-]|$)"}
    regex = start + "".join(parts.get(c, re.escape(c)) for c in body)
    # A token counts only where both its sides are sure to end it in any URL.
    marked = ("." if start else "*") + body + "*"
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", marked)
    return Rule(text, verdict, regex, tuple(dict.fromkeys(tokens)))


def compiled(host_rules: Iterable[tuple[str, str, str]], patterns: Iterable[str]) -> list[Rule]:
    return [host_rule(*x) for x in host_rules] + [pattern_rule(x) for x in patterns]


def token_counts(urls: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all URLs. As many rows as tokens come back."""
    lower = F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_intersect(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), 0), F.array(*map(F.lit, tokens)))
    rows = urls.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those without any."""
    by: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            by.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return by, always


def judge(url: str | None, rules: list[Rule], regexes: list[re.Pattern], by: dict[str, list[int]], always: list[int]) -> tuple[str, str, str | None, str, str | None]:
    """Host, path, the winning host rule, the verdict, and the pattern that blocked."""
    host, path = url_parts(url)
    if url is None:
        return host, path, None, "allow", None
    lower = ascii_lower(url)
    candidates = [*always, *(i for t in dict.fromkeys(TOKEN.findall(lower)) for i in by.get(t, ()))]
    fits = [i for i in candidates if (regexes[i].match(host + path) if rules[i].rank else regexes[i].search(lower))]
    if ranked := [rules[i] for i in fits if rules[i].rank]:
        best = max(ranked, key=lambda r: r.rank)
        return host, path, best.name, best.verdict, None
    if any(rules[i].verdict == "allow" for i in fits) or not fits:
        return host, path, None, "allow", None
    return host, path, None, "block", rules[min(fits)].name


def judge_urls(urls: DataFrame, id_col: str, url_col: str, host_rules: Iterable[tuple[str, str, str]] = HOST_RULES, patterns: Iterable[str] = PATTERN_RULES) -> DataFrame:
    """id_col, host, path, rule, verdict and pattern of every row. Rules travel with the tasks: they do not grow with the data."""
    rules = compiled(host_rules, patterns)
    tokens = sorted({t for r in rules for t in r.tokens})
    by, always = index_rules(rules, token_counts(urls, url_col, tokens) if tokens else {})
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    small_batches(rows)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = [re.compile(r.regex, re.S) for r in rules]
        for batch in batches:
            out = [judge(u, rules, regexes, by, always) for u in batch.column(1).to_pylist()]
            columns = [pa.array([x[k] for x in out], pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "host", "path", "rule", "verdict", "pattern"])

    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, pattern string").withColumnRenamed("id", id_col)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the contract's host rules and the default patterns."""
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def oracle_sql() -> str:
    """The same by plain SQL: every rule against every URL."""
    hosts = ", ".join(f"('{v}', '{h}', '{p}', {len(h + p)})" for v, h, p in HOST_RULES)
    pats = [pattern_rule(x) for x in PATTERN_RULES]
    sql_regex = lambda r: r.regex.replace("\\U0010ffff", "\\x{10ffff}").replace("\\x80", "\\x{80}").replace("'", "''")
    values = ", ".join(f"({i}, '{r.verdict}', '{r.name}', '{sql_regex(r)}')" for i, r in enumerate(pats))
    return f"""
WITH u AS (
  SELECT page_id, url, regexp_matches(coalesce(url, ''), '://') AS ok,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS raw_host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), p AS (
  SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u
), rules(verdict, host, path, len) AS (VALUES {hosts}),
fits AS (
  SELECT p.page_id, arg_max(r.host || r.path, r.len) AS rule, arg_max(r.verdict, r.len) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id
), pats(k, verdict, name, regex) AS (VALUES {values}),
pf AS (
  SELECT p.page_id, bool_or(t.verdict = 'allow') AS saved, arg_min(t.name, t.k) AS name
  FROM p JOIN pats t ON regexp_matches(p.low, t.regex, 's') GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN pf.page_id IS NOT NULL AND NOT pf.saved THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.rule IS NULL AND pf.page_id IS NOT NULL AND NOT pf.saved THEN pf.name END AS pattern
FROM p LEFT JOIN fits f USING (page_id) LEFT JOIN pf USING (page_id)
"""
