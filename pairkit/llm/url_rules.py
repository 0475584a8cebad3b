"""URL filter: pattern rules behind an index on each rule's rarest literal token.

A rule names the tokens ([a-z0-9]+, whole tokens of any URL it matches) that its pattern needs.
It is filed under the one that the fewest URLs have, counted over all URLs. The tokens of a URL
fetch its candidate rules, and only these run their regular expression. Rules without a whole
token are candidates of every URL. The rule table must fit in a worker's memory.

Defined results: a NULL URL, or one without `://`, has an empty host and path, fits no site rule
and is allowed unless a pattern matches the URL itself. Columns of the input named host, path, rule,
verdict, pattern or n_candidates are replaced, others stay. Repeated URLs get equal results; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class SiteRule:
    """A host with all its subdomains and the start of a path; `*` in the path stands for any text."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        path = ".*".join(map(re.escape, self.path.split("*")))
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{path}"

    @property
    def tokens(self) -> frozenset[str]:
        # a token at the pattern's end, or beside a wildcard, may go on in the URL
        parts = re.split(r"(?<=\*)|(?=\*)", (self.host + self.path).lower())
        found = set()
        for i, part in enumerate(parts):
            for m in TOKEN.finditer(part):
                starts = m.start() > 0 or i == 0
                if starts and m.end() < len(part):
                    found.add(m.group())
        return frozenset(found)


@dataclass(frozen=True)
class PatternRule:
    """A regular expression searched in the lower-cased URL, with tokens every match implies."""

    name: str
    regex: str
    verdict: str
    tokens: frozenset[str]


# Fixed values of the contract.
SITE_RULES = (
    SiteRule("net", "/", "block"),
    SiteRule("example.net", "/en/", "allow"),
    SiteRule("example.com", "/de/", "block"),
    SiteRule("org", "/fr/", "allow"),
)

BLOCKED_WORDS = ("adult", "casino", "escort", "malware", "phishing", "porn", "viagra", "warez", "xxx")
PATTERN_RULES = (
    *[PatternRule(w, rf"(?<![a-z0-9]){w}(?![a-z0-9])", "block", frozenset([w])) for w in BLOCKED_WORDS],
    PatternRule("spam-host", r"://(?:[^/?#]*[.-])?spam[.-](?:farm|link|site)[./:]", "block", frozenset(["spam"])),
    PatternRule("session-trap", r"[?&]phpsessid=[0-9a-f]{32}(?![0-9a-f])", "block", frozenset(["phpsessid"])),
)


def host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Append host (A-Z lower-cased) and path."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract("__rest", "^[^/?#]*", 0)
    return (urls.withColumn("__rest", rest).withColumn("host", host)
            .withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(host) + 1)"), "^[^?#]*", 0))
            .withColumn("host", F.translate("host", string.ascii_uppercase, string.ascii_lowercase))
            .drop("__rest"))


def token_counts(urls: DataFrame, tokens: Sequence[str], url: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs; at most one row per rule token reaches the driver."""
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("([a-z0-9]+)")))).alias("token"))
    rows = found.filter(F.col("token").isin(list(tokens))).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def build_index(rules: Sequence, counts: dict[str, int]) -> dict[str | None, list]:
    """Token to the rules filed under it: the rarest token wins, ties to the smaller one."""
    index: dict[str | None, list] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(token, []).append(rule)
    return index


def judge(urls: DataFrame, site_rules: Sequence[SiteRule] = SITE_RULES,
          pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Append host, path, rule, verdict, pattern and n_candidates (regular expressions run).

    The longest site rule that fits decides; equal lengths go to the smaller name. Without one,
    the first pattern rule that matches does, then the default.
    """
    tokens = sorted({t for r in (*site_rules, *pattern_rules) for t in r.tokens})
    counts = token_counts(urls, tokens, url)
    sites, patterns = build_index(site_rules, counts), build_index(pattern_rules, counts)
    order = {r.name: i for i, r in enumerate(pattern_rules)}
    schema = "rule string, verdict string, pattern string, n_candidates int"

    @F.pandas_udf(schema)
    def decide(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = {id(r): re.compile(r.regex, re.DOTALL) for group in (sites, patterns) for rs in group.values() for r in rs}

        def fetch(index, found):
            return [r for t in (None, *found) for r in index.get(t, ())]

        def one(whole, host, path):
            lowered = whole.lower() if whole is not None else ""
            found, subject = set(TOKEN.findall(lowered)), host + path
            near = fetch(sites, found)
            fits = [r for r in near if compiled[id(r)].match(subject)]
            if fits:
                best = min(fits, key=lambda r: (-len(r.name), r.name))
                return best.name, best.verdict, None, len(near)
            more = sorted(fetch(patterns, found), key=lambda r: order[r.name])
            hit = next((r for r in more if compiled[id(r)].search(lowered)), None)
            return None, hit.verdict if hit else default, hit.name if hit else None, len(near) + len(more)

        for whole, host, path in batches:
            yield pd.DataFrame([one(*x) for x in zip(whole, host, path)], columns=["rule", "verdict", "pattern", "n_candidates"])

    judged = host_and_path(urls, url).withColumn("__judged", decide(F.col(url), F.col("host"), F.col("path")))
    return judged.withColumns({c: F.col(f"__judged.{c}") for c in ("rule", "verdict", "pattern", "n_candidates")}).drop("__judged")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of pages under the fixed rules, then the pattern rules."""
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(urls).select("page_id", "host", "path", "rule", "verdict", "pattern")


OP4_SQL = f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, coalesce(lower(url), '') AS u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES {', '.join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in SITE_RULES)}) AS v(rhost, rpath, rverdict)),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
         FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
m AS (SELECT p.*, rule, rverdict, CASE WHEN rule IS NOT NULL THEN NULL
    {' '.join(f"WHEN regexp_matches(u, '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN '{w}'" for w in BLOCKED_WORDS)}
    WHEN regexp_matches(u, '://([^/?#]*[.-])?spam[.-](farm|link|site)[./:]') THEN 'spam-host'
    WHEN regexp_matches(u, '[?&]phpsessid=[0-9a-f]{{32}}($|[^0-9a-f])') THEN 'session-trap' END AS pattern
  FROM p LEFT JOIN fits USING (page_id))
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM m
"""
