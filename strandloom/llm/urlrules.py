"""URL filters: pattern rules found by their rarest literal token.

Every rule is a regular expression with literal tokens. Each rule is filed under
the one of its tokens that is rarest over all urls of the table; a url's tokens
fetch the rules filed under them, and only those run their expression. Rules
without a token of two letters are tried on every url.

List rules (host and path prefix) are such rules too: the longest that fits
gives ``rule`` and the verdict. Where none fits, the url is blocked if a content
rule fits and allowed otherwise. Null urls and urls without ``://`` have an
empty host and path, no rule, and are allowed. Of list rules of one name the
first counts. Repeated rows are judged each; an empty table gives no rows;
columns besides page_id and url are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The list rules of the contract.
LISTED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that mark an unwanted host or path.
CONTENT = ("casino", "porn", "xxx", "viagra", "poker", "betting", "torrent", "warez", "escort", "payday-loan")
TOKEN = re.compile(r"[a-z0-9]{2,}")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool


def listed_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host, its subdomains and paths that begin with ``path``; matched against host + path. No host has a slash, and every path that isn't empty begins with one."""
    whole = [t for t in TOKEN.findall(host.lower())]
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path) or '(?=/|$)'}", tuple(whole), True)


def content_rule(word: str) -> Rule:
    tokens = tuple(TOKEN.findall(word))
    return Rule(word, "block", rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", tokens, False)


def rules() -> list[Rule]:
    return [listed_rule(*r) for r in LISTED] + [content_rule(w) for w in CONTENT]


def parts(url):
    """Host and path columns by built-in functions."""
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    found = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    host = F.when(found, F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    path = F.when(found, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table of verdict, host, path and word: a list rule where host isn't null, else a content rule of the word. A rule list is read by the driver and sent to every task; it doesn't grow with the pages."""
    rows = table.select("verdict", "host", "path", "word").distinct().collect()
    listed = sorted({listed_rule(r.verdict, r.host, r.path or "") for r in rows if r.host is not None}, key=lambda r: (r.name, r.verdict))
    return listed + [content_rule(w) for w in sorted({r.word for r in rows if r.host is None and r.word})]


def token_counts(split: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Urls that hold each of the rules' tokens (as many rows as rules have tokens, whatever the table's size)."""
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(r"([a-z0-9]{2,})"), F.lit(1)))
    rows = split.select(F.explode(tokens).alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r.token: r["count"] for r in rows}


def judge(pages: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    found = rules() if found is None else found
    host, path = parts("url")
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    counts = token_counts(split, sorted({t for r in found for t in r.tokens}))
    index: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(found):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(i)
        else:
            always.append(i)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r.pattern) for r in found]
        for frame in frames:
            named, verdicts = [], []
            for host, path in zip(frame["host"], frame["path"]):
                subject = host + path
                low = subject.lower()
                best, blocked = None, False
                for i in [*always, *(i for t in set(TOKEN.findall(low)) for i in index.get(t, ()))]:
                    r = found[i]
                    if r.listed:
                        if (best is None or (len(r.name), r.name) > (len(best.name), best.name)) and compiled[i].search(subject):
                            best = r
                    elif not blocked and compiled[i].search(low):
                        blocked = True
                named.append(best.name if best else None)
                verdicts.append(best.verdict if best else "block" if blocked else "allow")
            yield frame.assign(rule=pd.Series(named, index=frame.index, dtype=object), verdict=verdicts)

    return split.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '(?s)\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '(?s)\A[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1)
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.verdict, CASE WHEN regexp_matches(lower(p.host || p.path), '(^|[^a-z0-9])(casino|porn|xxx|viagra|poker|betting|torrent|warez|escort|payday-loan)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
