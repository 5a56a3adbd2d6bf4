"""URL filters: rules indexed by their rarest literal token.

Two kinds of rules share one index:

  places    (verdict, "host/path"): fits its host and all subdomains when the url's path
            starts with the rule's; of several, the longest wins
  patterns  filter syntax: literal text, `*` any run, `^` one separator or the end, `||` the
            start of the host or of one of its labels, `|` the start or end, `@@` before an
            exception. A block pattern blocks unless an exception also matches.

A pattern's literal token is an alphanumeric run that the pattern closes off on both sides, so
any url it matches has that very token. Each rule is filed under the one of its tokens that
fewest urls have, counted over all urls. A url's tokens fetch candidate rules and only those
run their regular expression; rules without a token are always candidates.

A place that fits decides; else the patterns do.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# The default place rules and block patterns.
PLACES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PATTERNS = ("-pills.", "^casino^", "^poker^", "^viagra^", "^porn^", "^xxx^", "^payday-loans^", "||ads.*^", "/popunder/", "@@||edu^")

_TOKEN = re.compile("[a-z0-9]+")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SEPARATOR = "(?:[^0-9a-z_.%-]|$)"


def lower(text: str) -> str:
    """A-Z only."""
    return text.translate(_UPPER)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased; path: then up to ? or #. Else both empty."""
    rest = (url or "").partition("://")[2]
    cut = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = cut.partition("/")
    return lower(host), slash + path


def pattern_regex(pattern: str) -> str:
    """The regular expression, over a lower-cased url, of a block or exception pattern."""
    body = lower(pattern.removeprefix("@@"))
    head = tail = ""
    if body.startswith("||"):
        head, body = "^[^:/?#]*://(?:[^/?#]*\\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    return head + "".join({"*": ".*", "^": _SEPARATOR}.get(c) or (c if c.isalnum() or c in "_/-" else f"\\{c}") for c in body) + tail


def pattern_tokens(pattern: str) -> list[str]:
    """Tokens that a matching url surely has: runs closed off on both sides."""
    body = lower(pattern.removeprefix("@@"))
    found = []
    for m in _TOKEN.finditer(body):
        before, after = body[: m.start()], body[m.end() :]
        if before and not before.endswith("*") and after and not after.startswith("*"):
            found.append(m[0])
    return found


@dataclass(frozen=True)
class Rule:
    text: str  # as returned
    verdict: str
    place: bool
    regex: str
    tokens: tuple[str, ...]


def rules_of(places: Sequence[tuple[str, str]], patterns: Sequence[str]) -> list[Rule]:
    out = []
    for verdict, text in places:
        host, _, path = text.partition("/")
        regex = f"(?:[^/]*\\.)?{re.escape(lower(host))}{re.escape('/' + path)}"
        # a path is a prefix, so its last run may go on in the url
        tokens = _TOKEN.findall(lower(host)) + [m[0] for m in _TOKEN.finditer(lower(path)) if m.end() < len(path)]
        out.append(Rule(f"{lower(host)}/{path}", verdict, True, regex, tuple(tokens)))
    for p in patterns:
        out.append(Rule(p, "allow" if p.startswith("@@") else "block", False, pattern_regex(p), tuple(pattern_tokens(p))))
    return out


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = list(rules)
        self.compiled = [re.compile(r.regex, re.ASCII | re.DOTALL) for r in rules]
        for k, r in enumerate(rules):
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(k)
            else:
                self.always.append(k)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """(host, path, place rule, verdict, regular expressions run)."""
        host, path = host_and_path(url)
        low, place = lower(url or ""), host + path
        which = set(self.always)
        for t in set(_TOKEN.findall(low)):
            which.update(self.by_token.get(t, ()))
        best, blocked, excepted = None, False, False
        for k in which:
            r = self.rules[k]
            if r.place:
                if (best is None or len(r.text) > len(best.text)) and self.compiled[k].match(place):
                    best = r
            elif self.compiled[k].search(low):
                blocked |= r.verdict == "block"
                excepted |= r.verdict == "allow"
        verdict = best.verdict if best else "block" if blocked and not excepted else "allow"
        return host, path, best.text if best else None, verdict, len(which)


def filter_urls(
    pages: DataFrame,
    *,
    key: str = "page_id",
    places: Sequence[tuple[str, str]] = PLACES,
    patterns: Sequence[str] = PATTERNS,
) -> DataFrame:
    """(key, host, path, rule, verdict, n_candidates) for each row of pages(key, url).

    rule is the place that decided, else null; n_candidates counts the rules that the url's
    tokens fetched. A null url, or one without ://, has an empty host and path, fits no place
    and is left to the patterns (null: allow). Equal rows give equal results; the key may be
    null or repeat; other columns are ignored; an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    rules = rules_of(places, patterns)
    wanted = {t for r in rules for t in r.tokens}
    pages = pages.select(F.col(key).alias(key), F.col("url").cast("string").alias("url"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch["url"].to_pylist():
                for t in wanted.intersection(_TOKEN.findall(lower(url or ""))):
                    n[t] += 1
        yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["t", "n"])

    counts = {r["t"]: r["n"] for r in pages.select("url").mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row a rule token

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            got = [index.judge(u) for u in batch["url"].to_pylist()]
            columns = list(zip(*got, strict=True)) if got else [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int32())], names=[key, "host", "path", "rule", "verdict", "n_candidates"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string, n_candidates int")


def sql(places: Sequence[tuple[str, str]] = PLACES, patterns: Sequence[str] = PATTERNS, table: str = "pages") -> str:
    """DuckDB SQL for (page_id, host, path, rule, verdict): every rule tried on every url."""
    rules = rules_of(places, patterns)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    by_length = sorted((r for r in rules if r.place), key=lambda r: -len(r.text))
    fits = lambda r: (h := r.text.partition("/"), f"((host = {quote(h[0])} OR ends_with(host, {quote('.' + h[0])})) AND starts_with(path, {quote('/' + h[2])}))")[1]
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(r.text)}" for r in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = {quote(r.text)} THEN {quote(r.verdict)}" for r in by_length)
    hit = lambda v: " OR ".join(f"regexp_matches(low, {quote(r.regex)}, 's')" for r in rules if not r.place and r.verdict == v) or "false"
    verdict += f" WHEN ({hit('block')}) AND NOT ({hit('allow')}) THEN 'block' ELSE 'allow' END"
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (SELECT page_id, {low} AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
s AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule FROM s)
SELECT page_id, host, path, rule, {verdict} AS verdict FROM r"""
