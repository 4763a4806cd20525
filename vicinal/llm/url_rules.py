"""Judge URLs by pattern rules that are found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
#: Rules applied in one pass; a longer list takes more passes, each over its own block.
BLOCK_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path together; ``tokens`` are literals without
    which it cannot match.  Of the rules that match, the longest ``name`` wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, name: str) -> Rule:
    """A rule ``host/path`` for a host, its subdomains and every path that starts with its own."""
    host, _, path = name.partition("/")
    # The last token of the path may go on in a longer word of the URL, so that it is no key.
    tokens = re.findall(TOKEN, host.lower())
    tokens += re.findall(TOKEN + r"(?=[^a-z0-9])", path.lower())
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}/{re.escape(path)}", tuple(tokens))


def host_token_rule(verdict: str, token: str) -> Rule:
    """A nameless rule for hosts one of whose words, parted by dots and hyphens, is ``token``."""
    return Rule("", verdict, rf"^(?:[^/]*[.-])?{re.escape(token)}(?:[.-][^/]*)?(?:/|$)", tuple(re.findall(TOKEN, token)))


#: Most rules that a table may hold: they are sent to every task.
TABLE_RULES = 2_000_000


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules of a table ``kind, verdict, name``: ``host`` rules (``host/path``) and ``token`` rules (a word of the host)."""
    rows = table.select("kind", "verdict", "name").dropna().distinct().limit(TABLE_RULES + 1).collect()
    if len(rows) > TABLE_RULES:
        raise ValueError(f"more than {TABLE_RULES} rules")
    make = {"host": host_rule, "token": host_token_rule}
    return [make[r.kind](r.verdict, r.name) for r in sorted(rows)]


#: Rules of the query: the given ones, then the method's own for the rest.
RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)
#: Words of hosts that sell what no corpus wants, by a common notion of such hosts.
HOST_WORDS = "spam ads adserver casino casinos poker bets betting gambling pills viagra cialis pharma porn xxx adult escort payday loans replica warez torrent".split()
OWN_RULES = tuple(host_token_rule("block", w) for w in HOST_WORDS)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty for a null URL or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(F.concat(host, F.lit("/"), path)), F.lit(f"({TOKEN})"))
    )


def token_counts(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many URLs of ``host, path`` each token of the rules stands.

    One pre-aggregated pass; as many rows as the rules have tokens come back at most.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    found = F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*map(F.lit, wanted)))
    counted = pages.select(F.explode(found).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return {t: 0 for t in wanted} | {r.t: r.n for r in counted.collect()}


def rule_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without a token under the empty one."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts[t], t), default="")
        index.setdefault(rarest, []).append(rule)
    return index


def _judge(index: dict[str, list[Rule]], columns: list[str]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {t: [(re.compile(r.pattern), r) for r in rs] for t, rs in index.items()}
        always = compiled.pop("", [])
        for batch in batches:
            names, verdicts = [], []
            for host, path, name, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict"))):
                url = host + path
                best = (-1 if verdict is None else len(name or ""), name or "", verdict)
                keys = set(re.findall(TOKEN, (host + "/" + path).lower()))
                for found in [always, *(compiled[t] for t in keys & compiled.keys())]:
                    for pattern, rule in found:
                        if (len(rule.name), rule.name) > best[:2] and pattern.search(url):
                            best = (len(rule.name), rule.name, rule.verdict)
                names.append(best[1] or None)
                verdicts.append(best[2])
            rest = [batch.column(c) for c in columns]
            yield pa.record_batch([*rest, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[*columns, "rule", "verdict"])

    return judge


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = (*RULES, *OWN_RULES),
    id_col: str = "page_id",
    url: str = "url",
    default: str = DEFAULT,
    block: int = BLOCK_RULES,
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every page.

    ``rule`` is the longest rule with a name that fits (null if none does), ``verdict`` that
    rule's, else that of a nameless rule, else ``default``.  Nothing is shuffled: each URL looks
    up its tokens in the index that its task holds, and only the rules found run their patterns.
    A rule list of any length works: it is applied block by block, each one adding to the
    verdicts of those before.  Null and broken URLs have an empty host and path; no host rule
    fits them.  Repeated rows are judged alike; no other column is carried.
    """
    judged = pages.select(
        F.col(id_col).alias(id_col),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    counts = token_counts(judged, rules) if rules else {}
    columns = [id_col, "host", "path"]
    for start in range(0, len(rules), block):
        index = rule_index(rules[start : start + block], counts)
        judged = judged.mapInArrow(_judge(index, columns), judged.schema)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


_PARTS = r"""parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)"""


def _named_sql(rule: Rule) -> str:
    host, _, path = rule.name.partition("/")
    return f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule.name}'"


def _own_sql(rule: Rule) -> str:
    return f"WHEN regexp_matches(host || path, '{rule.pattern}') THEN '{rule.verdict}'"


#: The same over the whole table ``pages``, for DuckDB.
SQL = f"""
WITH {_PARTS},
named AS (
  SELECT *, CASE {" ".join(_named_sql(r) for r in sorted(RULES, key=lambda r: -len(r.name)))} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)}
    {" ".join(_own_sql(r) for r in OWN_RULES)} ELSE '{DEFAULT}' END AS verdict
FROM named
"""
