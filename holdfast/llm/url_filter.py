"""URL rules with an index on their rarest token (operator 1).

A rule has a host and a path: it fits its host and all subdomains, where the path of a URL starts with
the rule's. Rules and URLs are cut into tokens, the runs of letters and digits of host and path. A rule
is filed under one of its tokens, the one that the fewest URLs have (its own index key); the
tokens of a URL fetch the rules filed under them, and only those run their regular expression. The
longest rule that fits gives the verdict.

All tokens but the last of a rule's path are whole tokens of every URL it fits; the last may go on in
the URL (``/en`` fits ``/english``) unless a separator follows it, so it is no key. A rule without a
whole token (an empty host, or one without ASCII letters and digits) is filed under ``ANY``, a token that
all URLs have.

Token counts are combined before they are shuffled. Distinct hosts and paths are judged, not rows, so
a page that a third of the table repeats is judged once. The join with the rules is left to Spark: it
broadcasts them where their known size allows, and shuffles by token otherwise.

Defined results: null urls and urls without ``://`` have an empty host and path, and the default
verdict ``allow``, as have all urls that no rule fits; of equally long rules the first in order of
host, path and verdict wins; repeated rows keep their own row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.tables import lower_ascii, read_table

# The rules of the registered query: host, path and verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
# The token of all URLs; others start with ``h:`` or ``p:``.
ANY = "*"


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9A-Za-z]+", text)


def whole_tokens(host: str, path: str) -> list[str]:
    """Tokens of a rule that every URL it fits has as whole tokens."""
    found = ["h:" + t for t in tokens(host)]
    own = tokens(path)
    if own and re.search(r"[0-9A-Za-z]\Z", path):
        own.pop()
    return found + ["p:" + t for t in own] or [ANY]


def rule_pattern(host: str, path: str) -> str:
    """Regular expression over host and path of a URL, joined by ``#``, which neither of them has. An empty host fits all."""
    own = r"(?:.*\.)?" + re.escape(host) if host else "[^#]*"
    return "(?s)^" + own + "#" + re.escape(path)


def host_of(url: Column) -> Column:
    # The part after the first ``://``, which itself may hold another.
    rest = url.substr(F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = url.substr(F.instr(url, "://") + 3, F.char_length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    def marked(text: Column, mark: str) -> Column:
        found = F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+"), F.lit(0))
        return F.transform(found, lambda t: F.concat(F.lit(mark), t))

    return F.array_distinct(F.concat(F.array(F.lit(ANY)), marked(host, "h:"), marked(path, "p:")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = [
        (host, path, verdict, host + path, rule_pattern(host, path), whole_tokens(host, path))
        for host, path, verdict in rules
    ]
    return spark.createDataFrame(
        rows, "rule_host string, rule_path string, verdict string, rule string, pattern string, tokens array<string>"
    )


def indexed(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """Rules with ``key``: of their whole tokens the one that the fewest URLs have."""
    names = [c for c in rules.columns if c != "tokens"]
    counted = (
        rules.select(*names, F.explode("tokens").alias("token"))
        .join(token_counts, "token", "left")
        .groupBy(*names)
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best"))
    )
    return counted.select(*names, F.col("best.token").alias("key"))


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``urls`` (``page_id``, ``url``) with ``host``, ``path``, ``rule`` and ``verdict``."""
    rows = urls.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "path")})
    distinct = rows.select("host", "path").distinct()
    found = distinct.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = found.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    keyed_rules = indexed(rules, counts)
    candidates = found.join(keyed_rules, found["token"] == keyed_rules["key"]).drop("token", "key")
    fits = candidates.filter("concat(host, '#', path) RLIKE pattern")
    length = -F.char_length("rule")
    best = fits.groupBy("host", "path").agg(
        F.min(F.struct(length.alias("order"), "rule_host", "rule_path", "verdict", "rule")).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES))


_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
OP1_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
rests AS (
    SELECT page_id, CASE WHEN CONTAINS(url, '://') THEN SUBSTR(url, STRPOS(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
        TRANSLATE(REGEXP_EXTRACT(COALESCE(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        REGEXP_EXTRACT(COALESCE(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), best AS (
    SELECT host, path, ARG_MAX(rule_host || rule_path, LENGTH(rule_host || rule_path)) AS rule,
        ARG_MAX(verdict, LENGTH(rule_host || rule_path)) AS verdict
    FROM (SELECT DISTINCT host, path FROM parts)
    JOIN rules ON (host = rule_host OR ENDS_WITH(host, '.' || rule_host)) AND STARTS_WITH(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, COALESCE(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""
