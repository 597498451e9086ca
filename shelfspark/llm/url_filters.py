"""URL filtering by host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into the expressions that a rule could name: each suffix of the host with a
number of labels that occurs in the rule list, with each prefix of the path whose length occurs there; so a url makes
no more expressions than the rules have shapes, however long it is.  Expressions meet rules in an equi-join on a short
prefix of their SHA-256 (of host and path with a separator that neither can hold); the full digest, and host and path
themselves, then confirm the hit and precedence picks the rule: the longest expression wins, then the longer host, then
``block`` over ``allow``.

Only DataFrame functions are used.  URLs are reduced to distinct (host, path) before they are expanded, so a URL
that a third of all pages share is judged once.  The rule list has no size limit: Spark broadcasts it when its
size is under the session's threshold and shuffles otherwise.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; an empty path fits only
rules with an empty path; repeated rows give repeated results; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the digest that the join uses, as hexadecimal digits.
SHORT_DIGITS = 8
DEFAULT_VERDICT = "allow"

#: The rules of the registered query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All host suffixes of the given numbers of labels with all path prefixes of the given lengths."""
    parts = F.split(host, r"\.")
    numbers = F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(parts))
    suffixes = F.transform(numbers, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    usable = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(usable, lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path"))))
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\0", host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (``host`` followed by ``path``, or null) and verdict of every row.

    ``rules`` has the columns action, host and path.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = rules.select(
        F.col("action"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.col("host").alias("named_host"),
        F.col("path").alias("named_path"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, SHORT_DIGITS))
    # One bounded row: the numbers of labels and the path lengths that occur, at most as many as the longest rule has characters.
    shape = {"labels": F.size(F.split("host", r"\.")), "lengths": F.length("path")}
    found = rules.agg(*[F.array_sort(F.collect_set(v)).alias(k) for k, v in shape.items()]).first()
    labels, lengths = list(found["labels"]), list(found["lengths"])
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    distinct = urls.select("host", "path").distinct()
    tried = distinct.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("e")).select(
        "host", "path", "e", _digest(F.col("e.rule_host"), F.col("e.rule_path")).alias("digest")
    )
    best = F.max_by(
        F.struct("rule", "action"), F.struct(F.length("rule"), "host_length", (F.col("action") == "block").cast("int"))
    )
    hits = (
        tried.withColumn("short", F.substring("digest", 1, SHORT_DIGITS))
        .join(named, "short")
        .where((F.col("digest") == F.col("rule_digest")) & (F.col("e.rule_host") == F.col("named_host")) & (F.col("e.rule_path") == F.col("named_path")))
        .groupBy("host", "path")
        .agg(best.alias("hit"))
    )
    # Written first, so that Spark can split a (host, path) which very many pages share.
    hits = cut(hits)
    return urls.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


ORACLE_SQL = """
WITH rules(action, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (
  SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, rid,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (
  SELECT rid, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action = 'block' DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.rid = parts.rid AND fits.k = 1
"""
