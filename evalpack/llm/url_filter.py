"""URL filters: host and path rules found through short hash prefixes. DataFrame operations only.

A rule is a host and a path. It fits its host and all subdomains, if the URL's path
starts with the rule's. An expression is a host suffix (cut at a dot) followed by a
path prefix (cut behind a slash). Each URL is expanded into the expressions that have
as many labels and slashes as some rule, and each rule is entered under its own
expression: its host and its path up to the last slash. Both sides are joined on the
first four bytes of the expression's SHA-256; a pair counts if the whole digests are
equal and the URL's path starts with the rule's whole path. The longest rule (host and
path together) wins, then the longer host, then a block before an allow. A URL without
a rule gets ``otherwise``, allow by default as nothing speaks against it.

The rules decide for a (host, path), so each distinct one is judged once, however many
pages hold it, and joined back; the hash join and the join back are sort-merge joins
whose large sides Spark can split, or broadcasts of what Spark has measured.

Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case
(user names and ports belong to it); path: from there up to ``?``, ``#`` or the end.

Defined results: a null URL or one without ``://`` has an empty host and path, which
only a rule with an empty host can fit; repeated rows are judged each; repeated rules
count once, contrary ones block; rules with a null host, path or verdict are no rules;
an empty table of pages or rules gives no rows or no matches; URLs of any length are
expanded to no more expressions than there are shapes of rules; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, read, stored

#: The rules of the registered query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Bytes of a digest that are joined on.
PREFIX = 4


def lower(column: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with the columns host and path."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": lower(host), "path": path})


def _slashes(path: str) -> Column:
    return F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def _digest() -> Column:
    """SHA-256 of the last ``labels`` labels of the host and the path up to its ``slashes``-th slash."""
    return F.expr("""unhex(sha2(concat(substring_index(host, '.', -labels), '\n',
        CASE WHEN slashes = 0 THEN '' ELSE concat(substring_index(path, '/', slashes), '/') END), 256))""")


def indexed(rules: DataFrame) -> DataFrame:
    """Each rule once with labels, slashes, digest and its first bytes; contrary rules are one block."""
    rules = rules.select(lower(F.col("host")).alias("host"), "path", "verdict").dropna()
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is behind 'allow'
    rules = rules.withColumns({"labels": _labels("host"), "slashes": _slashes("path")})
    rules = rules.withColumn("digest", _digest())
    return rules.withColumn("short", F.substring("digest", 1, PREFIX))


def expanded(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path and the digest of each expression that has the shape of a rule."""
    shapes = rules.groupBy("labels").agg(F.collect_set("slashes").alias("depths"))
    most = rules.select(F.coalesce(F.max("labels"), F.lit(0)).alias("most"))
    each = sites.withColumns({"n_labels": _labels("host"), "n_slashes": _slashes("path")})
    upto = F.least("n_labels", most.scalar())
    each = each.withColumn("labels", F.explode(F.when(upto > 0, F.sequence(F.lit(1), upto))))
    each = each.join(shapes, "labels").withColumn("slashes", F.explode("depths")).where("slashes <= n_slashes")
    each = each.withColumn("digest", _digest())
    return each.select("host", "path", "digest", F.substring("digest", 1, PREFIX).alias("short"))


def judged(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict of the sites (host, path) that a rule fits."""
    rules = indexed(rules)
    right = rules.select("short", F.col("digest").alias("r_digest"), F.col("host").alias("r_host"),
                         F.col("path").alias("r_path"), "verdict")
    hits = expanded(sites.distinct(), rules).join(right, "short").where(
        "digest = r_digest AND startswith(path, r_path)")
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"),
                    F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host")))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row of ``pages`` (page_id, url);
    ``rules`` has host, path and verdict (allow or block)."""
    rows = split_url(columns(pages, "page_id", "url")).select("page_id", "host", "path")
    found = stored(judged(rows.select("host", "path"), rules), "url-verdicts")
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page under RULES."""
    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM cut),
sites AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM hosts),
rules(r_host, r_path, r_verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT s.*, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY s.id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS place
  FROM (SELECT *, row_number() OVER () AS id FROM sites) s
  LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE place = 1
"""
