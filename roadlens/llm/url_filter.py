"""URL filters: host-suffix and path-prefix expressions joined with rules on a short hash prefix, then confirmed.

All of it is DataFrame code. Each distinct (host, path) is expanded into the host's suffixes of as many labels as rules have times the
path's prefixes of the lengths that rules have, so hostile URLs of many labels cost no more than others; an expression meets a rule on the first HEX characters of its SHA-256, the full digest
confirms it, and the longest rule wins. URLs without a rule get the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

HEX = 8
#: Rules that are broadcast (about 200 bytes each); with more of them, those of hot expressions are broadcast and the rest is shuffled.
BROADCAST_RULES = 100_000
#: (verdict, host, path): the rules of query op3.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty without '://' or for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.length(host).cast("string"), F.concat(host, path)), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    rules: verdict, host, path. A rule fits its host and all subdomains if the path starts with the rule's path; of several the
    longest host wins, then the longest path, then block before allow. Null or odd URLs have an empty host and path. Empty rules
    leave every URL at the default; repeated rows are judged alike.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    n_labels = lambda host: 1 + F.length(host) - F.length(F.translate(host, ".", ""))
    shapes = rules.select(F.length("path").alias("n"), n_labels(F.col("host")).alias("labels")).distinct().collect()  # bounded by the longest rule
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    present = lambda parts: F.filter(F.array(*parts), lambda p: p.isNotNull())
    lengths, labels = sorted({r.n for r in shapes}), sorted({r.labels for r in shapes})
    suffixes = present([F.when(n_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in labels])
    prefixes = present([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    distinct = urls.select("host", "path").distinct()
    expressions = distinct.select(
        "host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps")
    ).select("host", "path", "h", F.explode("ps").alias("p"))
    expressions = expressions.withColumn("digest", _digest(F.col("h"), F.col("p"))).withColumn("short", F.substring("digest", 1, HEX))
    keyed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("nh"),
        F.length("path").alias("np"),
    )
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, HEX))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = expressions.join(F.broadcast(keyed), "short")
    else:  # a suffix that a third of all hosts share is a hot key
        expressions = materialize(expressions, "expressions")
        counts, total = expressions.groupBy("short").count().withColumnRenamed("count", "n"), expressions.count()
        table = keyed.groupBy("short").agg(F.collect_set(F.struct("rule_digest", "rule", "rule_verdict", "nh", "np")).alias("rules"))
        met = join_hot(expressions, table.join(counts, "short"), ["short"], "n", total, "host").withColumn("rules", F.explode("rules")).select("*", "rules.*")
    fits = met.where("digest = rule_digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("nh", "np", F.col("rule_verdict"), "rule")).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The rules above over all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP3_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, rh, rp) AS (VALUES {_VALUES}),
best AS (SELECT DISTINCT host, path, arg_max(rh || rp, length(rh) * 100000 + length(rp)) OVER w AS rule, arg_max(verdict, length(rh) * 100000 + length(rp)) OVER w AS v
         FROM (SELECT DISTINCT host, path FROM u) AS d JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
         WINDOW w AS (PARTITION BY host, path))
SELECT page_id, u.host, u.path, rule, coalesce(v, '{DEFAULT}') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""
