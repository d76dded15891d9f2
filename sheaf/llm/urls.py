"""URL filters by expanded host-suffix and path-prefix expressions.

Every url is turned into the expressions it could be listed under: each suffix of its host's labels with
prefixes of its path. Rules are kept as the SHA-256 of their expression; expressions and rules meet by an
equi-join on the digest's first four bytes, the full digests confirm, and the longest rule wins (then the
longer host, then block before allow).

Only the shapes that some rule has (labels in the host; slashes in a path that ends at a slash, signs in
one that doesn't) are expanded, so a hostile url with thousands of slashes costs no more than the rule
list allows. Shapes are rows of one literal array, so the plan doesn't grow with them. Expressions are
worked out once for each distinct host and path of a share of the pages; pages with neither are left out.
Rules are broadcast up to ``BROADCAST_RULES`` rows (their number is counted first), beyond that both sides
are shuffled.

Cases: a null url, or one without ``://``, has an empty host and path and no rule; ports and user names
stay part of the host; empty labels are kept; a rule's path fits every path that starts with it, whether
it ends at a slash or not, and an empty one fits all; repeated pages are judged each, null ids too; with
no rules every verdict is the default; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 50_000
#: Shares into which the pages of one host and path are dealt.
SHARES = 64
DEFAULT = "allow"
#: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = url.substr(F.instr(url, "://") + 3, F.length(url))
    known = url.isNotNull() & (F.instr(url, "://") > 0)
    host = F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their expression, digests and shape; of equal expressions the blocking one stays."""
    text = F.concat("host", "path")
    one = rules.groupBy(text.alias("rule")).agg(F.max("verdict").alias("verdict"), F.first("host").alias("host"), F.first("path").alias("path"))
    return one.select(
        "rule",
        "verdict",
        F.length("host").alias("host_length"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.col("path").endswith("/").alias("closed"),
        F.when(F.col("path").endswith("/"), F.size(F.split("path", "/", -1)) - 1).otherwise(F.length("path")).alias("reach"),
        F.sha2(F.col("rule").cast("binary"), 256).alias("digest"),
    ).withColumn("prefix", F.substring("digest", 1, 8))


def expressions(host: Column, path: Column, shapes: list[tuple[int, bool, int]]) -> Column:
    """Array of the host-suffix and path-prefix expressions with one of the given shapes (labels, closed, reach)."""
    labels = F.size(F.split(host, r"\.", -1))
    slashes = F.size(F.split(path, "/", -1)) - 1

    def fits(s: Column) -> Column:
        return (labels >= s["labels"]) & F.when(s["closed"], slashes >= s["reach"]).otherwise(F.length(path) >= s["reach"])

    def made(s: Column) -> Column:
        suffix = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        closed = F.concat(F.call_function("substring_index", path, F.lit("/"), s["reach"]), F.lit("/"))
        return F.concat(suffix, F.when(s["closed"], closed).otherwise(F.substring(path, F.lit(1), s["reach"])))

    rows = [F.struct(F.lit(n).alias("labels"), F.lit(c).alias("closed"), F.lit(r).alias("reach")) for n, c, r in shapes]
    every = F.array(*rows) if rows else F.array().cast("array<struct<labels:int,closed:boolean,reach:int>>")
    return F.transform(F.filter(every, fits), made)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page."""
    split = host_and_path(F.col("url"))
    share = F.pmod(F.xxhash64("page_id"), F.lit(SHARES)).cast("int")
    rows = pages.select("page_id", split[0].alias("host"), split[1].alias("path"), share.alias("share"))
    listed = prepared(rules)
    facts = listed.agg(F.count(F.lit(1)), F.collect_set(F.struct("labels", "closed", "reach"))).first()
    shapes = sorted(tuple(s) for s in facts[1])
    named = (F.col("host") != "") | (F.col("path") != "")
    places = rows.filter(named).select("host", "path", "share").distinct()
    met = places.select("host", "path", "share", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("expression"))
    met = met.withColumn("full", F.sha2(F.col("expression").cast("binary"), 256))
    listed = F.broadcast(listed) if facts[0] <= BROADCAST_RULES else listed
    hits = met.join(listed, F.substring("full", 1, 8) == F.col("prefix")).filter("full = digest")
    rank = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block", "rule")
    best = hits.groupBy("host", "path", "share").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("won"))
    judged = rows.filter(named).join(best, ["host", "path", "share"], "left").select("page_id", "host", "path", "won.rule", "won.verdict")
    nowhere = rows.filter(~named).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return judged.unionByName(nowhere).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(instr(url, '://'), 0) > 0 AS known, substr(url, instr(url, '://') + 3) AS rest FROM pages),
split AS (
  SELECT page_id,
         CASE WHEN known THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN known THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut),
rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""
