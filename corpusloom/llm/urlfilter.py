"""URL filters: rules (host, path, verdict) looked up by hashed host-suffix and path-prefix expressions.

A rule fits its host and all subdomains if the url's path starts with the rule's
path; the longest rule wins.  Each distinct (host, path) of the table is expanded
into every host suffix with every path prefix of a length that some rule has.
Expressions and rules meet in an equi-join on the first 32 bits of their SHA-256 as a number;
what a url has met is then confirmed by the full digests, and the longest confirmed rule is taken.  Of rules
of the same length the one with the longer host wins, then block before allow.

Few rules are broadcast.  More are shuffled: expressions whose prefix falls into no cell of the rules' (a table of
CELLS numbers at most) go before that, and of a prefix that many urls have, rule or false hit, the
expressions are dealt over salts and the rule is copied to each.

Defined cases: an empty table gives an empty one; a url of any length is one row, of as many expressions as its host has labels times the rules' lengths; a null url or one without "://" has empty host and path; no rule
fits an empty host (a rule with an empty host fits nothing); repeated urls are judged once and joined back, so
repeated rows stay; other columns pass through unless named like a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small, written

#: The rules of the check.
DEFAULT_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules (some 300 bytes each) of which so many may be broadcast; cells that rules' prefixes fall into.
BROADCAST_RULES, CELLS = 100_000, 1 << 20
#: Expressions of a prefix that a task should get.
HOT = 100_000
#: Distinct urls with a rule of which so many (some 400 bytes each) may be broadcast.
BROADCAST_URLS = 100_000
#: The verdict where no rule fits.
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _met(asked: DataFrame, known: DataFrame, broadcast_rules: int, hot: int) -> DataFrame:
    """asked (.., short, digest) beside the rules known (short, full, found) of the same short prefix, confirmed or not."""
    if known.count() <= broadcast_rules:
        return asked.join(F.broadcast(known), "short")
    cell = F.pmod("short", F.lit(CELLS))
    asked = asked.withColumn("cell", cell).join(F.broadcast(known.select(cell.alias("cell")).distinct()), "cell", "left_semi").drop("cell")
    asked = written(asked, "expressions")
    heavy = written(asked.groupBy("short").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts")).filter("salts > 1"), "hot")
    mark = small(heavy, heavy.count())
    salts = F.coalesce("salts", F.lit(1))
    asked = asked.join(mark, "short", "left").withColumn("salt", F.pmod(F.xxhash64("host", "path"), salts).cast("int")).drop("salts")
    known = known.join(mark, "short", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return asked.join(known, ["short", "salt"])


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT, broadcast_rules: int = BROADCAST_RULES, hot: int = HOT) -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict.

    The distinct lengths of rule paths are read on the driver: at most as many as the longest path has characters.
    """
    rules = rules.filter("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect()) or [0]
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    expression = F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"))))))

    urls = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).filter("host <> ''").distinct()
    asked = urls.select("host", "path", expression.alias("e")).select("host", "path", F.sha2(F.concat_ws("\0", "e.h", "e.p"), 256).alias("digest"))
    asked = asked.withColumn("short", _short(F.col("digest")))
    known = rules.select(
        F.sha2(F.concat_ws("\0", "host", "path"), 256).alias("full"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict").alias("found"),
    )
    known = known.withColumn("short", _short(F.col("full")))
    # confirmed where the hits of a url are gathered: a filter would be taken into the join's key
    confirmed = F.max(F.when(F.col("digest") == F.col("full"), F.col("found")))
    best = written(_met(asked, known, broadcast_rules, hot).groupBy("host", "path").agg(confirmed.alias("_best")).filter("_best is not null"), "best")
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if best.count() <= BROADCAST_URLS:
        out = named.join(F.broadcast(best), ["host", "path"], "left")
    else:  # rows without a host fit no rule and need not meet in one task
        none = named.filter("host = ''").withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType))
        out = named.filter("host <> ''").join(best, ["host", "path"], "left").unionByName(none)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def url_report(pages: DataFrame) -> DataFrame:
    return url_verdicts(pages.select("page_id", "url"), rules_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


REPORT_SQL = r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path, row_number() over () as rn from pages),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (select rn, max_by(rh || rp, length(rh) + length(rp)) as rule, max_by(v, length(rh) + length(rp)) as v from p, r
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rn)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join best using (rn)"""
