"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

The list is a table of hosts and path prefixes: the rules, which decide by the longest
that fits, and listed urls, which are blocked where no rule fits. An entry fits its host
and all subdomains. Rules are met with the host as it stands in the url; listed urls
with the canonical host, which has no user name, port or final dot.

A distinct url offers the suffixes of its hosts; those that the list has, told by a
blocked Bloom filter and an exact join, bring the path lengths listed under them, and so
the url's candidate keys (a host suffix and a path prefix). The filter of all keys is a
table of 64-bit blocks: a key sets four bits of one block, and a candidate passes if its
block has all four. What passes meets the list in a hash join that removes the false
positives. The list may be as large as the pages; nothing of it reaches the driver but
its number of entries and the most labels of a host.

Defined cases: a null url or one without "://" has empty host and path, fits nothing and
is allowed; very long hosts and paths are judged whole; repeated urls are judged once and
each row gets its row; an empty table or list gives an empty result or no rule; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BLOCKS, bloom_block, bloom_blocks, bloom_mask

# The rules of the contract, and the listed spam hosts as names and endings.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SPAM_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
ENDINGS = ["example.com", "example.net", "example.org"]
SPAM_HOSTS = [f"{name}.{ending}" for name in SPAM_NAMES for ending in ENDINGS]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
USER, PORT = "^.*@", r":[0-9]*$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """A host without user name, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, ""), r"\.$", "")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Rules as (host, path, verdict)."""
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def url_list(urls: DataFrame) -> DataFrame:
    """Listed urls (url) as canonical (host, path); a listed host without a path, or with "/", covers all of its pages."""
    host, path = split_url(F.col("url"))
    return urls.select(canonical_host(host).alias("host"), F.when(path == "/", "").otherwise(path).alias("path")).where("host <> ''").distinct()


def spam_urls(spark: SparkSession, hosts: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(f"http://{h}/",) for h in (SPAM_HOSTS if hosts is None else hosts)], "url string")


def possible(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of keys (key, ...) that the blocked Bloom filter of entries (key) lets pass."""
    known, blocks = bloom_blocks(entries)
    if blocks <= BROADCAST_BLOCKS:
        known = F.broadcast(known)
    mask = bloom_mask(F.col("key"))
    hit = (bloom_block(F.col("key"), blocks) == F.col("block")) & (F.col("filter").bitwiseAND(mask) == mask)
    return keys.join(known, hit).select(*keys.columns)


def fitting(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path, key, ...) of each of urls (host, path) and each entry (host, path, ...) that fits it."""
    entries = entries.withColumn("key", F.concat("host", "path"))
    most = entries.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    n = F.least(F.size(labels), F.lit(most))
    # suffixes of one to n labels
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    offered = urls.where((F.col("host") != "") & (n > 0)).select("host", "path", F.explode(suffixes).alias("key"))
    lengths = entries.groupBy(F.col("host").alias("key")).agg(F.collect_set(F.char_length("path")).alias("lengths"))
    known = possible(offered, lengths.select("key")).join(lengths, "key")
    fit = F.filter("lengths", lambda k: k <= F.char_length("path"))
    keys = known.select("host", "path", F.col("key").alias("suffix"), F.explode(fit).alias("length"))
    keys = keys.select("host", "path", "suffix", F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("length"))).alias("key"))
    own = entries.select("key", F.col("host").alias("suffix"), *[c for c in entries.columns if c not in ("host", "path", "key")])
    return possible(keys, entries.select("key").distinct()).join(own, ["key", "suffix"])


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages, by rules (host, path, verdict) and listed (host, path)."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = urls.select("host", "path").where("host <> ''").distinct()
    best = fitting(distinct, rules).groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.char_length("key")).alias("best"))
    plain = distinct.select("host", "path", canonical_host(F.col("host")).alias("canonical"))
    hits = fitting(plain.select(F.col("canonical").alias("host"), "path").distinct(), listed)
    spam = plain.join(hits.select(F.col("host").alias("canonical"), "path").distinct(), ["canonical", "path"]).select("host", "path", F.lit(True).alias("spam"))
    judged = urls.join(best.join(spam, ["host", "path"], "full"), ["host", "path"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("spam"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rule_table(spark), url_list(spam_urls(spark)))


def url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    hosts = ", ".join(f"('{h}')" for h in SPAM_HOSTS)
    return rf"""
with r(rh, rp, rv) as (values {rules}), spam(sh) as (values {hosts}),
u as (select row_number() over () as i, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select i, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
c as (select i, regexp_replace(regexp_replace(regexp_replace(host, '{USER}', ''), '{PORT}', ''), '\.$', '') as host from p),
best as (select i, max_by(rh || rp, length(rh || rp)) as rule, max_by(rv, length(rh || rp)) as rv from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by i),
s as (select distinct i from c join spam on host = sh or ends_with(host, '.' || sh))
select page_id, host, path, rule, coalesce(rv, case when s.i is not null then 'block' else 'allow' end) as verdict from p left join best using (i) left join s using (i)"""
