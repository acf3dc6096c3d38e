"""Allow and block rules over URLs by a sort-merge range join.

A host is keyed by its labels in reverse, each with a dot behind it, so that a rule's host
and all its subdomains are the keys that begin with the rule's key: an interval, which nests
in or lies apart from every other. The same holds of paths behind one rule's host. A sweep
over keys in order meets starts, keys and ends; the rules active at a key are a stack.

The sweep is made of windows: the running sum of starts less ends is the height of the
stack, and the rule at height k is the last start that was put at height k. Keys are dealt
out in ranges, and a rule goes to each range that it reaches into, so every range is swept
by itself. Only distinct keys are swept, so a host, path or URL that many rows share weighs
nothing there; the rows get the results by an equi-join that the adaptive skew join splits.

Two sweeps: over hosts, giving each host the nested rule hosts around it, then over paths
behind each of these, giving the longest path rule. The longest of all wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands between the first :// and /, ? or #, A-Z lower-cased, and from
    there up to ? or #. Both are empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """org.example.www. for www.example.org, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def sweep(keys: DataFrame, rules: DataFrame, whole_stack: bool = False) -> DataFrame:
    """Rows (key, rule): the longest of the rules (start, rule) whose start the key begins with,
    or with whole_stack a row for each of them. keys (key) and starts are distinct bytes; keys
    without a rule give no row.

    A rule's end is its start followed by the byte FF, which no UTF-8 text holds: it comes
    behind all that begins with start, and behind the ends of all rules nested in it.
    """
    spark = keys.sparkSession
    dealt = staged(keys.repartitionByRange(shuffle_partitions(spark), "key").select("key", F.spark_partition_id().alias("range")), "url_keys")
    ranges = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()  # a row a partition
    start, end = F.col("start"), F.concat("start", F.lit(b"\xff"))
    reached = [F.struct(F.lit(r.range).alias("range"), F.lit(bytes(r.first)).alias("first"), F.lit(bytes(r.last)).alias("last")) for r in ranges]
    if not reached:
        return dealt.select("key", F.lit(None).cast(rules.schema["rule"].dataType).alias("rule"))
    there = F.filter(F.array(*reached), lambda r: (r["first"] <= end) & (r["last"] >= start))
    copies = rules.select(F.explode(F.transform(there, lambda r: r["range"])).alias("range"), start, end.alias("end"), "rule")

    none = F.lit(None).cast(rules.schema["rule"].dataType).alias("rule")
    events = (
        copies.select("range", F.col("start").alias("key"), F.lit(0).alias("kind"), "rule")
        .unionByName(dealt.select("range", "key", F.lit(1).alias("kind"), none))
        .unionByName(copies.select("range", F.col("end").alias("key"), F.lit(2).alias("kind"), none))
    )
    so_far = W.rowsBetween(W.unboundedPreceding, W.currentRow)
    height = F.sum(F.lit(1) - F.col("kind")).over(so_far.partitionBy("range").orderBy("key", "kind"))
    met = events.withColumn("height", height).where("kind < 2 and height > 0")
    if whole_stack:
        levels = F.when(F.col("kind") == 1, F.sequence(F.lit(1).cast("long"), F.col("height"))).otherwise(F.array("height"))
        met = met.withColumn("height", F.explode(levels))
    rule = F.last("rule", ignorenulls=True).over(so_far.partitionBy("range", "height").orderBy("key", "kind"))
    return met.select("key", "kind", rule.alias("rule")).where("kind = 1").select("key", "rule")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row (page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    rules has (host, path, verdict). A rule fits its host and all subdomains if the path of the
    url starts with the rule's; of those that fit the longest text host + path decides, of equal
    ones that of the longer host. rule is that text. Where none fits, rule is null and the verdict
    is default: what no rule names is let through.

    Null urls and ones without :// have an empty host and path. Null and repeated page_ids stay,
    one row each; other columns of pages are ignored. A rule's host is lower-cased (A-Z); its null
    path is an empty one, which fits every path; rules without host or verdict are ignored. Of
    repeated rules with unlike verdicts block counts.
    """
    pages = pages.select("page_id", *(c.alias(n) for c, n in zip(split_url(F.col("url")), ("host", "path"))))
    rules = rules.where("host is not null and verdict is not null").select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block follows allow
    rules = staged(rules.select(host_key(F.col("host")).alias("rule_host"), F.length("host").alias("host_length"), F.concat("host", "path").alias("text"), "path", "verdict"), "url_rules")

    hosts = pages.select("host").distinct().select(host_key(F.col("host")).alias("key"))
    around = sweep(hosts, rules.select(F.col("rule_host").alias("start"), F.col("rule_host").alias("rule")).distinct(), whole_stack=True)
    around = staged(around.select(F.col("key").alias("host_key"), F.col("rule").alias("rule_host")), "url_hosts")

    urls = pages.select("host", "path").distinct().withColumn("host_key", host_key(F.col("host")))
    urls = staged(urls.join(around, "host_key").select("host", "path", F.concat("rule_host", F.col("path").cast("binary")).alias("key")), "url_paths")
    named = F.struct(F.length("text").alias("length"), "host_length", "text", "verdict").alias("rule")
    fits = sweep(urls.select("key").distinct(), rules.select(F.concat("rule_host", F.col("path").cast("binary")).alias("start"), named))
    best = urls.join(fits, "key").groupBy("host", "path").agg(F.max("rule").alias("rule"))
    verdict = F.coalesce("rule.verdict", F.lit(default)).alias("verdict")
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("rule.text").alias("rule"), verdict)
