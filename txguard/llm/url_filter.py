"""URL filters: sort-merge range join of urls with host and path rules.

A rule ``(host, path, verdict)`` fits its host and all subdomains when the
url's path starts with the rule's.  Written as *reversed host labels* + ``/`` +
*path*, each rule is a key prefix, that is an interval of the sorted keys, and
intervals of two rules are nested or apart.  A url probes once per suffix of
its host, so subdomains need no wider intervals.

The sweep sorts rules and probes together.  The rule that started last before
a probe carries the stack of rules nested around it (its chain of prefixes);
every rule active at the probe is in that stack, so the deepest one that is a
prefix of the probe's key is the answer.  Range partitions are swept side by
side; the last stack of each partition is handed to the next ones, one row per
partition.

DataFrame functions only.  Distinct urls are swept, so a url that fills a third
of the table is one probe; the join that brings verdicts back to the rows is a
plain equi-join that adaptive execution can split.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _rule_chains(rules: DataFrame) -> DataFrame:
    """One row per rule key with its stack: itself and the rules whose keys are prefixes, deepest first."""
    rules = (rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .filter("host is not null and verdict is not null")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))     # 'block' beats 'allow'
             .withColumn("base", F.concat(F.array_join(_labels(F.col("host")), "."), F.lit("/")))
             .withColumn("key", F.concat("base", "path")))
    entry = F.struct("key", F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "verdict")
    outer = rules.select(F.col("key").alias("outer_key"), entry.alias("entry"))
    up = rules.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")),
                                                   lambda i: F.concat("base", F.substring("path", F.lit(1), i)))
                                       ).alias("outer_key"))
    return (up.join(outer, "outer_key").groupBy("key")
            .agg(F.collect_list(F.struct(F.length("outer_key").alias("n"), "entry")).alias("s"))
            .select("key", F.transform(F.sort_array("s", asc=False), lambda x: x["entry"]).alias("stack")))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of the longest fitting rule per page: ``id, host, path, rule, verdict``.

    Host and path are empty for a null url or one without ``://``; no rule fits
    an empty host.  Longest means host plus path; equal lengths: the longer
    host.  A rule given twice: block wins.  Without a fitting rule ``rule`` is
    null and the verdict is ``default``.  Null and repeated ids stay as they
    are: rows are matched by host and path, never by id.  Other columns of
    ``pages`` are not read.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "url-filter")
    rows = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    urls = rows.select("host", "path").distinct().filter("host <> ''")
    labels = _labels(F.col("host"))
    probe = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("/"), F.col("path")))
    chains = _rule_chains(rules)
    stack_type = chains.schema["stack"].dataType
    events = (urls.select(F.explode(probe).alias("key"), F.lit(1).alias("kind"), "host", "path",
                          F.lit(None).cast(stack_type).alias("stack"))
              .unionByName(chains.withColumn("kind", F.lit(0)), allowMissingColumns=True))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal keys of many hosts (``com//``) spread by host; rules sort before the probes they start at
    ranged = scratch.write(events.repartitionByRange(n, "key", "kind", "host").withColumn("part", F.spark_partition_id()))
    last = (ranged.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last")))
    parts = ranged.select("part").distinct().join(last, "part", "left")
    carried = (parts.select("part", F.last("last", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("stack"))
        .filter("stack is not null").withColumns({"kind": F.lit(-1), "key": F.lit("")}))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.filter("active", lambda r: F.startswith(F.col("key"), r["key"]))
    hits = (ranged.unionByName(carried, allowMissingColumns=True)
            .withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
            .filter("kind = 1 and active is not null")
            .withColumn("hit", F.get(active, F.lit(0))).filter("hit is not null"))
    best = (hits.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("hit.rule").alias("n"), "hit.host_len", "hit.verdict", "hit.rule")).alias("b"))
            .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict")))
    return (rows.join(best, ["host", "path"], "left")
            .select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
