"""URL rules by a sort-merge range join, with DataFrame functions only.

A host's canonical key is its labels in reverse order, each ended by a dot (``com.example.``), so
a rule's host and all of its subdomains are one interval of the sorted keys: those that begin
with the rule's key. Such intervals are nested or disjoint.

Rules and urls are sorted together by that key and swept once. The sweep holds the stack of
rule hosts passed last, one place for each number of labels. A rule host takes its place in
the stack; the places above it, and any that the sweep has left, are no prefix of the key at hand
and thereby popped. At a url the active places are the rule hosts around it, outermost first,
each with its path rules from the shortest to the longest; the last of these that the path
begins with is the url's rule.

Urls are dealt to the sweeps evenly, by a hash of their row and not by host, so a host with a
third of all urls is swept by many tasks. Every sweep gets all rules: a quarter as many rows as it
has urls, at most. Each url is moved once, and pages are not moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Urls of one sweep, at least and on average; four times the rules, if these are more.
PART_ROWS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels in reverse order, each ended by a dot: ``www.example.com`` gives ``com.example.www.``."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def rule_hosts(rules: DataFrame) -> DataFrame:
    """(key, labels, held) of each rule host; held is its paths and verdicts, the shortest path first.

    ``rules`` has host, path and verdict; of rules with one host and path, the smaller verdict counts.
    """
    own = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    held = F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "path", "verdict")))
    return own.groupBy("host").agg(held.alias("held")).select("host", host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), "held")


def judge_urls(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", part_rows: int = PART_ROWS) -> DataFrame:
    """Every row of ``urls`` as a struct ``row``, with ``host``, ``path``, ``rule`` (host and path of the
    longest rule that fits: more host labels, then the longer path; else null) and ``verdict``.

    A url that is null or has no :// has an empty host and path and fits no rule but those of the
    empty host. Urls of any length are read whole. Equal urls are judged once each; empty tables give
    no rows, and no rules let each url have the default. Columns of any name stay inside ``row``.
    """
    hosts = rule_hosts(rules)
    n_rules, depth = hosts.agg(F.sum(F.size("held")), F.max("labels")).first()
    parts = max(1, math.ceil(urls.count() / max(part_rows, 4 * (n_rules or 0))))
    address = F.col(f"`{url}`").cast("string")
    urls_side = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), url_host(address).alias("host"), url_path(address).alias("path")).select(
        # a place in the input, dealt at random
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part"),
        F.coalesce(host_key(F.col("host")), F.lit(".")).alias("key"),
        F.lit(1).alias("kind"),
        "row",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.lit(None).cast("int").alias("labels"),
        F.lit(None).cast(hosts.schema["held"].dataType).alias("held"),
    )
    rules_side = hosts.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
        "key",
        F.lit(0).alias("kind"),
        F.lit(None).cast(urls_side.schema["row"].dataType).alias("row"),
        "host",
        F.lit("").alias("path"),
        "labels",
        "held",
    )
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    place = lambda d: F.last(F.when(F.col("labels") == d, F.struct("key", "host", "held")), ignorenulls=True).over(sweep)
    stack = F.array(*[place(d) for d in range(1, (depth or 0) + 1)]) if depth else F.array(F.lit(None).cast("struct<key:string,host:string,held:array<struct<n:int,path:string,verdict:string>>>"))
    swept = urls_side.unionByName(rules_side).withColumn("stack", stack).where("kind = 1")
    fits = "filter(s.held, r -> startswith(path, r.path))"
    rule = F.expr(f"try_element_at(flatten(transform(filter(stack, s -> startswith(key, s.key)), s -> transform({fits}, r -> struct(concat(s.host, r.path) as text, r.verdict as verdict)))), -1)")
    return swept.withColumn("best", rule).select("row", "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
