"""URL filters by a sort-merge range join; DataFrame functions only.

Hosts are turned round ("blog.example.net" -> "net.example.blog."), so that a rule for a host and all its
subdomains is the interval [net.example. , net.example/) of sorted keys. The borders of these intervals cut the
key line into stretches, and each border carries the stack of rules that are active from there on: the rules of
a host and of the hosts it lies under. One sorted sweep over borders and urls then gives each url the stack of
its stretch; the longest rule of the stack whose path the url's path starts with decides.

The sweep is a window over key ranges. Range cuts come from a sample of the keys and only balance the work: a
range begins with the stack that is active at its lower cut. A host that holds a third of all urls is one key;
its rows, like all rows, are dealt to SALTS sweeps of the same range, each of which sees all borders.

A null url, or one without "://", has an empty host and path, which no rule fits. Host rules must be lower case
and without a leading dot. Repeated rows give repeated results; an empty table an empty one. Of rules with the
same text the smaller verdict in alphabetical order ("allow") counts. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import LOWER, UPPER

SALTS = 16
RANGES = 64


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = _rest(url)
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substr(rest, F.length(host) + 1)
    return F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, or the empty string."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _borders(rules: DataFrame) -> DataFrame:
    """(key, stack): from each key on, the rules that are active until the next one."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = rules.withColumn("key", host_key(F.col("host"))).groupBy("key").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    # The hosts above a host are the proper prefixes of its key, at most as many as it has labels.
    labels = F.split(F.regexp_replace("key", r"\.$", ""), r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("top"))
    joined = above.join(own.select(F.col("key").alias("top"), "own"), "top")
    full = joined.groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("top") != F.col("key"), F.col("own")))).alias("under"))
    begin = full.select("key", "stack")
    # '/' follows '.', so key without its last dot, then '/', is the first string after all that start with the key.
    end = full.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.col("under").alias("stack"))
    return begin.unionByName(end)


def url_filter(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", salts: int = SALTS, ranges: int = RANGES) -> DataFrame:
    """pages(page_id, url, ...), rules(host, path, verdict) -> page_id, host, path, rule, verdict."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    borders = _borders(rules.where(F.col("host") != ""))
    # At most ranges - 1 cuts: keys drawn by their hash from the distinct keys of the urls.
    drawn = urls.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(ranges - 1).collect()
    edges = F.array(F.lit(""), *[F.lit(k) for k in sorted(r[0] for r in drawn)])
    number = (F.size(F.filter(edges, lambda e: e <= F.col("key"))) - 1).alias("range")
    borders = borders.select("key", "stack", number)
    # The stack at the start of a range is the last one of the ranges before it: a window over `ranges` rows.
    line = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    numbers = pages.sparkSession.range(len(drawn) + 1).select(F.col("id").cast("int").alias("range"))
    ends = numbers.join(borders.groupBy("range").agg(F.max_by("stack", "key").alias("stack")), "range", "left")
    opening = ends.select(F.lit(None).cast("string").alias("key"), F.last("stack", True).over(line).alias("stack"), "range")
    stacks = borders.unionByName(opening).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = urls.select("*", number, F.pmod(F.xxhash64("page_id", "path", "host"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("is_url"))
    both = dealt.unionByName(stacks.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("range", "salt").orderBy(F.col("key").asc_nulls_first(), "is_url")
    swept = both.withColumn("active", F.last("stack", True).over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fitting = F.filter(F.col("active"), lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(F.concat(r["host"], r["path"])).alias("n"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return (
        swept.where("is_url = 1")
        .withColumn("best", longest)
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    )
