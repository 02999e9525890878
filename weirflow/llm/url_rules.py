"""URL filters as a sort-merge range join over reversed-host keys, in DataFrame functions only.

A rule names a host and the beginning of a path and holds for the host and all its subdomains.
A canonical key is a host's labels in reverse order, each closed by a full stop, as bytes.  So a
rule's host is an interval of keys: from its own key to that key and a byte 0xFF, which no text
holds.  The intervals nest or are apart.  URLs and interval ends are sorted together, and a sorted
sweep keeps the stack of active hosts: each end of an interval brings the stack that holds from
there on.  A second sweep does the same with paths: the URLs of each host on the stack meet that
host's intervals of paths, and the innermost active one is the longest rule of that host.  The
longest of all wins.

A URL has one key in the first sweep, however many labels its host has, and one for each active
host in the second.  Keys and interval ends are dealt by ranges, of which a URL's other half is the last part, so one
host or path may be spread over several; each range starts with the state at the end of the ranges before it.
The tables of the two sweeps are written to the shared folder.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule
fits; rules of equal length: the one with the longer host, then the last by text; of two rules
with the same host and path, block; without rules every URL has the default; repeated rows are
judged alike; an empty table gives an empty result; hosts and paths may have any length, and a
host may have empty labels; other columns than the URL and those kept are not read, and kept
columns may have any name but host, path, rule and verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Table, scratch, written

#: Above all bytes of a text.
LAST = b"\xff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: Column) -> Column:
    """A host's labels in reverse order, each closed by a full stop, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def rule_events(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interval ends of ``rules`` (host, path, verdict) with the state that holds from there on.

    For hosts: (edge, kind, state: the stack of active hosts).  For paths: (rule_host, edge, kind,
    state: the innermost active rule, or none).  Rules of one host and path are one.
    """
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of the two words "block" is the larger
    own = own.withColumn("rule", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict"))
    hosts = own.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    around = hosts.select("host", F.explode(suffixes).alias("outer")).join(hosts.select(F.col("host").alias("outer")), "outer")
    stacks = around.groupBy("host").agg(F.collect_list("outer").alias("stack"))
    host_events = _edges(stacks, canonical(F.col("host")), F.col("stack"), F.array_remove("stack", F.col("host")))
    # the rule around a rule: the longest of the host's paths that its own begins with
    sizes = own.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))
    shorter = F.filter("sizes", lambda n: n < F.length("path"))
    outer = own.select("host", F.col("path").alias("begin"), F.col("rule").alias("outer"))
    begins = own.join(sizes, "host").select("host", "path", F.explode(shorter).alias("n")).select("host", "path", F.left("path", F.col("n")).alias("begin"))
    around = begins.join(outer, ["host", "begin"]).groupBy("host", "path").agg(F.max("outer").alias("outer"))
    path_events = _edges(own.join(around, ["host", "path"], "left"), F.col("path").cast("binary"), F.col("rule"), F.col("outer"), F.col("host").alias("rule_host"))
    return host_events, path_events


def _edges(intervals: DataFrame, start: Column, within: Column, after: Column, *keep: Column) -> DataFrame:
    """Two rows for each interval; at one edge, ends (kind 0) come before starts (1) and those before keys (2)."""
    end = F.concat(start, F.lit(LAST))
    starts = intervals.select(*keep, start.alias("edge"), F.lit(1).alias("kind"), F.struct(within.alias("top")).alias("state"))
    return starts.unionByName(intervals.select(*keep, end.alias("edge"), F.lit(0).alias("kind"), F.struct(after.alias("top")).alias("state")))


def swept(keys: DataFrame, events: DataFrame, order: tuple[str, ...]) -> Table:
    """``keys`` and ``events`` by ranges of ``order``: adds _part, the number of the range."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = keys.withColumn("kind", F.lit(2)).unionByName(events, allowMissingColumns=True)
    return written(both.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "swept")


def active(placed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The keys of ``swept`` with active: the state of the last event before them.

    What a range starts with is found among one row for each range.
    """
    last = placed.groupBy("_part").agg(F.max_by(F.when(F.col("state").isNotNull(), F.col("state")), F.when(F.col("state").isNotNull(), F.struct(*order))).alias("_state"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("_part", F.last("_state", ignorenulls=True).over(before).alias("_carried"))
    sweep = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    state = F.coalesce(F.last("state", ignorenulls=True).over(sweep), F.col("_carried"))
    return placed.join(carried, "_part").withColumn("active", state["top"]).where(F.col("kind") == 2).drop("state", "kind", "_part", "_carried")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has the columns host, path and verdict ('allow' or 'block').  Distinct URLs are
    judged once.
    """
    host, path = host_and_path(F.col(url))
    read = pages.select(*keep, host.alias("host"), path.alias("path"))
    host_events, path_events = rule_events(rules)
    with scratch() as keep_table:
        urls = read.select("host", "path").where(F.col("host") != "").distinct().withColumn("edge", canonical(F.col("host")))
        order = ("edge", "kind", "path")
        hosts = active(swept(urls, host_events, order).frame, order)
        met = hosts.select("host", F.explode("active").alias("rule_host"), F.col("path").cast("binary").alias("edge"))
        order = ("rule_host", "edge", "kind", "host")
        paths = swept(met, path_events, order)
        keep_table(paths)
    best = active(paths.frame, order).where(F.col("active").isNotNull())
    best = best.groupBy(F.col("host").alias("_host"), F.col("edge").cast("string").alias("_path")).agg(F.max("active").alias("best"))
    # both sides grow with the input: neither is to be broadcast, however small a run finds it
    out = read.join(best.hint("merge"), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
