"""Allow and block rules for URLs by a range join on reversed hosts.

A rule's canonical key is its host's labels in reverse, a slash, and its path: all
URLs the rule fits at that host depth have keys in one interval, those that start with
the rule's key.  Intervals of rules are nested or apart.  Rules and URL keys are range
partitioned by key and swept in order; what a sweep hands on is the stack of rules
enclosing the last rule seen, and the deepest one that still holds the URL wins.  The
stack left at the end of a range is carried into the next ones, so a host with any
share of all URLs may be spread over many ranges.

A URL takes part once per host depth for which rules exist (a rule for ``net`` is at
depth 1, one for ``example.net`` at depth 2), so its key count is bounded by the rules,
not by the URL.  The longest rule (host and path) over all depths decides.

Cases: a missing URL or one without ``://`` has an empty host and path and fits no
rule; repeated rows are judged one by one; of rules with the same host and path the
blocking one holds; without rules every URL gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.llm.columns import ascii_lower
from basketlens.session import durable


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with key, depth and their enclosing rules.

    ``stack`` lists the rule and those around it (its key's prefixes that are keys
    themselves), shortest first.
    """
    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    named = known.select(
        F.concat(F.array_join(_labels(F.col("host")), "."), F.lit("/"), "path").alias("key"),
        F.size(_labels(F.col("host"))).alias("depth"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    prefixes = named.select(
        F.col("key").alias("inner"),
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
        ).alias("key"),
    )
    around = prefixes.join(named, "key").groupBy("inner").agg(
        F.sort_array(F.collect_list(F.struct(F.length("key").alias("n"), "key", "rule", "verdict"))).alias("stack")
    )
    return named.select("key", "depth").join(around, F.col("key") == F.col("inner")).drop("inner")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``key``, host, path, rule and verdict for every row of ``pages``."""
    parsed = durable(
        pages.select(
            F.col(key).alias("id"),
            url_host(F.col(url)).alias("host"),
            url_path(F.col(url)).alias("path"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    ruled = durable(rule_table(rules))
    # the depths of host names in use, a handful of small numbers
    depths = [r[0] for r in ruled.select("depth").distinct().orderBy("depth").collect()]
    reach = F.array(*[F.lit(d) for d in depths]).cast("array<int>")
    points = parsed.withColumn("labels", _labels(F.col("host"))).select(
        "row",
        F.explode(F.filter(reach, lambda d: d <= F.size("labels"))).alias("d"),
        "labels",
        "path",
    )
    points = points.select(
        F.concat(F.array_join(F.slice("labels", 1, F.col("d")), "."), F.lit("/"), "path").alias("key"),
        F.col("row"),
        F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack"),
    )
    starts = ruled.select("key", F.lit(-1).cast("long").alias("row"), "stack")
    # written, so that both uses below see the same ranges
    ranged = durable(
        points.unionByName(starts)
        .repartitionByRange("key", "row")
        .withColumn("range", F.spark_partition_id())
    )
    # a row per range: the last rule that starts there
    ends = ranged.groupBy("range").agg(
        F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("end")
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = (
        ranged.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep))
        .where("row >= 0")
        .join(carried, "range")
    )
    holding = F.filter(
        F.coalesce("seen", "carried"), lambda r: F.col("key").startswith(r["key"])
    )
    fits = swept.select("row", F.get(holding, F.size(holding) - 1).alias("fit")).where("fit is not null")
    best = fits.groupBy("row").agg(
        F.max_by("fit", F.struct(F.length("fit.rule"), F.col("fit.key"))).alias("fit")
    )
    return parsed.join(best, "row", "left").select(
        F.col("id").alias(key),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.lit(default)).alias("verdict"),
    )
